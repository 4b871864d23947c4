"""Change-request source: JSON bodies -> typed change rows.

Malformed lines are kept (PERMISSIVE) with the raw text in
``_corrupt_record`` so they can be counted as rejects, never dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from salonlake.schemas import CHANGES

CORRUPT = "_corrupt_record"


def _schema(entity: str) -> T.StructType:
    return T.StructType(CHANGES[entity].fields + [T.StructField(CORRUPT, T.StringType(), True)])


def read_changes(spark: SparkSession, path: str, entity: str) -> DataFrame:
    return (spark.read.schema(_schema(entity)).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT).json(path))


def stream_changes(spark: SparkSession, path: str, entity: str,
                   max_files_per_trigger: int | None = None) -> DataFrame:
    r = (spark.readStream.schema(_schema(entity)).option("mode", "PERMISSIVE")
         .option("columnNameOfCorruptRecord", CORRUPT))
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.json(path)
