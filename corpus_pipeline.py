"""The training-data pipeline: documents through the stages in order.

Every stage takes the documents its predecessor kept, whatever columns they
have, and all but the last return the same columns; ``n_chars``, where there is
one, follows the text. The result is a packing: one row for each piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from salonlake.llm import common, decontam, jaccard, packing, pii, quality


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return quality.good(docs, quality.learnt(spark, docs, sf_dir))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of least doc_id."""
    return jaccard.one_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans that also occur in the benchmark are cut; documents that are
    mostly benchmark go."""
    return _measured(decontam.decontaminate(docs, common.documents(spark, sf_dir, "benchmark")))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return _measured(pii.redacted(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of at most 2048 ids."""
    return packing.packed(docs)


STAGES = [("quality_classifier", good), ("ngram_jaccard_join", distinct), ("benchmark_decontamination", decontaminated),
          ("pii", private), ("packing", packed)]
#: SQL can express neither the classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared
    folder and read again as the next stage's documents."""
    docs = common.documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
