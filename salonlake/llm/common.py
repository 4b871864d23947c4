"""Shared pieces of the training-data operators: row keys, staged tables in the
shared checkpoint folder, ASCII word splitting and hashing of words in bulk.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from salonlake.session import ensure_checkpoint_dir

#: Rows of one Arrow batch and bytes of one Arrow batch handed to Python.
BATCH_ROWS, BATCH_BYTES = 2000, 32 << 20

_U64 = np.uint64


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ready(spark: SparkSession) -> None:
    """Before Python code runs on executors: they get this package (sent once
    by Spark), and Arrow batches stay small whatever the length of the texts."""
    sc = spark.sparkContext
    if not getattr(sc, "_salonlake_sent", False):
        top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        if os.path.isdir(os.path.join(top, "salonlake")):  # else it came as an archive itself
            sc.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(), "salonlake"), "zip", top, "salonlake"))
        sc._salonlake_sent = True
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def staged(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet into the shared folder that
    ``spark.checkpoint.dir`` names, and read back: cuts the lineage, survives
    lost executors, and is read by every later step with pruned columns."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/staged-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    # Spark deletes a finished job's shuffle files only after the driver's JVM
    # has collected its plan; at scale they would fill the executors' disks.
    spark.sparkContext._jvm.System.gc()
    table = spark.read.schema(df.schema).parquet(path)
    table._staged_at = path
    return table


def discard(table: DataFrame) -> None:
    """Deletes a table that ``staged`` returned and that nothing reads any
    more, since all that was made of it has been staged itself."""
    path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._staged_at)
    path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def keyed(docs: DataFrame, id_col: str, *cols: str) -> DataFrame:
    """``cols`` of ``docs`` with a unique, non-null long ``_k``.

    Distinct non-null integer ids serve as keys themselves. Otherwise
    (repeated rows, null ids) the rows are staged with a generated key, so each
    row stays a document of its own and the key never changes on a retry.
    """
    cols = (id_col, *cols)
    if docs.schema[id_col].dataType.typeName() in ("long", "integer", "short", "byte"):
        odd = (docs.groupBy(F.col(id_col).cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"))
               .filter("n > 1 or k is null").limit(1).count())
        if not odd:
            return docs.select(F.col(id_col).cast("long").alias("_k"), *cols)
    return staged(docs.select(F.monotonically_increasing_id().alias("_k"), *cols))


def chunked(docs: DataFrame, bits: int, *cols: Column | str) -> DataFrame:
    """``cols`` of ``docs`` with ``_c``, which names a row's chunk: 2**``bits``
    rows that follow each other in a file. It depends on the row's place in its
    file alone, so every pass sees the same chunks however a scan is cut into
    tasks (a task may see a part of a chunk). What is no scan is staged first."""
    chunk = F.xxhash64("_metadata.file_path", F.shiftright("_metadata.row_index", bits)).alias("_c")
    try:
        return docs.select(chunk, *cols)
    except AnalysisException:  # rows without a file
        return staged(docs).select(chunk, *cols)


def stretches(ids: np.ndarray) -> Iterator[tuple[int, int]]:
    """[start, end) ranges of equal neighbours."""
    edges = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
    return ((a, b) for a, b in zip(edges, edges[1:]) if a < b)


def wrapped(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns under names that no operator uses."""
    return docs.withColumnsRenamed({c: f"_doc_{c}" for c in docs.columns})


def unwrapped(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` in ``df``, which came from ``wrapped(docs)``."""
    return df.select(*(F.col(f"_doc_{c}").alias(c) for c in docs.columns))


def held_out(id_col: str, mod: int, rest: int) -> Column:
    """crc32 of the id as text, modulo ``mod``, equals ``rest`` (a null id: no)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % mod == rest, F.lit(False))


def text_bytes(col: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [v or b"" for v in col.cast(pa.large_binary()).to_pylist()]


def slices(values: list[bytes], most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """[start, end) ranges of about ``most`` bytes: bounds what numpy holds at once."""
    start, size = 0, 0
    for i, v in enumerate(values):
        if size and size + len(v) > most:
            yield start, i
            start, size = i, 0
        size += len(v)
    if start < len(values):
        yield start, len(values)


class WordHash(dict):
    """word -> 64-bit hash, computed once per distinct word; emptied when large."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.LIMIT:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), _U64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Final avalanche of 64-bit values."""
    h = (h ^ (h >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U64(27))) * _U64(0x94D049BB133111EB)
    return h ^ (h >> _U64(31))


def window_hash(words: np.ndarray, k: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of each run of k word hashes (empty if there are fewer than k)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, _U64)
    h, b, done = np.zeros(n, _U64), _U64(base), 0
    powers, spans = words, 1  # powers[i]: polynomial of words[i:i+spans]
    bp = b
    while True:  # binary decomposition of k: log2(k) passes
        if k >> (spans.bit_length() - 1) & 1:
            scale = _U64(pow(int(b), spans, 1 << 64))
            h = h * scale + powers[done:done + n]
            done += spans
        if done >= k:
            return mix(h)
        powers = powers[:-spans] * bp + powers[spans:]
        bp = _U64(int(bp) ** 2 & 0xFFFFFFFFFFFFFFFF)
        spans *= 2


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
