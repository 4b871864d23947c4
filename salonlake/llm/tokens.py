"""Token ids of texts, flat token files, and document token counts by separator scan.

``write_tokens`` lays the ids of all documents end to end in flat files of
little-endian 16-bit ids, an end-of-document id after each document, with no
index beside them. ``scan`` reads such files as Spark splits them up, searches
every block for the end id with one vectorised comparison, and stitches
documents that run across blocks: each block reports its whole documents, the
ids before its first end and after its last, and a prefix scan over the blocks
of a file carries open lengths and ordinals from block to block.

Defined results: a null or empty text has no tokens; null ids and repeated rows
are documents of their own; an empty table has no files and no counts; the end
id inside a text cannot occur, its string is ordinary text there.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from salonlake.session import ensure_checkpoint_dir

from . import common

END_ID = 50256
#: Ids of one block of the scan.
BLOCK = 1 << 16


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: How byte-level BPE shows bytes: printable Latin-1 as itself, the rest from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Fixed value: the pretoken pattern of this family of vocabularies.
_PRETOKEN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Coder:
    """Byte-level BPE ids of texts as little-endian 32-bit bytes, equal to those
    of the ``tokenizers`` file at ``path`` (whose ids are in merge order)."""

    def __init__(self, path: str, special_as_text: bool = False):
        import tiktoken
        from tokenizers import Tokenizer

        self._exact = Tokenizer.from_file(path)
        self._exact.encode_special_tokens = special_as_text
        special = {t.content for t in self._exact.get_added_tokens_decoder().values()}
        others = (c for c in range(256) if c not in set(_PRINTED))
        shown = {chr(c): c for c in _PRINTED} | {chr(256 + i): c for i, c in enumerate(others)}
        ranks = {bytes(map(shown.__getitem__, t)): i for t, i in self._exact.get_vocab(False).items() if t not in special}
        self._fast = tiktoken.Encoding("chunks", pat_str=_PRETOKEN, mergeable_ranks=ranks, special_tokens={})
        self._special = () if special_as_text else tuple(special)

    def encode(self, text: str) -> bytes:
        if not any(x in text for x in self._special):
            try:
                return self._fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
            except ValueError:  # its pattern gives up on very long runs of blanks
                pass
        return np.array(self._exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@cache
def coder(path: str, special_as_text: bool = False) -> Coder:
    """One coder for each worker process and file."""
    return Coder(path, special_as_text)


def write_tokens(docs: DataFrame, path: str, text_col: str = "text", tokenizer: str | None = None,
                 docs_per_file: int = 4000) -> None:
    """The ids of ``docs`` in row order as flat files under ``path``, one run of
    files for each partition. The end id is what Spark's text writer puts after
    every row."""
    common.ready(docs.sparkSession)
    name = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = coder(name, True)
        for batch in batches:
            ids = [np.frombuffer(made.encode(t or ""), "<u4").astype("<u2").tobytes() for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], names=["ids"])

    end = END_ID.to_bytes(2, "little").decode("latin-1")
    flat = docs.select(F.col(text_col).alias("t")).mapInArrow(run, "ids binary").select(F.col("ids").cast("string"))
    flat.write.option("encoding", "ISO-8859-1").option("lineSep", end).option("maxRecordsPerFile", docs_per_file).text(path)


def blocks(spark: SparkSession, path: str, end_id: int = END_ID, block: int = BLOCK) -> DataFrame:
    """(part, file, block, n, ends): of each block of the flat files its ids
    and the places of the end ids in it."""
    common.ready(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, file, content in zip(*(batch.column(c).to_pylist() for c in ("part", "file", "content"))):
                ids = np.frombuffer(content, "<u2")
                at = np.flatnonzero(ids == end_id)
                starts = np.arange(0, len(ids), block)
                cut = np.searchsorted(at, np.append(starts, len(ids)))
                ends = [at[a:b] - s for a, b, s in zip(cut, cut[1:], starts)]
                if len(starts):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part] * len(starts), pa.int32()), pa.array([file] * len(starts), pa.int32()),
                         pa.array(np.arange(len(starts)), pa.int64()), pa.array(np.diff(np.append(starts, len(ids)))),
                         pa.array(ends, pa.list_(pa.int64()))], names=["part", "file", "block", "n", "ends"])

    name = F.regexp_extract("path", r"part-(\d+)-.*?(?:-c(\d+))?\.[^/]*$", 1)
    piece = F.regexp_extract("path", r"part-(\d+)-.*?(?:-c(\d+))?\.[^/]*$", 2)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    files = files.select(name.cast("int").alias("part"), F.coalesce(piece.try_cast("int"), F.lit(0)).alias("file"), "content")
    return files.mapInArrow(run, "part int, file int, block long, n long, ends array<bigint>")


def scan(spark: SparkSession, path: str, end_id: int = END_ID, block: int = BLOCK) -> DataFrame:
    """(part, ordinal, n_tokens) of every document in the flat files, in file
    order; ids after the last end id are a last, unfinished document."""
    before = Window.partitionBy("part").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("part").orderBy(F.desc("file"), F.desc("block"))
    found = blocks(spark, path, end_id, block).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    found = found.withColumn("_last", F.when(F.size("ends") > 0, F.col("start") + F.element_at("ends", -1)))
    found = (found.withColumn("ordinal", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)))
             .withColumn("open", F.coalesce(F.max("_last").over(before), F.lit(-1)))  # place of the end id before
             .withColumn("final", F.row_number().over(upto) == 1))
    ends = F.transform("ends", lambda e: e + F.col("start"))
    tail = F.col("start") + F.col("n")
    ends = F.when(F.col("final") & (F.coalesce("_last", "open") < tail - 1), F.concat(ends, F.array(tail))).otherwise(ends)
    each = found.select("part", "ordinal", F.concat(F.array("open"), ends).alias("ends")).select(
        "part", "ordinal", F.posexplode(F.zip_with(F.slice("ends", 2, F.size("ends")), F.slice("ends", 1, F.size("ends") - 1),
                                                   lambda b, a: b - a - 1)).alias("i", "n_tokens"))
    return each.select("part", (F.col("ordinal") + F.col("i")).alias("ordinal"), "n_tokens")


def counted(docs: DataFrame, text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """The columns of ``docs`` but its text, with n_tokens, by writing token
    files and scanning them. ``docs`` must give the same rows in the same
    partitions when read again (a scan or a staged table); the numbers of rows
    and end ids of every partition are compared, and a difference is an error."""
    spark = docs.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, text_col, tokenizer)
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rest = [c for c in docs.columns if c != text_col]
    listed = docs.select(*(F.col(c).alias(f"_in_{c}") for c in rest), F.spark_partition_id().alias("part"), within.alias("ordinal"))
    paired = F.col("n_tokens").isNotNull() & F.col("_row").isNotNull()
    both = listed.withColumn("_row", F.lit(True)).join(scan(spark, path), ["part", "ordinal"], "full").withColumn(
        "n_tokens", F.when(paired, F.col("n_tokens")).otherwise(F.raise_error(F.lit("documents and token files differ")).cast("long")))
    return both.select(*(F.col(f"_in_{c}").alias(c) for c in rest), "n_tokens")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(common.documents(spark, sf_dir).select("doc_id", "text"))
