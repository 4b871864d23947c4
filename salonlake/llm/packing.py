"""Packing of tokenised documents into windows by Karmarkar-Karp differencing.

A document's ids are cut at every multiple of the window; whole windows stand
alone. What is left of each document is cut once more, at a multiple of
``GRAIN``, so that every group has many small pieces to level the sums with.
Multiway differencing then packs the pieces: each starts as a partial partition
with one filled window; the two partitions with the largest imbalance are
merged, the fullest windows of one onto the emptiest of the other, until one is
left with near-equal windows. If one holds more than the capacity, the window
count rises and the group is packed anew.

Groups are dealt by a hash of document and place, about ``GROUP`` pieces each,
so no source or long document meets in one task, and padding does not depend on
the size of the corpus.

Defined results: a null text is empty (its one id is the end id); null ids and
repeated rows are documents of their own; an empty table packs to no pieces.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common, tokens

WINDOW, GRAIN, GROUP = 2048, 256, 1500
#: The end id, little-endian, that closes every document.
END = (1).to_bytes(4, "little")
ADDED = ("start", "length", "ids_crc32", "doc_tokens")


def differencing(sizes: list[int], capacity: int) -> list[int]:
    """The window (0, 1, ...) of each piece; none holds more than ``capacity``.

    A partial partition is kept as its sorted window sums, together with the
    windows' pieces as nested pairs; empty windows are left out.
    """
    if not sizes:
        return []
    count = max(1, -(-sum(sizes) // capacity))
    while True:
        windows = _differenced(sizes, count)
        if max(total for total, _ in windows) <= capacity:
            break
        # At least the overflow must move; more windows level what remains.
        count += max(1, count // 200)
    place = [0] * len(sizes)
    for at, (_, held) in enumerate(windows):
        stack = [held]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack.extend(x)
            else:
                place[x] = at
    return place


def _differenced(sizes: list[int], count: int) -> list[tuple[int, object]]:
    """At most ``count`` (sum, pieces) windows by largest differencing."""
    # A heap of (-imbalance, order, windows by falling sum).
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    order = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        if len(a) < len(b):
            a, b = b, a
        free = count - len(a)  # empty windows of a take b's fullest
        merged = a[:len(a) - max(0, len(b) - free)] + b[:free]
        for (s, x), (t, y) in zip(a[len(a) - max(0, len(b) - free):], reversed(b[free:])):
            merged.append((s + t, (x, y)))
        merged.sort(key=lambda w: -w[0])
        low = merged[-1][0] if len(merged) == count else 0
        heapq.heappush(heap, (low - merged[0][0], order, merged))
        order += 1
    return heap[0][2]


def pieces(docs: DataFrame, text_col: str = "text", tokenizer: str | None = None, window: int = WINDOW,
           grain: int = GRAIN) -> DataFrame:
    """The columns of ``docs`` but its text, with start, length, ids_crc32 and
    doc_tokens of each piece."""
    common.ready(docs.sparkSession)
    path = tokenizer or tokens.default_path()
    carried = [c for c in docs.columns if c != text_col]
    kept = docs.select(*(F.col(c).alias(f"_in_{c}") for c in carried), F.col(text_col).alias("t"))
    fields = [f for f in kept.schema if f.name != "t"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.coder(path)
        for batch in batches:
            out, source = [[], [], [], []], []
            for row, text in enumerate(batch.column("t").to_pylist()):
                ids = coder.encode(text or "") + END
                total = len(ids) // 4
                rest = total % window
                cuts = [*range(0, total, window), total]
                if rest > grain and rest % grain:
                    cuts.insert(-1, total - rest % grain)
                for a, b in zip(cuts, cuts[1:]):
                    source.append(row)
                    for col, v in zip(out, (a, b - a, zlib.crc32(ids[4 * a:4 * b]), total)):
                        col.append(v)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name).take(pa.array(source, pa.int64())) for f in fields),
                 *(pa.array(c, pa.int64()) for c in out)], names=[*(f.name for f in fields), *ADDED])

    done = kept.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields),
                                           *(f"`{c}` long" for c in ADDED)]))
    return done.select(*(F.col(f"_in_{c}").alias(c) for c in carried), *ADDED)


def pack(cut: DataFrame, window: int = WINDOW) -> DataFrame:
    """``cut`` (length, _k, start, ...) with sequence_id and offset."""
    cut = common.staged(cut)  # tokenised once; the count below fixes the groups
    groups = max(1, round(cut.count() / GROUP))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "_k", "start"], ascending=[False, True, True], ignore_index=True)
        place = np.array(differencing(rows.length.tolist(), window), np.int64)
        order = np.argsort(place, kind="stable")
        rows, place = rows.iloc[order], place[order]
        before = np.cumsum(rows.length.to_numpy()) - rows.length.to_numpy()
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        rows["offset"] = before - np.repeat(before[first], np.diff(np.append(first, len(rows))))
        rows["sequence_id"] = place + (int(key[0]) << 24)
        return rows.drop(columns="_group")

    dealt = cut.withColumn("_group", F.pmod(F.xxhash64("_k", "start"), F.lit(groups)))
    return dealt.groupBy("_group").applyInPandas(run, f"{fields}, `offset` long, `sequence_id` long")


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """The pieces of ``docs`` with their sequences and offsets."""
    return pack(pieces(common.keyed(docs, id_col, text_col), text_col, tokenizer)).drop("_k")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(common.documents(spark, sf_dir))
