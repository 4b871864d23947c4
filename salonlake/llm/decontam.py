"""Benchmark decontamination with a generalised suffix automaton.

The word sequences of the test items are compiled into one suffix automaton per
shard of at most ``SHARD_WORDS`` item words (so what is broadcast has a fixed
bound, and a larger benchmark simply needs more passes). Every document is
streamed through it; the automaton's state and longest matching length tell, at
each word, whether a window of ``window`` item words (or a whole shorter item)
ends there.

Defined results: a null or wordless text has no words and no hits; null or
wordless items match nothing; items that share an id count once; repeated
document rows are judged each on their own; an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

WINDOW = 10
SHARD_WORDS = 200_000

_FOLD = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A
              else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and non-ASCII characters."""
    return text.translate(_FOLD).split()


class Automaton:
    """Generalised suffix automaton over words, marked with item windows."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        coded = []
        for name, ws in items:
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in ws]
            coded.append((name, ids))
            last = 0
            for c in ids:
                last = self._extend(last, c)
        # Item names of each state's window, and the short items that end there.
        self.full: dict[int, set[str]] = {}
        short: dict[int, list[tuple[int, str]]] = {}
        self.least = window
        for name, ids in coded:
            v = length = 0
            for c in ids:
                v, length = self.step(v, length, c)
                if length >= window:
                    self.full.setdefault(self.window_state(v), set()).add(name)
            if 0 < len(ids) < window:
                self.least = min(self.least, len(ids))
                short.setdefault(v, []).append((len(ids), name))
        # Along suffix links every shorter suffix of the match is found again.
        self.short: list[list[tuple[int, str]]] = [[] for _ in self.len]
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__):
            self.short[v] = self.short[self.link[v]] + short.get(v, [])

    def _state(self, length: int, nxt: dict[int, int], link: int) -> int:
        self.next.append(nxt)
        self.len.append(length)
        self.link.append(link)
        return len(self.len) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state for p's string plus c, cut out of q where q is longer."""
        if self.len[p] + 1 == self.len[q]:
            return q
        copy = self._state(self.len[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c, self.next[last][c])
        cur, p = self._state(self.len[last] + 1, {}, 0), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            self.link[cur] = self._split(p, c, self.next[p][c])
        return cur

    def step(self, v: int, length: int, c: int) -> tuple[int, int]:
        """State and matching length after one more word."""
        while v and c not in self.next[v]:
            v = self.link[v]
            length = self.len[v]
        if c in self.next[v]:
            return self.next[v][c], length + 1
        return 0, 0

    def window_state(self, v: int) -> int:
        """The state that holds the last ``window`` words of a longer match."""
        while self.len[self.link[v]] >= self.window:
            v = self.link[v]
        return v

    def hits(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Merged [start, end) word spans that are hit, items, longest match."""
        get, spans, found, longest = self.vocab.get, [], set(), 0
        ids = np.fromiter((get(w, -1) for w in ws), np.int64, len(ws))
        # Only runs of known words can match; walk those that are long enough.
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a < self.least:
                continue
            v = length = 0
            for i, c in enumerate(ids[a:b].tolist(), a + 1):
                v, length = self.step(v, length, c)
                longest = max(longest, length)
                size = 0
                if length >= self.window:
                    size = self.window
                    found |= self.full[self.window_state(v)]
                for m, name in self.short[v]:
                    if m <= length:
                        size = max(size, m)
                        found.add(name)
                if size:
                    start = i - size
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, i))
        return spans, found, longest


def _shards(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items in groups of at most SHARD_WORDS words (a longer item: its own)."""
    shard, size = [], 0
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col))
    for name, text in rows.toLocalIterator():
        ws = words((text or "").encode())
        if shard and size + len(ws) > SHARD_WORDS:
            yield shard
            shard, size = [], 0
        if ws:
            shard.append((name, ws))
            size += len(ws)
    yield shard


def _cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the hit words and what stands between them."""
    at = [m.span() for m in _WORD.finditer(text.translate(_FOLD))]
    out, end = [], 0
    for a, b in spans:
        out.append(text[end:at[a][0]])
        end = at[b - 1][1]
    return b"".join(out) + text[end:]


def contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with n_words, n_hit, longest (matching length in words), spans
    (hit [start, end) word ranges), items (sorted ids of the items with an
    occurring window) and clean (the text without the hit spans)."""
    spark = docs.sparkSession
    common.ready(spark)
    added = {"n_words": pa.int64(), "longest": pa.int64(), "spans": pa.list_(pa.list_(pa.int64())),
             "items": pa.list_(pa.string())}
    kinds = "`n_words` long, `longest` long, `spans` array<array<bigint>>, `items` array<string>"
    df = docs.withColumnsRenamed({c: f"_in_{c}" for c in docs.columns})
    base = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    text = f"_in_{text_col}"
    first = True
    for shard in _shards(items, item_id, item_text):
        sent = spark.sparkContext.broadcast((shard, window))
        df = _pass(df if first else staged_cols(df), sent, text, added, f"{base}, {kinds}", first)
        first = False
    cleaned = _cleaner(df, text)
    back = [F.col(f"_in_{c}").alias(c) for c in docs.columns]
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x[1] - x[0])
    return cleaned.select(*back, "n_words", n_hit.alias("n_hit"), "longest", "spans", "items", "clean")


def staged_cols(df: DataFrame) -> DataFrame:
    return common.staged(df)


def _pass(df: DataFrame, sent, text: str, added: dict[str, pa.DataType], schema: str, first: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton(*sent.value)
        for batch in batches:
            rows = {k: [] for k in added}
            before = None if first else (batch.column("spans").to_pylist(), batch.column("items").to_pylist(),
                                         batch.column("longest").to_pylist())
            for i, value in enumerate(common.text_bytes(batch.column(text))):
                ws = words(value)
                spans, found, longest = machine.hits(ws)
                if before:
                    spans = _merged(spans + [tuple(x) for x in before[0][i]])
                    found |= set(before[1][i])
                    longest = max(longest, before[2][i])
                for k, v in zip(added, (len(ws), longest, [list(x) for x in spans], sorted(found))):
                    rows[k].append(v)
            keep = [c for c in batch.schema.names if c not in added]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), *(pa.array(rows[k], t) for k, t in added.items())],
                names=[*keep, *added])

    return df.mapInArrow(run, schema)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _cleaner(df: DataFrame, text: str) -> DataFrame:
    @F.pandas_udf("string")
    def cut(texts, spans):  # noqa: ANN001, ANN202 - pandas Series
        return texts.combine(spans, lambda t, s: None if t is None else _cut(t.encode(), [tuple(x) for x in s]).decode())

    return df.withColumn("clean", F.when(F.size("spans") > 0, cut(F.when(F.size("spans") > 0, F.col(text)), "spans"))
                         .otherwise(F.col(text)))


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", max_span: int = WINDOW,
                  max_coverage: float = 0.5, **kw) -> DataFrame:
    """``docs`` without the spans of ``max_span`` or more matching item words;
    documents of which more than ``max_coverage`` of the words are hit go."""
    text = f"_doc_{text_col}"
    found = contamination(common.wrapped(docs), items, text, window=max_span, **kw)
    kept = found.filter(F.col("n_hit") <= max_coverage * F.col("n_words"))
    return common.unwrapped(kept.withColumn(text, F.col("clean")), docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    found = contamination(docs, common.documents(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def brute(text: str | None, items: list[tuple[str, str | None]], window: int = WINDOW) -> tuple[int, int, int, str]:
    """The query's numbers for one text by direct search; used by the tests."""
    ws = words((text or "").encode())
    hit, found = set(), set()
    for name, item in items:
        iw = words((item or "").encode())
        size = min(window, len(iw))
        for j in range(len(iw) - size + 1 if size else 0):
            for i in range(len(ws) - size + 1):
                if ws[i:i + size] == iw[j:j + size]:
                    hit.update(range(i, i + size))
                    found.add(name)
    return len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
