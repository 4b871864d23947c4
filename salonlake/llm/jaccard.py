"""N-gram Jaccard join by T-occurrence search.

A text's set holds the hashes of its five-word shingles. Texts with equal sets
fold into one class first, so thousands of copies are one record. Two classes
are linked when their sets' Jaccard coefficient is at least 0.8.

1. Least hashes: of two linked sets each of the least k hashes of the union is
   shared with probability 0.8 or more, and a shared one is among the least k of
   both sets. For (k, T) of ``SCREEN``, ``SEARCH`` and ``PROBE`` fewer than T are
   shared with probability below 1e-18 (as certain as the 64-bit hashes themselves).
   Smaller sets are listed whole and need the exact share of their hashes.
   So a link is a T-occurrence: a class stands in at least T of the lists.
2. The screen keeps classes of which T of the least hashes recur at all; only
   those are searched, with four times as many hashes.
3. DivideSkip: the T - 1 longest lists of a class are skipped. The shortest list
   of a link is skipped by neither side, so the pair still meets there.
4. In every list each class is first tried with the list's least class: one
   candidate per class, the most frequent. Linked ones are joined to components.
5. Lists that still hold two components are gathered by their least class and
   cut into pairs of class blocks, so that a task holds a bounded number of
   classes. There the short lists are merged to the pairs that occur, and these
   are probed, by binary search, for their other hashes. Pairs that reach T go
   on; of the links among sets that are probed whole only a spanning forest does.
6. Survivors are verified with the full sets, made again from the texts.

Links are only followed to components; no pair inside a component is needed.

Defined results: a text with one to four words has one shingle, all its words;
a null or wordless text has an empty set and is linked to nothing; repeated rows
and null ids are documents of their own (null ids never name a component that
has another id); an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common

SHINGLE, PERCENT = 5, 80
#: Least hashes of a set, and how many of them a link shares at least.
SCREEN, SEARCH, PROBE = (64, 16), (256, 138), (1024, 691)
#: Classes of one block, list entries of one task, and occurrences of pairs up
#: to which lists are merged by a heap rather than by a product of matrices.
BLOCK, BUCKET, HEAP = 400, 20_000, 20_000
#: Parts into which one list head's entries are dealt.
SALTS = 32
#: Pairs and bytes of text of one class's candidates that are verified together.
PAIRS, TEXTS = 1000, 16 << 20

_UPPER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def shingles(text: bytes, words_of: common.WordHash) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = text.translate(_UPPER).split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(common.window_hash(words_of.of(words), min(SHINGLE, len(words))))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words_of = common.WordHash()
    for batch in batches:
        n, cls, sketch = [], [], []
        for text in common.text_bytes(batch.column("t")):
            s = shingles(text, words_of)
            n.append(len(s))
            cls.append(int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())))) if len(s) else None)
            sketch.append(s[:SCREEN[0]].view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("_k"), pa.array(n, pa.int64()), pa.array(cls, pa.int64()),
                                          pa.array(sketch, pa.list_(pa.int64()))], names=["_k", "n", "cls", "sketch"])


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words_of = common.WordHash()
    for batch in batches:
        sets = [shingles(text, words_of) for text in common.text_bytes(batch.column("t"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("cls"), pa.array([len(s) for s in sets], pa.int64()),
             pa.array([np.sort(s.view(np.int64))[:PROBE[0]] for s in sets], pa.list_(pa.int64()))], names=["cls", "n", "sketch"])


def _allowed(n: Column, least: tuple[int, int]) -> Column:
    """Lists that a class may skip: one less than its least T."""
    # All partners of a set this small are listed whole, like itself, and have
    # at least 0.8 n of its hashes in common.
    size, t = least
    return F.when(n * 100 < size * PERCENT, F.ceil(n * PERCENT / 100)).otherwise(t).cast("int") - 1


def recurring(classes: DataFrame, least: tuple[int, int]) -> DataFrame:
    """(cls, n, x): the classes with T recurring hashes; x holds those hashes
    as (df, token), the shortest lists first."""
    each = classes.select("cls", "n", F.explode("sketch").alias("token")).repartition("token")
    counts = each.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    held = each.join(counts, "token").groupBy("cls", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("x"))
    return held.filter(F.size("x") > _allowed(F.col("n"), least))


def lists(classes: DataFrame) -> DataFrame:
    """(token, cls, n): the lists' entries after DivideSkip."""
    able = recurring(classes.withColumn("sketch", F.slice("sketch", 1, SEARCH[0])), SEARCH)
    short = F.slice("x", F.lit(1), F.size("x") - _allowed(F.col("n"), SEARCH))
    return able.select("cls", "n", F.explode(short).alias("e")).select("e.token", "cls", "n")


def _close(a: Column, b: Column) -> Column:
    """Sizes that can reach the threshold at all."""
    return (F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT)


def hubs(entries: DataFrame) -> DataFrame:
    """(a, b): each class with the class that heads most of its lists."""
    head = entries.groupBy("token").agg(F.min(F.struct("cls", "n")).alias("h"))
    tried = entries.join(head, "token").filter((F.col("h.cls") != F.col("cls")) & _close(F.col("h.n"), F.col("n")))
    votes = tried.groupBy("cls", F.col("h.cls").alias("hub")).agg(F.count(F.lit(1)).alias("v"))
    return votes.groupBy("cls").agg(F.max(F.struct("v", "hub")).alias("x")).select(F.col("x.hub").alias("a"), F.col("cls").alias("b"))


def _short(tokens: np.ndarray, one: np.ndarray, two: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places (i in block one, j in block two) that stand in one of the
    lists; ``one`` and ``two`` hold the entries' places, -1 outside the block."""
    order = np.argsort(tokens, kind="stable")
    edges = np.flatnonzero(np.diff(tokens[order])) + 1
    parts = [(x[x >= 0], y[y >= 0]) for x, y in zip(np.split(one[order], edges), np.split(two[order], edges))]
    if sum(len(x) * len(y) for x, y in parts) <= HEAP:
        codes = (sorted(i * classes + j for i in x.tolist() for j in y.tolist()) for x, y in parts)
        found = np.array([code for code, _ in itertools.groupby(heapq.merge(*codes))], np.int64)
        return found // classes, found % classes
    sides = [np.zeros((classes, len(parts)), np.float32) for _ in range(2)]
    for t, (x, y) in enumerate(parts):
        sides[0][x, t] = 1
        sides[1][y, t] = 1
    return np.nonzero(sides[0] @ sides[1].T)


def _probe(rows: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
    """Pairs of different components that reach T, of some pairs of blocks."""
    held = dict(zip(sets["cls"].tolist(), sets["sketch"].tolist()))
    out: list[list[int]] = [[], []]
    for _, x in rows.groupby(["head", "left", "right"], sort=False):
        same = bool((x["left"] == x["right"]).iloc[0])
        ids, place = np.unique(x["cls"].to_numpy(), return_inverse=True)
        where = np.empty(len(ids), np.int64)
        where[place] = np.arange(len(x))
        n, comp = x["n"].to_numpy()[where], x["comp"].to_numpy()[where]
        in_one = x["side"].to_numpy() == 0
        one, two = np.where(in_one, place, -1), np.where(~in_one | same, place, -1)
        i, j = _short(x["token"].to_numpy(), one, two, len(ids))
        fit = (comp[i] != comp[j]) & (100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j]))
        if same:
            fit &= i < j
        i, j = i[fit], j[fit]
        up = {int(c): int(c) for c in np.unique(comp)}
        maybe = []
        for a in np.unique(i).tolist():
            of = j[i == a]
            own = held[int(ids[a])]
            others = [held[int(ids[b])] for b in of.tolist()]
            flat = np.concatenate(others)
            at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
            size = np.array([len(o) for o in others])
            edge = np.concatenate(([0], np.cumsum(size)))
            hit = own[at] == flat
            before = np.concatenate(([0], np.cumsum(hit)))
            hits = np.diff(before[edge])
            # A shared hash's rank in the union: its places, shared ones once.
            start = np.repeat(edge[:-1], size)
            rank = at + np.arange(len(flat)) - start - (before[:-1] - before[start])
            least = np.diff(np.concatenate(([0], np.cumsum(hit & (rank < PROBE[0]))))[edge])
            whole = (n[a] <= PROBE[0]) & (n[of] <= PROBE[0])
            reach = np.where(whole, 100 * hits >= PERCENT * (n[a] + n[of] - hits), least >= PROBE[1])
            for b, sure in zip(of[reach].tolist(), whole[reach].tolist()):
                if not sure:
                    maybe.append((a, b))
                elif (p := _root(up, int(comp[a]))) != (q := _root(up, int(comp[b]))):
                    up[p] = q
                    out[0].append(int(ids[a]))
                    out[1].append(int(ids[b]))
        for a, b in maybe:
            if _root(up, int(comp[a])) != _root(up, int(comp[b])):
                out[0].append(int(ids[a]))
                out[1].append(int(ids[b]))
    low, high = np.minimum(*map(np.array, out)), np.maximum(*map(np.array, out))
    return pd.DataFrame({"a": low.astype(np.int64), "b": high.astype(np.int64)})


def _root(up: dict[int, int], x: int) -> int:
    while up[x] != x:
        up[x] = x = up[up[x]]
    return x


def occurring(entries: DataFrame, component: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): pairs of different components that occur T times, ``classes``
    (cls, n, sketch) with their least hashes."""
    named = entries.join(component.withColumnRenamed("id", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    named = named.repartition("token")
    mixed = (named.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("cls").alias("head"))
             .filter("low <> high").select("token", "head"))
    kept = common.staged(named.join(mixed, "token"))
    blocks = (kept.select("head", "cls").distinct().groupBy("head").agg(F.count(F.lit(1)).alias("m"))
              .select("head", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")))
    # Salted: one head may stand for a large share of the entries.
    blocks = blocks.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    kept = kept.withColumn("_s", F.pmod(F.xxhash64("token", "cls"), F.lit(SALTS)).cast("int"))
    kept = kept.join(blocks, ["head", "_s"]).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    # Every entry goes to the pairs of blocks (left <= right) that hold its own.
    kept = kept.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    kept = (kept.withColumn("left", F.least("own", "o")).withColumn("right", F.greatest("own", "o"))
            .withColumn("side", (F.col("own") > F.col("o")).cast("int")))
    groups = max(1, -(-kept.count() // BUCKET))
    dealt = kept.select(F.pmod(F.xxhash64("head", "left", "right"), F.lit(groups)).alias("_g"),
                        "head", "left", "right", "side", "token", "cls", "n", "comp")
    asked = dealt.select(F.col("_g").alias("_h"), "cls").distinct()
    sets = classes.select("cls", "sketch").join(asked, "cls").select(F.col("_h").alias("_g"), "cls", "sketch")
    return dealt.groupBy("_g").cogroup(sets.groupBy("_g")).applyInPandas(_probe, "a long, b long").distinct()


def _verify(left: pa.Table, right: pa.Table) -> pa.Table:
    """The links among one class and its candidates' texts."""
    words_of = common.WordHash()
    out: list[list[int]] = [[], []]
    sets = {a: shingles(t or b"", words_of) for a, t in zip(left.column("a").to_pylist(), left.column("t").to_pylist())}
    for a, b, t in zip(*(right.column(c).to_pylist() for c in ("a", "b", "t"))):
        x, y = sets[a], shingles(t, words_of)
        if 100 * len(np.intersect1d(x, y, assume_unique=True)) >= PERCENT * len(np.union1d(x, y)):
            out[0].append(a)
            out[1].append(b)
    return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) of classes that are linked; ``texts``: (cls, t)."""
    pairs = common.staged(pairs)
    named = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()
    some = common.staged(texts.join(named, "cls", "left_semi"))
    # A class with many candidates, or long ones, has as many parts of its own
    # as they need; its text goes to each. The others are dealt to groups.
    size = some.select(F.col("cls").alias("b"), F.octet_length("t").alias("size"))
    need = common.staged(pairs.join(size, "b").groupBy("a").agg(
        F.greatest(F.count(F.lit(1)) / PAIRS, F.sum("size") / TEXTS).alias("need")))
    groups = max(1, math.ceil(4 * (need.filter("need <= 1").agg(F.sum("need")).first()[0] or 0)))
    heavy = need.filter("need > 1").select("a", F.ceil("need").alias("parts"))  # a row for TEXTS bytes at most
    dealt = common.staged(pairs.join(F.broadcast(heavy), "a", "left").select(
        F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("a"), F.lit(groups))).otherwise(F.col("a")).alias("_g"),
        F.coalesce(F.pmod(F.xxhash64("b"), F.col("parts")), F.lit(-1).cast("long")).alias("_s"), "a", "b"))
    right = dealt.join(some.withColumnRenamed("cls", "b"), "b")
    left = dealt.select("_g", "_s", "a").distinct().join(some.withColumnRenamed("cls", "a"), "a")
    left = left.select(*(F.col(c).alias(c) for c in left.columns))  # attributes of its own
    return common.staged(left.select("_g", "_s", "a", "t").groupBy("_g", "_s").cogroup(
        right.select("_g", "_s", "a", "b", "t").groupBy("_g", "_s")).applyInArrow(_verify, "a long, b long"))


def components(links: DataFrame) -> DataFrame:
    """(id, comp): the least id that links reach, for every linked id.

    Alternating large-star and small-star contraction: the edges of a vertex
    are moved to its least neighbour, in turn for larger and smaller ones, until
    nothing moves; the number of rounds grows with the logarithm of a chain.
    """
    edges = common.staged(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("u <> v").distinct())
    total = None
    while True:
        ways = edges.union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = ways.groupBy("v").agg(F.min("u").alias("m"))
        least = least.select("v", F.least("v", "m").alias("m"))
        # Large star: larger neighbours are linked to the least one.
        large = ways.join(least, "v").filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).filter("u <> v").distinct()
        # Small star: a vertex and its smaller neighbours to the least of them.
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v")
        small = (small.select("v", F.col("m").alias("u")).union(small.select(F.col("u").alias("v"), F.col("m").alias("u")))
                 .filter("u <> v").distinct())
        edges = common.staged(small)
        mark = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")), F.lit(0))).first()
        if mark == total:
            return edges.select(F.col("v").alias("id"), F.col("u").alias("comp")).union(
                edges.select(F.col("u").alias("id"), F.col("u").alias("comp")).distinct())
        total = mark


def classed(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(_k, n, cls) of every document of ``docs`` (unique key ``_k``), and the
    links (a, b) that join their classes."""
    common.ready(docs.sparkSession)
    sets = common.staged(docs.select("_k", F.col(text_col).alias("t")).mapInArrow(
        _sets, "_k long, n long, cls long, sketch array<bigint>"))
    # One document speaks for each class; its text is the class's.
    first = sets.filter("cls is not null").groupBy("cls").agg(F.min("_k").alias("_k"))
    able = recurring(sets.join(first.select("_k"), "_k", "left_semi"), SCREEN).select("cls")
    texts = common.staged(docs.select("_k", F.col(text_col).cast("binary").alias("t")).join(first.join(able, "cls"), "_k").select("cls", "t"))
    classes = common.staged(texts.mapInArrow(_searched, "cls long, n long, sketch array<bigint>"))
    entries = common.staged(lists(classes))
    links = verified(hubs(entries), texts)
    rest = verified(occurring(entries, components(links), classes), texts)
    return sets.select("_k", "n", "cls"), links.union(rest)


def joined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_k, id, n_shingles, component) of ``docs`` (unique key ``_k``, long
    ``id_col``): component is the least id reachable by links."""
    sets, links = classed(docs, text_col)
    comp = components(links)
    members = sets.join(comp.withColumnRenamed("id", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    members = members.join(docs.select("_k", F.col(id_col).alias("_id")), "_k")
    named = members.filter("comp is not null").groupBy("comp").agg(F.min("_id").alias("least"), F.min("_k").alias("first"))
    # A text without shingles has no class and stands alone.
    alone = members.filter("comp is null").select("_k", "_id", "n", F.col("_id").alias("least"), F.col("_k").alias("first"))
    both = members.filter("comp is not null").join(named, "comp").select("_k", "_id", "n", "least", "first")
    return both.unionByName(alone).select("_k", F.col("_id").alias(id_col), F.col("n").alias("n_shingles"),
                                          F.col("least").alias("component_id"), (F.col("first") == F.col("_k")).alias("kept"))


def one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component: the one of least key."""
    own, text = f"_doc_{id_col}", f"_doc_{text_col}"
    rows = common.wrapped(docs)
    rows = common.keyed(rows, own, *(c for c in rows.columns if c != own))
    kept = joined(rows.select("_k", own, text), own, text).filter("kept").select("_k")
    return common.unwrapped(rows.join(kept, "_k", "left_semi"), docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.keyed(common.documents(spark, sf_dir), "doc_id", "text")
    return joined(docs).select("doc_id", "n_shingles", "component_id")
