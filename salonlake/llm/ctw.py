"""Language-model scoring by context-tree weighting.

Bytes are decomposed into eight binary decisions. For every decision there is a
context tree over the ``DEPTH`` bytes before it; every node holds how often the
decision was 0 and 1 after that context. Krichevsky-Trofimov estimates of all
nodes on a context's path are mixed with the weights that context-tree
weighting gives them: a node's weighted probability is half its own estimate
and half the product of its children's.

What is learnt is the number of times each run of ``DEPTH`` + 1 bytes occurs in
the training texts; it grows with the corpus, so it is never brought together
in one place. Spark sums the runs' counts; runs that end alike (by the two
bytes before the last) share every deeper node, so each such family is weighted
by itself, the upper nodes coming from a table of fixed size. A family gives
the code length of each of its runs, also of those that only texts to be scored
hold. Texts are scored in chunks of documents: a chunk sends its distinct runs
and words out and gets their code lengths and counts back.

A text is scored with ASCII letters lower-cased, from its UTF-8 bytes, after
``DEPTH`` blanks, and closed by one end byte.

Defined results: a null text is empty; null ids and repeated rows are documents
of their own; with nothing to learn from every decision has probability 1/2.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

DEPTH = 4
#: Documents of one chunk as a power of two; runs of one group of families.
CHUNK_BITS, FAMILY_RUNS = 13, 200_000
#: Bytes of text whose runs and words are held at a time.
SLICE = 1 << 20
#: Additive smoothing of the base score.
ALPHA = 0.1
#: Closes a text; no UTF-8 text holds this byte.
END = 0xFF

_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the DEPTH + 1 bytes that end at every byte of every text (end
    bytes included), and the number of codes of each text."""
    pad = b" " * DEPTH
    joined = np.frombuffer(b"".join(pad + t + bytes([END]) for t in texts), np.uint8).astype(np.int64)
    out = np.zeros(max(0, len(joined) - DEPTH), np.int64)
    for i in range(DEPTH + 1):
        out = (out << 8) | joined[i:len(joined) - DEPTH + i]
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    keep = np.ones(len(out), bool)  # codes that end inside the next text's pad
    for i in range(DEPTH):
        keep[(np.cumsum(sizes + DEPTH) - DEPTH + i)[:-1]] = False
    return out[keep], sizes


def fold(text: bytes) -> bytes:
    return text.translate(_FOLD)


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of the counts."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _lgamma(zeros + ones + 1.0) - np.log(np.pi)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by eight."""
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z ** 3) + 1 / (1260 * z ** 5) - shift


class Nodes:
    """Decision counts of all contexts of one length.

    A node is (context, prefix of the next byte's bits); ``key`` is
    context * 256 + a one followed by the prefix bits.
    """

    def __init__(self, codes: np.ndarray, counts: np.ndarray, depth: int):
        tail = codes & ((1 << 8 * (depth + 1)) - 1)
        context, byte = tail >> 8, tail & 255
        keys, zeros, ones = [], [], []
        for bit in range(8):
            keys.append(context << 8 | (256 | byte) >> (8 - bit))
            one = (byte >> (7 - bit) & 1).astype(bool)
            zeros.append(np.where(one, 0, counts))
            ones.append(np.where(one, counts, 0))
        self.key, place = np.unique(np.concatenate(keys), return_inverse=True)
        self.zeros = np.bincount(place, np.concatenate(zeros), len(self.key))
        self.ones = np.bincount(place, np.concatenate(ones), len(self.key))
        self.log_own = _log_kt(self.zeros, self.ones)
        self.log_weighted = self.log_own

    def weigh(self, children: Nodes, depth: int) -> None:
        """Weighted probabilities from those of the contexts one byte longer."""
        parent = (children.key >> 8 & ((1 << 8 * depth) - 1)) << 8 | children.key & 255
        at = np.searchsorted(self.key, parent)
        below = np.bincount(at, children.log_weighted, len(self.key))
        self.set_below(below)

    def set_below(self, below: np.ndarray) -> None:
        self.log_weighted = np.logaddexp(self.log_own, below) - np.log(2)

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _look_up(self.key, key)


def predict(levels: list[Nodes], codes: np.ndarray, first: int = 0) -> np.ndarray:
    """log10 probability of each code's last byte after its other bytes, mixed
    over the contexts of ``levels`` (lengths ``first``, ``first`` + 1, ...)."""
    total = np.zeros(len(codes))
    byte = codes & 255
    for bit in range(8):
        prefix = (256 | byte) >> (8 - bit)
        one = (byte >> (7 - bit) & 1).astype(bool)
        p = np.full(len(codes), 0.5)
        for i in range(len(levels) - 1, -1, -1):  # from the longest context up
            depth, nodes = first + i, levels[i]
            at, known = nodes.find((codes >> 8 & ((1 << 8 * depth) - 1)) << 8 | prefix)
            if not len(nodes.key):
                continue
            n1, n0 = nodes.ones[at], nodes.zeros[at]
            own = np.where(one, n1 + 0.5, n0 + 0.5) / (n0 + n1 + 1.0)
            # At the deepest contexts a node stands for itself alone.
            share = np.ones(len(codes)) if depth == DEPTH else np.exp(nodes.log_own[at] - np.log(2) - nodes.log_weighted[at])
            p = np.where(known, share * own + (1 - share) * p, p)
        total += np.log10(p)
    return total


def _family(rows: pd.DataFrame) -> tuple[list[Nodes], np.ndarray, np.ndarray]:
    codes, counts = rows.code.to_numpy(np.int64), rows.n.to_numpy(np.float64)
    seen = counts > 0
    levels = [Nodes(codes[seen], counts[seen], d) for d in range(2, DEPTH + 1)]
    for i in range(len(levels) - 2, -1, -1):
        levels[i].weigh(levels[i + 1], i + 2)
    return levels, codes, counts


class Upper:
    """The nodes of contexts of no and of one byte: at most 257 * 255 of them."""

    def __init__(self, pairs: pd.DataFrame, below: pd.DataFrame):
        """``pairs``: counts of runs of two bytes; ``below``: of each one-byte
        context's decision, the sum of its children's weighted logs."""
        codes, counts = pairs.code.to_numpy(np.int64), pairs.n.to_numpy(np.float64)
        self.levels = [Nodes(codes, counts, 0), Nodes(codes, counts, 1)]
        sums = np.zeros(len(self.levels[1].key))
        at, known = self.levels[1].find(below.key.to_numpy(np.int64))
        np.add.at(sums, at[known], below.w.to_numpy()[known])
        self.levels[1].set_below(sums)
        self.levels[0].weigh(self.levels[1], 0)


def _tally(keys: list[np.ndarray], weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, in no order, and the sums of their weights."""
    place, distinct = pd.factorize(np.concatenate(keys))
    return distinct, np.bincount(place, np.concatenate(weights), len(distinct)).astype(np.int64)


class _Chunk:
    """Distinct runs (kind 0) and words (kind 1) of one chunk's texts, with
    how often training texts hold them."""

    def __init__(self, words_of: common.WordHash):
        self._words_of = words_of
        self._parts: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]

    def add(self, texts: list[bytes], learn: np.ndarray) -> None:
        for a, b in common.slices(texts, SLICE):
            codes, sizes = runs(texts[a:b])
            split = [t.split() for t in texts[a:b]]
            flat = self._words_of.of([w for ws in split for w in ws]).view(np.int64)
            for kind, keys, n in ((0, codes, sizes), (1, flat, [len(ws) for ws in split])):
                self._parts[kind].append(_tally([keys], [np.repeat(learn[a:b], n)]))

    def rows(self, chunk: int) -> Iterator[pa.RecordBatch]:
        for kind, parts in enumerate(self._parts):
            if parts:
                keys, n = _tally(*map(list, zip(*parts)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), kind, np.int32)), pa.array(np.full(len(keys), chunk, np.int64)),
                     pa.array(keys), pa.array(n)], names=["kind", "_c", "code", "n"])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words_of, chunk, held = common.WordHash(), None, None
    for batch in batches:
        texts = [fold(t) for t in common.text_bytes(batch.column("t"))]
        learn = batch.column("learn").to_numpy(zero_copy_only=False).astype(np.float64)
        ids = batch.column("_c").to_numpy()
        for a, b in common.stretches(ids):
            if ids[a] != chunk:
                if held:
                    yield from held.rows(chunk)
                chunk, held = int(ids[a]), _Chunk(words_of)
            held.add(texts[a:b], learn[a:b])
    if held:
        yield from held.rows(chunk)


def scored(docs: DataFrame, text_col: str = "text", learn_col: str = "learn") -> DataFrame:
    """(_k, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte)
    of ``docs`` with unique key ``_k`` and boolean ``learn_col``; score and
    base_score are log10."""
    common.ready(docs.sparkSession)
    lean = common.chunked(docs, CHUNK_BITS, "_k", F.col(learn_col).alias("learn"), F.col(text_col).alias("t"))
    asked = common.staged(lean.mapInArrow(_gather, "kind int, _c long, code long, n long"))
    lengths = _lengths(common.staged(asked.filter("kind = 0").groupBy("code").agg(F.sum("n").alias("n"))))
    # A word's rows, one for each chunk and task, are dealt once for sum and join alike.
    words = asked.filter("kind = 1").select("_c", "code", "n").repartition("code")
    counts = words.groupBy("code").agg(F.sum("n").alias("value"), F.count(F.lit(1)).alias("chunks"))
    docs_learnt = docs.filter(learn_col).count()
    totals = asked.filter("kind = 1").groupBy("code").agg(F.sum("n").alias("n")).filter("n > 0").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    known, total = totals.v + (docs_learnt > 0), (totals.n or 0) + docs_learnt
    # A word of one chunk has the count that its own chunk can see.
    shared = words.join(counts.filter("chunks > 1"), "code").select("_c", F.lit(1).alias("kind"), "code", F.col("value").cast("double"))
    priced = asked.filter("kind = 0").select("_c", "code").join(lengths, "code").select("_c", F.lit(0).alias("kind"), "code", F.col("p").alias("value"))
    answers = priced.unionByName(shared)
    scores = lean.groupBy("_c").cogroup(answers.groupBy("_c")).applyInArrow(
        _scorer(total, known, docs_learnt), "_k long, n_tokens long, n_known long, base_score double, score double, n_bytes long")
    return scores.withColumn("train_tokens", F.lit(total).cast("long")).withColumn(
        "bits_per_byte", -F.col("score") / F.lit(float(np.log10(2))) / F.col("n_bytes"))


def _lengths(grams: DataFrame) -> DataFrame:
    """(code, p): log10 probability of each run's last byte after the others."""
    spark = grams.sparkSession
    # Runs that share the two bytes before the last stay together; many such
    # families make a group, as many groups as the runs need.
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-grams.count() // FAMILY_RUNS))
    family = F.shiftright("code", 8).bitwiseAND(F.lit(0xFFFF))
    dealt = grams.withColumn("f", F.pmod(F.xxhash64(family), F.lit(groups)))

    def tops(rows: pd.DataFrame) -> pd.DataFrame:
        """What the families hand up: their two-byte contexts' weighted logs."""
        top = _family(rows)[0][0]
        keys, place = np.unique((top.key >> 8 & 255) << 8 | top.key & 255, return_inverse=True)
        return pd.DataFrame({"key": keys, "w": np.bincount(place, top.log_weighted, len(keys))})

    below = dealt.groupBy("f").applyInPandas(tops, "key long, w double").groupBy("key").agg(F.sum("w").alias("w"))
    pairs = grams.filter("n > 0").groupBy(F.col("code").bitwiseAND(F.lit(0xFFFF)).alias("code")).agg(F.sum("n").alias("n"))
    # Both have at most 65,536 rows, whatever the corpus.
    upper = spark.sparkContext.broadcast(Upper(pairs.toPandas().sort_values("code"), below.toPandas().sort_values("key")).levels)

    def weigh(rows: pd.DataFrame) -> pd.DataFrame:
        levels, codes, _ = _family(rows)
        return pd.DataFrame({"code": codes, "p": predict([*upper.value, *levels], codes)})

    return dealt.groupBy("f").applyInPandas(weigh, "code long, p double")


def _scorer(total: int, known: int, ends: int):  # noqa: ANN202
    """Scores one chunk's documents from the answers it got; raises if they are
    not the documents that asked."""
    scale = total + ALPHA * (known + 1)

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        kind, code, value = (answers.column(c).to_numpy() for c in ("kind", "code", "value"))
        price, count = ((code[m][o], value[m][o]) for m in (kind == 0, kind == 1) for o in [np.argsort(code[m])])
        words_of = common.WordHash()
        texts = [fold(t) for t in common.text_bytes(docs.column("t").combine_chunks())]
        learn = docs.column("learn").to_numpy().astype(np.float64)
        out: dict[str, list] = {c: [] for c in ("n_tokens", "n_known", "base_score", "score", "n_bytes")}
        cuts = list(common.slices(texts, SLICE))
        hashed, sizes = [], []
        for a, b in cuts:
            split = [t.split() for t in texts[a:b]]
            hashed.append(words_of.of([w for ws in split for w in ws]).view(np.int64))
            sizes.append(np.array([len(ws) for ws in split]))
        own, n_own = _tally([np.zeros(0, np.int64), *hashed],
                            [np.zeros(0), *(np.repeat(learn[a:b], n) for (a, b), n in zip(cuts, sizes))])
        own, n_own = own[order := np.argsort(own)], n_own[order]
        c = n_own.astype(np.float64)
        at, there = _look_up(count[0], own)
        c[there] = count[1][at[there]]  # words that other chunks hold as well
        if there.sum() < len(np.unique(count[0])):
            raise RuntimeError("a chunk's documents changed between two passes: words it asked for are gone")
        for (a, b), n, flat in zip(cuts, sizes, hashed):
            codes, length = runs(texts[a:b])
            place, distinct = pd.factorize(codes)
            where, priced = _look_up(price[0], distinct)
            if not priced.all():
                raise RuntimeError("a chunk's documents changed between two passes: runs without an answer")
            p = price[1][where][place]
            out["score"].append(np.add.reduceat(p, np.concatenate(([0], np.cumsum(length)[:-1]))))
            out["n_bytes"].append(length)
            each, which = c[np.searchsorted(own, flat)], np.repeat(np.arange(b - a), n)
            out["base_score"].append(np.bincount(which, np.log10((each + ALPHA) / scale), b - a) + np.log10((ends + ALPHA) / scale))
            out["n_known"].append(np.bincount(which, each > 0, b - a).astype(np.int64) + (ends > 0))
            out["n_tokens"].append(n + 1)
        done = {k: pa.array(np.concatenate(v)) for k, v in out.items()}
        return pa.table({"_k": docs.column("_k"), **{k: done[k] for k in ("n_tokens", "n_known", "base_score", "score", "n_bytes")}})

    return run


def _look_up(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``keys`` in the sorted ``table``, and which are there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.keyed(common.documents(spark, sf_dir), "doc_id", "text")
    held = common.held_out("doc_id", 10, 0)
    rows = docs.withColumn("learn", ~held)
    done = scored(rows)
    named = rows.select("_k", "doc_id", held.alias("held_out"))
    return named.join(done, "_k").select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score",
                                         "score", "bits_per_byte")
