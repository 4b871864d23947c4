"""Document quality from a linear-chain conditional random field over lines.

Every line of a document is good or bad; a line's features are its own shares of
character classes, its length and repetition, and the same of the line before
and after it, and neighbouring labels depend on each other. A labelled document
gives its label to all its lines for training. A document's score is the mean
of its lines' forward-backward marginals of "good", weighted by line length.

Training takes the labelled texts, copies once, with the ``SAMPLE`` smallest
hashes (a documented bound; fewer: all), at most half of them of one label.
Training and scoring read whole texts.

Defined results: a null or empty text is one empty line; without rows of both
labels every line scores the share of label 1 (0.5 without labels) and, as
nothing was learnt, ``good`` keeps every document; null labels teach nothing;
repeated rows each get their row.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import common

SAMPLE = 4000
#: Shares of the labelled texts whose least hashes are found apart.
SHARES = 64
THRESHOLD, STEPS, L2 = 0.7, 300, 1e-3

# Character classes of UTF-8 bytes.
_LOWER, _UPPER, _DIGIT, _BLANK, _STOP, _SYMBOL, _LEAD, _FOLLOW = range(8)
_CLASSES = 8


def _table() -> np.ndarray:
    t = np.full(256, _SYMBOL, np.uint8)
    t[ord("a"):ord("z") + 1], t[ord("A"):ord("Z") + 1], t[ord("0"):ord("9") + 1] = _LOWER, _UPPER, _DIGIT
    t[:33] = _BLANK
    for c in b".,;:!?'\"":
        t[c] = _STOP
    t[0x80:0xC0], t[0xC0:] = _FOLLOW, _LEAD
    return t


_TABLE = _table()
#: Features of one line; a row of the chain has those of three lines.
WIDTH = 16


class Lines:
    """Line features of a batch of texts, laid end to end."""

    def __init__(self, texts: list[bytes]):
        joined = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(joined, np.uint8)
        ends = np.flatnonzero(raw == 10)
        starts = np.concatenate(([0], ends[:-1] + 1))
        sizes = np.array([len(t) + 1 for t in texts])
        #: First line of each text, and one past the last.
        self.first = np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))
        self.size = (ends - starts).astype(np.float64)
        kind = _TABLE[raw]
        share = np.empty((len(starts), _CLASSES))
        for c in range(_CLASSES):
            share[:, c] = np.add.reduceat((kind == c).astype(np.int32), starts)
        share[:, _BLANK] -= 1  # the line's end
        blank = kind == _BLANK
        word_starts = ~blank & np.concatenate(([True], blank[:-1]))
        words = np.add.reduceat(word_starts.astype(np.int32), starts).astype(np.float64)
        glued = np.zeros(len(raw), bool)  # symbols that follow a letter or digit
        glued[1:] = (kind[1:] == _SYMBOL) & (kind[:-1] != _BLANK) & (kind[:-1] != _SYMBOL)
        same = np.zeros(len(raw), bool)
        same[1:] = (raw[1:] == raw[:-1]) & ~blank[1:]
        n = np.maximum(self.size, 1)
        chars = np.maximum(share[:, :7].sum(1), 1)
        x = np.zeros((len(starts), WIDTH))
        for j, c in enumerate((_LOWER, _UPPER, _DIGIT, _STOP, _SYMBOL, _LEAD)):
            x[:, j] = share[:, c] / chars
        x[:, 6] = np.log1p(share[:, _SYMBOL])
        x[:, 7] = np.log1p(self.size) / 5
        x[:, 8] = np.minimum(n / np.maximum(words, 1), 40) / 10
        x[:, 9] = np.add.reduceat(glued.astype(np.int32), starts) / np.maximum(words, 1)
        x[:, 10] = np.add.reduceat(same.astype(np.int32), starts) / n
        x[:, 11] = self.size == 0
        x[:, 12] = np.minimum(words, 50) / 50
        x[:, 13:] = self._repeated(joined, starts, ends)
        edge = np.zeros(len(starts), bool)
        edge[self.first[:-1]] = True
        before, after = np.zeros_like(x), np.zeros_like(x)
        before[1:] = np.where(edge[1:, None], 0, x[:-1])
        after[:-1] = np.where(edge[1:, None], 0, x[1:])
        self.x = np.concatenate((x, before, after, np.ones((len(x), 1))), 1)

    def _repeated(self, joined: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of each line: whether it stands more than once in its text, the
        share of its words seen before in it, and that of doubled words."""
        out = np.zeros((len(starts), 3))
        lines = [joined[s:e] for s, e in zip(starts.tolist(), ends.tolist())]
        for i, line in enumerate(lines):
            words = line.split()
            if len(words) > 1:
                out[i, 1] = 1 - len(set(words)) / len(words)
                out[i, 2] = sum(map(eq, words, words[1:])) / (len(words) - 1)
        for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist()):
            if b - a > 1:
                seen = Counter(lines[a:b])
                out[a:b, 0] = [bool(x) and seen[x] > 1 for x in lines[a:b]]
        return out


class Chain:
    """Two-label linear chain: label 1 is good."""

    def __init__(self, prior: float = 0.5):
        self.fitted = False
        self.w = np.zeros(WIDTH * 3 + 1)  # score of good over bad
        self.w[-1] = np.log(prior / (1 - prior))
        self.t = np.zeros((2, 2))  # from label, to label
        self.mean, self.std = np.zeros(WIDTH * 3 + 1), np.ones(WIDTH * 3 + 1)

    def unary(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.std) @ self.w

    def marginals(self, u: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(good) of each line and the expected transitions, by forward and
        backward passes over all texts at once, position by position."""
        count = np.diff(first)
        order = np.argsort(-count, kind="stable")
        start, size = first[:-1][order], count[order]
        n = len(u)
        score = np.stack((np.zeros(n), u), 1)
        fwd, bwd = np.zeros((n, 2)), np.zeros((n, 2))
        longest = int(size[0]) if len(size) else 0
        # live[p]: texts with more than p lines.
        live = np.searchsorted(-size, -np.arange(longest), side="left")
        fwd[start[:live[0]] if longest else []] = score[start[:live[0]] if longest else []]
        for p in range(1, longest):
            i = start[:live[p]] + p
            f = fwd[i - 1][:, :, None] + self.t
            fwd[i] = np.logaddexp(f[:, 0], f[:, 1]) + score[i]
        for p in range(longest - 2, -1, -1):
            i = start[:live[p + 1]] + p
            b = self.t + (score[i + 1] + bwd[i + 1])[:, None, :]
            bwd[i] = np.logaddexp(b[:, :, 0], b[:, :, 1])
        both = fwd + bwd
        good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))
        last = np.zeros(n, bool)
        last[first[1:] - 1] = True
        i = np.flatnonzero(~last)
        pair = fwd[i][:, :, None] + self.t + (score[i + 1] + bwd[i + 1])[:, None, :]
        total = np.logaddexp(both[i, 0], both[i, 1])
        return good, np.exp(pair - total[:, None, None]).sum(0)

    def fit(self, lines: Lines, label: np.ndarray) -> Chain:
        """Maximum likelihood (Adam, full batch, weighted so that each label
        and, within it, each line length counts alike)."""
        first = lines.first
        y = np.repeat(label, np.diff(first)).astype(np.float64)
        self.mean, self.std = lines.x.mean(0), lines.x.std(0) + 1e-6
        self.mean[-1], self.std[-1] = 0, 1
        x = (lines.x - self.mean) / self.std
        last = np.zeros(len(y), bool)
        last[first[1:] - 1] = True
        i = np.flatnonzero(~last)
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[i].astype(int), y[i + 1].astype(int)), 1)
        theta = np.concatenate((self.w, self.t.ravel()))
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, STEPS + 1):
            self.w, self.t = theta[:-4], theta[-4:].reshape(2, 2)
            good, pairs = self.marginals(x @ self.w, first)
            g = np.concatenate(((y - good) @ x, (seen - pairs).ravel())) / len(y) - L2 * theta
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta + 0.05 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        self.w, self.t = theta[:-4], np.clip(theta[-4:], -2, 2).reshape(2, 2)
        self.fitted = True
        return self

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Length-weighted mean of the lines' marginals, one per text."""
        if not texts:
            return np.zeros(0)
        lines = Lines(texts)
        good, _ = self.marginals(self.unary(lines.x), lines.first)
        weight = lines.size + 1
        at = lines.first[:-1]
        return np.add.reduceat(good * weight, at) / np.add.reduceat(weight, at)


def _fitted(rows: list[tuple[int, int, bytes]]) -> Chain:
    """A chain from (label, hash, text) rows, in the order of label and hash."""
    rows = sorted(rows)
    if len({y for y, _, _ in rows}) < 2:
        return Chain(min(max(rows[0][0], 1e-6), 1 - 1e-6) if rows else 0.5)
    return Chain().fit(Lines([t for _, _, t in rows]), np.array([y for y, _, _ in rows]))


def sampled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """(y, h, t): at most ``sample`` labelled texts of ``docs``, half of either
    label, those of least hash, copies once."""
    marked = labels.filter(F.col(label_col).isin(0, 1)).select(
        F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("y"))
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    hashed = texts.select("_id", F.xxhash64("t").alias("h")).join(marked, "_id")
    # Only ids and hashes are shuffled, and of those each task's least ones.
    once = hashed.groupBy("h", "y").agg(F.min("_id").alias("_id"))
    # First the least of every share, then, of at most SHARES times that many, of each label.
    picked = once.withColumn("_s", F.pmod(F.xxhash64("h"), F.lit(SHARES)))
    for by in (("y", "_s"), ("y",)):
        least = Window.partitionBy(*by).orderBy("h")
        picked = picked.withColumn("_r", F.row_number().over(least)).filter(F.col("_r") <= sample // 2).drop("_r")
    picked = picked.drop("_s")
    whole = texts.withColumn("h", F.xxhash64("t")).join(F.broadcast(picked), ["_id", "h"])  # ``sample`` rows at most
    return whole.dropDuplicates(["h", "y"]).select("y", "h", "t")  # an id may have many rows


def train(docs: DataFrame, labels: DataFrame, **how) -> Chain:
    """A chain fitted to ``sampled`` documents by one executor task; only its
    weights come to the driver."""
    common.ready(docs.sparkSession)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, bytes]] = []
        for batch in batches:
            rows += zip(batch.column("y").to_pylist(), batch.column("h").to_pylist(), common.text_bytes(batch.column("t")))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(_fitted(rows))], pa.binary())], names=["chain"])

    made = sampled(docs, labels, **how).repartition(1).mapInArrow(fit, "chain binary").first()
    return pickle.loads(bytes(made.chain)) if made else _fitted([])  # no task: no documents


def score(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """``docs`` with score, 0 to 1."""
    spark = docs.sparkSession
    common.ready(spark)
    sent = spark.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = common.text_bytes(batch.column(f"_in_{text_col}"))
            parts = [sent.value.scores(texts[a:b]) for a, b in common.slices(texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(parts or [np.zeros(0)]))],
                                             names=[*batch.schema.names, "score"])

    df = docs.withColumnsRenamed({c: f"_in_{c}" for c in docs.columns})
    base = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    done = df.mapInArrow(run, f"{base}, `score` double")
    return done.select(*(F.col(f"_in_{c}").alias(c) for c in docs.columns), "score")


def learnt(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Chain:
    return train(docs.filter(~common.held_out("doc_id", 4, 2)), common.documents(spark, sf_dir, "labels"))


def good(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """The documents that are not rejected: all, if nothing could be learnt."""
    if not chain.fitted:
        return docs
    scores = score(common.wrapped(docs), chain, f"_doc_{text_col}")
    return common.unwrapped(scores.filter(F.col("score") >= THRESHOLD), docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    chain = learnt(spark, docs, sf_dir)
    return score(docs.select("doc_id", "text"), chain).select(
        "doc_id", common.held_out("doc_id", 4, 2).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
