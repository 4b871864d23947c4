"""Language identification with hyperdimensional profiles.

Every character gets a random vector of +1 and -1, derived from its code point
alone. An n-gram's vector binds (multiplies) its letters' vectors, each rotated
by its place; a text's vector bundles (sums) those of all its n-grams; a
language's prototype bundles the unit vectors of its training texts. A text is
given the language whose prototype has the largest cosine with it.

Prototypes are integer sums of rounded unit vectors, so they do not depend on
how rows are dealt out. One vector of ``DIM`` longs per language is all that
reaches the driver; ``MAX_LANGS`` bounds their number (an error, not a cut).

Defined results: a null text, or one without letters, is ``und`` with score 0;
null languages teach nothing; an empty or unlabelled table predicts ``und``;
repeated rows each count and each get a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

DIM, GRAM, MAX_LANGS = 1024, 3, 1000
#: Unit vectors are rounded to this many parts before they are summed.
SCALE = 1 << 20
#: Gram vectors kept by a worker, characters handled at once.
CACHE, CHUNK = 30_000, 1 << 18

_SPACE = 32
_isletter: np.ndarray | None = None


def _letters(codes: np.ndarray) -> np.ndarray:
    """Which code points are letters (table over all of Unicode, built once)."""
    global _isletter
    if _isletter is None:
        _isletter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _isletter[codes]


class Profiles:
    """Bundled n-gram vectors of texts."""

    def __init__(self, dim: int = DIM, gram: int = GRAM):
        self.dim, self.gram = dim, gram
        self._letter: dict[int, np.ndarray] = {}
        self._row: dict[int, int] = {}
        self._grams = np.empty((0, dim), np.float32)

    def _letter_vector(self, c: int) -> np.ndarray:
        v = self._letter.get(c)
        if v is None:
            bits = np.random.default_rng([c, self.dim]).integers(0, 2, self.dim, dtype=np.int8)
            v = self._letter[c] = (bits * 2 - 1).astype(np.float32)
        return v

    def _vectors(self, codes: np.ndarray) -> np.ndarray:
        """One row per n-gram code: the product of its rotated letters."""
        if len(self._row) > CACHE:
            self._row, self._grams = {}, np.empty((0, self.dim), np.float32)
        new = [c for c in codes.tolist() if c not in self._row]
        if new:
            rows = np.ones((len(new), self.dim), np.float32)
            for r, code in zip(rows, new):
                for place in range(self.gram):
                    r *= np.roll(self._letter_vector(code >> 21 * (self.gram - 1 - place) & 0x1FFFFF), place)
            self._row.update(zip(new, range(len(self._grams), len(self._grams) + len(new))))
            self._grams = np.concatenate((self._grams, rows))
        return self._grams[[self._row[c] for c in codes.tolist()]]

    def codes(self, text: str) -> np.ndarray:
        """n-gram codes of the lower-cased words, a blank around each word."""
        raw = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        raw = np.where(_letters(raw), raw, _SPACE).astype(np.int64)
        raw = raw[(raw != _SPACE) | np.concatenate(([True], raw[:-1] != _SPACE))]
        n = len(raw) - self.gram + 1
        if n < 1 or len(raw) < 3:
            return np.empty(0, np.int64)
        out = np.zeros(n, np.int64)
        for i in range(self.gram):
            out = (out << 21) | raw[i:i + n]
        return out

    def bundle(self, texts: list[str]) -> np.ndarray:
        """(len(texts), dim) unit vectors; a text without letters has zeros."""
        out = np.zeros((len(texts), self.dim), np.float64)
        held: list[tuple[int, np.ndarray]] = []
        size = 0
        for i, text in enumerate(texts):
            for at in range(0, len(text), CHUNK):  # a very long text in parts: bundles add up
                held.append((i, self.codes(text[at:at + CHUNK])))
                size += len(held[-1][1])
                if size > CHUNK:
                    self._add(out, held)
                    held, size = [], 0
        self._add(out, held)
        norm = np.sqrt((out * out).sum(1))
        return out / np.where(norm == 0, 1, norm)[:, None]

    def _add(self, out: np.ndarray, held: list[tuple[int, np.ndarray]]) -> None:
        held = [(i, c) for i, c in held if len(c)]
        if not held:
            return
        distinct, place = np.unique(np.concatenate([c for _, c in held]), return_inverse=True)
        rows = np.repeat(np.arange(len(held)), [len(c) for _, c in held])
        vectors = self._vectors(distinct)
        for a in range(0, len(held), 64):  # counts as a dense block of 64 texts
            pick = (rows >= a) & (rows < a + 64)
            counts = np.bincount((rows[pick] - a) * len(distinct) + place[pick], minlength=64 * len(distinct))
            part = counts.reshape(64, -1).astype(np.float32) @ vectors
            for j, (i, _) in enumerate(held[a:a + 64]):
                out[i] += part[j]


def prototypes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dim: int = DIM,
               gram: int = GRAM) -> dict[str, np.ndarray]:
    """Language -> unit prototype, learnt from all rows with text and language."""
    common.ready(docs.sparkSession)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, sums = Profiles(dim, gram), {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            texts = [t or "" for t in batch.column("text").to_pylist()]
            vectors = np.rint(made.bundle(texts) * SCALE).astype(np.int64)
            for name in set(langs):
                part = vectors[[x == name for x in langs]].sum(0)
                sums[name] = sums.get(name, 0) + part
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))],
                names=["lang", "v"])

    train = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).dropna()
    summed = (train.mapInArrow(partial, "lang string, v array<bigint>")
              .select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x")))
    each = summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
    rows = each.select("lang", F.col("v.x").alias("v")).orderBy("lang").limit(MAX_LANGS + 1).collect()
    if len(rows) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    out = {}
    for r in rows:
        v = np.array(r.v, np.float64)
        if v.any():
            out[r.lang] = v / np.sqrt((v * v).sum())
    return out


def identify(docs: DataFrame, learnt: dict[str, np.ndarray], text_col: str = "text", dim: int = DIM,
             gram: int = GRAM) -> DataFrame:
    """``docs`` with lang_pred, score (the best cosine, at least 0) and margin
    (its lead over the second)."""
    spark = docs.sparkSession
    common.ready(spark)
    names = sorted(learnt)
    sent = spark.sparkContext.broadcast(np.array([learnt[n] for n in names]).reshape(len(names), dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Profiles(dim, gram)
        for batch in batches:
            texts = [t or "" for t in batch.column(f"_in_{text_col}").to_pylist()]
            vectors = made.bundle(texts)
            pred, score, lead = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
            if names and len(texts):
                cos = np.round(vectors @ sent.value.T, 9)
                best, some = cos.argmax(1), vectors.any(1)
                top = np.sort(cos, 1)
                score = np.where(some, np.clip(top[:, -1], 0, 1), 0.0)
                lead = np.where(some, top[:, -1] - (top[:, -2] if len(names) > 1 else 0), 0.0)
                pred = [names[b] if s else "und" for b, s in zip(best, some)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score), pa.array(lead)],
                                             names=[*batch.schema.names, "lang_pred", "score", "margin"])

    df = docs.withColumnsRenamed({c: f"_in_{c}" for c in docs.columns})
    base = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    done = df.mapInArrow(run, f"{base}, `lang_pred` string, `score` double, `margin` double")
    return done.select(*(F.col(f"_in_{c}").alias(c) for c in docs.columns), "lang_pred", "score", "margin")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    held = common.held_out("doc_id", 4, 2)
    learnt = prototypes(docs.filter(~held))
    return identify(docs.select("doc_id", "text"), learnt).select(
        "doc_id", held.alias("held_out"), "lang_pred", "score", "margin")
