"""Substring dedup with repeated-phrase automata.

A window of ``WINDOW`` words that starts at more than one place of the corpus is
a recurring passage; every word that such a window covers is removed.

1. Every window has an anchor: the run of ``ANCHOR`` words inside it with the
   least hash. Equal windows have equal anchors, so a window can recur only if
   its anchor does. Chunks of documents send out their anchors' hashes and get
   back those that occur more than once.
2. The windows that share a recurring anchor are one fragment of a document.
   Equal fragments are folded; window hashes (128 bits) of the distinct ones are
   counted, and windows counted more than once are confirmed.
3. The confirmed phrases are compiled into Aho-Corasick automata over words,
   sharded by anchor; the fragments of all documents, each distinct one once,
   are streamed through the automaton of their anchor's shard, which locates
   every occurrence word for word. Words outside the fragments have been shown
   to lie in no recurring window.

Shards take a bounded number of phrases and fragments: one with more fragments
is salted (its phrases are sent to every part), one with more phrases is cut.

Defined results: a null or wordless text keeps nothing and removes nothing;
repeated rows (null ids too) are documents of their own and so recur; a text
below ``WINDOW`` words is kept; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import gc
import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

WINDOW, ANCHOR = 35, 10
#: Bytes of texts hashed at a time.
BYTES = 1 << 18
#: Documents of a chunk as a power of two; fragments with phrases and streamed
#: fragments of one part of a shard.
CHUNK_BITS, PHRASES, STREAMED = 12, 1500, 20_000

_SECOND = 0xD6E8FEB86659FD93
_SINGLE = 1 << 62


def anchors(words: np.ndarray, size: np.ndarray, window: int = WINDOW,
            gram: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the word hashes of texts of ``size`` words, end to end: each
    fragment's text, its first and last window there, and its anchor's hash.
    The windows from first to last share one anchor."""
    n = len(words) - window + 1
    if n < 1:
        empty = np.empty(0, np.int64)
        return empty, empty, empty, empty
    end = np.cumsum(size)
    grams = common.window_hash(words, gram)
    bits = np.uint64(max(24, len(grams).bit_length()))
    least = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)  # leftmost of equals
    width, span = window - gram + 1, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[:n], least[width - span:width - span + n])
    text = np.repeat(np.arange(len(size)), size)[:n]
    at = np.flatnonzero(np.arange(window, window + n) <= end[text])  # windows inside one text
    if not len(at):
        return at, at, at, at
    place = (least[at] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    last = np.append(first[1:] - 1, len(at) - 1)
    text = text[at[first]]
    start = (end - size)[text]
    return text, at[first] - start, at[last] - start, common.as_long(grams[place[first]])


_BASE = 0x9E3779B97F4A7C15 | 1


@functools.lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of the base, and of its inverse modulo 2 ** 64."""
    steps = (np.full(n - 1, b, np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    return tuple(np.cumprod(np.concatenate((np.ones(1, np.uint64), step))) for step in steps)


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' words, end to end, and each text's number of words.

    Polynomial hashes by prefix sums over the bytes, a block of ``BYTES`` at a
    time, cut after a blank.
    """
    data = b" ".join([*texts, b""])
    edge = np.cumsum([len(t) + 1 for t in texts])
    out, size, pos = [np.empty(0, np.uint64)], np.zeros(len(texts), np.int64), 0
    while pos < len(data):
        most = BYTES
        while True:
            u = np.frombuffer(data, np.uint8, min(most, len(data) - pos), pos)
            blank = (u == 32) | ((u >= 9) & (u <= 13))
            if blank.any():
                break
            most *= 2  # one word longer than the block; the data ends with a blank
        cut = len(u) - int(np.argmax(blank[::-1]))
        u, blank = u[:cut], blank[:cut]
        before = np.concatenate(([True], blank[:-1]))
        start, end = np.flatnonzero(~blank & before), np.flatnonzero(blank & ~before)
        up, down = _powers(most)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((u + np.uint64(1)) * up[:cut])))
        out.append(common.mix((total[end] - total[start]) * down[start]))
        if len(start):
            size += np.bincount(np.searchsorted(edge, start + pos, side="right"), minlength=len(texts))
        pos += cut
    return np.concatenate(out), size


def _lean(docs: DataFrame, text_col: str) -> DataFrame:
    return common.chunked(docs, CHUNK_BITS, "_k", F.col(text_col).alias("t"))


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_c, h, n): how often a chunk's documents of this task hold each anchor."""
    chunk, held = None, []

    def counted() -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), chunk, np.int64)), pa.array(h), pa.array(n)], names=["_c", "h", "n"])

    for batch in batches:
        chunks, texts = batch.column("_c").to_numpy(), common.text_bytes(batch.column("t"))
        for start, end in common.stretches(chunks):
            if chunks[start] != chunk:
                if held:
                    yield counted()
                chunk, held = int(chunks[start]), []
            own = texts[start:end]
            for a, b in common.slices(own):
                held.append(anchors(*hashed(own[a:b]))[3])
    if held:
        yield counted()


def _mark(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """A chunk's documents with their fragments; the text only where there are
    any. Raises if they are not the documents that asked."""
    again, place = np.unique(answers.column("h").to_numpy(), return_inverse=True)
    missing = np.bincount(place, answers.column("n").to_numpy(), len(again)).astype(np.int64)
    texts = common.text_bytes(docs.column("t").combine_chunks())
    n_words, count, kept, sha = [], [], [], []
    lists: list[list[np.ndarray]] = [[], [], []]
    for a, b in common.slices(texts):
        words, size = hashed(texts[a:b])
        text, first, last, h = anchors(words, size)
        at = np.minimum(np.searchsorted(again, h), max(0, len(again) - 1))
        m = again[at] == h if len(again) else np.zeros(len(h), bool)
        missing -= np.bincount(at[m], minlength=len(again))
        held = np.bincount(text[m], minlength=b - a)
        n_words.append(size)
        count.append(held)
        for own, values in zip(lists, (first, last, h)):
            own.append(values[m])
        for t, some in zip(texts[a:b], held.tolist()):
            kept.append(t if some else None)
            sha.append(None if some else hashlib.sha256(b" ".join(t.split())).hexdigest())
    if missing.any():
        raise RuntimeError("a chunk's documents changed between two passes: its anchors are not those it asked for")
    edge = pa.array(np.concatenate([[0], *count]).cumsum().astype(np.int32))
    listed = [pa.ListArray.from_arrays(edge, pa.array(np.concatenate([np.empty(0, np.int64), *own]))) for own in lists]
    return pa.table({"_k": docs.column("_k"), "n_words": pa.array(np.concatenate([np.empty(0, np.int64), *n_words])),
                     "sha": pa.array(sha, pa.string()), "text": pa.array(kept, pa.binary()),
                     **dict(zip(("first", "last", "h"), listed))})


_MARKED = "_k long, n_words long, sha string, text binary, first array<bigint>, last array<bigint>, h array<bigint>"


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_k, first, h, f1, f2, phrase): each fragment's words, and a hash of them."""
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("_k", "text", "first", "last", "h")]
        out: list[list] = [[] for _ in range(6)]
        for key, text, first, last, h in zip(*cols):
            words = text.split()
            for a, b, anchor in zip(first, last, h):
                phrase = b" ".join(words[a:b + WINDOW])
                f = xxhash.xxh3_128_intdigest(phrase)
                for col, v in zip(out, (key, a, anchor, _signed(f >> 64), _signed(f), phrase)):
                    col.append(v)
        kinds = [pa.int64()] * 5 + [pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["_k", "first", "h", "f1", "f2", "phrase"])


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w1, w2, n, x) of every window of the distinct fragments. ``x`` names one
    place of it: whether its fragment occurs once, 56 bits of the fragment's
    hash, and the window's number in the fragment."""
    for batch in batches:
        words, size = hashed(batch.column("phrase").to_pylist())
        end = np.cumsum(size)
        # Windows over all phrases end to end; those across an edge are left out.
        at = np.arange(max(0, len(words) - WINDOW + 1))
        row = np.searchsorted(end, at, side="right")
        within = at + WINDOW <= end[row] if len(at) else np.zeros(0, bool)
        at, row = at[within], row[within]
        w1 = common.as_long(common.window_hash(words, WINDOW))[within]
        w2 = common.as_long(common.window_hash(words, WINDOW, _SECOND))[within] >> 32
        n, f1 = batch.column("n").to_numpy(), batch.column("f1").to_numpy()
        x = ((f1 >> 7 & (1 << 56) - 1) << 6 | np.where(n == 1, _SINGLE, 0))[row] | (at - (end - size)[row])
        yield pa.RecordBatch.from_arrays([pa.array(w1), pa.array(w2.astype(np.int32)), pa.array(np.minimum(n, 2)[row].astype(np.int32)),
                                          pa.array(x)], names=["w1", "w2", "n", "x"])


def _located(streamed: pa.Table, phrases: pa.Table) -> pa.Table:
    """(f1, f2, at): the windows of the streamed fragments in which a window of
    a phrase occurs.

    The words that all confirmed windows of a phrase share, its core, go into
    the automaton; where a core occurs, the words on both sides tell which of
    the phrase's windows do.
    """
    ids: dict[bytes, int] = {}
    cores: dict[tuple[int, ...], list[tuple[tuple[int, ...], int, int, frozenset[int]]]] = {}
    texts = phrases.column("phrase").to_pylist()
    hashes, size = hashed(texts)
    windows = common.as_long(common.window_hash(hashes, WINDOW))
    for phrase, n, end, at, w1 in zip(texts, size.tolist(), np.cumsum(size).tolist(), *(phrases.column(c).to_pylist() for c in ("at", "w1"))):
        words = tuple(ids.setdefault(w, len(ids) + 1) for w in phrase.split())
        if at is None:
            sure = range(n - WINDOW + 1)
        else:  # a place's hash bits may be another fragment's: its window's hash decides
            sure = [a for a, h in zip(at, w1) if a <= n - WINDOW and windows[end - n + a] == h]
        if len(sure):
            low, high = max(sure), min(sure) + WINDOW
            cores.setdefault(words[low:high], []).append((words, low, high, frozenset(sure)))
    machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for core, found in cores.items():
        machine.add_word(core, (len(core), found))
    out: list[list] = [[], [], []]
    if len(machine):
        machine.make_automaton()
        for f1, f2, phrase in zip(*(streamed.column(c).to_pylist() for c in ("f1", "f2", "phrase"))):
            words = tuple(ids.get(w, 0) for w in phrase.split())
            starts: set[int] = set()
            for last, (size, found) in machine.iter(words):
                end = last + 1
                for known, low, high, sure in found:
                    shift = end - high  # the phrase's first word, were it all there
                    left = low
                    while left and shift + left > 0 and known[left - 1] == words[shift + left - 1]:
                        left -= 1
                    right = high
                    while right < len(known) and shift + right < len(words) and known[right] == words[shift + right]:
                        right += 1
                    starts.update(shift + a for a in range(left, right - WINDOW + 1) if a in sure)
            if starts:
                for col, v in zip(out, (f1, f2, sorted(starts))):
                    col.append(v)
    return pa.table({"f1": pa.array(out[0], pa.int64()), "f2": pa.array(out[1], pa.int64()),
                     "at": pa.array(out[2], pa.list_(pa.int64()))})


def _locate(streamed: pa.Table, phrases: pa.Table) -> pa.Table:
    gc.disable()  # millions of small tuples without cycles: scanning them is in vain
    try:
        return _located(streamed, phrases)
    finally:
        gc.enable()


def _sharded(distinct: DataFrame, phrases: DataFrame) -> DataFrame:
    """Occurrences of ``phrases`` in the ``distinct`` fragments."""
    shards = max(1, -(-phrases.count() // PHRASES))
    shard = F.pmod(F.xxhash64("h"), F.lit(shards)).alias("shard")
    asked, held = distinct.select(shard, "f1", "f2", "phrase"), phrases.select(shard, "f1", "phrase", "at", "w1")
    size = (asked.select("shard", F.lit(1).alias("s"), F.lit(0).alias("p")).unionByName(
        held.select("shard", F.lit(0).alias("s"), F.lit(1).alias("p"))).groupBy("shard").agg(F.sum("s").alias("s"), F.sum("p").alias("p"))
        .filter("p > 0").select("shard", F.ceil(F.col("s") / STREAMED).alias("salts"), F.ceil(F.col("p") / PHRASES).alias("cuts")))
    asked = asked.join(size, "shard").select("*", F.pmod("f1", "salts").alias("salt"),
                                             F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)).alias("cut"))
    held = held.join(size, "shard").select("*", F.pmod("f1", "cuts").alias("cut"),
                                           F.explode(F.sequence(F.lit(0).cast("long"), F.greatest("salts", F.lit(1)) - 1)).alias("salt"))
    part = ("shard", "cut", "salt")
    return asked.select(*part, "f1", "f2", "phrase").groupBy(*part).cogroup(
        held.select(*part, "phrase", "at", "w1").groupBy(*part)).applyInArrow(_locate, "f1 long, f2 long, at array<bigint>")


def _clean(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, kept = [], []
        for text, starts in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist()):
            words = text.split()
            edge = np.zeros(len(words) + 1, np.int64)
            at = np.unique(np.array(starts or [], np.int64))
            np.add.at(edge, at, 1)
            np.add.at(edge, at + WINDOW, -1)
            gone = np.cumsum(edge[:-1]) > 0
            removed.append(int(gone.sum()))
            left = b" ".join(w for w, g in zip(words, gone.tolist()) if not g)
            kept.append(left if texts else hashlib.sha256(left).hexdigest().encode())
        yield pa.RecordBatch.from_arrays([batch.column("_k"), batch.column("n_words"), pa.array(removed, pa.int64()),
                                          pa.array(kept, pa.binary())], names=["_k", "n_words", "n_removed", "kept"])


def occurrences(marked: DataFrame) -> DataFrame:
    """(_k, starts): the recurring windows' starts of every document that has
    any, of documents ``marked`` with their fragments."""
    found = marked.filter("text is not null").select("_k", "text", "first", "last", "h").mapInArrow(
        _fragments, "_k long, first long, h long, f1 long, f2 long, phrase binary")
    distinct = common.staged(found.groupBy("f1", "f2").agg(
        F.count(F.lit(1)).alias("n"), F.first("h").alias("h"), F.first("phrase").alias("phrase")))
    windows = distinct.select("phrase", "n", "f1").mapInArrow(_windows, "w1 long, w2 int, n int, x long")
    # A confirmed window is compiled from one fragment that holds it, at best
    # one that recurs as a whole, whose windows are all compiled anyway.
    sure = (windows.groupBy("w1", "w2").agg(F.sum("n").alias("n"), F.min("x").alias("x"))
            .filter((F.col("n") > 1) & (F.col("x").bitwiseAND(F.lit(_SINGLE)) != 0)))
    partly = sure.groupBy(F.shiftright("x", 6).bitwiseAND(F.lit((1 << 56) - 1)).alias("f")).agg(
        F.collect_list(F.struct(F.col("x").bitwiseAND(F.lit(63)).alias("at"), "w1")).alias("s"))
    partly = common.staged(partly)  # the windows' shuffle goes before the phrases are joined
    none = F.lit(None).cast("array<bigint>")
    single = distinct.filter("n = 1").withColumn("f", F.shiftright("f1", 7).bitwiseAND(F.lit((1 << 56) - 1)))
    phrases = common.staged(
        distinct.filter("n > 1").select("h", "f1", "phrase", none.alias("at"), none.alias("w1"))
        .unionByName(single.join(partly, "f").select("h", "f1", "phrase", F.col("s.at").alias("at"), F.col("s.w1").alias("w1"))))
    # Each step is staged, so that the phrases' shuffles and tables are gone
    # before the next one writes its own.
    hits = common.staged(_sharded(distinct, phrases))
    common.discard(distinct)
    common.discard(phrases)
    common.discard(partly)
    placed = found.select("_k", "first", "f1", "f2").join(hits, ["f1", "f2"])
    starts = placed.select("_k", F.transform("at", lambda a: a + F.col("first")).alias("s"))
    starts = common.staged(starts.groupBy("_k").agg(F.array_distinct(F.flatten(F.collect_list("s"))).alias("starts")))
    common.discard(hits)
    return starts


def dedup(docs: DataFrame, text_col: str = "text", texts: bool = True) -> DataFrame:
    """(_k, n_words, n_removed, kept) of ``docs`` (unique key ``_k``). ``kept``
    holds the words left, joined by one blank, or, without ``texts``, only
    their SHA-256 in hex."""
    common.ready(docs.sparkSession)
    lean = _lean(docs, text_col)
    gathered = common.staged(lean.mapInArrow(_gather, "_c long, h long, n long"))
    asked = gathered.repartition("h")
    again = asked.groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h")
    answers = asked.select("_c", "h", "n").join(again, "h")
    marked = common.staged(lean.groupBy("_c").cogroup(answers.groupBy("_c")).applyInArrow(_mark, _MARKED))
    common.discard(gathered)
    starts = occurrences(marked)
    some = marked.filter("text is not null").select("_k", "n_words", "text").join(starts, "_k", "left")
    done = some.mapInArrow(lambda b: _clean(b, texts), "_k long, n_words long, n_removed long, kept binary")
    if texts:
        whole = docs.select("_k", F.col(text_col).alias("t")).join(marked.filter("text is null").select("_k", "n_words"), "_k")
        joined = F.array_join(F.filter(F.split(F.coalesce("t", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != ""), " ")
        rest = whole.select("_k", "n_words", F.lit(0).cast("long").alias("n_removed"), joined.cast("binary").alias("kept"))
    else:
        rest = marked.filter("text is null").select("_k", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").cast("binary").alias("kept"))
    return rest.unionByName(done).withColumn("kept", F.col("kept").cast("string"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.keyed(common.documents(spark, sf_dir), "doc_id", "text")
    done = dedup(docs, texts=False)
    return done.join(docs.select("_k", "doc_id"), "_k").select(
        "doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def brute(texts: list[str | None], window: int = WINDOW) -> list[tuple[int, int, str]]:
    """(n_words, n_removed, kept_sha256) of each text by direct counting; used
    by the tests."""
    split = [(t or "").encode().split() for t in texts]
    seen: dict[tuple[bytes, ...], int] = {}
    for ws in split:
        for i in range(len(ws) - window + 1):
            seen[tuple(ws[i:i + window])] = seen.get(tuple(ws[i:i + window]), 0) + 1
    out = []
    for ws in split:
        gone = set()
        for i in range(len(ws) - window + 1):
            if seen[tuple(ws[i:i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((len(ws), len(gone), hashlib.sha256(kept).hexdigest()))
    return out
