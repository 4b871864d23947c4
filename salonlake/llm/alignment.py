"""Cross-tokenizer alignment by divide and conquer at shared cuts.

A text is encoded by two tokenizers whose tokens cover the same bytes. An
interval of both token lists is cut at an end that both share near its middle:
ends of A are looked up in those of B by bisection, first the middle one, then
rings around it of doubling width, and both halves are treated likewise; an
interval without a shared end inside is a leaf group. All intervals of a level,
over many texts, are handled by one vectorised search. Tokens of a group are
linked where their bytes overlap.

Neither tokenizer joins a space to a character other than white space before
it. So a task encodes each different word once, as long as it remembers it, and
very long texts are aligned in stretches that are cut there.

Counts of linked id pairs speak of the whole corpus. Every task gathers its
chunk's distinct pairs; Spark sums them, finds each B id's highest (a B id has
no more pairs than A's vocabulary has ids), and sends every chunk the counts of
its own pairs only. Documents keep their links as places in their chunk's pairs,
staged beside them, so texts are neither shuffled nor encoded again.

Defined results: null and empty texts, and texts that a tokenizer changes (such
as those with U+2581) have no tokens: zeros and an empty groups text; rows with
null or repeated ids are documents of their own; an empty table gives an empty
table. ``aligned`` reads the id and text columns only, whatever others are there.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import common, tokens

#: Characters of text whose links a task holds before it hands on a chunk, and of a stretch aligned at once.
CHUNK, STRETCH = 6 << 20, 1 << 19
#: Words that a task remembers, and characters of new words encoded in one go.
WORDS, RUN = 300_000, 4000
#: Where neither tokenizer joins: before a space that follows no white space.
_CUT = re.compile(r"(?<=\S)(?= )")


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# Tokens

class _Words(dict):
    """Place of each word (the text between two cuts, without its space)."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, w: str) -> int:
        i = self[w] = len(self)
        self.new.append(w)
        return i


def _open(w: str) -> bool:
    """Whether a space after ``w`` might be joined to its end."""
    return not w or w[-1].isspace()


class Pair:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self._a = tokens.coder(path_a, True)
        self._b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        shown = {chr(c): c for c in tokens._PRINTED}
        shown |= {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in set(tokens._PRINTED))}
        held = Tokenizer.from_file(path_a)
        special = {t.content for t in held.get_added_tokens_decoder().values()}
        self.bytes_a = [b""] * held.get_vocab_size(True)
        for t, i in held.get_vocab(True).items():
            self.bytes_a[i] = t.encode() if t in special else bytes(map(shown.__getitem__, t))
        self.bytes_b = [self._piece(i) for i in range(self._b.vocab_size())]
        self.len_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.len_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self._space = self._b.piece_to_id("▁")
        self._forget()

    def _forget(self) -> None:
        self._words = _Words()
        self._ids = [np.empty(0, np.int32)] * 2
        self._to = [np.zeros(1, np.int64)] * 2  # where each word's ids end, A and B
        self._kind = np.empty(0, np.int8)  # 1: open, 2: changed by a tokenizer

    def _piece(self, i: int) -> bytes:
        piece = self._b.id_to_piece(i)
        if self._b.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def _run(self, words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], bool]:
        """Ids and where each word's end, of words in one go; False if a
        tokenizer changes one of them."""
        text = " " + " ".join(words)
        raw = text.encode()
        ids = [np.frombuffer(self._a.encode(text), "<u4").astype(np.int32),
               np.array([self._space] if text == " " else self._b.encode(text[1:]), np.int32)]
        ends = np.cumsum([len(w.encode()) + 1 for w in words])
        to, same = [], True
        for x, shown, size in zip(ids, (self.bytes_a, self.bytes_b), (self.len_a, self.len_b)):
            same = same and b"".join(map(shown.__getitem__, x.tolist())) == raw
            at = np.cumsum(size[x])
            cut = np.searchsorted(at, ends)
            same = same and bool((at[cut] == ends).all())
            to.append(cut + 1)
        return ids, to, same

    def _learn(self) -> None:
        """Encodes the words that are new."""
        new, self._words.new = self._words.new, []
        ids, to = [[self._ids[i]] for i in (0, 1)], [[self._to[i]] for i in (0, 1)]
        kind = np.fromiter(map(_open, new), np.int8, len(new))
        groups, size = [[]], 0
        for w, apart in zip(new, kind.tolist()):
            if apart or size > RUN:
                groups.append([])
                size = 0
            groups[-1].append(w)
            size = RUN + 1 if apart else size + len(w) + 1
        at = 0
        for g in filter(None, groups):
            made = [self._run(g)]
            if not made[0][2]:
                made = [self._run([w]) for w in g]
                kind[at:at + len(g)] += 2 * np.array([not same for _, _, same in made], np.int8)
            at += len(g)
            for x, end, same in made:
                for i in (0, 1):
                    base = to[i][-1][-1]
                    ids[i].append(x[i] if same else x[i][:0])
                    to[i].append(end[i] + base if same else np.full(len(end[i]), base))
        self._ids, self._to = [np.concatenate(x) for x in ids], [np.concatenate(x) for x in to]
        self._kind = np.concatenate([self._kind, kind])

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], list[list[int]]]:
        """Ids (A, B) of all units of ``texts``, end to end; where each unit's end;
        and each text's units, none if a tokenizer changes the text. A unit is a
        text, or a stretch of a long one."""
        if len(self._words) > WORDS:
            self._forget()
        place = self._words.__getitem__
        found = [np.fromiter(map(place, t.split(" ")), np.int64) for t in texts]
        self._learn()
        for i, at in enumerate(found):  # white space before a space: cut by the rule
            if (self._kind[at[:-1]] & 1).any():
                found[i] = np.fromiter((place(w[1:]) for w in _CUT.split(" " + texts[i])), np.int64)
        self._learn()
        units, of = [], []
        for t, at in zip(texts, found):
            if (self._kind[at] & 2).any():
                of.append([])
                continue
            cut = [0, len(at)]
            if len(t) > STRETCH:
                step = np.cumsum(self._to[0][at + 1] - self._to[0][at]) // STRETCH  # of STRETCH ids at most
                cut = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(at)]
            of.append(list(range(len(units), len(units) + len(cut) - 1)))
            units += [at[x:y] for x, y in zip(cut, cut[1:])]
        at = np.concatenate(units) if units else np.empty(0, np.int64)
        ends = np.cumsum([len(u) for u in units]).astype(np.int64)
        out, to = [], []
        for ids, end in zip(self._ids, self._to):
            n = end[at + 1] - end[at]
            upto = np.cumsum(n)
            out.append(ids[np.arange(n.sum()) + np.repeat(end[at] - upto + n, n)])
            to.append(upto[ends - 1] if len(ends) else ends)
        return out, to, of


@cache
def pair(path_a: str, path_b: str) -> Pair:
    """One for each worker process."""
    return Pair(path_a, path_b)


# Alignment

def _rings(mid: np.ndarray, low: np.ndarray, high: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (and whose they are) at distances [width // 2, width) of each
    ``mid`` that lie in [low, high)."""
    inner = width // 2
    la, lb = np.maximum(mid - width + 1, low), np.minimum(mid - inner + 1, high)
    ra, rb = np.maximum(mid + max(inner, 1), low), np.minimum(mid + width, high)
    a, n = np.concatenate([la, ra]), np.maximum(np.concatenate([lb - la, rb - ra]), 0)
    whose = np.repeat(np.tile(np.arange(len(mid)), 2), n)
    start = np.cumsum(n) - n
    return np.arange(n.sum()) - np.repeat(start - a, n), whose


def leaves(ends_a: np.ndarray, ends_b: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First A and first B token of every leaf group, in order.

    ``ends`` are rising byte offsets of token ends; ``whole`` (rows a0, a1, b0,
    b1) are the intervals of tokens to begin with, each covering equal bytes.
    """
    done = []
    while whole.shape[1]:
        a0, a1, b0, b1 = whole
        inner = (a1 - a0 > 1) & (b1 - b0 > 1)
        done.append(whole[:, ~inner])
        a0, a1, b0, b1 = whole = whole[:, inner]
        mid, cut_a, cut_b = (a0 + a1 - 1) // 2, np.zeros(len(a0), np.int64), np.zeros(len(a0), np.int64)
        open_, width = np.arange(len(a0)), 1
        while len(open_):
            at, whose = _rings(mid[open_], a0[open_], a1[open_] - 1, width)  # the last end is no inner one
            j = np.searchsorted(ends_b, ends_a[at])
            hit = ends_b[np.minimum(j, len(ends_b) - 1)] == ends_a[at]
            at, j, whose = at[hit], j[hit], open_[whose[hit]]
            far = np.abs(at - mid[whose])
            order = np.lexsort((far, whose))
            at, j, whose = at[order], j[order], whose[order]
            lead = np.append(True, whose[1:] != whose[:-1])[:len(whose)]
            cut_a[whose[lead]], cut_b[whose[lead]] = at[lead] + 1, j[lead] + 1
            width *= 2
            gone = (mid[open_] - width // 2 < a0[open_]) & (mid[open_] + width // 2 >= a1[open_] - 1)
            open_ = open_[(cut_a[open_] == 0) & ~gone]
        found = cut_a > 0
        done.append(whole[:, ~found])
        a0, a1, b0, b1 = whole[:, found]
        ca, cb = cut_a[found], cut_b[found]
        whole = np.concatenate([np.stack([a0, ca, b0, cb]), np.stack([ca, a1, cb, b1])], axis=1)
    out = np.concatenate(done, axis=1)
    first_b = np.full(len(ends_a), -1)
    first_b[out[0]] = out[2]
    first_a = np.flatnonzero(first_b >= 0)
    return first_a, first_b[first_a]


def linked(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens (A's, B's place) that overlap: one pair for every stretch between
    neighbouring ends of either."""
    if not len(ends_a):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    last = np.zeros(int(ends_a[-1]) + 1, np.int8)  # of each byte offset: bit 1 ends an A token, bit 2 a B token
    last[ends_a] = 1
    last[ends_b] |= 2
    ends = last[np.flatnonzero(last)]
    a, b = np.cumsum(ends & 1), np.cumsum(ends >> 1)
    return a - (ends & 1), b - (ends >> 1)


class _Text:
    """How both tokenizers' ids are written in the groups text."""

    def __init__(self, n_a: int, n_b: int):
        self.shown = [s for n, marks in ((n_a, b",|"), (n_b, b",;")) for m in marks for s in (b"%d%c" % (i, m) for i in range(n))]
        self.n_a, self.n_b = n_a, n_b

    def groups(self, a: np.ndarray, b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> bytes:
        """``a1,a2|b1;a3|b2,b3;`` of the groups that begin at these tokens."""
        last_a, last_b = np.append(first_a[1:], len(a)) - 1, np.append(first_b[1:], len(b)) - 1
        code_a, code_b = a.astype(np.int64), b.astype(np.int64) + 2 * self.n_a
        code_a[last_a] += self.n_a
        code_b[last_b] += self.n_b
        at_a = np.arange(len(a)) + np.repeat(first_b, last_a - first_a + 1)  # B tokens of earlier groups come before
        at_b = np.arange(len(b)) + np.repeat(last_a + 1, last_b - first_b + 1)
        row = np.empty(len(a) + len(b), np.int64)
        row[at_a], row[at_b] = code_a, code_b
        return b"".join(map(self.shown.__getitem__, row.tolist()))


@cache
def _written(n_a: int, n_b: int) -> _Text:
    return _Text(n_a, n_b)


def align(a: np.ndarray, b: np.ndarray, len_a: np.ndarray, len_b: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first A, first B token of each group; A, B token of each link) of two
    id lists over the same bytes, given the byte lengths of all ids."""
    ends_a, ends_b = np.cumsum(len_a[a]), np.cumsum(len_b[b])
    whole = np.array([[0], [len(a)], [0], [len(b)]], np.int64)
    return *leaves(ends_a, ends_b, whole), *linked(ends_a, ends_b)


def _aligned(ids: list[np.ndarray], to: list[np.ndarray], made: Pair) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """Groups, their text and the link codes (A id, B id) of units that lie end
    to end and end at ``to``, all at once."""
    (a, b), (to_a, to_b) = ids, to
    if not len(to_a):
        return
    ends_a, ends_b = np.cumsum(made.len_a[a]), np.cumsum(made.len_b[b])
    whole = np.stack([np.append(0, to_a[:-1]), to_a, np.append(0, to_b[:-1]), to_b])
    first_a, first_b = leaves(ends_a, ends_b, whole)
    link_a, link_b = linked(ends_a, ends_b)
    codes = a[link_a].astype(np.int64) << 32 | b[link_b]
    text = _written(len(made.bytes_a), len(made.bytes_b))
    cut_g, cut_l = np.searchsorted(first_a, whole[0]), np.searchsorted(link_a, whole[0])
    for k, (g0, g1, l0, l1) in enumerate(zip(cut_g, np.append(cut_g[1:], len(first_a)), cut_l, np.append(cut_l[1:], len(codes)))):
        a0, a1, b0, b1 = whole[:, k]
        yield int(g1 - g0), text.groups(a[a0:a1], b[b0:b1], first_a[g0:g1] - a0, first_b[g0:g1] - b0), codes[l0:l1]


# Corpus

_ROW = pa.schema([("chunk", pa.string()), ("_k", pa.string()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                  ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("places", pa.binary()), ("times", pa.binary()),
                  ("codes", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])
_ROW_SQL = ("chunk string, _k string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places binary, times binary, "
            "codes array<bigint>, counts array<bigint>")


class _Chunk:
    """Documents of a task until their texts are CHUNK characters."""

    def __init__(self, made: Pair):
        self.made, self.rows, self.links, self.size = made, [], [], 0

    def add(self, batch: list[tuple[str, str | None]]) -> None:
        """Aligns some texts together."""
        ids, to, of = self.made.encode([t for _, t in batch if t])
        size, each, units = [np.diff(x, prepend=0) for x in to], _aligned(ids, to, self.made), iter(of)
        for k, t in batch:
            mine = next(units) if t else []
            if not mine:
                self.rows.append((k, 0, 0, 0, ""))
                self.links.append(np.empty(0, np.int64))
                continue
            groups, sha, codes, last = 0, hashlib.sha256(), [], b""
            for n, text, c in islice(each, len(mine)):
                sha.update(last)
                groups, last = groups + n, text
                codes.append(c)
            sha.update(last[:-1])
            self.rows.append((k, int(size[0][mine].sum()), int(size[1][mine].sum()), groups, sha.hexdigest()))
            self.links.append(np.concatenate(codes))

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        name, size = uuid.uuid4().hex, np.array([len(x) for x in self.links])
        codes, place = np.unique(np.concatenate(self.links), return_inverse=True)
        self.links = []
        total = np.bincount(place, minlength=len(codes))
        # Of each document its distinct pairs and how often, as differences of places.
        both, times = np.unique(np.repeat(np.arange(len(size)), size) << 32 | place, return_counts=True)
        del place
        cut = np.searchsorted(both, np.arange(len(size) + 1) << 32)
        both &= (1 << 32) - 1
        for a in range(0, len(self.rows), 500):
            out = []
            for i, (k, n_a, n_b, groups, sha) in enumerate(self.rows[a:a + 500], a):
                at = both[cut[i]:cut[i + 1]]
                out.append((name, k, n_a, n_b, groups, int(size[i]), sha, np.diff(at, prepend=0).astype("<u4").tobytes(),
                            times[cut[i]:cut[i + 1]].astype("<u4").tobytes(), None, None))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t.type) for x, t in zip(zip(*out), _ROW)], schema=_ROW)
        yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip((name, *[None] * 8, codes, total), _ROW)], schema=_ROW)
        self.rows, self.size = [], 0


def encoded(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """Staged alignments of ``docs`` (_k, text): a row for each document, and a
    row for each chunk with its distinct pairs and how often they are linked.
    A chunk's name is made by the task attempt whose rows are written."""
    common.ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = pair(*paths)
        chunk = _Chunk(made)
        for batch in batches:
            ks, held, size = batch.column("_k").to_pylist(), [], 0
            for i, k in enumerate(ks):
                text = batch.column("text")[i].as_py()
                held.append((k, text))
                size += len(text or "")
                if size > STRETCH or i == len(ks) - 1:
                    chunk.add(held)
                    chunk.size += size
                    held, size = [], 0
                if chunk.size > CHUNK:
                    yield from chunk.flush()
        yield from chunk.flush()

    return common.staged(docs.select("_k", "text").mapInArrow(run, _ROW_SQL))


def pair_counts(made: DataFrame) -> DataFrame:
    """(code, count, best): corpus-wide links of each id pair, and whether no
    other pair of its B id has more."""
    each = made.filter("codes is not null").select(F.explode(F.arrays_zip("codes", "counts")).alias("x"))
    total = each.groupBy(F.col("x.codes").alias("code")).agg(F.sum("x.counts").alias("count"))
    of_b = Window.partitionBy(F.col("code").bitwiseAND(F.lit((1 << 32) - 1)))  # at most A's vocabulary
    return total.withColumn("best", F.col("count") == F.max("count").over(of_b))


_OUT = "_k string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def aligned(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """Alignment of ``docs`` (_k string, text), one row each by ``_k``."""
    made = encoded(docs, paths or default_paths())
    counts = pair_counts(made)
    asked = made.filter("codes is not null").select(F.col("chunk").alias("of"), F.posexplode("codes").alias("place", "code"))
    answers = asked.join(counts, "code").select("of", "place", "count", "best")
    rows = made.filter("codes is null").drop("codes", "counts")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        place = right.column("place").to_numpy()
        count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        if len(place) and place.max() + 1 != len(place):
            raise ValueError("a chunk's pairs are not those that were counted")
        count[place], best[place] = right.column("count").to_numpy(), right.column("best").to_numpy(zero_copy_only=False)
        n_best, sums = [], []
        for batch in left.select(["places", "times"]).to_batches():
            for p, t in zip(batch.column(0), batch.column(1)):
                at, times = np.cumsum(np.frombuffer(p.as_buffer(), "<u4"), dtype=np.int64), np.frombuffer(t.as_buffer(), "<u4").astype(np.int64)
                n_best.append(int(best[at] @ times))
                sums.append(int(count[at] @ times))
        keep = {c: left.column(c) for c in ("_k", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
        made = keep | {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(sums, pa.int64())}
        return pa.table({c.split()[0]: made[c.split()[0]] for c in _OUT.split(", ")})

    return rows.groupBy("chunk").cogroup(answers.groupBy("of")).applyInArrow(run, _OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("_k"), "text")
    out = aligned(docs)
    return out.select(F.col("_k").cast("long").alias("doc_id"), *(c for c in out.columns if c != "_k"))
