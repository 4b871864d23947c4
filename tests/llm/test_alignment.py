"""Cross-tokenizer alignment against a plain version with the exact tokenizers."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from salonlake.llm import alignment

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def coders():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE = {chr(c): c for c in _PRINTED} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in set(_PRINTED))}


def _plain(texts, coders):
    """Whole texts through the exact tokenizers; shared ends as a set."""
    tk, sp = coders
    docs, counts = [], Counter()
    for t in texts:
        raw = (" " + (t or "")).encode()
        a = tk.encode(" " + t, add_special_tokens=False).ids if t else []
        b = sp.encode(t) if t else []
        bytes_a = [bytes(map(_BYTE.__getitem__, tk.id_to_token(i))) for i in a]
        pieces = [sp.id_to_piece(i) for i in b]
        bytes_b = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]
        if not t or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            docs.append((0, 0, [], ""))
            continue
        spans = []
        for parts in (bytes_a, bytes_b):
            at, out = 0, []
            for p in parts:
                out.append((at, at + len(p)))
                at += len(p)
            spans.append(out)
        shared = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        group = {e: i for i, e in enumerate(shared)}
        parts = [[[] for _ in shared] for _ in "ab"]
        for ids, sp_, out in zip((a, b), spans, parts):
            g = 0
            for i, (_, e) in zip(ids, sp_):
                out[g].append(str(i))
                g = group.get(e, g - 1) + 1
        groups = [f"{','.join(x)}|{','.join(y)}" for x, y in zip(*parts)]
        links, j = [], 0
        for i, (s, e) in enumerate(spans[0]):
            while j and spans[1][j][0] > s:
                j -= 1
            while spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(b) and spans[1][k][0] < e:
                links.append((a[i], b[k]))
                k += 1
            j = k - 1
        counts.update(links)
        docs.append((len(a), len(b), links, ";".join(groups)))
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    return [(na, nb, g.count(";") + 1 if g else 0, len(ls), sum(counts[x] == top[x[1]] for x in ls), sum(counts[x] for x in ls),
             hashlib.sha256(g.encode()).hexdigest() if g else "") for na, nb, ls, g in docs]


def _rows(df):
    cols = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_query_is_plain_version(spark, coders):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = alignment.query(spark, SF).orderBy("doc_id")
    assert [r.doc_id for r in got.collect()] == [r.doc_id for r in docs]
    assert _rows(got) == _plain([r.text for r in docs], coders)


def test_odd_texts_and_small_chunks(spark, coders, make, odd, monkeypatch):
    rng = random.Random(2)
    alpha = [*" \n\t  ab.,'é中　😀ﬁ́\r<>/s0123\x00\x1c\x85", "the ", "</s>", "<0x41>", "<|endoftext|>", "ing", "▁"]
    data = [*odd, *("".join(rng.choices(alpha, k=rng.randrange(40))) for _ in range(300)), " " * 300, "\n" * 200 + "x", "中" * 500, "a▁b"]
    rows = make(data).select(F.col("doc_id").cast("string").alias("_k"), "text")
    want = Counter(_plain(data, coders))
    assert Counter(_rows(alignment.aligned(rows))) == want
    assert alignment.aligned(rows.limit(0)).count() == 0
    # Repeated and null ids stay documents of their own.
    assert Counter(_rows(alignment.aligned(rows.withColumn("_k", F.lit(None).cast("string"))))) == want


def test_stretches_of_a_long_text(coders, monkeypatch):
    monkeypatch.setattr(alignment, "STRETCH", 50)
    made = alignment.Pair(*alignment.default_paths())
    text = " ".join(f"Wörd{i} thing, \n and  more {i * 7919}" for i in range(300))
    chunk = alignment._Chunk(made)
    chunk.add([("0", text), ("1", "short"), ("2", None), ("3", "short")])
    want = _plain([text, "short", None, "short"], coders)
    assert [(r[1], r[2], r[3], len(x), r[4]) for r, x in zip(chunk.rows, chunk.links)] == [(*w[:4], w[6]) for w in want]


@pytest.mark.parametrize("seed", range(5))
def test_leaves_are_cut_at_every_shared_end(seed):
    rng = np.random.default_rng(seed)
    lens = [rng.integers(1, 2 + 3 * seed, n) for n in (400, 300)]
    total = max(int(x.sum()) for x in lens) + 1
    ends = [np.append(np.cumsum(x), total) for x in lens]
    first_a, first_b = alignment.leaves(*ends, np.array([[0], [len(ends[0])], [0], [len(ends[1])]]))
    shared = np.intersect1d(*ends)
    assert first_a.tolist() == [0, *(np.searchsorted(ends[0], shared)[:-1] + 1)]
    assert first_b.tolist() == [0, *(np.searchsorted(ends[1], shared)[:-1] + 1)]


def test_long_stretch_without_a_cut():
    a, b = np.append(np.arange(1, 200_000, 2), 300_000), np.append(np.arange(2, 200_000, 2), 300_000)
    first_a, first_b = alignment.leaves(a, b, np.array([[0], [len(a)], [0], [len(b)]]))
    assert first_a.tolist() == [0] and first_b.tolist() == [0]
