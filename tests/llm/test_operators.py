"""The training-data operators against brute force and planted cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from salonlake.llm import common, ctw, decontam, jaccard, language, merkle, packing, pii, quality, substrings, tokens

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def _words(n, rng, vocab=60):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


def _keyed(df):
    return common.keyed(df, "doc_id", "text")


# 1. Substring dedup

def test_substring_query_is_brute_force(spark, texts):
    got = {r.doc_id: r for r in substrings.query(spark, SF).collect()}
    for d, e in zip(texts, substrings.brute(list(texts.values()))):
        assert (got[d].n_words, got[d].n_removed, got[d].kept_sha256) == e


def test_substring_planted_and_odd(make, odd):
    rng = random.Random(1)
    passage = _words(60, rng, 10_000)
    many = [f"{_words(rng.randrange(80), rng, 10_000)} {passage} {_words(rng.randrange(80), rng, 10_000)}" for _ in range(40)]
    periodic = " ".join(["a b c"] * 40)
    data = [*odd, *many, periodic, _words(34, rng)]
    rows = _keyed(make(data, ids=[i // 2 for i in range(len(data))]))  # repeated ids
    got = Counter((r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substrings.dedup(rows).collect())
    assert got == Counter(substrings.brute(data))
    assert substrings.dedup(_keyed(make([]))).count() == 0


def test_every_window_has_one_anchor_fragment():
    words = np.random.default_rng(3).integers(0, 5, 400).astype(np.uint64)
    whole = substrings.anchors(words, np.array([400]))
    _, first, last, _ = whole
    assert first[0] == 0 and last[-1] == 400 - substrings.WINDOW and (first[1:] == last[:-1] + 1).all()
    assert (last - first < substrings.WINDOW - substrings.ANCHOR + 1).all()
    # Texts end to end have the fragments that each has alone.
    many = substrings.anchors(np.concatenate((words[:7], words, words[:100])), np.array([7, 0, 400, 100]))
    alone = substrings.anchors(words[:100], np.array([100]))
    for i in (1, 2, 3):
        assert many[i].tolist() == whole[i].tolist() + alone[i].tolist()
    assert set(many[0].tolist()) == {2, 3}


def test_words_hashed_from_bytes(monkeypatch):
    texts = ["a bb\x0bbb\u00a0c  a\n".encode(), b"", b" ", b"x" * 50 + b"\x1cy a", b"bb"]
    for block in (4, 16, 1 << 18):
        monkeypatch.setattr(substrings, "BYTES", block)
        hashes, size = substrings.hashed(texts)
        words = [w for t in texts for w in t.split()]
        assert size.tolist() == [len(t.split()) for t in texts] and len(hashes) == len(words)
        seen = dict(zip(words, hashes.tolist()))
        assert [seen[w] for w in words] == hashes.tolist() and len(set(seen.values())) == len(seen)
    assert len(substrings.hashed([])[0]) == 0


def _recut(monkeypatch, spark, tmp_path, make, data):
    """``data`` as one file for every two texts; the first pass reads them in
    one task, every later one each file in its own."""
    path = str(tmp_path / "docs")
    for i in range(0, len(data), 2):
        make(data[i:i + 2], ids=range(i, i + len(data[i:i + 2]))).coalesce(1).write.mode("append").parquet(path)
    most, opening, staged = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", common.staged
    old = {k: spark.conf.get(k, None) for k in (most, opening, "spark.sql.files.minPartitionNum")}
    for k, v in zip(old, ("1g", "1", "1")):
        spark.conf.set(k, v)

    def then_recut(df):
        out = staged(df)
        spark.conf.set(most, "4m")
        spark.conf.set(opening, "4m")
        return out

    monkeypatch.setattr(common, "staged", then_recut)
    df = spark.read.parquet(path).select(F.col("doc_id").alias("_k"), "text", (F.col("doc_id") % 3 != 0).alias("learn"))
    assert df.rdd.getNumPartitions() == 1

    def restore():
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return df, restore


def test_substring_chunks_survive_another_cut_of_the_scan(monkeypatch, spark, make, tmp_path):
    rng = random.Random(29)
    passage = _words(50, rng, 10_000)
    data = [f"{_words(20, rng, 10_000)} {passage} {_words(20, rng, 10_000)}" for _ in range(10)]
    df, restore = _recut(monkeypatch, spark, tmp_path, make, data)
    try:
        got = {r._k: (r.n_words, r.n_removed, r.kept) for r in substrings.dedup(df, texts=False).collect()}
    finally:
        restore()
    assert list(map(got.get, range(10))) == substrings.brute(data)


def test_substring_marks_refuse_other_documents():
    import pyarrow as pa
    docs = pa.table({"_k": [1], "t": [" ".join(f"a{i}" for i in range(40))]})
    answers = pa.table({"h": pa.array([5], pa.int64()), "n": pa.array([1], pa.int64())})
    with pytest.raises(RuntimeError, match="changed between two passes"):
        substrings._mark(docs, answers)


# 2. Language

def test_language_held_out(spark, docs):
    lang = {r.doc_id: r.lang for r in docs.collect()}
    rows = language.query(spark, SF).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)


def test_language_odd(make, odd):
    df = make([*odd, "123 !!"])
    learnt = language.prototypes(df)
    got = [r.lang_pred for r in language.identify(df.drop("score"), learnt).orderBy("doc_id").collect()]
    assert got == ["und", "und", "und", "en", "en", "en", "en", "en", "en", "und", "und"]
    assert language.prototypes(make([])) == {}
    assert {r.lang_pred for r in language.identify(df.drop("score"), {}).collect()} == {"und"}


# 3. Packing

def _check_packing(rows, ids):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for d, x in ids.items():
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(x)
            assert r.ids_crc32 == zlib.crc32(np.array(x[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(x)
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= packing.WINDOW
    return sum(map(len, ids.values())) / (len(by_seq) * packing.WINDOW)


def test_packing_query(spark, texts):
    from tokenizers import Tokenizer
    exact = Tokenizer.from_file(tokens.default_path())
    ids = {d: exact.encode(t or "", add_special_tokens=False).ids + [1] for d, t in texts.items()}
    assert _check_packing(packing.query(spark, SF).collect(), ids) > 0.98


def test_packing_odd(make, odd):
    coder = tokens.coder(tokens.default_path())
    ids = {i: np.frombuffer(coder.encode(t or ""), "<u4").tolist() + [1] for i, t in enumerate(odd)}
    _check_packing(packing.packed(make(odd)).collect(), ids)
    assert packing.packed(make([])).count() == 0
    assert packing.packed(make(["a", "a"], ids=[None, None])).count() == 2


def test_differencing_never_overflows():
    rng = random.Random(5)
    for _ in range(30):
        sizes = [rng.randrange(1, 2049) for _ in range(rng.randrange(1, 200))]
        place = packing.differencing(sizes, 2048)
        sums = Counter()
        for s, p in zip(sizes, place):
            sums[p] += s
        assert max(sums.values()) <= 2048 and set(place) == set(range(max(place) + 1))


# 4. Personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _pii(text):
    out = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            v, digits = m.group(), re.sub("[^0-9]", "", m.group())
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in v.split(".")),
                  "card": 12 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), order, kind, m.end()))
    return [(k, a, b) for a, _, k, b in sorted(out)]


def test_pii_query_is_brute_force(spark, texts):
    for r in pii.query(spark, SF).collect():
        shown = ",".join(f"{k}:{a}:{b}" for k, a, b in _pii(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(shown.encode()).hexdigest()


def test_pii_random_strings(make, odd):
    rng = random.Random(7)
    data = [*odd, "😀 a@b.c😀 1.2.3.4", *("".join(rng.choice("ab.@-+ 0129()😀") for _ in range(60)) for _ in range(400)),
            "x" * 20_000, "1" * 20_000, "a@b.c_d@e.f", "+4 4.4.4.4.4.4.4.4 4111 1111 1111 1111"]
    rows = pii.detect(_keyed(make(data))).collect()
    base = set(BASE)
    for r in rows:
        assert [(s.kind, s.start, s.end) for s in r.spans if s.kind in base] == _pii(r.text)


def test_pii_checksums_context_and_redaction(make):
    data = ["iban DE89 3704 0044 0532 0130 00 and DE89 3704 0044 0532 0130 01", "ssn 123-45-6789", "part 123-45-6789",
            "write a@b.co, 10.0.0.1", None]
    kinds = {r.doc_id: [s.kind for s in r.spans] for r in pii.detect(_keyed(make(data))).collect()}
    assert kinds[0].count("iban") == 1 and kinds[1] == ["national_id"] and kinds[2] == [] and kinds[4] == []
    done = {r.doc_id: r for r in pii.redacted(make(data)).collect()}
    assert done[3].text == "write [email], [ip]" and done[4].text is None and done[3]._k == "k"


# 5. Jaccard join

def test_pii_accounts_before_capitals_codes_and_numbers(make):
    """(text, start and end of its accounts)"""
    de, spaced, gb = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB29 NWBK 6016 1331 9268 19"
    most = "ZZ" + f"{98 - int('0' * 0 + '1' * 30 + '353500') % 97:02d}" + "1" * 30  # no country's; the longest there is
    cases = [f"IBAN {de} BIC COBADEFFXXX", f"{spaced} Please pay", f"{de} 2024", f"{spaced} {gb} EUR", f"AB12 {spaced} NOW",
             f"pay {most} AND MORE WORDS", f"x {gb}", f"{de}Please", f"{de}, {spaced}.", f"DE89 3704 0044 0532 0130 01 BIC X",
             "AB12 " * 3000 + spaced, "A1" * 5000 + f" {de} X"]
    rows = pii.detect(_keyed(make(cases))).collect()
    for r in rows:
        got = [r.text[s.start:s.end] for s in r.spans if s.kind == "iban"]
        want = [x for _, x in sorted((m.start(), a) for a in (de, spaced, gb, most) for m in re.finditer(a + r"(?![A-Za-z0-9])", r.text))]
        assert got == want, r.text[:60]
    assert {r.doc_id: r.text for r in pii.redacted(make(cases)).collect()}[0] == "IBAN [iban] BIC COBADEFFXXX"


def _components(data, ids):
    sets = []
    for t in data:
        ws = (t or "").encode().translate(jaccard._UPPER).split()
        k = min(5, len(ws))
        sets.append({tuple(ws[i:i + k]) for i in range(len(ws) - k + 1)} if ws else set())
    comp = list(range(len(data)))

    def top(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(data)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                comp[max(a, b)] = min(a, b)
    return {d: (len(sets[i]), ids[top(i)]) for i, d in enumerate(ids)}


def test_jaccard_query_is_brute_force(spark, texts):
    ids = sorted(texts)
    expected = _components([texts[i] for i in ids], ids)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.query(spark, SF).collect()} == expected


def test_jaccard_chains_sizes_and_boilerplate(make, odd, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 7)  # several blocks of a list
    rng = random.Random(11)
    data = list(odd)
    boiler = _words(60, rng, 10_000)
    for size in (6, 20, 48, 52, 60, 70, 120, 400):
        ws = _words(size, rng, 10_000).split()
        for _ in range(12):  # a chain of edits: neighbours are alike, ends are not
            data.append(" ".join(ws))
            ws[rng.randrange(len(ws))] = f"new{rng.random()}"
            ws += [f"end{rng.random()}"] if rng.random() < 0.5 else []
    data += [f"{boiler} {_words(rng.randrange(10, 150), rng, 10_000)}" for _ in range(60)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.joined(_keyed(make(data))).collect()}
    assert got == _components(data, list(range(len(data))))


def test_jaccard_one_each(make):
    near = _words(100, random.Random(2), 10_000)
    df = make([near, near + " x", None, None, "", near, "other text of five words"], ids=[9, 4, 1, 2, 3, None, 7])
    kept = jaccard.one_each(df)
    assert kept.columns == df.columns and kept.count() == 5
    assert jaccard.joined(_keyed(make([]))).count() == 0


def test_jaccard_hub_is_verified_in_bounded_parts(monkeypatch, spark):
    import pyarrow as pa

    def measured(left, right):
        return pa.table({"a": pa.array([right.num_rows], pa.int64()), "b": pa.array([sum(map(len, right.column("t").to_pylist()))], pa.int64())})

    monkeypatch.setattr(jaccard, "_verify", measured)
    n = 40_000  # candidates of one class; another has few, but long ones
    pairs = spark.range(1, n).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b")).union(
        spark.range(1, 101).select(F.lit(-1).cast("long").alias("a"), -F.col("id") * 10))
    texts = spark.range(-1, n).select(F.col("id").alias("cls"), F.lit(b"a b c")).union(
        spark.range(1, 101).select(-F.col("id") * 10, F.encode(F.repeat(F.lit("word "), 200_000), "utf-8"))).toDF("cls", "t")
    rows = jaccard.verified(pairs, texts).collect()
    assert sum(r.a for r in rows) == n - 1 + 100
    assert max(r.a for r in rows) <= 1.3 * 1000 and max(r.b for r in rows) <= 40 << 20


def test_components_of_a_long_chain(spark):
    n = 200
    links = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long")
    assert {(r.id, r.comp) for r in jaccard.components(links).collect()} == {(i, 0) for i in range(n + 1)}
    assert jaccard.components(links.limit(0)).count() == 0


# 6. Decontamination

def test_decontamination_query(spark, texts):
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r.doc_id: r for r in decontam.query(spark, SF).collect()}
    some = sorted(texts)[::4] + [d for d, r in got.items() if r.contaminated]
    for d in some:
        if len(texts[d] or "") < 20_000:
            assert (got[d].n_words, got[d].n_hit, got[d].n_items, got[d].items_sha256) == decontam.brute(texts[d], items)


def test_decontamination_small_alphabet(spark, make, monkeypatch):
    monkeypatch.setattr(decontam, "SHARD_WORDS", 40)  # several automata
    rng = random.Random(13)
    items = [(str(i), _words(rng.randrange(0, 25), rng, 2)) for i in range(8)] + [("8", None), ("9", "w0 w1 w0")]
    data = [None, "", *(_words(rng.randrange(0, 60), rng, 3) for _ in range(40))]
    bench = spark.createDataFrame([(int(a), b) for a, b in items], "item_id long, text string")
    for r in decontam.contamination(make(data).select("doc_id", "text"), bench).collect():
        assert (r.n_words, r.n_hit, len(r["items"])) == decontam.brute(r.text, items)[:3]


def test_decontaminate_cuts(make, spark):
    item = _words(12, random.Random(1), 10_000)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    clean = "A clean text, kept as it is. " * 5
    df = make([clean, f"{clean}{item.upper()}; after", item, None])
    rows = {r.doc_id: r.text for r in decontam.decontaminate(df, bench).collect()}
    assert rows == {0: clean, 1: f"{clean}; after", 3: None}
    assert decontam.decontaminate(df, bench.limit(0)).count() == 4


# 7. Fingerprints

def test_merkle_query(spark, texts):
    got = {r.doc_id: r for r in merkle.query(spark, SF).collect()}
    order = sorted(texts, reverse=True)
    assert len(got) == len(order)
    for i, d in enumerate(order):
        t, after = texts[d] or "", texts[order[(i + 1) % len(order)]] or ""
        k = len(t) // 3
        assert got[d].n_chars == len(t)
        assert got[d].edited_sha256 == hashlib.sha256((t[:len(t) - k] + after[:k]).encode()).hexdigest()
        assert 0 <= got[d].near_edited <= 1 and 0 <= got[d].near_next <= 1
    same = {}
    for d in order:
        same.setdefault(texts[d] or "", set()).add(got[d].fingerprint)
    assert all(len(v) == 1 for v in same.values()) and len(set.union(*same.values())) == len(same)


def test_merkle_order_and_edits(make, odd):
    n = len(odd)
    rows = {r.doc_id: r.next for r in merkle.with_next(make(odd)).collect()}
    assert rows == {i: odd[(i - 1) % n] or "" for i in range(n)}
    assert merkle.with_next(make(odd, ids=[None] * n)).count() == n
    assert merkle.with_next(make([])).count() == 0
    lines = [f"Line {i}." for i in range(40)]
    from pyspark.sql import functions as F
    df = make(["\n".join(lines)]).withColumn("other", F.lit("\n".join(lines[:17] + ["Changed."] + lines[18:] + ["More."])))
    a, b = merkle.tree(F.col("text")), merkle.tree(F.col("other"))
    assert df.select(merkle.differing(a, b).alias("x")).first().x == [17, 40]


# 8. Language model

def test_ctw_base_score_and_brute_force(spark, make, odd):
    rng = random.Random(17)
    data = [*odd[:6], "é ñ ü", *(_words(rng.randrange(1, 30), rng, 9) for _ in range(25))]
    from pyspark.sql import functions as F
    rows = _keyed(make(data)).withColumn("learn", F.col("doc_id") % 3 != 0)
    got = {r._k: r for r in ctw.scored(rows).collect()}
    train = [ctw.fold((t or "").encode()) for i, t in enumerate(data) if i % 3]
    count = Counter(w for t in train for w in [*t.split(), None])
    total = sum(count.values())
    nodes = {}
    for t in train:
        x = b" " * 4 + t + b"\xff"
        for i in range(4, len(x)):
            for bit in range(8):
                for d in range(5):
                    n = nodes.setdefault((x[i - d:i], (256 | x[i]) >> (8 - bit)), [0, 0])
                    n[x[i] >> (7 - bit) & 1] += 1
    own = {k: math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi) for k, (a, b) in nodes.items()}
    below, weighted = Counter(), {}
    for size in range(4, -1, -1):
        for (c, z), v in own.items():
            if len(c) == size:
                w = weighted[c, z] = v if size == 4 else float(np.logaddexp(v, below[c, z])) - math.log(2)
                if size:
                    below[c[1:], z] += w
    for i, t in enumerate(data):
        t = ctw.fold((t or "").encode())
        ws = [*t.split(), None]
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(ws), sum(w in count for w in ws), total)
        assert got[i].base_score == pytest.approx(sum(math.log10((count[w] + .1) / (total + .1 * (len(count) + 1))) for w in ws))
        x, log = b" " * 4 + t + b"\xff", 0.0
        for j in range(4, len(x)):
            for bit in range(8):
                z, o, p = (256 | x[j]) >> (8 - bit), x[j] >> (7 - bit) & 1, 0.5
                for d in range(4, -1, -1):
                    k = (x[j - d:j], z)
                    if k in nodes:
                        share = 1 if d == 4 else math.exp(own[k] - math.log(2) - weighted[k])
                        p = share * (nodes[k][o] + .5) / (sum(nodes[k]) + 1) + (1 - share) * p
                log += math.log10(p)
        assert got[i].score == pytest.approx(log)


def test_ctw_chunks_survive_another_cut_of_the_scan(monkeypatch, spark, make, tmp_path):
    rng = random.Random(31)
    data = [_words(30, rng, 40) for _ in range(10)]
    plain = {r._k: r.asDict() for r in ctw.scored(_keyed(make(data)).withColumn("learn", F.col("doc_id") % 3 != 0)).collect()}
    df, restore = _recut(monkeypatch, spark, tmp_path, make, data)
    try:
        got = {r._k: r.asDict() for r in ctw.scored(df).collect()}
    finally:
        restore()
    assert len(got) == 10 and all(got[k] == pytest.approx(plain[k]) for k in got)


def test_ctw_scorer_refuses_other_documents():
    import pyarrow as pa
    docs = pa.table({"_k": [1], "learn": [True], "t": ["abc"]})
    answers = pa.table({"kind": pa.array([0], pa.int32()), "code": pa.array([7], pa.int64()), "value": pa.array([-1.0])})
    with pytest.raises(RuntimeError, match="changed between two passes"):
        ctw._scorer(1, 1, 1)(docs, answers)


# 9. Token counts

def test_token_counts_query(spark, texts):
    from tokenizers import Tokenizer
    exact = Tokenizer.from_file(tokens.default_path())
    exact.encode_special_tokens = True
    got = {r.doc_id: r.n_tokens for r in tokens.query(spark, SF).collect()}
    assert got == {d: len(exact.encode(t or "", add_special_tokens=False).ids) for d, t in texts.items()}


def test_token_counts_odd(spark, make, odd, tmp_path):
    df = make([*odd, "<|endoftext|>"]).coalesce(2)
    path = str(tmp_path / "tokens")
    tokens.write_tokens(df, path, docs_per_file=3)
    whole = sum(r.n_tokens for r in tokens.scan(spark, path, block=7).collect())
    got = {r.doc_id: r.n_tokens for r in tokens.counted(df.select("doc_id", "text", "score")).collect()}
    assert got[0] == got[1] == 0 and got[4] == got[5] == 3 and got[10] > 1 and whole == sum(got.values())


def test_coder_is_the_tokenizer():
    from tokenizers import Tokenizer
    exact, coder, rng = Tokenizer.from_file(tokens.default_path()), tokens.coder(tokens.default_path()), random.Random(19)
    for _ in range(500):
        t = "".join(rng.choice(" \n\tab.1'éſ​\x1c\x85<😀") for _ in range(40))
        assert np.frombuffer(coder.encode(t), "<u4").tolist() == exact.encode(t, add_special_tokens=False).ids
    special = "a <|endoftext|> b"
    assert np.frombuffer(coder.encode(special), "<u4").tolist() == exact.encode(special, add_special_tokens=False).ids


# 10. Quality

def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = quality.query(spark, sf).collect()
    held = [r for r in rows if r.held_out and r.doc_id in label]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert sum(r.predicted == label[r.doc_id] for r in held) >= 0.95 * len(held)


def test_quality_odd(spark, make, odd):
    labels = spark.createDataFrame([(0, 1), (1, None), (None, 0)], "doc_id long, quality int")
    chain = quality.train(make([]), labels)
    assert chain.scores([]).tolist() == []
    scores = [r.score for r in quality.score(make(odd).drop("score"), chain).collect()]
    assert len(scores) == len(odd) and all(abs(s - 0.5) < 1e-9 for s in scores)
    assert quality.good(make(odd), quality.train(make(["x"]), labels)).count() == len(odd)


def _trained_on(docs, labels, **kw):
    """The texts that a chain is fitted to."""
    return [r.t.encode() for r in quality.sampled(docs, labels, **kw).collect()]


def test_quality_learns_from_whole_texts(spark, make):
    data = ["A good line.\n" * 3000 + "b@d!\n" * 50, "A good line."]
    labels = spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, quality int")
    assert sorted(_trained_on(make(data), labels)) == sorted(t.encode() for t in data)


def test_quality_learns_from_copies_once(spark, make):
    data = [f"text {i % 3 if i < 30 else i}" for i in range(40)]  # three texts ten times each
    ids = [*range(38), 7, 7]  # repeated rows of an id
    data[38] = data[39] = data[7]
    labels = spark.createDataFrame([(i, int(i >= 30)) for i in range(38)], "doc_id long, quality int")
    want = sorted(t.encode() for t in set(data[:38]))
    assert sorted(_trained_on(make(data, ids=ids), labels)) == want
    some = _trained_on(make(data, ids=ids), labels, sample=6)
    assert len(some) == len(set(some)) == 6


def test_quality_is_fitted_in_a_task_as_in_the_driver(spark, make):
    data = [("Good words in a line.\n" if i % 2 else "b@d!! x9 ~~\n") * (1 + i % 5) + str(i) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    chain = quality.train(make(data), labels)
    plain = quality._fitted([(r.y, r.h, r.t.encode()) for r in quality.sampled(make(data), labels).collect()])
    assert chain.fitted and np.allclose(chain.w, plain.w) and np.allclose(chain.t, plain.t)


def test_quality_keeps_all_when_nothing_is_learnt(spark, make, odd):
    labels = spark.createDataFrame([(0, 0), (1, 0), (99, 1)], "doc_id long, quality int")
    for some in (labels.limit(0), labels, labels.filter("doc_id = 99")):
        kept = quality.good(make(odd), quality.train(make(odd), some))
        assert kept.count() == len(odd) and kept.columns == make(odd).columns


def test_chain_marginals_are_exact():
    rng = np.random.default_rng(23)
    chain = quality.Chain()
    chain.t = rng.normal(size=(2, 2))
    u, first = rng.normal(size=9), np.array([0, 4, 5, 9])
    good, _ = chain.marginals(u, first)
    for a, b in zip(first, first[1:]):
        total, part = 0.0, np.zeros(b - a)
        for code in range(1 << (b - a)):
            y = [code >> i & 1 for i in range(b - a)]
            p = math.exp(sum(u[a + i] * v for i, v in enumerate(y)) + sum(chain.t[v, w] for v, w in zip(y, y[1:])))
            total += p
            part += p * np.array(y)
        assert np.allclose(good[a:b], part / total)


# Pipeline

def test_pipeline_stages(spark, make, odd):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    df = make(odd)
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns, name
        assert stage(spark, df.limit(0), SF).count() == 0


def test_pipeline_is_its_parts(spark, docs, texts):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    kept = {r.doc_id for r in quality.query(spark, SF).collect() if r.predicted == 1}
    ids = sorted(kept)
    comp = _components([texts[i] for i in ids], ids)
    kept = {d for d in ids if comp[d][1] == d}
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    machine = decontam.Automaton([(n, decontam.words((t or "").encode())) for n, t in items], decontam.WINDOW)
    left = {}
    for d in kept:
        raw = (texts[d] or "").encode()
        ws = decontam.words(raw)
        spans = machine.hits(ws)[0]
        if sum(b - a for a, b in spans) <= 0.5 * len(ws):
            left[d] = decontam._cut(raw, spans).decode()
    coder = tokens.coder(tokens.default_path())
    ids = {}
    for d, t in left.items():
        out, end = [], 0
        for k, a, b in _pii(t):
            if a >= end:
                out += [t[end:a], f"[{k}]"]
            end = max(end, b)
        ids[d] = np.frombuffer(coder.encode("".join(out) + t[end:]), "<u4").tolist() + [1]
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(ids)
    _check_packing(rows, ids)
