"""Conversation repair against plain and exhaustive versions."""

import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F, types as T

from salonlake.llm import repair

SF = "/root/testdata/sf0.001"
ROWS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
                     T.StructField("text", T.StringType()), T.StructField("_c", T.StringType()), T.StructField("n", T.StringType())])


def _after(rows):
    """The damaged rows of each conversation, in order."""
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv, held in out.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2][:64].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
    return out


def _faults(held):
    seen, out = set(), []
    for _, role, text in held:
        words = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def _least(held, faults):
    """(cost, audit, lines) of the least edits, by recursion from the end."""
    roles = {"0": "u", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def best(i, state, inserts):
        options = []
        if i == len(held):
            if state in "0a":
                options.append((0, "", ()))
        else:
            _, role, text = held[i]
            extra = 3 * (faults[i] == "truncated")
            c, a, ls = best(i + 1, state, 0)
            options.append((c + 4, "D" + a, ls))
            if faults[i] not in ("blank", "duplicate"):
                first = role[:1]
                if first == "s" and state == "0" or first == roles[state]:
                    c, a, ls = best(i + 1, first, 0)
                    options.append((c + extra, "K" + a, (f"{role}:{text}", *ls)))
                for new in ("user", "assistant"):
                    if new[0] == roles[state]:
                        c, a, ls = best(i + 1, new[0], 0)
                        options.append((c + 3 + extra, "R" + a, (f"{new}:{text}", *ls)))
        if inserts < 3:
            new = roles[state]
            c, a, ls = best(i, new, inserts + 1)
            options.append((c + 3, "I" + a, ({"u": "user:", "a": "assistant:"}[new], *ls)))
        return min(options, default=(10 ** 9, "", ()), key=lambda o: o[:2])

    for i in range(len(held), -1, -1):  # keeps the recursion shallow
        for s in "0sua":
            best(i, s, 0)
    return best(0, "0", 0)


def _plain(rows):
    out = {}
    for conv, held in _after(rows).items():
        faults = _faults(held)
        turns = {t for t, _, _ in held if t is not None}
        cost, audit, ls = _least(held, faults) if held else (0, "", ())
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(held, held[1:])]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(k) for k in ("blank", "duplicate", "truncated")),
                     sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(ls).encode()).hexdigest())
    return out


def _got(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def _random(seed, conversations=60, most=14):
    rng = random.Random(seed)
    rows = []
    for c in range(conversations):
        for t in range(rng.randrange(most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No", "why?", "", " \t", None, "é.", f"text {t}.", f"text {t}", "Done! \n"])
            rows.append((c, rng.choice([t, t, t, t + 1, None, t // 2, -t]), role, text))
    return rows


def _table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], ROWS)


def test_query_is_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got, want = _got(repair.query(spark, SF)), _plain(rows)
    assert got == want


@pytest.mark.parametrize("bits", [13, 1])
def test_odd_rows_and_small_pieces(spark, bits):
    rows = _random(bits) + [(None, None, None, None), (None, 3, "user", "Hi."), (900, 1, "user", "long " * 50_000 + ".")]
    rows += [(901, 5, "assistant", "same.")] * 40 + [(902, t, "user", "copy.") for t in range(40)]
    assert _got(repair.told(_table(spark, rows), bits)) == _plain(rows)


def test_long_conversation_in_many_pieces(spark):
    rng = random.Random(3)
    rows = [(7, t, rng.choice(["user", "assistant"]) if rng.random() < 0.2 else ("user", "assistant")[t % 2],
             f"turn {t}{rng.choice(['.', '.', ''])}" if rng.random() < 0.9 else "") for t in range(1500)]
    rows += [(8, t, "system", f"rule {t}.") for t in range(40)]  # vectors that never agree
    assert _got(repair.told(_table(spark, rows), 4)) == _plain(rows)


def test_nothing_left_and_empty_table(spark):
    gone = next(c for c in itertools.count() if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    nothing = hashlib.sha256(b"").hexdigest()
    assert _got(repair.told(_table(spark, [(gone, 0, "user", "Hi.")]))) == {gone: (0, 0, 0, 0, 0, 0, "", nothing)}
    assert repair.told(_table(spark, [])).count() == 0


def test_least_audit_is_exhaustive():
    """All edit sequences of short conversations, written out."""
    rng = random.Random(5)
    pattern = re.compile(r"(s?(ua)+)?")
    for _ in range(60):
        codes = [rng.randrange(8) for _ in range(rng.randrange(4))]
        found = []
        for letters in itertools.product("DKR", repeat=len(codes)):
            for reroled in itertools.product("ua", repeat=letters.count("R")):
                for ins in itertools.product(["", "u", "a", "ua", "au"], repeat=len(codes) + 1):
                    news, out, audit, cost = iter(reroled), "", "", 0
                    for code, letter, new in zip(codes, letters, ins):
                        out, audit, cost = out + new, audit + "I" * len(new) + letter, cost + 3 * len(new)
                        out += "" if letter == "D" else next(news) if letter == "R" else "sua?"[code & 3]
                        cost += {"D": 4, "K": 0, "R": 3}[letter] + 3 * (letter != "D" and code >> 2)
                    out, audit, cost = out + ins[-1], audit + "I" * len(ins[-1]), cost + 3 * len(ins[-1])
                    if pattern.fullmatch(out):
                        found.append((cost, audit))
        edits, state = repair.trace(codes, repair.END, 0)
        assert "".join(edits) + "I" * {0: 0, 1: 2, 2: 1, 3: 0}[state] == min(found)[1]


def test_fix_up_stops_where_vectors_agree():
    codes = [1, 2] * 50 + [5, 0, 3] + [1, 2] * 50
    end = (7, 1, 0, 4)
    whole = repair.run(codes, end)
    assert repair.rerun(codes, repair.END, repair.run(codes, repair.END), end) == whole
