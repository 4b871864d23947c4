"""Conversation structure repair by rank-convergence parallel Viterbi.

A conversation's rows, by turn, are kept, reroled or deleted, and empty user or
assistant turns inserted, at least cost, so that the roles read system?
(user assistant)*; blank rows and repeats must go. The automaton has four states
(nothing yet, after system, after user, after assistant), and a row is a 4 x 4
min-plus step, so cost-to-go vectors run backward over the rows.

Rows are range-partitioned by (conversation, turn) and cut into pieces of at
most ``PIECE`` rows of one conversation; a piece needs one byte a row. All pieces
run at once, those inside a conversation from a speculative vector (as if the
conversation ended there). Then fix-up passes: a piece whose vector at its end
is not, up to a constant, the one that its successor has at its start runs again
from there, old and new vector side by side, until they differ by a constant
only, for all before is settled then. Passes go on until no piece is stale.
Tracing is forward: with the stitched vectors every piece gives its exit for
every entry state, entries follow by composition over a conversation's pieces,
and the cheapest, then ASCII-least edits are read off.

Must-delete rows never change the state and cost the same wherever, so they take
no part in the vectors: copies cannot keep them from converging. Identical rows
are counted before they are shuffled. What a task holds of a conversation is a
piece; only its audit, a string in the result, is put together whole (so a
conversation has less than 2^31 rows, 2^18 pieces), and its text runs past one
digest in order, held by nobody. Worst case: passes are as many as the pieces
of the longest stretch over which two vectors keep differing, say thousands of
system rows on end; clean dialogue converges within two rows.

Defined results: nulls are one space in role, text and the damage key; null
turns come first; rows of one turn are ordered by role, the first 64 code points
of the text and its SHA-256; null conversation ids are one conversation; roles
count by their first character, other initials than s, u, a must be reroled or
deleted; a conversation whose rows are all dropped has zeros, an empty audit and
the digest of nothing; an empty table gives an empty table; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import common

#: Rows of a piece, as a power of two.
PIECE_BITS = 13
#: Cost to end the conversation in each state: the inserts that it still needs.
END = (0, 6, 3, 0)
_WORD = r"[^\x20\x09-\x0D]"
_ENDED = r"[.!?][\x20\x09-\x0D]*\z"
_ROLES = {"s": 0, "u": 1, "a": 2}
#: State after the next turn that the pattern wants (user or assistant).
_NEXT = (2, 2, 3, 2)
_INF = 1 << 40
_DELETE, _INSERT, _REROLE = 4, 3, 3
_FORCED = 8


# Rows, faults and pieces

def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage: (_c, conv_id, turn, role, text, n): n copies of a row."""
    def named(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(named("text"), ".!?", "")).otherwise(named("text"))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"),
                       F.when(kind == 4, "user").otherwise(named("role")).alias("role"), text.alias("text"),
                       F.when(kind == 3, 2).otherwise(1).cast("long").alias("n"), (kind != 0).alias("there")).filter("there").drop("there")


def _key(c: str = "conv_id") -> Column:
    """A non-null text that tells conversations apart, null ids too."""
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")).alias("_c")


def faulted(rows: DataFrame) -> DataFrame:
    """Distinct rows without their texts, as (_c, turn, role, head, digest, n,
    blank, duplicate, truncated); of n copies, ``duplicate`` speaks of the first."""
    text = F.col("text")
    narrow = rows.select(_key(), "turn", "role", F.substring(text, 1, 64).alias("head"), F.sha2(text.cast("binary"), 256).alias("digest"),
                         (~text.rlike(_WORD)).alias("blank"), (~text.rlike(_ENDED)).alias("open"), "n")
    narrow = narrow.groupBy("_c", "turn", "role", "head", "digest", "blank", "open").agg(F.sum("n").alias("n"))
    order = F.struct(F.col("turn").isNotNull().alias("_has"), F.col("turn"))  # null turns first
    again = (narrow.groupBy("_c", "role", "digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("_m"))
             .filter("_m > 1").drop("_m"))
    both = narrow.join(again, ["_c", "role", "digest"], "left")
    later = F.coalesce(order > F.col("first"), F.lit(False))
    return both.select("_c", "turn", "role", "head", "digest", "n", "blank", (~F.col("blank") & later).alias("duplicate"),
                       (~F.col("blank") & ~later & F.col("open")).alias("truncated"))


def ordered(rows: DataFrame, bits: int = PIECE_BITS) -> DataFrame:
    """Staged ``faulted`` rows with their place ``_at`` in the order of all
    conversations, and ``_p``, the piece of its conversation that a row is in."""
    by = ["_c", F.asc_nulls_first("turn"), "role", "head", "digest"]
    placed = rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by)
    return common.staged(placed.withColumn("_at", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_at", bits)))


def pieces(placed: DataFrame) -> DataFrame:
    """Staged: a row for each piece, its rows in order; ``code`` has a byte for each."""
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    code = role + F.when(F.col("blank") | F.col("duplicate"), _FORCED).when(F.col("truncated"), 4).otherwise(0)
    row = F.struct("_at", code.cast("byte").alias("code"), "n")
    held = placed.groupBy("_c", "_p").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    free = F.exists("rows", lambda r: r["code"] < _FORCED)
    turns = Window.partitionBy("_c", "free").orderBy("_p")
    follow = Window.partitionBy("_c").orderBy("_p")
    ends = held.withColumn("free", free).select(
        "_c", "_p", "free", F.lead("_p").over(turns).alias("_next"), F.lag("_p").over(turns).alias("_prev"),
        F.lag(F.element_at("rows", -1)["code"]).over(follow).alias("before"))  # narrow: pieces' links
    both = held.join(ends, ["_c", "_p"])
    return common.staged(both)


# Steps of one row and runs over a piece

def _steps() -> np.ndarray:
    """[code, state, next state] costs of the rows that may stay."""
    out = np.full((8, 4, 4), _INF, np.int64)
    for code in range(8):
        role, open_ = code & 3, 3 * (code >> 2)
        for q in range(4):
            out[code, q, q] = _DELETE
            out[code, q, _NEXT[q]] = min(out[code, q, _NEXT[q]], _REROLE + open_)
            if role == 0 and q == 0:
                out[code, 0, 1] = open_
            elif role in (1, 2) and _NEXT[q] == role + 1:
                out[code, q, _NEXT[q]] = open_
    return out


_STEP = _steps().tolist()


def back(code: int, v: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to go before a row with ``code``, from those after it."""
    step = _STEP[code]
    b = [min(s + x for s, x in zip(step[q], v)) for q in range(4)]
    b = [min(b[q], _INSERT + b[_NEXT[q]]) for q in range(4)]
    return tuple(min(b[q], _INSERT + b[_NEXT[q]]) for q in range(4))  # at most two inserts help


def level(v: tuple[int, ...]) -> tuple[int, ...]:
    """What vectors that differ by a constant share."""
    low = min(v)
    return tuple(x - low for x in v)


def run(codes: list[int], end: tuple[int, ...]) -> tuple[int, ...]:
    for code in reversed(codes):
        end = level(back(code, end))
    return end


def rerun(codes: list[int], old: tuple[int, ...], start: tuple[int, ...], end: tuple[int, ...]) -> tuple[int, ...]:
    """The vector at the start when the one at the end is ``end`` instead of
    ``old``, for which it is ``start``: runs only until both agree."""
    for code in reversed(codes):
        if old == end:
            return start
        old, end = level(back(code, old)), level(back(code, end))
    return start if old == end else end


def trace(codes: list[int], end: tuple[int, ...], state: int) -> tuple[list[str], int]:
    """The edits of every row (its inserts, then its own letter) from ``state``,
    and the state after the last: the least letter that keeps the least cost."""
    after = [end]
    for code in reversed(codes):
        after.append(level(back(code, after[-1])))
    edits = []
    for i, code in enumerate(codes):
        v, step, done = after[len(codes) - 1 - i], _STEP[code], ""
        b = back(code, v)
        while True:
            keeps = (code & 3) == 0 and state == 0 or (code & 3) in (1, 2) and _NEXT[state] == (code & 3) + 1
            kept = 1 if (code & 3) == 0 else _NEXT[state]
            if b[state] == _DELETE + v[state]:
                done += "D"
            elif b[state] == _INSERT + b[_NEXT[state]]:
                done, state = done + "I", _NEXT[state]
                continue
            elif keeps and b[state] == step[state][kept] + v[kept]:
                done, state = done + "K", kept
            else:
                done, state = done + "R", _NEXT[state]
            edits.append(done)
            break
    return edits, state


# Passes over all pieces

_VECTOR = "array<int>"


def _mapped(df: DataFrame, schema: str, each) -> DataFrame:
    """``each`` row (a dict) of ``df`` as a dict of ``schema``'s columns."""
    common.ready(df.sparkSession)
    names = [x.split()[0] for x in schema.split(", ")]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):  # a piece's rows are many objects
                made = [each(r) for r in batch.slice(a, 64).to_pylist()]
                kinds = [_KINDS[x.split()[1]] for x in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array([m[n] for m in made], k) for n, k in zip(names, kinds)], names=names)

    return df.mapInArrow(over, schema)


_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), _VECTOR: pa.list_(pa.int32())}


def _codes(rows_code: bytes) -> list[int]:
    return [c for c in rows_code if c < _FORCED]


def stitched(held: DataFrame) -> DataFrame:
    """(_c, _p, _next, _prev, end, start): the vectors at both ends of the
    pieces of conversations with more than one, after all fix-up passes."""
    many = held.filter("free and (_next is not null or _prev is not null)").select(
        "_c", "_p", "_next", "_prev", F.transform("rows", lambda r: r["code"]).alias("codes"))
    many = common.staged(many)
    schema = f"_c string, _p long, _next long, _prev long, end {_VECTOR}, start {_VECTOR}"

    def first(r: dict) -> dict:
        return r | {"end": list(END), "start": list(run(_codes(r["codes"]), END))}

    state = common.staged(_mapped(many, schema, first))
    while True:
        ahead = state.select("_c", F.col("_p").alias("_next"), F.col("start").alias("want"))
        stale = state.join(ahead, ["_c", "_next"]).filter("end <> want").select("_c", "_p", "end", "start", "want")
        stale = common.staged(stale)
        if stale.isEmpty():
            return state

        def again(r: dict) -> dict:
            start = rerun(_codes(r["codes"]), tuple(r["end"]), tuple(r["start"]), tuple(r["want"]))
            return r | {"end": r["want"], "start": list(start)}

        fixed = _mapped(many.join(stale, ["_c", "_p"]), schema, again)
        rest = state.join(stale.select("_c", "_p"), ["_c", "_p"], "left_anti").select(*fixed.columns)
        now = common.staged(rest.unionByName(fixed))
        common.discard(state)
        common.discard(stale)
        state = now


def entered(held: DataFrame, state: DataFrame) -> DataFrame:
    """(_c, _p, end, entry) of the pieces of conversations with more than one.
    Every piece maps its four entry states to exits; entries follow by
    composing the maps in order (four numbers for a piece, at most 2^18 pieces)."""
    codes = held.select("_c", "_p", F.transform("rows", lambda r: r["code"]).alias("codes")).join(state.select("_c", "_p", "end"), ["_c", "_p"])

    def exits(r: dict) -> dict:
        return r | {"exits": [trace(_codes(r["codes"]), tuple(r["end"]), q)[1] for q in range(4)]}

    maps = _mapped(codes, f"_c string, _p long, end {_VECTOR}, exits {_VECTOR}", exits)
    whole = maps.groupBy("_c").agg(F.array_sort(F.collect_list(F.struct("_p", "end", "exits"))).alias("ps"))

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q, out = 0, []
                for p in r["ps"]:
                    out.append((r["_c"], p["_p"], p["end"], q))
                    q = p["exits"][q]
                yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*out), (
                    pa.string(), pa.int64(), _KINDS[_VECTOR], pa.int32()))], names=["_c", "_p", "end", "entry"])

    return whole.mapInArrow(composed, f"_c string, _p long, end {_VECTOR}, entry int")


def audited(held: DataFrame) -> DataFrame:
    """Staged: for each piece its part of the audit, its cost, its illegal
    neighbours, the inserts after its conversation's last row (``tail``), and
    ``kept``: for every row that stays its place, what is inserted before it
    and the role that it gets."""
    joined = held.join(entered(held, stitched(held)), ["_c", "_p"], "left")
    slim = joined.select("_c", "_p", "_next", "free", "before", "end", "entry",
                         F.transform("rows", lambda r: r["code"]).alias("codes"), F.transform("rows", lambda r: r["n"]).alias("ns"),
                         F.transform("rows", lambda r: r["_at"]).alias("ats"))
    schema = "_c string, _p long, audit string, cost long, illegal long, tail string, ats array<bigint>, lead array<string>, become array<string>"
    common.ready(held.sparkSession)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                made = [_audit(r) for r in batch.slice(a, 256).to_pylist()]
                yield pa.RecordBatch.from_pylist(made, schema=_AUDIT)

    return common.staged(slim.mapInArrow(over, schema))


_AUDIT = pa.schema([("_c", pa.string()), ("_p", pa.int64()), ("audit", pa.string()), ("cost", pa.int64()), ("illegal", pa.int64()),
                    ("tail", pa.string()), ("ats", pa.list_(pa.int64())), ("lead", pa.list_(pa.string())), ("become", pa.list_(pa.string()))])
_LEGAL = {(0, 1), (1, 2), (2, 1)}


def _audit(r: dict) -> dict:
    codes, ns = r["codes"], r["ns"]
    free = [c for c in codes if c < _FORCED]
    entry = r["entry"] or 0
    edits, state = trace(free, tuple(r["end"] or END), entry)
    told, cost, illegal, before = [], 0, 0, r["before"]
    ats, lead, become, each, q = [], [], [], iter(edits), entry
    for code, n, at in zip(codes, ns, r["ats"]):
        role = code & 3
        illegal += (before is not None and (before & 3, role) not in _LEGAL) + n - 1
        before = code
        done = "D" if code >= _FORCED else next(each)
        told.append(done + "D" * (n - 1))
        cost += _DELETE * (n - 1 + (done[-1] == "D")) + 3 * (len(done) - 1) + 3 * (done[-1] == "R") + 3 * (done[-1] != "D" and code >> 2 & 1)
        inserted = ""
        for _ in done[:-1]:
            q = _NEXT[q]
            inserted += " ua"[q - 1]
        if done[-1] != "D":
            q = 1 if done[-1] == "K" and role == 0 else _NEXT[q]
            ats.append(at)
            become.append("" if done[-1] == "K" else " ua"[q - 1])
        if done[-1] != "D" or inserted:
            if done[-1] == "D":
                raise ValueError("an insert before a deleted row is never least")
            lead.append(inserted)
    tail = {0: "", 1: "ua", 2: "a", 3: ""}[state] if r["free"] and r["_next"] is None else ""
    return {"_c": r["_c"], "_p": r["_p"], "audit": "".join(told), "cost": cost + 3 * len(tail), "illegal": illegal, "tail": tail,
            "ats": ats, "lead": lead, "become": become}


# Results

def lines(rows: DataFrame, placed: DataFrame, edits: DataFrame) -> DataFrame:
    """(_c, _at, line): the repaired rows, each with the turns inserted before
    it, and, last, those inserted at the end of a conversation."""
    empty = F.transform(F.split(F.col("lead"), ""), lambda x: F.when(x == "u", "user:").otherwise("assistant:"))
    stays = edits.select("_c", F.explode(F.arrays_zip("ats", "lead", "become")).alias("e")).select(
        "_c", F.col("e.ats").alias("_at"), F.col("e.lead").alias("lead"), F.col("e.become").alias("become"))
    stays = placed.select("_c", "_at", "turn", "role", "digest").join(stays, ["_c", "_at"])
    texts = rows.select(_key(), "turn", "role", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), "text")
    texts = texts.groupBy("_c", "turn", "role", "digest").agg(F.first("text").alias("text"))
    on = (texts["_c"] == stays["_c"]) & texts["turn"].eqNullSafe(stays["turn"]) & (texts["role"] == stays["role"]) & (
        texts["digest"] == stays["digest"])
    name = F.when(F.col("become") == "u", "user").when(F.col("become") == "a", "assistant").otherwise(stays["role"])
    own = F.array(F.concat(name, F.lit(":"), F.col("text")))
    kept = stays.join(texts, on).select(stays["_c"], "_at", F.array_join(
        F.when(F.col("lead") == "", own).otherwise(F.concat(empty, own)), "\n").alias("line"))
    tails = edits.filter("tail <> ''").select("_c", F.lit((1 << 63) - 1).cast("long").alias("_at"), F.array_join(
        F.transform(F.split("tail", ""), lambda x: F.when(x == "u", "user:").otherwise("assistant:")), "\n").alias("line"))
    return kept.unionByName(tails)


def digests(parts: DataFrame) -> DataFrame:
    """(_c, repaired_sha256) of ``lines``: they run past the digest in order."""
    common.ready(parts.sparkSession)
    dealt = parts.repartition("_c").sortWithinPartitions("_c", "_at")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, made = None, None
        for batch in batches:
            done = []
            for c, line in zip(batch.column("_c").to_pylist(), batch.column("line").to_pylist()):
                if c != now:
                    if now is not None:
                        done.append((now, made.hexdigest()))
                    now, made = c, hashlib.sha256()
                else:
                    made.update(b"\n")
                made.update(line.encode())
            if done:
                yield _pairs(done)
        if now is not None:
            yield _pairs([(now, made.hexdigest())])

    return dealt.select("_c", "line").mapInArrow(over, "_c string, repaired_sha256 string")


def _pairs(done: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in (0, 1)], names=["_c", "repaired_sha256"])


def repaired(rows: DataFrame, bits: int = PIECE_BITS) -> tuple[DataFrame, DataFrame]:
    """(report, lines) for rows (conv_id, turn, role, text, n): the report has a
    row for each conversation by ``_c``, without its digest."""
    placed = ordered(faulted(rows), bits)
    held = pieces(placed)
    edits = audited(held)
    first = F.when(F.col("duplicate"), F.col("n")).otherwise(F.col("n") - 1)
    turns = placed.groupBy("_c", "turn").agg(
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).otherwise(first)).alias("duplicate"),
        F.sum(F.col("truncated").cast("long")).alias("truncated"))
    span = F.try_subtract(F.max("turn"), F.min("turn"))
    faults = turns.groupBy("_c").agg(
        F.coalesce(F.when(F.max("turn").isNull(), 0), F.try_add(span, 1 - F.count("turn"))).cast("long").alias("gaps"),
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")))
    audits = edits.groupBy("_c").agg(
        F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.max("tail").alias("tail"),
        F.array_sort(F.collect_list(F.struct("_p", "audit"))).alias("ps"))
    audit = F.concat(F.array_join(F.transform("ps", lambda p: p["audit"]), ""), F.repeat(F.lit("I"), F.length("tail")))
    report = faults.join(audits.select("_c", "illegal", "cost", audit.alias("audit")), "_c")
    return report, lines(rows, placed, edits)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(common.documents(spark, sf_dir, "conversations"))


def told(conversations: DataFrame, bits: int = PIECE_BITS) -> DataFrame:
    """The report of every conversation of the table, after the damage."""
    every = conversations.select("conv_id").distinct().select("conv_id", _key())
    report, parts = repaired(damaged(conversations), bits)
    out = every.join(report, "_c", "left").join(digests(parts), "_c", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in (
        "gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
