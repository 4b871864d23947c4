"""Document fingerprints: a Merkle tree over paragraphs and sections.

Native expressions only. A text's lines are its paragraphs; a paragraph's leaves
are its sentences (pieces of at most ``PIECE`` code points, each ended by
sentence marks); ``SECTION`` paragraphs make a section; the root covers the
sections. Equal roots mean equal texts; where roots differ, the differing
sections, then paragraphs, say where the edit is. The fingerprint string is the
root and, after a colon, eight hex digits of every leaf; two fingerprints'
likeness is the share of leaves they have in common (Dice).

The next document in falling id order is found without a single-task window:
rows are dealt by slices of the id range whose upper bounds are ids of the
table, and the row that heads a slice is sent to the slice before it as well.

Defined results: a null text is an empty text, with one empty paragraph and no
leaf, and is like no other but an empty one; null ids come last; rows that share
an id follow each other in a fixed order; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import common

PIECE, SECTION = 256, 8
_SENTENCE = rf"[^.!?]{{1,{PIECE}}}+[.!?]*+|[.!?]++"


def _hash(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def tree(text: Column) -> Column:
    """struct(root, sections, paragraphs, leaves) of hex hashes."""
    leaves = F.transform(F.split(text, "\n", -1), lambda p: F.transform(
        F.regexp_extract_all(p, F.lit(_SENTENCE), F.lit(0)), _hash))
    return F.transform(F.array(leaves), _rest)[0]


def _rest(leaves: Column) -> Column:
    paragraphs = F.transform(leaves, lambda x: _hash(F.array_join(x, "")))

    def upper(nodes: Column) -> Column:
        sections = F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / SECTION).cast("int")), lambda i: _hash(
            F.array_join(F.slice(nodes, i * SECTION + 1, F.lit(SECTION)), "")))
        return F.struct(sections.alias("sections"), nodes.alias("paragraphs"))

    both = F.transform(F.array(paragraphs), upper)[0]
    return F.struct(_hash(F.array_join(both["sections"], "")).alias("root"), both["sections"].alias("sections"),
                    both["paragraphs"].alias("paragraphs"),
                    F.transform(F.flatten(leaves), lambda x: F.substring(x, 1, 8)).alias("leaves"))


def fingerprint(node: Column) -> Column:
    return F.concat(node["root"], F.lit(":"), F.array_join(node["leaves"], ""))


def likeness(a: Column, b: Column) -> Column:
    """Share of distinct leaves in common, 1 for equal roots."""
    n = F.size(F.array_distinct(a["leaves"])) + F.size(F.array_distinct(b["leaves"]))
    return F.when(a["root"] == b["root"], 1.0).when(n == 0, 0.0).otherwise(
        2.0 * F.size(F.array_intersect(a["leaves"], b["leaves"])) / n)


def differing(a: Column, b: Column) -> Column:
    """Places (from 0) of the paragraphs in which two trees differ: only
    sections whose hashes differ are looked into."""
    def inside(s: Column) -> Column:
        low, most = s * SECTION, F.greatest(F.size(a["paragraphs"]), F.size(b["paragraphs"]))
        return F.filter(F.sequence(low, F.least(low + SECTION, most) - 1),
                        lambda i: ~F.get(a["paragraphs"], i).eqNullSafe(F.get(b["paragraphs"], i)))

    every = F.sequence(F.lit(0), F.greatest(F.size(a["sections"]), F.size(b["sections"])) - 1)
    changed = F.filter(every, lambda s: ~F.get(a["sections"], s).eqNullSafe(F.get(b["sections"], s)))
    return F.flatten(F.transform(changed, inside))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``next``: the text of the next row in falling order of the
    id, of the first row for the last."""
    spark = docs.sparkSession
    own = f"_doc_{id_col}"
    rows = common.wrapped(docs)
    rows = common.keyed(rows, own, *(c for c in rows.columns if c != own))
    rows = rows.withColumn("_o", F.coalesce(F.col(own).cast("long"), F.lit(-(1 << 63))))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = rows.agg(F.max("_o").alias("top"), F.percentile_approx("_o", [i / n for i in range(1, n)], 100 * n).alias("at")).first()
    bounds = sorted({cut.top, *cut.at}, reverse=True) if cut.top is not None else [0]
    # The slice of an id: how many bounds lie at or above it, less one; found in
    # two steps so that many slices stay cheap.
    step = max(1, math.isqrt(len(bounds)))
    fine, coarse = F.array(*map(_long, bounds)), F.array(*map(_long, bounds[step::step]))
    o = F.col("_o")
    rows = rows.withColumn("_c", F.size(F.filter(coarse, lambda b: b >= o)) * step)
    rows = rows.withColumn("_s", F.col("_c") + F.size(F.filter(F.slice(fine, F.col("_c") + 1, F.lit(step)), lambda b: b >= o)) - 1)
    heads = F.get(fine, F.col("_s")) == o
    before = F.when(F.col("_s") == 0, len(bounds) - 1).otherwise(F.col("_s") - 1)
    sent = F.when(heads, F.array(F.struct(F.col("_s").alias("s"), F.lit(0).alias("ghost")),
                                 F.struct(before.alias("s"), F.lit(1).alias("ghost")))).otherwise(
        F.array(F.struct(F.col("_s").alias("s"), F.lit(0).alias("ghost"))))
    dealt = rows.withColumn("_to", F.explode(sent))
    w = Window.partitionBy("_to.s").orderBy("_to.ghost", F.desc("_o"), F.desc("_k"))
    led = dealt.withColumn("_next", F.lead(F.coalesce(F.col(f"_doc_{text_col}"), F.lit(""))).over(w)).filter("_to.ghost = 0")
    return led.select(*(F.col(f"_doc_{c}").alias(c) for c in docs.columns), F.col("_next").alias("next"))


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_next(common.documents(spark, sf_dir).select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), "next", F.length(text).cast("long").alias("n_chars"))
    moved = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - moved).cast("int")), F.substring("next", F.lit(1), moved))
    rows = rows.withColumn("edited", edited)
    rows = rows.select("doc_id", "n_chars", _hash(F.col("edited")).alias("edited_sha256"), tree(F.col("text")).alias("a"),
                       tree(F.col("edited")).alias("e"), tree(F.col("next")).alias("b"))
    a, e, b = F.col("a"), F.col("e"), F.col("b")
    return rows.select("doc_id", "n_chars", "edited_sha256", fingerprint(a).alias("fingerprint"),
                       fingerprint(e).alias("edited_fingerprint"), likeness(a, e).alias("near_edited"),
                       likeness(a, b).alias("near_next"), F.size(differing(a, e)).alias("n_differing"))
