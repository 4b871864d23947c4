"""Mixing sources to target weights, in native expressions.

Words are counted once per document and aggregated per source. The sources, in
code-point order with null last, take the weights in turn and share ``share``
times all words by weight; no source's target exceeds ``most`` times its words,
and what a capped source cannot take goes to the others by weight until none is
above. That is done in rounds over the table of sources, from which only two
sums return to the driver; the rounds end when no further source is capped.

A document of a source with rate = target / words is emitted floor(rate) times,
and once more if its coin, a hash of seed, id and text, is below the rest. So
a rerun takes the same documents, and whatever else is in the table or however
it is cut into tasks, a document's copies follow from its row and its rate.

Defined results: a null text has no words and is emitted by its coin like any
other; a null source is a source of its own, the last; null ids have coins from
their texts; rows alike in id and text share their coin; a source without words
has target 0 and rate 0; an empty table gives an empty table. A column of the
documents that has the name of a result (size, coin, source_size, target,
copies) is replaced by it.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import common

WEIGHTS, SHARE, MOST, SEED = (5, 2, 1), Fraction(3, 2), 2, "mix"
_WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of a coin, and the values that they have.
_DIGITS = 13
_EXACT = "decimal(38,0)"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def coin(id_: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1), the same for the same seed, id and text."""
    key = F.concat_ws(":", F.lit(seed), F.coalesce(id_.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, _DIGITS), 16, 10).cast("double") / float(16 ** _DIGITS)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED) -> DataFrame:
    """``docs`` with ``size`` and ``coin``."""
    return docs.withColumns({"size": words(F.col(text_col)), "coin": coin(F.col(id_col), F.col(text_col), seed)})


def _weighed(sources: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Staged (source, size, w): weights in turn in code-point order, null last.
    Places are counted by slices of the order, so no task sees all sources."""
    placed = common.staged(sources.repartitionByRange(F.asc_nulls_last("source")).sortWithinPartitions(F.asc_nulls_last("source"))
                           .withColumn("_at", F.monotonically_increasing_id())
                           .withColumn("_part", F.shiftright("_at", 33)))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each slice
    slices = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    slices = slices.select("_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    turn = (F.col("_before") + F.col("_at") - F.col("_first")) % len(weights)
    weight = F.get(F.array(*(F.lit(w).cast("long") for w in weights)), turn.cast("int"))
    out = common.staged(placed.join(slices, "_part").select("source", "size", weight.alias("w")))
    common.discard(placed)
    return out


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size), one row a source.

    With S all words, P those of capped sources and W the weights of the others,
    an uncapped source's target is w * (share * S - most * P) / W. All sums and
    comparisons are exact; capping a source only raises what the others get, so
    the capped ones stay capped and the rounds end.
    """
    table = _weighed(sources, weights)
    n, d = share.numerator, share.denominator
    size, w = F.col("size").cast(_EXACT), F.col("w").cast(_EXACT)
    total = table.agg(F.sum(size).alias("s")).first().s or 0
    capped, seen = F.lit(False), None
    while True:
        now = table.agg(F.coalesce(F.sum(F.when(capped, size)), F.lit(0).cast(_EXACT)).alias("p"),
                        F.coalesce(F.sum(F.when(~capped, w)), F.lit(0).cast(_EXACT)).alias("w")).first()
        if (now.p, now.w) == seen:
            break
        seen = (now.p, now.w)
        left = n * total - d * most * now.p  # d times what the uncapped share
        above = F.lit(False) if left <= 0 else w * F.lit(left).cast(_EXACT) > size * F.lit(most * d * now.w).cast(_EXACT)
        capped = above if now.w else F.lit(True)
    shared = F.lit(0.0) if not now.w else (w * F.lit(max(0, left)).cast(_EXACT)).cast("double") / float(d * now.w)
    return table.select("source", F.col("size").alias("source_size"),
                        F.when(capped, (size * most).cast("double")).otherwise(shared).alias("target"))


def planned(rows: DataFrame, source_col: str = "source", **shares) -> DataFrame:
    """``measured`` rows with their source's size and target, and ``copies``.
    The table of targets is joined by what Spark measures of it: sent to all
    tasks if it is small, else merged by source, where Spark splits hot ones."""
    goal = targets(rows.groupBy(F.col(source_col).alias("source")).agg(F.sum("size").alias("size")), **shares)
    goal = goal.withColumnsRenamed({c: f"_goal_{c}" for c in goal.columns})
    rows = rows.drop("source_size", "target", "copies") if source_col not in ("source_size", "target", "copies") else rows
    both = rows.join(goal, F.col(source_col).eqNullSafe(F.col("_goal_source")), "left")
    rate = F.when(F.col("_goal_source_size") > 0, F.col("_goal_target") / F.col("_goal_source_size")).otherwise(0.0)
    whole = F.floor(rate)
    copies = whole + (F.col("coin") < rate - whole).cast("long")
    return both.withColumns({"source_size": F.col("_goal_source_size"), "target": F.col("_goal_target"), "copies": copies}).drop(
        "_goal_source", "_goal_source_size", "_goal_target")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED,
          **shares) -> DataFrame:
    """The mix itself: every row of ``docs``, with its columns, as often as its
    copies say; ``copy`` (from 1) numbers them."""
    rows = common.wrapped(docs)
    plan = planned(measured(rows, f"_doc_{id_col}", f"_doc_{text_col}", seed), f"_doc_{source_col}", **shares)
    taken = plan.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return taken.select(*(F.col(f"_doc_{c}").alias(c) for c in docs.columns if c != "copy"), "copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "source", "text")
    rows = common.staged(measured(docs).drop("text"))  # counted once, read by both passes
    return planned(rows).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"),
                                "source", "copies")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, text, len([x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> '']) AS size
  FROM documents),
s AS (SELECT source, sum(size)::HUGEINT AS size, ([5, 2, 1])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::HUGEINT AS w
      FROM d GROUP BY source),
t AS (SELECT sum(size)::HUGEINT AS total FROM s),
r AS (
  SELECT 0 AS k, 0::HUGEINT AS p, (SELECT sum(w) FROM s)::HUGEINT AS free
  UNION ALL
  SELECT k + 1, np, nw FROM (
    SELECT k, p, free,
      (SELECT coalesce(sum(size), 0)::HUGEINT FROM s, t WHERE w * (3 * total - 4 * p) > 4 * size * free) AS np,
      (SELECT coalesce(sum(w), 0)::HUGEINT FROM s, t WHERE w * (3 * total - 4 * p) <= 4 * size * free) AS nw
    FROM r) WHERE (np, nw) <> (p, free)),
e AS (SELECT p, free FROM r ORDER BY k DESC LIMIT 1),
g AS (SELECT source, size::BIGINT AS source_size,
        CASE WHEN w * (3 * total - 4 * p) > 4 * size * free THEN (2 * size)::DOUBLE
             WHEN free = 0 THEN 0 ELSE (w * (3 * total - 4 * p))::DOUBLE / (2 * free)::DOUBLE END AS target
      FROM s, t, e),
c AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
        ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT / 4503599627370496.0 AS coin
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (size * (floor(rate) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken,
  source, (floor(rate) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies
FROM c"""
