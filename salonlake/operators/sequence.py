"""Ordered per-key scans that stay balanced when one key is hot.

A plain ``Window.partitionBy(key).orderBy(...)`` sends every row of a key to
one task; if one key holds a third of a 100 TB table, that task never ends.
Here rows are range-partitioned on (key, order) instead, so a hot key is cut
into several contiguous slices. Each slice is scanned locally by a window on
(slice, key), and the only thing that crosses slices is one carry row per
(slice, key) that continues from the neighbouring slices. A key can continue
into slice p only as the first (or, scanning backwards, the last) key of p,
so the carry table has at most one row per slice boundary: bounded by the
partition count and safe to broadcast.

``sliced`` materialises the slicing once; any number of ``scan``/``lag_scan``
calls then reuse it (their windows share the (slice, key) clustering).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salonlake.session import ensure_checkpoint_dir

SLICE = "_slice"
_AGG = {"sum": F.sum, "min": F.min, "max": F.max}


def slices(spark) -> int:
    try:
        return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    except (TypeError, ValueError):
        return 200


def sliced(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Range-partition on (keys, order) and tag rows with their slice.

    The sliced rows are checkpointed (reliable storage under the session's
    ``spark.checkpoint.dir``): every later scan and its carry table must see
    the *same* slice boundaries, but two range exchanges of the same data
    pick boundaries from independent samples (and column pruning makes the
    exchanges of two branches differ, so they are not reused). Reading one
    written copy makes the slices identical, and cuts the lineage so a lost
    executor does not re-sample."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = slices(spark)
    return (df.repartitionByRange(n, *[F.col(k) for k in keys], *order)
              .withColumn(SLICE, F.spark_partition_id())
              .checkpoint(eager=True))


def _combine(fn: str, a: Column, b: Column) -> Column:
    """Combine a local partial with the carry (either may be NULL)."""
    if fn == "sum":
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
    if fn == "min":
        return F.least(a, b)
    return F.greatest(a, b)


def _carry_join(local: DataFrame, carry: DataFrame, keys: list[str],
                carries: list[str] = ("_carry",)) -> DataFrame:
    c = carry.select(F.col(SLICE).alias("_cp"), *[F.col(k).alias("_ck_" + k) for k in keys],
                     *carries)
    cond = local[SLICE] == c["_cp"]
    for k in keys:
        cond = cond & local[k].eqNullSafe(c["_ck_" + k])
    # One carry row per slice boundary at most: bounded, so broadcast.
    return local.join(F.broadcast(c), cond, "left")


def _drop_carry(df: DataFrame, keys: list[str], *extra: str) -> DataFrame:
    return df.drop("_cp", "_carry", *extra, *["_ck_" + k for k in keys])


def scan(s: DataFrame, keys: list[str], order: list[str | Column], value, out,
         fn: str = "sum", inclusive: bool = True, reverse: bool = False) -> DataFrame:
    """On ``sliced`` rows: ``out`` = fn(``value``) over the rows of the same key
    before this one in ``order`` (after it when ``reverse``), plus this row
    when ``inclusive``. NULL values are skipped; nothing to aggregate gives
    NULL. ``order`` is the ascending slicing order, given as column names
    when ``reverse`` is used. ``value``/``out`` may be lists (same fn, one
    pass)."""
    values = [value] if isinstance(value, str) else list(value)
    outs = [out] if isinstance(out, str) else list(out)
    agg = _AGG[fn]
    if reverse:
        order = [F.col(c).desc() if isinstance(c, str) else _bad_reverse(c) for c in order]
    w = Window.partitionBy(SLICE, *keys).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    local = s
    for v, o in zip(values, outs):
        local = local.withColumn(o, agg(v).over(w))
    tot = s.groupBy(SLICE, *keys).agg(*[agg(v).alias(f"_tot{i}") for i, v in enumerate(values)],
                                      F.count(F.lit(1)).alias("_n"))
    slice_order = F.col(SLICE).desc() if reverse else F.col(SLICE)
    prior = Window.partitionBy(*keys).orderBy(slice_order).rowsBetween(
        Window.unboundedPreceding, -1)
    carry = tot.withColumn("_has", F.sum("_n").over(prior) > 0)
    names = [f"_carry{i}" for i in range(len(values))]
    for i, n in enumerate(names):
        carry = carry.withColumn(n, agg(f"_tot{i}").over(prior))
    carry = carry.where("_has")
    j = _carry_join(local, carry, keys, names)
    for o, n in zip(outs, names):
        j = j.withColumn(o, _combine(fn, F.col(o), F.col(n)))
    return _drop_carry(j, keys, *names)


def _bad_reverse(c: Column):
    raise ValueError("reverse scans take the ascending order as column names")


def lag_scan(s: DataFrame, keys: list[str], order: list[Column], value: str,
             out: str) -> DataFrame:
    """On ``sliced`` rows: ``out`` = ``value`` of the previous row of the key
    in ``order`` (NULL for the key's first row)."""
    w = Window.partitionBy(SLICE, *keys).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    local = (s.withColumn(out, F.lag(value).over(w))
              .withColumn("_first", F.row_number().over(w) == 1)
              .withColumn("_lastv", F.last(value).over(whole)))
    # Same (slice, key) clustering as the window: no extra exchange.
    last = local.groupBy(SLICE, *keys).agg(F.first("_lastv").alias("_last"))
    prior = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = (last.withColumn("_has", F.count(F.lit(1)).over(prior) > 0)
                 .withColumn("_carry", F.last("_last").over(prior))
                 .where("_has"))
    j = _carry_join(local, carry, keys)
    res = j.withColumn(out, F.when(F.col("_first") & F.col("_cp").isNotNull(), F.col("_carry"))
                        .otherwise(F.col(out)))
    return _drop_carry(res, keys, "_first", "_lastv")


# ------------------------------------------------------- scans without a job
def bucketed_sum(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], value: str, out: str) -> DataFrame:
    """``out`` = sum of ``value`` over the rows of the same key up to and
    including this row in ``order``, planned lazily: nothing runs and nothing is
    written while the query is built.

    ``bucket`` must never fall along ``order`` (a day of its leading time, a range
    of its leading number). Being a function of the row alone, it gives both
    passes the same slices whatever runs when: rows are dealt by (key, bucket) and
    summed there, so a hot key is cut into its buckets, and what comes before a
    bucket is a running sum over the key's bucket totals, one row per bucket
    that the key has."""
    rows = df.withColumn(SLICE, bucket)
    within = Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.groupBy(*keys, SLICE).agg(F.sum(value).alias("_total"))
    carry = carry.select(*[F.col(k).alias(f"_ck_{k}") for k in keys], F.col(SLICE).alias("_cp"),
                         F.sum("_total").over(before).alias("_carry"))
    local = rows.withColumn(out, F.sum(value).over(within))
    on = F.col(SLICE).eqNullSafe(F.col("_cp"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_ck_{k}"))
    j = local.join(carry, on).withColumn(out, _combine("sum", F.col(out), F.col("_carry")))
    return _drop_carry(j, keys, SLICE)


# --------------------------------------------------------- one-shot wrappers
def running_agg(df: DataFrame, keys: list[str], order: list[Column], value: str, out: str,
                fn: str = "sum", inclusive: bool = True) -> DataFrame:
    """``out`` = fn(``value``) over the rows of the same key that come before
    this row in ``order`` (and this row too when ``inclusive``). ``order``
    must make rows unique within a key. fn is sum, min or max."""
    return scan(sliced(df, keys, order), keys, order, value, out, fn, inclusive).drop(SLICE)


def running_sum(df: DataFrame, keys: list[str], order: list[Column], value: str,
                out: str) -> DataFrame:
    """``out`` = sum of ``value`` over rows of the same key up to and including
    this row in ``order`` (``order`` must make rows unique within a key)."""
    return running_agg(df, keys, order, value, out, "sum", True)


def previous_value(df: DataFrame, keys: list[str], order: list[Column], value: str,
                   out: str) -> DataFrame:
    """``out`` = ``value`` of the row just before this one within the key
    (NULL for the first row of a key): a skew-safe ``lag``."""
    return lag_scan(sliced(df, keys, order), keys, order, value, out).drop(SLICE)
