"""Stock views: inventory report, low-stock count, latest changes per item."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salonlake.functions.expressions import stock_status3, stock_status4
from salonlake.params import RECENT_ROWS


def report_inventory(t) -> DataFrame:
    """Every item with stock value and the four-level label, sorted by label
    (descending, binary order), category, name."""
    inv = t["inventory"]
    return (inv.select("name", "category", "quantity", "unit_price",
                       (F.col("quantity") * F.col("unit_price")).alias("total_value"),
                       "min_stock_level",
                       stock_status4(F.col("quantity"), F.col("min_stock_level")).alias("status"),
                       "id")
            .orderBy(F.col("status").desc(), F.col("category").asc_nulls_first(), "name", "id")
            .drop("id"))


def recent_changes(t, n: int = RECENT_ROWS) -> DataFrame:
    """The n latest stock changes of every item, with the actor's name.

    ``row_number() <= n`` lets Spark insert a partial WindowGroupLimit before
    the shuffle, so a hot item ships at most n rows per map task."""
    ic = t["inventory_changes"]
    w = Window.partitionBy("inventory_id").orderBy(F.col("created_at").desc_nulls_last(),
                                                   F.col("id").desc())
    top = (ic.withColumn("change_rank", F.row_number().over(w)).where(F.col("change_rank") <= n)
           .withColumn("change_rank", F.col("change_rank").cast("bigint")))
    top = top.join(t["inventory"].select(F.col("id").alias("inventory_id")), "inventory_id",
                   "left_semi")
    u = t["users"].select(F.col("id").alias("_uid"), F.col("full_name").alias("user_name"))
    return top.join(u, top.created_by == u._uid, "left").drop("_uid")


def inventory_cards(t, n: int = RECENT_ROWS) -> DataFrame:
    """Every item with its stock status and its n latest changes nested as an
    array (bounded by n, so collecting it per item is safe)."""
    ch = recent_changes(t, n)
    fields = [c for c in ch.columns if c != "inventory_id"]
    nested = (ch.groupBy("inventory_id")
              .agg(F.sort_array(F.collect_list(F.struct(
                  F.col("change_rank"), *[F.col(c) for c in fields if c != "change_rank"])))
                  .alias("changes")))
    inv = t["inventory"].withColumn(
        "stock_status", stock_status3(F.col("quantity"), F.col("min_stock_level")))
    out = inv.join(nested, inv["id"] == nested["inventory_id"], "left").drop("inventory_id")
    return out.withColumn("changes", F.coalesce(F.col("changes"), F.array().cast(
        nested.schema["changes"].dataType)))


def low_stock_count(t) -> DataFrame:
    inv = t["inventory"]
    return (inv.where(F.col("quantity") <= F.col("min_stock_level"))
            .agg(F.count(F.lit(1)).alias("low_stock_items")))
