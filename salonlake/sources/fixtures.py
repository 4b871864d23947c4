"""The seven business tables as views over the driver's test tables.

The mapping (which test column plays which business column) is fixed in
FIXTURES.md; the same mapping is written as SQL for the DuckDB oracle in
``salonlake.plans.oracle``. Everything here is lazy: a query that needs two
columns of ``appointments`` only scans those columns of ``orders``/``lineitem``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salonlake.operators.sequence import bucketed_sum
from salonlake.schemas import MONEY

# Fixed value of the fixture mapping: ledger dates are shifted back this many
# days so that they fall inside the appointment date range.
LEDGER_DAY_SHIFT = 9345


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = raw(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        k.alias("id"),
        F.col("s_name").alias("full_name"),
        F.concat(F.lit("u"), k.cast("string"), F.lit("@example.com")).alias("email"),
        F.when(k % 3 == 0, "admin").when(k % 3 == 1, "manager").otherwise("employee").alias("role"),
        F.when(F.col("s_acctbal") >= 0, 1).otherwise(0).alias("is_active"),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = raw(spark, sf_dir, "customer")
    first = (raw(spark, sf_dir, "orders").groupBy("o_custkey")
             .agg(F.min("o_orderdate").alias("created_at")))
    k = F.col("c_custkey")
    return (c.join(first, c.c_custkey == first.o_custkey, "left")
            .select(k.alias("id"),
                    F.col("c_name").alias("full_name"),
                    F.concat(F.lit("05"), (F.lit(10000000) + k).cast("string")).alias("phone"),
                    F.when(k % 7 == 0, F.lit(None).cast("string"))
                     .otherwise(F.concat(F.lit("c"), k.cast("string"), F.lit("@example.com")))
                     .alias("email"),
                    F.col("c_mktsegment").alias("notes"),
                    F.when(F.col("c_acctbal") >= 0, 1).otherwise(0).alias("is_active"),
                    F.col("created_at")))


def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = raw(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_retailprice").cast(MONEY).alias("price"),
        (F.lit(5) + F.col("p_size")).alias("duration_minutes"),
        F.when(F.col("p_type") == "PROMO", F.lit(None).cast("string"))
         .otherwise(F.col("p_type")).alias("category"),
        F.when(F.col("p_partkey") % 10 == 0, 0).otherwise(1).alias("is_active"),
    )


def appointments(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = raw(spark, sf_dir, "orders")
    lines = (raw(spark, sf_dir, "lineitem").groupBy("l_orderkey")
             .agg(F.min("l_partkey").alias("service_id"), F.max("l_suppkey").alias("employee_id")))
    k = F.col("o_orderkey")
    st = F.col("o_orderstatus")
    return (o.join(lines, o.o_orderkey == lines.l_orderkey, "left")
            .select(k.alias("id"),
                    F.col("o_custkey").alias("customer_id"),
                    F.col("service_id"),
                    F.col("employee_id"),
                    F.col("o_orderdate").cast("date").alias("appointment_date"),
                    F.when(st == "F", "completed").when(st == "P", "cancelled")
                     .when(k % 2 == 0, "scheduled").otherwise("confirmed").alias("status"),
                    F.when(k % 11 == 0, F.lit(None).cast(MONEY))
                     .otherwise(F.col("o_totalprice").cast(MONEY)).alias("price")))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = raw(spark, sf_dir, "events")
    et = F.col("event_type")
    return e.select(
        F.col("event_id").alias("id"),
        F.when(et.isin("purchase", "signup"), "income").otherwise("expense").alias("type"),
        et.alias("category"),
        F.col("value").cast(MONEY).alias("amount"),
        F.date_sub(F.col("ts").cast("date"), LEDGER_DAY_SHIFT).alias("date"),
        F.when(et == "purchase", F.col("event_id")).alias("appointment_id"),
        F.col("user_id").alias("created_by"),
        F.col("ts").alias("created_at"),
    )


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = raw(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        k.alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("category"),
        (F.col("p_size") - 1).alias("quantity"),
        F.when(k % 13 == 0, F.lit(None).cast(MONEY))
         .otherwise(F.col("p_retailprice").cast(MONEY)).alias("unit_price"),
        F.lit(10).alias("min_stock_level"),
    )


def inventory_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = raw(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    k = F.col("event_id")
    q = (k % 7).cast("int") - 3
    e = e.withColumn("_q", q)
    # Running stock per item in (ts, event_id) order; skew-safe (one item may
    # carry a large share of all changes: its days are summed apart).
    e = bucketed_sum(e, ["user_id"], F.to_date("ts"), [F.col("ts"), F.col("event_id")], "_q", "_run")
    return e.select(
        k.alias("id"),
        F.col("user_id").alias("inventory_id"),
        F.when(k % 7 > 3, "increase").when(k % 7 < 3, "decrease").otherwise("no_change")
         .alias("change_type"),
        F.col("_q").alias("quantity_change"),
        (F.lit(100) + F.col("_run") - F.col("_q")).cast("bigint").alias("previous_quantity"),
        (F.lit(100) + F.col("_run")).cast("bigint").alias("new_quantity"),
        (k % 20).alias("created_by"),
        F.col("ts").alias("created_at"),
    )


_BUILDERS = {
    "users": users,
    "customers": customers,
    "services": services,
    "appointments": appointments,
    "transactions": transactions,
    "inventory": inventory,
    "inventory_changes": inventory_changes,
}


class Tables(dict):
    """Lazy dict of the seven business tables for one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark = spark
        self.sf_dir = sf_dir

    def __missing__(self, name: str) -> DataFrame:
        df = _BUILDERS[name](self.spark, self.sf_dir)
        self[name] = df
        return df


def load_tables(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(spark, sf_dir)
