"""Day rows: the facts of a period report, kept once per entity and day, with
mergeable sketches for the distinct counts.

``day_rows`` aggregates appointments by (entity, day). Stored beside the facts
(``store_days``, one folder a day), they answer any period without reading the
facts again: sums, extremes and counts add up, and distinct customers,
employees or services come from the union of the days' sketches. The counts
are approximate (``LOG_K`` = 14: a standard error of about 0.7 %; sets up to a few
thousand are practically exact); the exact reports in ``rollups`` are what they
were, and these are for those who ask for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salonlake.operators.filters import active, in_period
from salonlake.operators.rollups import _attach, _cancelled, _completed, _count_if
from salonlake.params import Period

#: Registers of a sketch, as a power of two.
LOG_K = 14
DAY = "appointment_date"
#: What each report counts distinctly, by the key of its entity.
DISTINCT = {"service_id": ("customer_id", "employee_id"), "employee_id": ("customer_id", "service_id"),
            "customer_id": ("service_id", "employee_id")}


def day_rows(appointments: DataFrame, key: str) -> DataFrame:
    """One row per (``key``, day): counts, completed revenue and sketches."""
    paid = F.when(_completed(), F.col("price"))
    return appointments.where(F.col(key).isNotNull()).groupBy(key, DAY).agg(
        F.count(F.lit(1)).alias("visits"), _count_if(_completed()).alias("done"), _count_if(_cancelled()).alias("off"),
        _count_if(F.col("status") == "scheduled").alias("ahead"), F.sum(paid).alias("paid"), F.count(paid).alias("priced"),
        F.min(paid).alias("cheapest"), F.max(paid).alias("dearest"),
        *[F.hll_sketch_agg(c, LOG_K).alias(f"sketch_{c}") for c in DISTINCT[key]])


def store_days(appointments: DataFrame, key: str, path: str, days: Period | None = None) -> None:
    """Writes the day rows under ``path``, one folder a day. With ``days`` only
    those days are read and replaced, as after late bookings."""
    spark = appointments.sparkSession
    held = in_period(appointments, DAY, days) if days else appointments
    if days:  # a day without appointments any more must not keep its old rows
        fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for d in (days.start.fromordinal(o) for o in range(days.start.toordinal(), days.end.toordinal() + 1)):
            fs.delete(fs_path(f"{path}/{DAY}={d.isoformat()}"), True)
    (day_rows(held, key).repartition(DAY).write.mode("append" if days else "overwrite").partitionBy(DAY).parquet(path))


def load_days(spark: SparkSession, key: str, path: str) -> DataFrame:
    kinds = "visits long, done long, off long, ahead long, paid decimal(28,2), priced long, cheapest decimal(18,2), dearest decimal(18,2)"
    sketches = ", ".join(f"sketch_{c} binary" for c in DISTINCT[key])
    return spark.read.schema(f"{key} long, {kinds}, {sketches}, {DAY} date").parquet(path)


def period_rows(days: DataFrame, key: str, per: Period) -> DataFrame:
    """One row per ``key`` for a period, from day rows alone."""
    return in_period(days, DAY, per).groupBy(key).agg(
        *[F.sum(c).alias(c) for c in ("visits", "done", "off", "ahead", "paid", "priced")],
        F.min("cheapest").alias("cheapest"), F.max("dearest").alias("dearest"),
        F.min(DAY).alias("first_day"), F.max(DAY).alias("last_day"),
        *[F.hll_sketch_estimate(F.hll_union_agg(f"sketch_{c}")).alias(f"n_{c}") for c in DISTINCT[key]],
        F.count(F.lit(1)).alias("_n"))


def _measures(rows: DataFrame) -> DataFrame:
    some = F.when(F.col("visits") > F.col("done"), F.coalesce("paid", F.lit(0))).otherwise(F.col("paid"))
    return rows.withColumns({"revenue": some.cast("double"), "mean": F.when(F.col("priced") > 0, F.col("paid").cast("double") / F.col("priced")),
                             "cheapest": F.col("cheapest").cast("double"), "dearest": F.col("dearest").cast("double")})


_ZERO = ["visits", "done", "off", "ahead"]


def report_services(services: DataFrame, days: DataFrame, per: Period) -> DataFrame:
    """``rollups.report_services`` from day rows, distinct counts approximate."""
    m = _measures(period_rows(days, "service_id", per))
    dim = active(services).select("id", "name", "category", F.col("price").cast("double").alias("base_price"))
    out = _attach(dim, m, "service_id", [*_ZERO, "n_customer_id", "n_employee_id"], ["revenue"])
    return out.select("id", "name", "category", "base_price", F.col("visits").alias("appointment_count"),
                      F.col("n_customer_id").alias("unique_customers"), F.col("n_employee_id").alias("employees_provided"),
                      F.col("revenue").alias("total_revenue"), F.col("mean").alias("avg_price"), F.col("cheapest").alias("min_price"),
                      F.col("dearest").alias("max_price"), F.col("done").alias("completed"), F.col("off").alias("cancelled"))


def report_employees(users: DataFrame, days: DataFrame, per: Period) -> DataFrame:
    m = _measures(period_rows(days, "employee_id", per))
    out = _attach(active(users).select("id", "full_name", "role"), m, "employee_id",
                  [*_ZERO, "n_customer_id", "n_service_id"], ["revenue"])
    return out.select("id", "full_name", "role", F.col("visits").alias("total_appointments"), F.col("done").alias("completed"),
                      F.col("off").alias("cancelled"), F.col("ahead").alias("scheduled"), F.col("n_customer_id").alias("unique_customers"),
                      F.col("n_service_id").alias("services_provided"), F.col("revenue").alias("total_revenue"),
                      F.col("mean").alias("avg_service_value"), F.col("last_day").alias("last_appointment"))


def report_customers(customers: DataFrame, days: DataFrame, per: Period) -> DataFrame:
    m = _measures(period_rows(days, "customer_id", per)).withColumnRenamed("customer_id", "_fk")
    c = active(customers).select("id", "full_name", "phone", "email")
    return c.join(m, c["id"] == m["_fk"]).select(
        "id", "full_name", "phone", "email", F.col("visits").alias("visit_count"), F.col("n_service_id").alias("services_used"),
        F.col("n_employee_id").alias("employees_seen"), F.col("revenue").alias("total_spent"), F.col("mean").alias("avg_per_visit"),
        F.col("first_day").alias("first_visit"), F.col("last_day").alias("last_visit"), F.col("off").alias("cancelled_count"))


def within(rough: DataFrame, exact: DataFrame, counts: tuple[str, ...], part: float = 0.03) -> DataFrame:
    """``rough`` with its distinct counts replaced by whether they are within
    ``part`` of the exact report's."""
    e = exact.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in counts])
    both = rough.join(e, rough["id"] == e["_id"])
    near = {c: F.abs(F.col(c) - F.col(f"_{c}")) <= part * F.col(f"_{c}") for c in counts}
    return both.select(*[near[c].alias(f"{c}_near") if c in counts else F.col(c) for c in rough.columns])
