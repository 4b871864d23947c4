"""Aggregations: ledger rollups, entity cards and the per-entity reports.

Shape used for every "dimension LEFT JOIN facts GROUP BY dimension key":
facts are filtered, then aggregated by the foreign key (partial aggregation
runs map-side, so a hot key costs one row per map task), and only then
joined to the dimension, whose key is unique. The join input shrinks from
#facts to #distinct keys, and the dimension columns need no aggregate.

Null rules of the source SQL that the pre-aggregated form must keep:
counts of an entity without facts are 0; ``SUM(CASE ... ELSE 0)`` is 0 for an
entity without facts but NULL when all its facts are completed without a
price; averages/min/max without a completed fact are NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salonlake.functions.expressions import safe_avg
from salonlake.operators.filters import active, in_period
from salonlake.params import Period



def _is(col: str, value: str):
    return lambda: F.col(col) == value


_completed = _is("status", "completed")
_cancelled = _is("status", "cancelled")
_income = _is("type", "income")
_expense = _is("type", "expense")


def _count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def _revenue(price: str = "price") -> Column:
    """SUM(CASE WHEN completed THEN price ELSE 0 END)."""
    return F.sum(F.when(_completed(), F.col(price)).otherwise(F.lit(0)))


def _attach(dim: DataFrame, facts: DataFrame, key: str, counts: list[str],
            sums: list[str], how: str = "left") -> DataFrame:
    """Join pre-aggregated facts (keyed by ``key``) to a dimension keyed by id.
    ``counts`` default to 0; ``sums`` default to 0 only for entities that have
    no facts at all (``_n`` is NULL), keeping a genuine NULL sum."""
    f = facts.withColumnRenamed(key, "_fk")
    j = dim.join(f, dim["id"] == f["_fk"], how).drop("_fk")
    for c in counts:
        j = j.withColumn(c, F.coalesce(F.col(c), F.lit(0)))
    for c in sums:
        j = j.withColumn(c, F.when(F.col("_n").isNull(), F.lit(0)).otherwise(F.col(c)))
    return j.drop("_n")


# ------------------------------------------------------------------ ledger
def ledger_summary(t, per: Period) -> DataFrame:
    tx = in_period(t["transactions"], "date", per)
    return (tx.groupBy("type", "category")
            .agg(F.count(F.lit(1)).alias("count"),
                 F.sum("amount").cast("double").alias("total"),
                 safe_avg(F.col("amount")).alias("average"))
            .orderBy("type", F.col("total").desc()))


def ledger_totals(t, per: Period) -> DataFrame:
    tx = in_period(t["transactions"], "date", per)
    a = F.col("amount")
    return tx.agg(
        F.sum(F.when(_income(), a).otherwise(0)).cast("double").alias("total_income"),
        F.sum(F.when(_expense(), a).otherwise(0)).cast("double").alias("total_expense"),
        F.sum(F.when(_income(), a).otherwise(-a)).cast("double").alias("net_profit"))


def month_stats(t, per: Period) -> DataFrame:
    """Income, expense, profit, row count and active days of a period; zeros
    when the period is empty."""
    tx = in_period(t["transactions"], "date", per)
    a = F.col("amount")
    s = tx.agg(F.sum(F.when(_income(), a).otherwise(0)).alias("_inc"),
               F.sum(F.when(_expense(), a).otherwise(0)).alias("_exp"),
               F.count(F.lit(1)).alias("total_transactions"),
               F.count_distinct("date").alias("active_days"))
    inc = F.coalesce(F.col("_inc"), F.lit(0))
    exp = F.coalesce(F.col("_exp"), F.lit(0))
    return s.select(inc.cast("double").alias("income"), exp.cast("double").alias("expense"),
                    (inc - exp).cast("double").alias("profit"),
                    "total_transactions", "active_days")


def report_revenue(t, per: Period) -> DataFrame:
    """Daily income, expense, profit, row count and sorted distinct categories."""
    tx = in_period(t["transactions"], "date", per)
    a = F.col("amount")
    return (tx.groupBy("date")
            .agg(F.sum(F.when(_income(), a).otherwise(0)).cast("double").alias("income"),
                 F.sum(F.when(_expense(), a).otherwise(0)).cast("double").alias("expense"),
                 F.sum(F.when(_income(), a).otherwise(-a)).cast("double").alias("profit"),
                 F.count(F.lit(1)).alias("transaction_count"),
                 F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))
            .orderBy(F.col("date").desc()))


def report_summary(report: DataFrame) -> DataFrame:
    """Totals over report rows plus the record count (revenue columns are 0
    for report kinds that have none)."""
    cols = set(report.columns)

    def tot(c):
        if c not in cols:
            return F.lit(0.0)
        return F.coalesce(F.sum(F.coalesce(F.col(c), F.lit(0.0))), F.lit(0.0))

    return report.agg(tot("income").alias("total_income"),
                      tot("expense").alias("total_expense"),
                      tot("profit").alias("net_profit"),
                      F.count(F.lit(1)).alias("total_records"))


# ------------------------------------------------------------ entity cards
def _card(dim: DataFrame, facts: DataFrame, key: str, count_name: str,
          sum_name: str) -> DataFrame:
    # The appointment id is the table key, so COUNT(DISTINCT id) == COUNT(id).
    agg = facts.groupBy(key).agg(F.count("id").alias(count_name),
                                 _revenue().alias(sum_name),
                                 F.count(F.lit(1)).alias("_n"))
    out = _attach(active(dim), agg, key, [count_name], [sum_name])
    return out.withColumn(sum_name, F.col(sum_name).cast("double"))


def customer_cards(t) -> DataFrame:
    """Every active customer with all-time appointment count and completed spend."""
    return _card(t["customers"], t["appointments"], "customer_id",
                 "appointment_count", "total_spent")


def service_cards(t) -> DataFrame:
    return _card(t["services"], t["appointments"], "service_id",
                 "appointment_count", "total_revenue")


# ----------------------------------------------------------------- reports
def _period_facts(t, per: Period) -> DataFrame:
    return in_period(t["appointments"], "appointment_date", per)


def _completed_price(fn):
    return fn(F.when(_completed(), F.col("price")))


def report_services(t, per: Period) -> DataFrame:
    f = _period_facts(t, per).groupBy("service_id").agg(
        F.count("id").alias("appointment_count"),
        F.count_distinct("customer_id").alias("unique_customers"),
        F.count_distinct("employee_id").alias("employees_provided"),
        _revenue().alias("total_revenue"),
        safe_avg(F.when(_completed(), F.col("price"))).alias("avg_price"),
        _completed_price(F.min).alias("min_price"),
        _completed_price(F.max).alias("max_price"),
        _count_if(_completed()).alias("completed"),
        _count_if(_cancelled()).alias("cancelled"),
        F.count(F.lit(1)).alias("_n"))
    s = active(t["services"]).select("id", "name", "category", F.col("price").alias("base_price"))
    out = _attach(s, f, "service_id",
                  ["appointment_count", "unique_customers", "employees_provided", "completed",
                   "cancelled"], ["total_revenue"])
    return out.select("id", "name", "category", F.col("base_price").cast("double"),
                      "appointment_count", "unique_customers", "employees_provided",
                      F.col("total_revenue").cast("double"), "avg_price",
                      F.col("min_price").cast("double"), F.col("max_price").cast("double"),
                      "completed", "cancelled").orderBy(F.col("total_revenue").desc_nulls_last(), "id")


def report_employees(t, per: Period) -> DataFrame:
    f = _period_facts(t, per).groupBy("employee_id").agg(
        F.count("id").alias("total_appointments"),
        _count_if(_completed()).alias("completed"),
        _count_if(_cancelled()).alias("cancelled"),
        _count_if(F.col("status") == "scheduled").alias("scheduled"),
        F.count_distinct("customer_id").alias("unique_customers"),
        F.count_distinct("service_id").alias("services_provided"),
        _revenue().alias("total_revenue"),
        safe_avg(F.when(_completed(), F.col("price"))).alias("avg_service_value"),
        F.max("appointment_date").alias("last_appointment"),
        F.count(F.lit(1)).alias("_n"))
    u = active(t["users"]).select("id", "full_name", "role")
    out = _attach(u, f, "employee_id",
                  ["total_appointments", "completed", "cancelled", "scheduled",
                   "unique_customers", "services_provided"], ["total_revenue"])
    return out.withColumn("total_revenue", F.col("total_revenue").cast("double")) \
              .orderBy(F.col("total_revenue").desc_nulls_last(), "id")


def report_customers(t, per: Period) -> DataFrame:
    """Active customers with at least one appointment in the period (the
    source's HAVING visit_count > 0 makes this an inner join)."""
    f = _period_facts(t, per).groupBy("customer_id").agg(
        F.count("id").alias("visit_count"),
        F.count_distinct("service_id").alias("services_used"),
        F.count_distinct("employee_id").alias("employees_seen"),
        _revenue().cast("double").alias("total_spent"),
        safe_avg(F.when(_completed(), F.col("price"))).alias("avg_per_visit"),
        F.min("appointment_date").alias("first_visit"),
        F.max("appointment_date").alias("last_visit"),
        _count_if(_cancelled()).alias("cancelled_count"))
    c = active(t["customers"]).select("id", "full_name", "phone", "email")
    f = f.where(F.col("visit_count") > 0).withColumnRenamed("customer_id", "_fk")
    return (c.join(f, c["id"] == f["_fk"], "inner").drop("_fk")
            .orderBy(F.col("total_spent").desc_nulls_last(), "id"))


# ------------------------------------------------------------------ top-k
def _named(dim: DataFrame, facts: DataFrame, key: str, cols: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` of ``facts`` in ``order`` with columns of their dimension:
    only its ids meet all facts, its other columns the ``n`` that are left."""
    held = facts.withColumnRenamed(key, "id").join(dim.select("id"), "id", "left_semi").orderBy(*order).limit(n)
    names = dim.select(*cols).join(F.broadcast(held.select("id")), "id", "left_semi")  # n ids
    out = held.join(F.broadcast(names), "id")
    return out.select(*cols, *[c for c in facts.columns if c != key]).orderBy(*order)


def top_services(t, per: Period, n: int) -> DataFrame:
    """Services with the most completed appointments in the period."""
    f = (_period_facts(t, per).where(_completed()).groupBy("service_id")
         .agg(F.count("id").alias("count"), _revenue().cast("double").alias("revenue")))
    return _named(t["services"], f, "service_id", ["id", "name"], [F.col("count").desc(), F.col("id")], n)


def top_customers(t, per: Period, n: int) -> DataFrame:
    """Customers with the highest completed spend in the period."""
    f = (_period_facts(t, per).where(_completed()).groupBy("customer_id")
         .agg(F.count("id").alias("visits"), _revenue().cast("double").alias("total_spent")))
    return _named(t["customers"], f, "customer_id", ["id", "full_name"],
                  [F.col("total_spent").desc_nulls_last(), F.col("id")], n)


# ------------------------------------------------------------ simple counts
def active_counts(t) -> DataFrame:
    """Active customers and active services (the pagination total)."""
    c = active(t["customers"]).agg(F.count(F.lit(1)).alias("total_customers"))
    s = active(t["services"]).agg(F.count(F.lit(1)).alias("total_services"))
    return c.select("total_customers", s.scalar().alias("total_services"))
