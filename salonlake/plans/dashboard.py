"""Dashboard: nine statistics, four short lists and the period, one row.

Each statistic is a one-row aggregate; they are combined as scalar
subqueries on the month's ledger statistics (no cross join, each source
scanned once). The lists are bounded top-k
results nested with ``collect_list(struct)`` over at most k rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salonlake.functions.expressions import decimals_to_double
from salonlake.operators import filters, listings, rollups, stock
from salonlake.params import RECENT_ROWS, TOP_ROWS, Period


def dashboard_stats(t, as_of: dt.date) -> DataFrame:
    month = Period.month_of(as_of)
    customers = filters.active(t["customers"]).agg(F.count(F.lit(1)).alias("n"))
    services = filters.active(t["services"]).agg(F.count(F.lit(1)).alias("n"))
    today = (filters.open_only(t["appointments"])
             .where(F.col("appointment_date") == F.lit(as_of)).agg(F.count(F.lit(1)).alias("n")))
    low = stock.low_stock_count(t)
    # The month's ledger statistics are the one-row anchor (one ledger scan);
    # every other statistic is a scalar subquery referenced exactly once.
    ms = rollups.month_stats(t, month)
    return ms.select(
        customers.scalar().alias("total_customers"),
        services.scalar().alias("total_services"),
        today.scalar().alias("today_appointments"),
        low.scalar().alias("low_stock_items"),
        F.col("income").alias("monthly_income"),
        F.col("expense").alias("monthly_expense"),
        F.col("profit").alias("monthly_profit"),
        "total_transactions", "active_days",
        F.lit(as_of).alias("today"),
        F.lit(month.start).alias("month_start"),
        F.lit(month.end).alias("month_end"))


def _nest(df: DataFrame, *rank) -> DataFrame:
    """The rows as one array in the order of ``rank``, whose keys are not part
    of the elements."""
    keys = [k.alias(f"_r{i}") for i, k in enumerate(rank)]
    rows = decimals_to_double(df)
    ordered = F.sort_array(F.collect_list(F.struct(*keys, F.struct(*rows.columns).alias("row"))))
    return rows.agg(F.transform(ordered, lambda e: e["row"]).alias("x"))


def dashboard(t, as_of: dt.date) -> DataFrame:
    """Statistics plus the recent/top lists in their listed order, as one row."""
    month = Period.month_of(as_of)
    stats = dashboard_stats(t, as_of)
    by_id = F.col("id")
    spent, created = F.col("total_spent"), F.unix_micros(F.col("created_at").cast("timestamp"))
    lists = {
        "recent_appointments": _nest(listings.recent_appointments(t, as_of, RECENT_ROWS),
                                     -F.unix_date("appointment_date"), -by_id),
        "recent_transactions": _nest(listings.recent_transactions(t, RECENT_ROWS), created.isNull(), -created, -by_id),
        "top_services": _nest(rollups.top_services(t, month, TOP_ROWS), -F.col("count"), by_id),
        "top_customers": _nest(rollups.top_customers(t, month, TOP_ROWS), spent.isNull(), -spent, by_id),
    }
    return stats.select("*", *[df.scalar().alias(n) for n, df in lists.items()])
