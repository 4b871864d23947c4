"""Enriched listings, cards and top-k lists.

Dimensions are joined LEFT so dangling keys survive as NULL names. When the
fact side is already bounded by a LIMIT, each dimension is first cut down by
a semi join against the (at most k) keys — the broadcast side is the k-row
list, never the dimension — so no dimension is shuffled for a 10-row list.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salonlake.functions.expressions import stock_status3
from salonlake.operators.filters import active, from_date, in_period
from salonlake.params import LEDGER_LISTING_CAP, RECENT_ROWS, Period


def lookup(dim: DataFrame, bounded_keys: DataFrame, dim_key: str = "id") -> DataFrame:
    """Rows of ``dim`` whose key is among ``bounded_keys`` (a LIMIT-bounded
    single column): semi join with the key list broadcast."""
    k = bounded_keys.columns[0]
    keys = bounded_keys.select(F.col(k).alias(dim_key)).where(F.col(dim_key).isNotNull())
    return dim.join(F.broadcast(keys), dim_key, "left_semi")


def _enrich_appointments(a: DataFrame, t, with_email: bool, bounded: bool) -> DataFrame:
    c = t["customers"]
    s = t["services"]
    u = t["users"]
    if bounded:
        c = lookup(c, a.select("customer_id"))
        s = lookup(s, a.select("service_id"))
        u = lookup(u, a.select("employee_id"))
    cc = [F.col("full_name").alias("customer_name"), F.col("phone").alias("customer_phone")]
    if with_email:
        cc.append(F.col("email").alias("customer_email"))
    c = c.select(F.col("id").alias("_cid"), *cc)
    s = s.select(F.col("id").alias("_sid"), F.col("name").alias("service_name"),
                 "duration_minutes", F.col("price").alias("service_price"))
    u = u.select(F.col("id").alias("_uid"), F.col("full_name").alias("employee_name"))
    return (a.join(c, a.customer_id == c._cid, "left")
             .join(s, a.service_id == s._sid, "left")
             .join(u, a.employee_id == u._uid, "left")
             .drop("_cid", "_sid", "_uid"))


def appointment_schedule(t, per: Period) -> DataFrame:
    """Appointments of a period with customer, service and staff names."""
    a = in_period(t["appointments"], "appointment_date", per)
    return _enrich_appointments(a, t, False, False).orderBy("appointment_date", "id")


def appointment_cards(t) -> DataFrame:
    """Full appointment card (adds customer email) for every appointment."""
    return _enrich_appointments(t["appointments"], t, True, False)


def recent_appointments(t, as_of: dt.date, n: int = RECENT_ROWS) -> DataFrame:
    """The n appointments on or after ``as_of`` with the latest dates (the
    source calls them recent); ties broken by id. Top-k first, then joins."""
    a = (from_date(t["appointments"], "appointment_date", as_of)
         .orderBy(F.col("appointment_date").desc(), F.col("id").desc()).limit(n)
         .cache())  # k rows, used by three key lookups: compute the top-k once
    return _enrich_appointments(a, t, False, True).select(
        *t["appointments"].columns, "customer_name", "service_name", "employee_name")


def _with_creator(tx: DataFrame, users: DataFrame) -> DataFrame:
    u = users.select(F.col("id").alias("_uid"), F.col("full_name").alias("created_by_name"))
    return tx.join(u, tx.created_by == u._uid, "left").drop("_uid")


def ledger_listing(t, per: Period, n: int = LEDGER_LISTING_CAP) -> DataFrame:
    """Newest ledger rows of a period (at most 100) with the creator's name."""
    tx = (in_period(t["transactions"], "date", per)
          .orderBy(F.col("date").desc(), F.col("id").desc()).limit(n).cache())
    return _with_creator(tx, lookup(t["users"], tx.select("created_by")))


def ledger_cards(t) -> DataFrame:
    return _with_creator(t["transactions"], t["users"])


def recent_transactions(t, n: int = RECENT_ROWS) -> DataFrame:
    return (t["transactions"]
            .orderBy(F.col("created_at").desc_nulls_last(), F.col("id").desc()).limit(n))


def service_catalogue(t) -> DataFrame:
    return active(t["services"]).orderBy(F.col("category").asc_nulls_first(), "name", "id")


def inventory_list(t) -> DataFrame:
    inv = t["inventory"]
    return (inv.withColumn("stock_status", stock_status3(F.col("quantity"), F.col("min_stock_level")))
            .orderBy(F.col("category").asc_nulls_first(), "name", "id"))
