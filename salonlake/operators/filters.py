"""Row filters and projections (predicates reach the Parquet scan)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salonlake.functions.expressions import (OPEN_STATUSES, ascii_fold, escape_text, fold_text,
                                             like_contains)
from salonlake.params import CUSTOMER_PAGE_DEFAULT, CUSTOMER_PAGE_MAX, Period


def active(df: DataFrame) -> DataFrame:
    return df.where(F.col("is_active") == 1)


def in_period(df: DataFrame, column: str, per: Period) -> DataFrame:
    """Inclusive date range on a DATE column."""
    return df.where(F.col(column).between(F.lit(per.start), F.lit(per.end)))


def from_date(df: DataFrame, column: str, day: dt.date) -> DataFrame:
    return df.where(F.col(column) >= F.lit(day))


def is_open(status: Column) -> Column:
    return status.isin(*OPEN_STATUSES)


def open_only(df: DataFrame) -> DataFrame:
    return df.where(is_open(F.col("status")))


def low_stock(inventory: DataFrame) -> DataFrame:
    """Items at or under their threshold (a NULL threshold never matches)."""
    return inventory.where(F.col("quantity") <= F.col("min_stock_level"))


def by_ids(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows whose key is in ``ids`` (one column). A semi join: never duplicates
    rows, and AQE broadcasts ``ids`` only if it turns out small at run time."""
    key = ids.columns[0]
    return df.join(ids.select(F.col(key).alias(id_col)).distinct(), id_col, "left_semi")


def search_customers(customers: DataFrame, q: str, limit: int = CUSTOMER_PAGE_DEFAULT) -> DataFrame:
    """Active customers whose name, phone or email contains ``q``, newest first.

    The term is markup-escaped first, as incoming text always is; ``%`` and
    ``_`` keep their LIKE meaning; only ASCII letters fold case."""
    n = min(int(limit), CUSTOMER_PAGE_MAX)
    folded = like_contains(fold_text(escape_text(q)))
    hit = (ascii_fold(F.col("full_name")).like(folded)
           | ascii_fold(F.col("phone")).like(folded)
           | ascii_fold(F.col("email")).like(folded))
    return (active(customers).where(hit)
            .orderBy(F.col("created_at").desc_nulls_last(), F.col("id").desc())
            .limit(n))


def customer_page(customers: DataFrame, limit: int = CUSTOMER_PAGE_DEFAULT,
                  offset: int = 0) -> DataFrame:
    """Offset page of active customers, newest first (page size capped at 100)."""
    n = min(int(limit), CUSTOMER_PAGE_MAX)
    return (active(customers)
            .orderBy(F.col("created_at").desc_nulls_last(), F.col("id").desc())
            .offset(int(offset)).limit(n))


def customer_page_after(customers: DataFrame, after_created_at, after_id: int,
                        limit: int = CUSTOMER_PAGE_DEFAULT) -> DataFrame:
    """Keyset form of ``customer_page``: the page after a (created_at, id) cursor.
    A deep offset has to rank every earlier row; a cursor is a pushed-down filter."""
    n = min(int(limit), CUSTOMER_PAGE_MAX)
    c, i = F.col("created_at"), F.col("id")
    if after_created_at is None:
        after = c.isNull() & (i < after_id)
    else:
        ts = after_created_at if isinstance(after_created_at, Column) else F.lit(after_created_at)
        after = c.isNull() | (c < ts) | ((c == ts) & (i < after_id))
    return (active(customers).where(after)
            .orderBy(c.desc_nulls_last(), i.desc()).limit(n))


def user_directory(users: DataFrame) -> DataFrame:
    """Active staff without secret columns, by role then name."""
    keep = [c for c in ("id", "full_name", "email", "phone", "role", "avatar_url", "is_active",
                        "created_at") if c in users.columns]
    return active(users).select(*keep).orderBy("role", "full_name", "id")
