"""Report dispatcher: five report kinds over a period, each with a summary
computed as a second aggregate over the report rows (not on the driver)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from salonlake.functions.expressions import decimals_to_double
from salonlake.operators import rollups, stock
from salonlake.params import Period

KINDS = ("revenue", "services", "employees", "customers", "inventory")


def report(t, kind: str, per: Period) -> tuple[DataFrame, DataFrame]:
    """(result rows, one-row summary). Unknown kinds raise ValueError."""
    if per is None or per.start is None or per.end is None:
        raise ValueError("report needs a start and an end date")
    builders = {
        "revenue": lambda: rollups.report_revenue(t, per),
        "services": lambda: rollups.report_services(t, per),
        "employees": lambda: rollups.report_employees(t, per),
        "customers": lambda: rollups.report_customers(t, per),
        "inventory": lambda: stock.report_inventory(t),
    }
    if kind not in builders:
        raise ValueError(f"unknown report type {kind!r}; available: {', '.join(KINDS)}")
    rows = decimals_to_double(builders[kind]())
    return rows, rollups.report_summary(rows)


def parse_period(start: str | None, end: str | None) -> Period:
    """Both bounds required, as real YYYY-MM-DD dates."""
    try:
        return Period(dt.date.fromisoformat(start), dt.date.fromisoformat(end))
    except (TypeError, ValueError) as e:
        raise ValueError(f"invalid period {start!r}..{end!r}") from e


def default_period(as_of: dt.date, start: str | None = None, end: str | None = None,
                   ledger: bool = False) -> Period:
    """Listing defaults: the ledger takes the month of ``as_of`` when either
    bound is missing; the appointment listing takes ``as_of`` as start and
    the start as end."""
    if ledger:
        if not start or not end:
            return Period.month_of(as_of)
        return parse_period(start, end)
    s = start or as_of.isoformat()
    return parse_period(s, end or s)
