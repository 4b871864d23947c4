"""Run parameters. Every job takes an explicit run date instead of reading
the wall clock, so a rerun (e.g. after an executor loss) gives the same rows."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass


@dataclass(frozen=True)
class Period:
    """Inclusive date range."""

    start: dt.date
    end: dt.date

    @staticmethod
    def month_of(day: dt.date) -> "Period":
        first = day.replace(day=1)
        nxt = (first + dt.timedelta(days=32)).replace(day=1)
        return Period(first, nxt - dt.timedelta(days=1))


# Standard parameters of the test fixtures (FIXTURES.md).
AS_OF = dt.date(1998, 6, 15)
PERIOD = Period(dt.date(1998, 6, 1), dt.date(1998, 6, 30))

# Fixed values that must equal the reference for equal results.
CUSTOMER_PAGE_DEFAULT = 50
CUSTOMER_PAGE_MAX = 100
LEDGER_LISTING_CAP = 100
RECENT_ROWS = 10
TOP_ROWS = 5
REQUEST_LIMIT = 100
REQUEST_TTL_SECONDS = 60
SESSION_HOURS = 24
