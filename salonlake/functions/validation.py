"""Row validation as one projection: every rule is a Column that yields an
error code or NULL, and a row's errors are the non-NULL codes, in rule order.

Rule semantics follow the source system's input checks:
* a blank value (absent, NULL or '') fails ``required`` and skips the other
  rules of that field; an optional blank value skips them all;
* ``email``/``number``/``date`` are text-shape checks (a real calendar date
  is required, so 2024-02-30 fails);
* ``min_length``/``max_length`` count characters;
* ``min``/``max`` compare the numeric value (an infinity too), and do not fire
  when the value is not a number (``number`` reports that);
* ``enum`` is an exact, case-sensitive membership test.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salonlake.functions.expressions import (APPOINTMENT_STATUSES, DATE_PATTERN, EMAIL_PATTERN,
                                             LEDGER_TYPES, blank, parse_date, parse_number)

_INFINITY = r"^\s*[+-]?Infinity\s*$"
_MINUS_INFINITY, _PLUS_INFINITY = r"^\s*-Infinity\s*$", r"^\s*[+]?Infinity\s*$"


@dataclass(frozen=True)
class Rule:
    required: bool = False
    type: str | None = None  # email | number | date
    min_length: int | None = None
    max_length: int | None = None
    min: float | None = None
    max: float | None = None
    enum: tuple[str, ...] | None = None


def _is_number_text(s: Column) -> Column:
    return parse_number(s).isNotNull() | s.rlike(_INFINITY)


def field_errors(name: str, rule: Rule, value: Column | None = None) -> list[Column]:
    v = F.col(name) if value is None else value
    s = v.cast("string")
    b = blank(v)
    out: list[Column] = []
    if rule.required:
        out.append(F.when(b, F.lit(f"{name}:required")))
    checks: list[tuple[Column, str]] = []
    if rule.type == "email":
        checks.append((~s.rlike(EMAIL_PATTERN), "email"))
    elif rule.type == "number":
        checks.append((~_is_number_text(s), "number"))
    elif rule.type == "date":
        checks.append((~s.rlike(DATE_PATTERN) | parse_date(s).isNull(), "date"))
    if rule.min_length is not None:
        checks.append((F.char_length(s) < rule.min_length, "min_length"))
    if rule.max_length is not None:
        checks.append((F.char_length(s) > rule.max_length, "max_length"))
    num = parse_number(s)
    if rule.min is not None:
        below = F.regexp_like(s, F.lit(_MINUS_INFINITY))  # a number, and less than any
        checks.append((F.coalesce(num < F.lit(rule.min), below), "min"))
    if rule.max is not None:
        above = F.regexp_like(s, F.lit(_PLUS_INFINITY))
        checks.append((F.coalesce(num > F.lit(rule.max), above), "max"))
    if rule.enum is not None:
        checks.append((~s.isin(*rule.enum), "enum"))
    for cond, code in checks:
        out.append(F.when(~b & F.coalesce(cond, F.lit(False)), F.lit(f"{name}:{code}")))
    return out


def error_list(rules: dict[str, Rule]) -> Column:
    cols = [c for name, rule in rules.items() for c in field_errors(name, rule)]
    return F.filter(F.array(*cols), lambda x: x.isNotNull())


def validate(df: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """Add ``errors`` (array of ``field:rule`` codes) and ``is_valid``. A rule
    for a column the batch does not carry sees an absent (NULL) value."""
    for name in rules:
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("string"))
    return (df.withColumn("errors", error_list(rules))
              .withColumn("is_valid", F.size("errors") == 0))


def split_valid(df: DataFrame, rules: dict[str, Rule]) -> tuple[DataFrame, DataFrame]:
    v = validate(df, rules)
    return v.where("is_valid").drop("errors", "is_valid"), v.where(~F.col("is_valid"))


# ------------------------------------------------------- rule sets (fixed values)
_TEXT_100 = Rule(min_length=2, max_length=100)

CUSTOMER_CREATE = {
    "full_name": Rule(required=True, min_length=2, max_length=100),
    "phone": Rule(min_length=10, max_length=20),
    "email": Rule(type="email"),
    "notes": Rule(max_length=500),
}
CUSTOMER_UPDATE = {
    "full_name": _TEXT_100,
    "phone": Rule(min_length=10, max_length=20),
    "email": Rule(type="email"),
    "notes": Rule(max_length=500),
}
USER_CREATE = {
    "full_name": Rule(required=True, min_length=2, max_length=100),
    "email": Rule(required=True, type="email"),
    "phone": Rule(min_length=10, max_length=20),
}
APPOINTMENT_CREATE = {
    "customer_id": Rule(required=True, type="number"),
    "service_id": Rule(required=True, type="number"),
    "appointment_date": Rule(required=True, type="date"),
    "employee_id": Rule(type="number"),
    "status": Rule(enum=APPOINTMENT_STATUSES),
    "notes": Rule(max_length=500),
    "price": Rule(type="number", min=0),
}
APPOINTMENT_UPDATE = {
    "status": Rule(enum=APPOINTMENT_STATUSES),
    "appointment_date": Rule(type="date"),
    "employee_id": Rule(type="number"),
    "notes": Rule(max_length=500),
    "price": Rule(type="number", min=0),
}
LEDGER_CREATE = {
    "type": Rule(required=True, enum=LEDGER_TYPES),
    "category": Rule(required=True, min_length=2, max_length=50),
    "amount": Rule(required=True, type="number", min=0.01),
    "date": Rule(required=True, type="date"),
    "description": Rule(max_length=500),
    "appointment_id": Rule(type="number"),
}
LEDGER_UPDATE = {
    "type": Rule(enum=LEDGER_TYPES),
    "category": Rule(min_length=2, max_length=50),
    "amount": Rule(type="number", min=0.01),
    "description": Rule(max_length=500),
    "date": Rule(type="date"),
}
SERVICE_CREATE = {
    "name": Rule(required=True, min_length=2, max_length=100),
    "price": Rule(required=True, type="number", min=0),
    "duration_minutes": Rule(required=True, type="number", min=5, max=480),
    "category": Rule(max_length=50),
    "description": Rule(max_length=500),
}
SERVICE_UPDATE = {
    "name": _TEXT_100,
    "price": Rule(type="number", min=0),
    "duration_minutes": Rule(type="number", min=5, max=480),
    "category": Rule(max_length=50),
    "description": Rule(max_length=500),
}
INVENTORY_CREATE = {
    "name": Rule(required=True, min_length=2, max_length=100),
    "quantity": Rule(required=True, type="number", min=0),
    "unit_price": Rule(type="number", min=0),
    "min_stock_level": Rule(type="number", min=0),
    "category": Rule(max_length=50),
    "description": Rule(max_length=500),
}
INVENTORY_UPDATE = {
    "name": _TEXT_100,
    "quantity": Rule(type="number", min=0),
    "unit_price": Rule(type="number", min=0),
    "min_stock_level": Rule(type="number", min=0),
    "category": Rule(max_length=50),
    "description": Rule(max_length=500),
}


def valid_period(start: Column, end: Column) -> Column:
    """Both bounds present and real YYYY-MM-DD dates."""
    return parse_date(start).isNotNull() & parse_date(end).isNotNull()
