"""Column expressions shared by the operators. All are built-in Spark
expressions, so they compile into whole-stage codegen; no Python UDFs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------- fixed values
# Status and type vocabularies of the source system.
OPEN_STATUSES = ("scheduled", "confirmed")
APPOINTMENT_STATUSES = ("scheduled", "confirmed", "completed", "cancelled")
LEDGER_TYPES = ("income", "expense")
ROLES = ("admin", "employee", "manager")
# Four-level stock labels (out, low, warning, good), as the reports print them.
STOCK_OUT, STOCK_LOW, STOCK_WARNING, STOCK_GOOD = "نفذ", "منخفض", "تحذير", "جيد"
# Three-level stock labels of the inventory listing.
STOCK3_LOW, STOCK3_WARNING, STOCK3_OK = "low", "warning", "ok"
# Markup escaping applied to incoming text: < > " ' / (ampersand is left alone).
MARKUP_ESCAPES = (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"), ("/", "&#x2F;"))
# Email pattern of the input rules.
EMAIL_PATTERN = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
DATE_PATTERN = r"^\d{4}-\d{2}-\d{2}$"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


# ------------------------------------------------------------------- money out
def to_double(c: Column) -> Column:
    """Money is summed exactly as DECIMAL and only then turned into DOUBLE."""
    return c.cast("double")


def safe_avg(c: Column) -> Column:
    """Average of a DECIMAL column as DOUBLE; NULL when there is no value."""
    n = F.count(c)
    return F.when(n > 0, F.sum(c).cast("double") / n)


def decimals_to_double(df: DataFrame) -> DataFrame:
    """Final projection: every DECIMAL column leaves as DOUBLE."""
    return df.select(*[F.col(f.name).cast("double").alias(f.name)
                       if isinstance(f.dataType, T.DecimalType) else F.col(f.name)
                       for f in df.schema.fields])


# ------------------------------------------------------------------ stock bands
def stock_status3(quantity: Column, minimum: Column) -> Column:
    """low / warning / ok; a NULL threshold falls through to ok."""
    return (F.when(quantity <= minimum, STOCK3_LOW)
             .when(quantity <= minimum * 2, STOCK3_WARNING)
             .otherwise(STOCK3_OK))


def stock_status4(quantity: Column, minimum: Column) -> Column:
    return (F.when(quantity == 0, STOCK_OUT)
             .when(quantity <= minimum, STOCK_LOW)
             .when(quantity <= minimum * 2, STOCK_WARNING)
             .otherwise(STOCK_GOOD))


# ---------------------------------------------------------------------- text
def ascii_fold(c: Column) -> Column:
    """Lower-case ASCII letters only (the source store's LIKE folds no others)."""
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def fold_text(s: str) -> str:
    """``ascii_fold`` for a literal parameter."""
    return s.translate(str.maketrans(ASCII_UPPER, ASCII_LOWER))


def escape_text(s: str) -> str:
    """``escape_markup`` for a literal parameter."""
    for raw, rep in MARKUP_ESCAPES:
        s = s.replace(raw, rep)
    return s


def escape_markup(c: Column) -> Column:
    for raw, rep in MARKUP_ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(rep))
    return c


def sanitize_column(c: Column, dtype: T.DataType) -> Column:
    """Escape markup in every string inside ``c``, recursing into structs and arrays."""
    if isinstance(dtype, T.StringType):
        return escape_markup(c)
    if isinstance(dtype, T.StructType):
        if not dtype.fields:
            return c
        return F.when(c.isNull(), F.lit(None)).otherwise(F.struct(*[
            sanitize_column(c.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields]))
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: sanitize_column(x, dtype.elementType))
    return c


def sanitize(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    names = set(columns) if columns is not None else None
    return df.select(*[
        sanitize_column(F.col(f.name), f.dataType).alias(f.name)
        if names is None or f.name in names else F.col(f.name)
        for f in df.schema.fields])


def like_contains(q: str) -> str:
    """LIKE pattern for 'contains q': % and _ in q stay wildcards; a backslash
    is doubled so Spark's default escape character stays literal."""
    return "%" + q.replace("\\", "\\\\") + "%"


def pseudonym(c: Column, salt: str) -> Column:
    """Hex SHA-256 of text + salt."""
    return F.sha2(F.concat(c, F.lit(salt)), 256)


# --------------------------------------------------------------------- time
def epoch_micros(df: DataFrame, ts: str) -> Column:
    """Microseconds since the epoch, independent of the session time zone:
    a TIMESTAMP_NTZ is read as wall-clock time (no DST jumps), a TIMESTAMP
    as an instant."""
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return F.timestamp_diff("MICROSECOND", epoch, F.col(ts))
    return F.unix_micros(F.col(ts).cast("timestamp"))


def epoch_seconds(df: DataFrame, ts: str) -> Column:
    """Whole seconds since the epoch (floored), as session tokens count them."""
    return F.floor(epoch_micros(df, ts) / 1_000_000)


# ------------------------------------------------------------------- numbers
_NUMBER_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def parse_number(c: Column) -> Column:
    """Text -> DOUBLE as a JSON body number would be read; NULL when not a
    finite decimal number. A regex guard comes first, because a bare cast
    also accepts forms such as '5d', 'NaN' and 'Infinity'."""
    s = c.cast("string")
    return F.when(s.rlike(_NUMBER_TEXT), F.trim(s).try_cast("double"))


def parse_money(c: Column) -> Column:
    return parse_number(c).try_cast(T.DecimalType(18, 2))


def parse_int(c: Column) -> Column:
    """Truncating integer read (12.7 -> 12)."""
    return F.when(parse_number(c).isNotNull(), parse_number(c).try_cast("int"))


def parse_date(c: Column) -> Column:
    s = c.cast("string")
    return F.when(s.rlike(DATE_PATTERN), F.try_to_date(s, "yyyy-MM-dd"))


def blank(c: Column) -> Column:
    """Absent, NULL or empty text."""
    return c.isNull() | (c.cast("string") == "")


def truthy(c: Column, zero_is_null: bool = True) -> Column:
    """Presence test of an optional numeric field as the source makes it
    (``x ? read(x) : null``): absent or empty text is falsy, and, with
    ``zero_is_null`` (the default, for parity), so is a numeric zero."""
    present = ~blank(c)
    if zero_is_null:
        present = present & F.coalesce(parse_number(c) != 0, F.lit(True))
    return present
