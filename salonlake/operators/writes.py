"""Write rules: apply a batch of change rows to a table snapshot.

The source applies one request at a time, in arrival order. A batch carries
``request_seq`` and every rule here returns what replaying the batch in
``request_seq`` order would give, but as bulk joins and aggregations:

* partial update: per id and column, the last non-NULL value of the batch
  (``max_by`` with a NULL ordering for NULL values), then ``coalesce`` over
  the snapshot;
* double booking: per (employee, day) the earliest open request, joined back;
* automatic ledger posting: first qualifying update per appointment, anti
  join on the ledger;
* stock log: previous quantity via a skew-safe ``lag``;
* new surrogate ids: slice-local row numbers plus slice offsets (no global
  single-partition window).

All grouping keys may be hot: every aggregate here is partial (map-side
combine) and every per-key order uses ``operators.sequence``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salonlake.functions.expressions import (OPEN_STATUSES, blank, escape_markup, parse_date,
                                             parse_money, parse_number, truthy)
from salonlake.functions.validation import Rule, validate
from salonlake.operators.sequence import previous_value, running_sum

# Fixed values written by the automatic ledger posting and the stock log.
POSTING_CATEGORY = "خدمة"
POSTING_DESCRIPTION_PREFIX = "دفعة موعد رقم "
STOCK_SET_REASON = "تحديث الكمية"
STOCK_CREATE_REASON = "إضافة منتج جديد"
STOCK_UPDATE_REASON = "تحديث المنتج"


def _last_non_null(c: str) -> Column:
    """Last non-NULL value of ``c`` in request order."""
    return F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("request_seq")))


def assign_ids(df: DataFrame, base: Column | int, out: str = "id",
               order: str = "request_seq") -> DataFrame:
    """``out`` = base + 1, base + 2, ... in ``order``: sequential surrogate
    keys as a store's last-row-id would hand them out."""
    one = df.withColumn("_one", F.lit(1))
    r = running_sum(one, [], [F.col(order)], "_one", "_rank")
    b = base if isinstance(base, Column) else F.lit(base)
    return r.withColumn(out, (b + F.col("_rank")).cast("bigint")).drop("_one", "_rank")


def known(batch: DataFrame, table: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``batch`` whose ``key`` exists in ``table``.

    The table side is first cut to the ids the batch names (a semi join whose
    small side is the batch's distinct ids, which AQE broadcasts when it is
    small), so a large table is filtered where it is read rather than
    shuffled whole for a small batch."""
    ids = batch.select(F.col(key).alias("id")).where(F.col("id").isNotNull()).distinct()
    hit = table.select("id").join(ids, "id", "left_semi").withColumnRenamed("id", key)
    return batch.join(hit, key, "left_semi")


def stored_values(batch: DataFrame, table: DataFrame, value: str, out: str, key: str = "id") -> DataFrame:
    """``batch`` with ``out``: the stored ``value`` of the row that ``key`` names
    (NULL if there is none). The table is cut to those rows where it is read."""
    ids = batch.select(F.col(key).alias("_sid")).where("_sid is not null").distinct()
    held = table.select(F.col("id").alias("_sid"), F.col(value).alias(out)).join(ids, "_sid", "left_semi")
    return batch.join(held, batch[key] == held["_sid"], "left").drop("_sid")


def max_id(table: DataFrame) -> Column:
    """Scalar subquery: the largest id of ``table`` (0 when empty)."""
    return table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).scalar()


# ------------------------------------------------------------- H3 updates
def apply_updates(snapshot: DataFrame, changes: DataFrame, columns: list[str],
                  require_active: bool = False) -> DataFrame:
    """Partial update: NULL keeps the old value. Changes to unknown ids (or
    inactive ones when ``require_active``) do nothing. Adds ``updated_by``,
    ``updated_at`` (of the last applied change) and ``n_updates``."""
    target = snapshot.where(F.col("is_active") == 1) if require_active else snapshot
    applied = known(changes, target)
    fold = applied.groupBy("id").agg(
        *[_last_non_null(c).alias("_new_" + c) for c in columns],
        F.max_by("actor_id", "request_seq").alias("_by"),
        F.max_by("now", "request_seq").alias("_at"),
        F.count(F.lit(1)).alias("n_updates"))
    fold = fold.withColumnRenamed("id", "_fid")
    j = snapshot.join(fold, snapshot["id"] == fold["_fid"], "left")
    audit = ("updated_by", "updated_at", "n_updates")
    keep = [c for c in snapshot.columns if c not in audit]

    def old(c):
        return F.col(c) if c in snapshot.columns else F.lit(None)

    by, at = F.col("_by"), F.col("_at")
    if "updated_at" in snapshot.columns:
        at = at.cast(snapshot.schema["updated_at"].dataType)
    return j.select(
        *[F.coalesce(F.col("_new_" + c).cast(snapshot.schema[c].dataType), F.col(c)).alias(c)
          if c in columns else F.col(c) for c in keep],
        F.coalesce(by, old("updated_by")).alias("updated_by"),
        F.coalesce(at, old("updated_at")).alias("updated_at"),
        F.coalesce(F.col("n_updates"), F.lit(0)).alias("n_updates"))


def update_customers(customers: DataFrame, changes: DataFrame,
                     rules: dict[str, Rule]) -> DataFrame:
    """Validated, markup-escaped partial update of active customers."""
    cols = ["full_name", "phone", "email", "notes"]
    ok = validate(changes, rules).where("is_valid")
    ok = ok.select("request_seq", "actor_id", "now", "id",
                   *[escape_markup(F.col(c)).alias(c) for c in cols])
    return apply_updates(customers, ok, cols, require_active=True)


# ----------------------------------------------------------- H4 deletes
def soft_delete(snapshot: DataFrame, deletes: DataFrame, by_col: str = "deleted_by",
                at_col: str = "deleted_at") -> DataFrame:
    """Mark rows inactive; the last request for an id sets who/when. No
    active guard: deleting twice rewrites who/when."""
    d = (deletes.groupBy("id").agg(F.max_by("actor_id", "request_seq").alias("_by"),
                                   F.max_by("now", "request_seq").alias("_at"))
         .withColumnRenamed("id", "_did"))
    j = snapshot.join(d, snapshot["id"] == d["_did"], "left")
    hit = F.col("_did").isNotNull()
    return _marked(j, snapshot, {by_col: "_by", at_col: "_at"}, is_active=F.when(hit, F.lit(0)).otherwise(F.col("is_active")))


def cancel_appointments(appointments: DataFrame, cancels: DataFrame) -> DataFrame:
    """DELETE on an appointment sets status cancelled with who/when."""
    d = (cancels.groupBy("id").agg(F.max_by("actor_id", "request_seq").alias("_by"),
                                   F.max_by("now", "request_seq").alias("_at"))
         .withColumnRenamed("id", "_did"))
    j = appointments.join(d, appointments["id"] == d["_did"], "left")
    hit = F.col("_did").isNotNull()
    return _marked(j, appointments, {"cancelled_by": "_by", "cancelled_at": "_at"},
                   status=F.when(hit, F.lit("cancelled")).otherwise(F.col("status")))


def _marked(j: DataFrame, snapshot: DataFrame, who: dict[str, str], **changed) -> DataFrame:
    """Columns of ``snapshot`` with the ``changed`` ones, and who/when columns
    that keep earlier values of rows without a request. ``updated_at``, where
    the snapshot has it, follows the request's time."""
    if "updated_at" in snapshot.columns:
        who = {**who, "updated_at": "_at"}

    def merged(new: str, col: str):
        if col not in snapshot.columns:
            return F.col(new).alias(col)
        return F.coalesce(F.col(new).cast(snapshot.schema[col].dataType), F.col(col)).alias(col)

    return j.select(*[changed.get(c, F.col(c)).alias(c) for c in snapshot.columns if c not in who],
                    *[merged(new, col) for col, new in who.items()])


def hard_delete(snapshot: DataFrame, deletes: DataFrame) -> DataFrame:
    return snapshot.join(deletes.select("id"), "id", "left_anti")


def outcome(changes: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Per request: 'ok' when its id exists, else 'not_found'."""
    hit = changes.join(snapshot.select("id").withColumn("_hit", F.lit(True)), "id", "left")
    return hit.select("*", F.when(F.col("_hit"), F.lit("ok")).otherwise(F.lit("not_found"))
                      .alias("outcome")).drop("_hit")


# -------------------------------------------------------- H5 unique insert
def insert_users(users: DataFrame, new: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """Accepted sign-ups: valid, first of their email in the batch, email not
    taken; new ids follow the current largest id in request order."""
    v = validate(new, rules).where("is_valid")
    made = [F.col("now").alias("created_at")] if "now" in v.columns else []
    v = v.select("request_seq", *made, *[escape_markup(F.col(c)).alias(c)
                                         for c in ("full_name", "email", "phone", "role")])
    first = v.groupBy("email").agg(F.min("request_seq").alias("request_seq"))
    v = v.join(first, ["email", "request_seq"], "left_semi")
    # The table is cut to the batch's e-mails where it is read.
    taken = users.select("email").join(first.select("email"), "email", "left_semi")
    v = v.join(taken, "email", "left_anti")
    v = v.withColumn("role", F.coalesce(F.when(~blank(F.col("role")), F.col("role")),
                                        F.lit("employee")))
    v = assign_ids(v, max_id(users))
    return v.select("id", "full_name", "email", "phone", "role",
                    F.lit(1).alias("is_active"), *[c for c in v.columns if c == "created_at"], "request_seq")


# ------------------------------------------------------ H6 double booking
def booking_accept(appointments: DataFrame, requests: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """Decide each new booking: invalid, conflict or accepted.

    A booking with an employee is refused when that employee already has an
    open appointment that day (existing row with id != 0, as the source's
    ``id != 0`` self-exclusion leaves out id 0), or an earlier open booking
    of the batch for the same key. An earlier open booking always exists iff
    an earlier *accepted* open booking exists, so the rule needs only the
    earliest open request per key: a partial aggregate, skew-safe."""
    v = validate(requests, rules)
    r = v.select("request_seq", "actor_id", "is_valid",
                 F.when(truthy(F.col("employee_id")),
                        parse_number(F.col("employee_id")).cast("bigint")).alias("employee_id"),
                 parse_date(F.col("appointment_date")).alias("appointment_date"),
                 F.coalesce(F.when(~blank(F.col("status")), F.col("status")),
                            F.lit("scheduled")).alias("status"))
    checked = F.col("is_valid") & F.col("employee_id").isNotNull()
    first_open = (r.where(checked & F.col("status").isin(*OPEN_STATUSES))
                  .groupBy("employee_id", "appointment_date")
                  .agg(F.min("request_seq").alias("_first_open")))
    # The table is cut to the batch's slots where it is read.
    slots = r.where(checked).select("employee_id", "appointment_date").distinct()
    existing = (appointments.where(F.col("status").isin(*OPEN_STATUSES)
                                   & F.col("employee_id").isNotNull() & (F.col("id") != 0))
                .select("employee_id", "appointment_date").join(slots, ["employee_id", "appointment_date"], "left_semi")
                .groupBy("employee_id", "appointment_date")
                .agg(F.lit(True).alias("_taken")))
    keys = (first_open.join(existing, ["employee_id", "appointment_date"], "full")
            .withColumnRenamed("employee_id", "_e").withColumnRenamed("appointment_date", "_d"))
    j = r.join(keys, (r.employee_id == keys._e) & (r.appointment_date == keys._d), "left")
    conflict = checked & (F.coalesce(F.col("_taken"), F.lit(False))
                          | (F.col("request_seq") > F.coalesce(F.col("_first_open"),
                                                               F.col("request_seq"))))
    return j.select("request_seq", "employee_id", "appointment_date", "status",
                    F.when(~F.col("is_valid"), F.lit("invalid"))
                     .when(conflict, F.lit("conflict")).otherwise(F.lit("accepted"))
                     .alias("decision"))


def booking_conflicts(appointments: DataFrame) -> DataFrame:
    """Existing double bookings: (employee, day) with more than one open
    appointment. A group count, not a self join."""
    return (appointments.where(F.col("status").isin(*OPEN_STATUSES)
                               & F.col("employee_id").isNotNull())
            .groupBy("employee_id", "appointment_date")
            .agg(F.count(F.lit(1)).alias("open_count"), F.min("id").alias("first_id"),
                 F.max("id").alias("last_id"))
            .where(F.col("open_count") > 1))


# ------------------------------------------------- H7 automatic ledger posting
def post_completed(appointments: DataFrame, ledger: DataFrame, updates: DataFrame,
                   rules: dict[str, Rule], as_of: dt.date | Column) -> DataFrame:
    """Ledger rows, dated ``as_of``, created by updates that complete an
    appointment with a price: valid update of an existing appointment, status 'completed', a
    non-empty price, and no ledger row for that appointment yet (neither
    before the batch nor from an earlier update of the batch)."""
    v = validate(updates, rules).where("is_valid")
    q = known(v.where((F.col("status") == "completed") & truthy(F.col("price"))), appointments)
    first = q.groupBy("id").agg(F.min("request_seq").alias("request_seq"))
    q = q.join(first, ["id", "request_seq"], "left_semi")
    # The ledger is cut to the batch's appointments where it is read.
    posted = ledger.select(F.col("appointment_id").alias("id")).join(q.select("id").distinct(), "id", "left_semi")
    q = q.join(posted, "id", "left_anti")
    rows = q.select(
        "request_seq",
        F.lit("income").alias("type"),
        F.lit(POSTING_CATEGORY).alias("category"),
        parse_money(F.col("price")).alias("amount"),
        F.concat(F.lit(POSTING_DESCRIPTION_PREFIX), F.col("id").cast("string")).alias("description"),
        F.lit(as_of).alias("date"),
        F.col("id").alias("appointment_id"),
        F.col("actor_id").alias("created_by"))
    return assign_ids(rows, max_id(ledger)).select(
        "id", "type", "category", "amount", "description", "date", "appointment_id",
        "created_by", "request_seq")


# -------------------------------------------------------- H8 stock change log
_INT_PREFIX = r"^\s*([+-]?\d+)"


def parse_int_prefix(c: Column) -> Column:
    """Integer read that stops at the first non-digit ('12.7' -> 12)."""
    return F.regexp_extract(c.cast("string"), _INT_PREFIX, 1).try_cast("int")


def stock_change_log(inventory: DataFrame, sets: DataFrame) -> DataFrame:
    """Log rows of short-form quantity sets. Each set needs an id (0 counts
    as missing), a numeric quantity and an existing item; the previous
    quantity is the one set just before for that item, or the stored one."""
    ok = (known(sets.where(F.col("id").isNotNull() & (F.col("id") != 0)
                           & parse_number(F.col("quantity")).isNotNull()), inventory)
          .withColumn("new_quantity", parse_int_prefix(F.col("quantity")))
          .where(F.col("new_quantity").isNotNull()))
    ok = previous_value(ok, ["id"], [F.col("request_seq")], "new_quantity", "_prev")
    j = stored_values(ok, inventory, "quantity", "_stored")
    prev = F.coalesce(F.col("_prev"), F.col("_stored"))
    new = F.col("new_quantity")
    return j.select(
        "request_seq", F.col("id").alias("inventory_id"),
        F.when(new > prev, F.lit("increase")).when(new < prev, F.lit("decrease"))
         .otherwise(F.lit("no_change")).alias("change_type"),
        (new - prev).alias("quantity_change"),
        prev.alias("previous_quantity"), new.alias("new_quantity"),
        F.coalesce(F.when(~blank(F.col("reason")), F.col("reason")),
                   F.lit(STOCK_SET_REASON)).alias("reason"),
        F.col("actor_id").alias("created_by"))


def stock_after_sets(inventory: DataFrame, log: DataFrame) -> DataFrame:
    """Inventory snapshot after the sets: each item takes its last set."""
    last = (log.groupBy("inventory_id").agg(F.max_by("new_quantity", "request_seq").alias("_q"))
            .withColumnRenamed("inventory_id", "_iid"))
    j = inventory.join(last, inventory["id"] == last["_iid"], "left")
    return j.select(*[F.coalesce(F.col("_q"), F.col("quantity")).alias("quantity")
                      if c == "quantity" else F.col(c) for c in inventory.columns])
