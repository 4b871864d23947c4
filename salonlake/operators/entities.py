"""Per-entity create and update rules on top of the generic write operators.

Creates: validate -> (entity-specific markup escaping) -> defaults for
absent values -> sequential ids after the table's largest id. Updates:
validate -> numeric reads -> partial update (``writes.apply_updates``).

Value reads follow the source's request handling: an optional text field
that is empty becomes NULL; a numeric field given as text is read when it
is present, and a numeric zero counts as absent where the source tests the
field for truthiness (SURVEY Q3, `functions.expressions.truthy`); the stock
threshold defaults to 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salonlake.functions import validation as V
from salonlake.functions.expressions import (blank, escape_markup, parse_money, parse_number,
                                             truthy)
from salonlake.operators.sequence import previous_value
from salonlake.operators.writes import (STOCK_CREATE_REASON, STOCK_UPDATE_REASON, apply_updates,
                                        assign_ids, booking_accept, known, max_id,
                                        parse_int_prefix, stored_values)


def _opt(c: str) -> Column:
    """Optional text: empty or absent -> NULL."""
    return F.when(~blank(F.col(c)), F.col(c))


def _clean(c: str, escape: bool) -> Column:
    return escape_markup(_opt(c)) if escape else _opt(c)


def _numbers_ok(*cols: str) -> Column:
    """Numeric fields that are present must be finite numbers."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & (blank(F.col(c)) | parse_number(F.col(c)).isNotNull())
    return cond


def _when(df: DataFrame) -> list[Column]:
    """``created_at`` of new rows: the request's time, where requests carry one."""
    return [F.col("now").alias("created_at")] if "now" in df.columns else []


def _valid(df: DataFrame, rules) -> DataFrame:
    return V.validate(df, rules).where("is_valid").drop("errors", "is_valid")


# ------------------------------------------------------------------ creates
def insert_customers(customers: DataFrame, creates: DataFrame,
                     rules=V.CUSTOMER_CREATE) -> DataFrame:
    v = _valid(creates, rules)
    rows = v.select("request_seq", *_when(v), "actor_id",
                    escape_markup(F.col("full_name")).alias("full_name"),
                    *[_clean(c, True).alias(c) for c in ("phone", "email", "notes")])
    return assign_ids(rows, max_id(customers)).select(
        "id", "full_name", "phone", "email", "notes", F.lit(1).alias("is_active"),
        F.col("actor_id").alias("created_by"), *[c for c in rows.columns if c == "created_at"], "request_seq")


def insert_services(services: DataFrame, creates: DataFrame,
                    rules=V.SERVICE_CREATE) -> DataFrame:
    v = _valid(creates, rules).where(_numbers_ok("price", "duration_minutes"))
    rows = v.select("request_seq", *_when(v),
                    escape_markup(F.col("name")).alias("name"),
                    _clean("description", True).alias("description"),
                    parse_money(F.col("price")).alias("price"),
                    parse_int_prefix(F.col("duration_minutes")).alias("duration_minutes"),
                    _clean("category", True).alias("category"))
    return assign_ids(rows, max_id(services)).select(
        "id", "name", "description", "price", "duration_minutes", "category",
        F.lit(1).alias("is_active"), *[c for c in rows.columns if c == "created_at"], "request_seq")


def insert_transactions(ledger: DataFrame, creates: DataFrame,
                        rules=V.LEDGER_CREATE) -> DataFrame:
    v = _valid(creates, rules).where(_numbers_ok("amount"))
    rows = v.select("request_seq", *_when(v), "actor_id",
                    escape_markup(F.col("type")).alias("type"),
                    escape_markup(F.col("category")).alias("category"),
                    parse_money(F.col("amount")).alias("amount"),
                    _clean("description", True).alias("description"),
                    F.to_date(F.col("date")).alias("date"),
                    F.when(truthy(F.col("appointment_id")),
                           parse_number(F.col("appointment_id")).cast("bigint"))
                     .alias("appointment_id"))
    return assign_ids(rows, max_id(ledger)).select(
        "id", "type", "category", "amount", "description", "date", "appointment_id",
        F.col("actor_id").alias("created_by"), *[c for c in rows.columns if c == "created_at"], "request_seq")


def insert_inventory(inventory: DataFrame, creates: DataFrame,
                     rules=V.INVENTORY_CREATE) -> tuple[DataFrame, DataFrame]:
    """New items and their 'initial' stock-log rows."""
    v = _valid(creates, rules).where(_numbers_ok("quantity", "unit_price", "min_stock_level"))
    rows = v.select("request_seq", *_when(v), "actor_id",
                    escape_markup(F.col("name")).alias("name"),
                    _clean("description", True).alias("description"),
                    parse_int_prefix(F.col("quantity")).alias("quantity"),
                    F.when(truthy(F.col("unit_price")), parse_money(F.col("unit_price")))
                     .alias("unit_price"),
                    _clean("category", True).alias("category"),
                    F.coalesce(F.when(truthy(F.col("min_stock_level")),
                                      parse_int_prefix(F.col("min_stock_level"))),
                               F.lit(0)).alias("min_stock_level"))
    items = assign_ids(rows, max_id(inventory)).select(
        "id", "name", "description", "quantity", "unit_price", "category", "min_stock_level",
        F.col("actor_id").alias("created_by"), *[c for c in rows.columns if c == "created_at"], "request_seq")
    log = items.select(
        "request_seq", F.col("id").alias("inventory_id"), F.lit("initial").alias("change_type"),
        F.col("quantity").alias("quantity_change"), F.lit(0).alias("previous_quantity"),
        F.col("quantity").alias("new_quantity"), F.lit(STOCK_CREATE_REASON).alias("reason"),
        "created_by", *[c for c in items.columns if c == "created_at"])
    return items, log


def insert_appointments(appointments: DataFrame, requests: DataFrame,
                        rules=V.APPOINTMENT_CREATE) -> DataFrame:
    """Accepted bookings (see ``writes.booking_accept``) as new rows. Text is
    stored as sent (the source does not escape appointment fields)."""
    d = booking_accept(appointments, requests, rules).where(F.col("decision") == "accepted")
    r = requests.join(d.select("request_seq", F.col("employee_id").alias("_emp"),
                               F.col("appointment_date").alias("_date"),
                               F.col("status").alias("_status")), "request_seq", "inner")
    rows = r.select("request_seq", *_when(r), "actor_id",
                    parse_number(F.col("customer_id")).cast("bigint").alias("customer_id"),
                    parse_number(F.col("service_id")).cast("bigint").alias("service_id"),
                    F.col("_emp").alias("employee_id"), F.col("_date").alias("appointment_date"),
                    F.col("_status").alias("status"),
                    _opt("notes").alias("notes") if "notes" in requests.columns
                    else F.lit(None).cast("string").alias("notes"),
                    F.when(truthy(F.col("price")), parse_money(F.col("price"))).alias("price"))
    return assign_ids(rows, max_id(appointments)).select(
        "id", "customer_id", "service_id", "employee_id", "appointment_date", "status", "notes",
        "price", F.col("actor_id").alias("created_by"), *[c for c in rows.columns if c == "created_at"], "request_seq")


# ------------------------------------------------------------------ updates
def _read_numbers(df: DataFrame, money: tuple[str, ...], ints: tuple[str, ...],
                  presence=truthy) -> DataFrame:
    """Numeric text is read when present (see ``truthy``); otherwise NULL,
    which keeps the stored value."""
    out = df
    for c in money:
        out = out.withColumn(c, F.when(presence(F.col(c)), parse_money(F.col(c))))
    for c in ints:
        out = out.withColumn(c, F.when(presence(F.col(c)), parse_int_prefix(F.col(c))))
    return out


def update_services(services: DataFrame, changes: DataFrame, rules=V.SERVICE_UPDATE) -> DataFrame:
    """Partial update of active services (text stored as sent)."""
    v = _valid(changes, rules).where(_numbers_ok("price", "duration_minutes"))
    v = _read_numbers(v, ("price",), ("duration_minutes",))
    cols = [c for c in ("name", "description", "price", "duration_minutes", "category")
            if c in services.columns]
    return apply_updates(services, v, cols, require_active=True)


def update_ledger(ledger: DataFrame, changes: DataFrame, rules=V.LEDGER_UPDATE) -> DataFrame:
    v = _valid(changes, rules).where(_numbers_ok("amount"))
    v = _read_numbers(v, ("amount",), ()).withColumn(
        "date", F.when(~blank(F.col("date")), F.to_date(F.col("date"))))
    cols = [c for c in ("type", "category", "amount", "description", "date")
            if c in ledger.columns]
    return apply_updates(ledger, v, cols)


def update_appointments(appointments: DataFrame, changes: DataFrame,
                        rules=V.APPOINTMENT_UPDATE) -> DataFrame:
    """Partial update of appointments with the double-booking check of
    moves, decided exactly in request order (``booking``)."""
    from salonlake.operators.booking import apply_appointment_batch
    batch = changes.withColumn("op", F.lit("update"))
    for c in ("employee_id", "appointment_date", "status", "price", "customer_id", "service_id", "notes"):
        if c not in batch.columns:
            batch = batch.withColumn(c, F.lit(None).cast("string"))
    return apply_appointment_batch(appointments, batch)[1]


def update_inventory(inventory: DataFrame, changes: DataFrame,
                     rules=V.INVENTORY_UPDATE) -> tuple[DataFrame, DataFrame]:
    """Full-form item update: (new snapshot, stock-log rows). A log row is
    written only when a quantity is sent and differs from the quantity just
    before that request."""
    v = (_valid(changes, rules).where(_numbers_ok("quantity", "unit_price", "min_stock_level"))
         .transform(lambda df: known(df, inventory)))
    # The quantity counts whenever it is sent (0 included); the price and the
    # threshold only when truthy.
    v = _read_numbers(v, ("unit_price",), ("min_stock_level",))
    v = _read_numbers(v, (), ("quantity",), presence=lambda c: ~blank(c))
    cols = [c for c in ("name", "description", "quantity", "unit_price", "category",
                        "min_stock_level") if c in inventory.columns]
    snap = apply_updates(inventory, v, cols)
    sets = v.where(F.col("quantity").isNotNull())
    sets = previous_value(sets, ["id"], [F.col("request_seq")], "quantity", "_prev")
    j = stored_values(sets, inventory, "quantity", "_stored")
    prev = F.coalesce(F.col("_prev"), F.col("_stored"))
    new = F.col("quantity")
    log = j.where(new != prev).select(
        "request_seq", F.col("id").alias("inventory_id"),
        F.when(new > prev, F.lit("increase")).otherwise(F.lit("decrease")).alias("change_type"),
        (new - prev).alias("quantity_change"), prev.alias("previous_quantity"),
        new.alias("new_quantity"), F.lit(STOCK_UPDATE_REASON).alias("reason"),
        F.col("actor_id").alias("created_by"), *_when(v))
    return snap, log


# ----------------------------------------------------- mixed inventory batch
def inventory_batch(inventory: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new snapshot, stock-log rows) for a mixed batch of item requests,
    equal to applying them one by one in ``request_seq`` order.

    ``op``: 'set' (short quantity form: id, quantity, reason), 'update' (full
    form), 'insert', 'delete'. A request for an id deleted earlier in the
    batch finds nothing. Quantities from sets and updates form one sequence
    per item: each request's previous quantity is the one set just before it
    (a skew-safe lag over that sequence) or the stored one. Sets log every
    change, no_change included; full updates log only real changes; inserts
    log 'initial'. Deleted items disappear; their log rows stay."""
    from salonlake.operators.writes import STOCK_SET_REASON
    for c in ("reason", "name", "description", "unit_price", "min_stock_level", "category"):
        if c not in batch.columns:
            batch = batch.withColumn(c, F.lit(None).cast("string"))
    op = F.lower(F.col("op"))
    first_del = (batch.where(op == "delete").groupBy(F.col("id").cast("bigint").alias("_did"))
                 .agg(F.min("request_seq").alias("_del_seq")))

    def alive(df: DataFrame) -> DataFrame:
        j = df.join(first_del, df["id"] == first_del["_did"], "left")
        j = j.where(F.col("_del_seq").isNull() | (F.col("request_seq") < F.col("_del_seq")))
        return known(j.drop("_did", "_del_seq"), inventory)

    sets = batch.where(op == "set")
    sets = sets.where(F.col("id").isNotNull() & (F.col("id") != 0)
                      & parse_number(F.col("quantity")).isNotNull())
    sets = alive(sets.withColumn("id", F.col("id").cast("bigint")))
    sets = sets.select("request_seq", "actor_id", "now", "id",
                       parse_int_prefix(F.col("quantity")).alias("quantity"),
                       F.coalesce(_opt("reason"), F.lit(STOCK_SET_REASON)).alias("reason"),
                       F.lit(True).alias("_short")).where(F.col("quantity").isNotNull())
    upd = _valid(batch.where(op == "update"), V.INVENTORY_UPDATE) \
        .where(_numbers_ok("quantity", "unit_price", "min_stock_level"))
    upd = alive(upd.withColumn("id", F.col("id").cast("bigint")))
    upd = _read_numbers(upd, ("unit_price",), ("min_stock_level",))
    upd = _read_numbers(upd, (), ("quantity",), presence=lambda c: ~blank(c))

    # One quantity sequence per item, from both forms.
    qseq = sets.select("request_seq", "actor_id", "now", "id", "quantity", "reason", "_short").unionByName(
        upd.where(F.col("quantity").isNotNull()).select(
            "request_seq", "actor_id", "now", "id", "quantity",
            F.lit(STOCK_UPDATE_REASON).alias("reason"), F.lit(False).alias("_short")))
    qseq = previous_value(qseq, ["id"], [F.col("request_seq")], "quantity", "_prev")
    j = stored_values(qseq, inventory, "quantity", "_stored")
    prev = F.coalesce(F.col("_prev"), F.col("_stored"))
    new = F.col("quantity")
    log = j.where(F.col("_short") | (new != prev)).select(
        "request_seq", F.col("id").alias("inventory_id"),
        F.when(new > prev, F.lit("increase")).when(new < prev, F.lit("decrease"))
         .otherwise(F.lit("no_change")).alias("change_type"),
        (new - prev).alias("quantity_change"), prev.alias("previous_quantity"),
        new.alias("new_quantity"), "reason", F.col("actor_id").alias("created_by"),
        F.col("now").alias("created_at"))

    cols = [c for c in ("name", "description", "quantity", "unit_price", "category",
                        "min_stock_level") if c in inventory.columns]
    changes = upd.select("request_seq", "actor_id", "now", "id",
                         *[F.col(c) if c in upd.columns else F.lit(None).alias(c) for c in cols])
    changes = changes.unionByName(sets.select(
        "request_seq", "actor_id", "now", "id",
        *[F.col("quantity") if c == "quantity" else F.lit(None).alias(c) for c in cols]))
    snap = apply_updates(inventory, changes, cols)
    snap = snap.join(first_del.select(F.col("_did").alias("id")), "id", "left_anti")
    items, initial = insert_inventory(inventory, batch.where(op == "insert"))
    snap = snap.unionByName(items.drop("request_seq"), allowMissingColumns=True)
    return snap, log.unionByName(initial.select(*log.columns))
