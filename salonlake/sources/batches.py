"""Change batches derived from the driver's test tables.

Write-side operators consume batches of change rows (as they would arrive
as JSON bodies: every field text). For tests and the oracle gate the rows
are derived from the test tables, so they grow with the scale factor; some
values are deliberately dirty (empty, too short, not a number, not a date,
unknown ids) so that every rule fires. The same derivations are written as
SQL in ``salonlake.plans.oracle.BATCH_VIEWS``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salonlake.sources.fixtures import LEDGER_DAY_SHIFT, raw

# Offset that turns an id into one that no table holds (not-found paths).
UNKNOWN_ID_OFFSET = 100000000
# Offset that orders the second update source after the first.
SECOND_SOURCE_SEQ = 1000000000


def _s(c):
    return c.cast("string")


def customer_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One update per order, addressed to the order's customer."""
    o = raw(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("request_seq"), (k % 100).alias("actor_id"), F.col("o_orderdate").alias("now"),
        F.lit("update").alias("op"), F.col("o_custkey").alias("id"),
        F.when(k % 5 == 0, F.concat(F.lit("Client <"), _s(k), F.lit(">"))).alias("full_name"),
        F.when(k % 3 == 0, F.concat(F.lit("06"), _s(F.lit(20000000) + k))).alias("phone"),
        F.when(k % 4 == 0, F.concat(F.lit("n"), _s(k), F.lit("@example.org")))
         .when(k % 9 == 0, F.lit("bad-email")).alias("email"),
        F.when(k % 2 == 0, F.col("o_orderpriority")).alias("notes"))


def customer_creates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One create request per test customer, some with dirty fields."""
    c = raw(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("request_seq"), (k % 100).alias("actor_id"),
        F.when(k % 10 == 0, F.lit("")).when(k % 10 == 1, F.lit("A")).otherwise(F.col("c_name"))
         .alias("full_name"),
        F.when(k % 4 == 0, F.concat(F.lit("05"), _s(k)))
         .otherwise(F.concat(F.lit("05"), _s(F.lit(10000000) + k))).alias("phone"),
        F.when(k % 7 == 0, F.lit(None).cast("string"))
         .when(k % 5 == 0, F.concat(F.lit("c"), _s(k), F.lit("@example")))
         .otherwise(F.concat(F.lit("c"), _s(k), F.lit("@example.com"))).alias("email"),
        F.col("c_mktsegment").alias("notes"))


def ledger_creates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = raw(spark, sf_dir, "events")
    k = F.col("event_id")
    et = F.col("event_type")
    return e.select(
        k.alias("request_seq"),
        F.when(k % 13 == 0, F.lit("refund"))
         .when(et.isin("purchase", "signup"), F.lit("income")).otherwise(F.lit("expense"))
         .alias("type"),
        F.when(k % 17 == 0, F.lit("x")).otherwise(et).alias("category"),
        F.when(k % 19 == 0, F.lit("0")).when(k % 23 == 0, F.lit("abc"))
         .otherwise(_s(F.col("value"))).alias("amount"),
        F.when(k % 29 == 0, F.lit("2024-02-30"))
         .otherwise(F.date_format(F.col("ts"), "yyyy-MM-dd")).alias("date"),
        F.col("props").alias("description"),
        F.when(et == "purchase", _s(k)).alias("appointment_id"))


def customer_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soft-delete requests: urgent pending orders delete their customer."""
    o = raw(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return (o.where((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P"))
            .select(k.alias("request_seq"), (k % 100).alias("actor_id"),
                    F.col("o_orderdate").alias("now"),
                    F.when(k % 50 == 0, F.col("o_custkey") + UNKNOWN_ID_OFFSET)
                     .otherwise(F.col("o_custkey")).alias("id")))


def ledger_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = raw(spark, sf_dir, "events")
    k = F.col("event_id")
    return (e.where((F.col("event_type") == "error") & (F.col("value") > 300))
            .select(k.alias("request_seq"),
                    F.when(k % 4 == 0, k + UNKNOWN_ID_OFFSET).otherwise(k).alias("id")))


def new_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups: emails repeat within the batch and collide with staff."""
    c = raw(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("request_seq"), F.timestamp_seconds(F.lit(1700000000) + k).cast("timestamp_ntz").alias("now"),
        F.when(k % 11 == 0, F.lit("B")).otherwise(F.col("c_name")).alias("full_name"),
        F.concat(F.lit("u"), _s(k % 130), F.lit("@example.com")).alias("email"),
        F.lit(None).cast("string").alias("phone"),
        F.when(k % 3 == 0, F.lit("manager")).alias("role"))


def appointment_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New bookings, dated in the appointment range so they meet real ones."""
    e = raw(spark, sf_dir, "events")
    k = F.col("event_id")
    et = F.col("event_type")
    return e.select(
        k.alias("request_seq"), (k % 20).alias("actor_id"), F.col("ts").alias("now"),
        _s(F.col("user_id")).alias("customer_id"),
        _s(k % 200).alias("service_id"),
        F.when(k % 9 == 0, F.lit(None).cast("string")).otherwise(_s(F.col("user_id") % 100))
         .alias("employee_id"),
        F.date_format(F.date_sub(F.col("ts").cast("date"), LEDGER_DAY_SHIFT), "yyyy-MM-dd")
         .alias("appointment_date"),
        F.when(et == "purchase", F.lit("completed")).when(et == "error", F.lit("cancelled"))
         .when(et == "view", F.lit("scheduled")).alias("status"),
        _s(F.col("value")).alias("price"),
        F.lit(None).cast("string").alias("notes"))


def appointment_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status/price updates: one per order, then one per purchase event (some
    appointments get two updates in the batch)."""
    o = raw(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    a = o.select(
        k.alias("request_seq"), (k % 100).alias("actor_id"), k.alias("id"),
        F.when(F.col("o_orderstatus") == "F", F.lit("completed"))
         .when(F.col("o_orderstatus") == "O", F.lit("confirmed")).alias("status"),
        F.when(k % 11 == 0, F.lit(None).cast("string")).when(k % 17 == 0, F.lit(""))
         .otherwise(_s(F.col("o_totalprice"))).alias("price"))
    e = raw(spark, sf_dir, "events").where(F.col("event_type") == "purchase")
    ek = F.col("event_id")
    b = e.select((ek + SECOND_SOURCE_SEQ).alias("request_seq"), (ek % 100).alias("actor_id"),
                 ek.alias("id"), F.lit("completed").alias("status"),
                 _s(F.col("value")).alias("price"))
    absent = [F.lit(None).cast("string").alias(c)
              for c in ("appointment_date", "employee_id", "notes")]
    return a.select("*", *absent).unionByName(b.select("*", *absent))


def stock_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short-form quantity sets, one per event, addressed to item user_id."""
    e = raw(spark, sf_dir, "events")
    k = F.col("event_id")
    return e.select(
        k.alias("request_seq"), (k % 20).alias("actor_id"),
        F.when(k % 10 == 0, F.col("user_id") + UNKNOWN_ID_OFFSET).otherwise(F.col("user_id"))
         .alias("id"),
        F.when(k % 31 == 0, F.lit("abc"))
         .otherwise(_s(F.floor(F.col("value")).cast("bigint") % 60)).alias("quantity"),
        F.col("event_type").alias("reason"))


def session_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with the actor and the issue time of the actor's session."""
    e = raw(spark, sf_dir, "events")
    k = F.col("event_id")
    return e.select(
        k.alias("request_id"), F.col("user_id").alias("actor_id"), F.col("ts").alias("now"),
        (F.col("ts") - F.make_dt_interval(F.lit(0), (k % 30).cast("int"))).alias("issued_at"))


def upload_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One upload per web page: the URL's last segment is the file name."""
    p = raw(spark, sf_dir, "pages")
    k = F.col("page_id")
    name = F.element_at(F.split(F.col("url"), "/"), -1)
    ext = F.lower(F.element_at(F.split(name, r"\."), -1))
    mime = (F.when(k % 5 == 0, F.lit("application/pdf")).when(k % 5 == 1, F.lit("image/png"))
             .when(k % 5 == 2, F.lit("image/gif")).when(k % 5 == 3, F.lit("image/jpeg"))
             .otherwise(F.lit("text/html")))
    return p.select(
        k.alias("upload_id"),
        F.when(k % 2 == 0, F.lit("avatar")).otherwise(F.lit("receipt")).alias("kind"),
        F.when(k % 7 == 0, F.lit(None).cast("string")).otherwise(name).alias("file_name"),
        mime.alias("mime"),
        (F.octet_length(F.col("html")) * 97).cast("bigint").alias("size_bytes"),
        (k % 100).alias("user_id"),
        F.when(k % 3 == 0, F.lit(None).cast("bigint")).otherwise(k).alias("transaction_id"),
        (F.lit(1700000000000) + k * 1000).alias("uploaded_ms"),
        ext.alias("_ext")).drop("_ext")


def service_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Service updates addressed to item user_id (some invalid)."""
    e = raw(spark, sf_dir, "events")
    k = F.col("event_id")
    return e.select(
        k.alias("request_seq"), (k % 20).alias("actor_id"), F.col("ts").alias("now"),
        F.col("user_id").alias("id"),
        F.when(k % 3 == 0, F.concat(F.lit("Svc "), _s(k))).alias("name"),
        F.when(k % 15 == 0, F.lit("-1")).when(k % 4 == 0, _s(F.col("value"))).alias("price"),
        F.when(k % 5 == 0, _s(F.lit(5) + k % 500)).alias("duration_minutes"),
        F.when(k % 6 == 0, F.col("event_type")).alias("category"),
        F.lit(None).cast("string").alias("description"))


def inventory_creates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One new item per part (some invalid, some without price/threshold)."""
    p = raw(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        k.alias("request_seq"), (k % 20).alias("actor_id"),
        F.when(k % 17 == 0, F.lit("x")).otherwise(F.col("p_name")).alias("name"),
        F.when(k % 19 == 0, F.lit("many")).otherwise(_s(F.col("p_size"))).alias("quantity"),
        F.when(k % 13 == 0, F.lit(None).cast("string")).when(k % 23 == 0, F.lit("0"))
         .otherwise(_s(F.col("p_retailprice"))).alias("unit_price"),
        F.when(k % 3 == 0, F.lit("")).otherwise(_s(F.col("p_size") % 7)).alias("min_stock_level"),
        F.col("p_brand").alias("category"),
        F.col("p_type").alias("description"))


def inventory_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-form item updates addressed to item user_id."""
    e = raw(spark, sf_dir, "events")
    k = F.col("event_id")
    return e.select(
        k.alias("request_seq"), (k % 20).alias("actor_id"), F.col("ts").alias("now"),
        F.when(k % 10 == 0, F.col("user_id") + UNKNOWN_ID_OFFSET).otherwise(F.col("user_id"))
         .alias("id"),
        F.lit(None).cast("string").alias("name"),
        F.when(k % 3 == 0, _s(F.floor(F.col("value")).cast("bigint") % 40)).alias("quantity"),
        F.lit(None).cast("string").alias("unit_price"),
        F.when(k % 7 == 0, F.lit("5")).alias("min_stock_level"),
        F.lit(None).cast("string").alias("category"),
        F.lit(None).cast("string").alias("description"))


def appointment_mixed_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixed booking requests: new bookings, moves of existing appointments
    to another employee/day, status changes and cancellations."""
    e = raw(spark, sf_dir, "events")
    k = F.col("event_id")
    et = F.col("event_type")
    day = F.date_format(F.date_sub(F.col("ts").cast("date"), LEDGER_DAY_SHIFT), "yyyy-MM-dd")
    emp = _s(F.col("user_id") % 100)
    op = (F.when(et == "view", F.lit("insert")).when(et == "error", F.lit("cancel"))
           .otherwise(F.lit("update")))
    return e.select(
        k.alias("request_seq"), (k % 20).alias("actor_id"), F.col("ts").alias("now"),
        op.alias("op"),
        F.when(et != "view", k).alias("id"),
        F.when(et == "view", _s(F.col("user_id"))).alias("customer_id"),
        F.when(et == "view", _s(k % 200)).alias("service_id"),
        F.when(et.isin("view", "click"), emp).alias("employee_id"),
        F.when(et.isin("view", "click"), day).alias("appointment_date"),
        F.when(et == "purchase", F.lit("completed")).when(et == "signup", F.lit("confirmed"))
         .alias("status"),
        F.lit(None).cast("string").alias("notes"),
        F.lit(None).cast("string").alias("price"))


def inventory_mixed_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixed item requests: quantity sets, full updates, new items and a few
    deletions, addressed to item user_id."""
    e = raw(spark, sf_dir, "events")
    k = F.col("event_id")
    et = F.col("event_type")
    op = (F.when(et == "purchase", F.lit("insert")).when(et == "click", F.lit("update"))
           .when((et == "error") & (k % 10 == 0), F.lit("delete")).otherwise(F.lit("set")))
    qty = F.when(k % 31 == 0, F.lit("abc")).otherwise(_s(F.floor(F.col("value")).cast("bigint") % 60))
    return e.select(
        k.alias("request_seq"), (k % 20).alias("actor_id"), F.col("ts").alias("now"),
        op.alias("op"),
        F.when(et != "purchase", F.col("user_id")).alias("id"),
        F.when(et == "purchase", F.concat(F.lit("Item "), _s(k)))
         .when((et == "click") & (k % 5 == 0), F.concat(F.lit("Renamed "), _s(k))).alias("name"),
        F.when((et == "click") & (k % 4 == 0), F.lit(None).cast("string")).otherwise(qty)
         .alias("quantity"),
        F.when(et == "purchase", _s(F.col("value"))).alias("unit_price"),
        F.when(et == "purchase", F.lit("5")).alias("min_stock_level"),
        F.lit(None).cast("string").alias("category"),
        F.lit(None).cast("string").alias("description"),
        F.when((et != "click") & (k % 3 == 0), et).alias("reason"))


def _aligned(*parts: DataFrame) -> DataFrame:
    """Union of requests that carry different fields (absent ones are NULL)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def customer_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer requests of all kinds in one batch: updates and deletes of the
    same customers in turn, creates, and lines that no one can apply (corrupt,
    without a place in the order, of an unknown kind)."""
    k = F.col("request_seq")
    updates = customer_changes(spark, sf_dir).withColumn("request_seq", 2 * k)
    deletes = customer_deletes(spark, sf_dir).select((2 * k + 1).alias("request_seq"), "actor_id", "now", F.lit("delete").alias("op"), "id")
    new = customer_creates(spark, sf_dir)
    new = new.withColumns({
        "op": F.when(k % 83 == 0, F.lit("merge")).otherwise(F.lit("insert")),
        "_corrupt_record": F.when(k % 97 == 0, F.concat(F.lit("{"), _s(k))),
        "request_seq": F.when(k % 89 == 0, F.lit(None).cast("bigint")).otherwise(k + SECOND_SOURCE_SEQ)})
    return _aligned(updates, deletes, new)


def ledger_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger creates, updates (also of rows deleted just before) and deletes."""
    k = F.col("event_id")
    new = ledger_creates(spark, sf_dir).withColumns({"op": F.lit("insert"), "request_seq": 3 * F.col("request_seq")})
    e = raw(spark, sf_dir, "events").where(F.col("event_type").isin("view", "error"))
    updates = e.select(
        (3 * k + 1).alias("request_seq"), F.lit("update").alias("op"), (k - k % 2).alias("id"),
        F.when(k % 5 == 0, F.lit("Infinity")).when(k % 7 == 0, F.lit("0")).otherwise(_s(F.col("value"))).alias("amount"),
        F.when(k % 11 == 0, F.lit("gift")).alias("type"))
    deletes = ledger_deletes(spark, sf_dir).select((3 * F.col("request_seq") + 2).alias("request_seq"), F.lit("delete").alias("op"), "id")
    return _aligned(new, updates, deletes)


def service_creates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One new service per part (some invalid, some with markup)."""
    p = raw(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        k.alias("request_seq"), (k % 20).alias("actor_id"), F.timestamp_seconds(F.lit(1700000000) + k).cast("timestamp_ntz").alias("now"),
        F.when(k % 17 == 0, F.lit("x")).when(k % 5 == 0, F.concat(F.lit("<b>"), "p_name")).otherwise(F.col("p_name")).alias("name"),
        F.when(k % 19 == 0, F.lit("-1")).when(k % 23 == 0, F.lit("Infinity")).otherwise(_s(F.col("p_retailprice"))).alias("price"),
        F.when(k % 13 == 0, F.lit("4")).when(k % 29 == 0, F.lit("481")).otherwise(_s(F.col("p_size") + 5)).alias("duration_minutes"),
        F.when(k % 3 == 0, F.lit("")).otherwise(F.col("p_brand")).alias("category"),
        F.col("p_type").alias("description"))


def ledger_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger updates, several for one row, some invalid, some of unknown rows."""
    e = raw(spark, sf_dir, "events")
    k = F.col("event_id")
    return e.select(
        k.alias("request_seq"), (k % 20).alias("actor_id"), F.col("ts").alias("now"),
        F.when(k % 10 == 0, k + UNKNOWN_ID_OFFSET).otherwise(k - k % 4).alias("id"),
        F.when(k % 11 == 0, F.lit("gift")).when(k % 3 == 0, F.lit("expense")).alias("type"),
        F.when(k % 7 == 0, F.lit("c")).when(k % 2 == 0, F.col("event_type")).alias("category"),
        F.when(k % 13 == 0, F.lit("0")).when(k % 4 == 1, _s(F.col("value"))).alias("amount"),
        F.when(k % 17 == 0, F.lit("2024-02-30")).when(k % 5 == 0, F.date_format("ts", "yyyy-MM-dd")).alias("date"),
        F.lit(None).cast("string").alias("description"))


def appointment_cancels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cancellations, some appointments twice, some of unknown ones."""
    e = raw(spark, sf_dir, "events").where(F.col("event_type").isin("error", "signup"))
    k = F.col("event_id")
    return e.select(k.alias("request_seq"), (k % 20).alias("actor_id"), F.col("ts").alias("now"), (k - k % 3).alias("id"))
