"""Entity create/update rules, dashboard and uploads on small frames."""

import datetime as dt

from pyspark.sql import functions as F

from salonlake.operators import entities, listings, rollups, uploads, writes
from salonlake.params import AS_OF, Period
from salonlake.plans.dashboard import dashboard
from salonlake.sources import batches
from salonlake.sources.fixtures import load_tables
from tests.conftest import SF_SMALL


def test_insert_transactions_and_services(spark):
    led = spark.createDataFrame([(5, "income")], "id long, type string")
    tx = spark.createDataFrame([
        (1, 3, "income", "خدمة", "12.50", "2024-01-02", None, "7"),
        (2, 3, "expense", "rent<>", "0", "2024-01-02", None, None),     # amount < 0.01
        (3, 3, "expense", "rent", "Infinity", "2024-01-02", None, None),  # not finite
        (4, 3, "expense", "rent", "3", "2024-01-03", "", "")],
        "request_seq long, actor_id long, type string, category string, amount string, "
        "date string, description string, appointment_id string")
    rows = {r.request_seq: r for r in entities.insert_transactions(led, tx).collect()}
    assert sorted(rows) == [1, 4]
    assert rows[1].id == 6 and float(rows[1].amount) == 12.5 and rows[1].appointment_id == 7
    assert rows[4].id == 7 and rows[4].description is None and rows[4].date == dt.date(2024, 1, 3)
    sv = spark.createDataFrame([(9, "a")], "id long, name string")
    ch = spark.createDataFrame([(1, "Cut", "10", "30", None, None), (2, "Cut", "10", "481", None, None)],
                               "request_seq long, name string, price string, duration_minutes string, "
                               "category string, description string")
    got = entities.insert_services(sv, ch).collect()
    assert len(got) == 1 and got[0].id == 10 and got[0].duration_minutes == 30


def test_insert_appointments_uses_booking_rule(spark):
    t = load_tables(spark, SF_SMALL)
    req = batches.appointment_requests(spark, SF_SMALL)
    new = entities.insert_appointments(t["appointments"], req)
    dec = writes.booking_accept(t["appointments"], req, __import__(
        "salonlake.functions.validation", fromlist=["x"]).APPOINTMENT_CREATE)
    assert new.count() == dec.where("decision = 'accepted'").count()
    mx = t["appointments"].agg(F.max("id")).first()[0]
    assert new.agg(F.min("id")).first()[0] == mx + 1


def test_update_ledger_and_appointments(spark):
    led = spark.createDataFrame([(1, "income", "a", None)],
                                "id long, type string, category string, amount decimal(18,2)")
    ch = spark.createDataFrame([(1, 4, dt.datetime(2024, 1, 1), 1, None, "bb", "2.5", None),
                                (2, 4, dt.datetime(2024, 1, 2), 1, "refund", None, None, None)],
                               "request_seq long, actor_id long, now timestamp, id long, type string, "
                               "category string, amount string, date string")
    r = entities.update_ledger(led, ch).first()
    assert (r.type, r.category, float(r.amount), r.n_updates) == ("income", "bb", 2.5, 1)
    t = load_tables(spark, SF_SMALL)
    ups = batches.appointment_updates(spark, SF_SMALL).withColumn("now", F.lit(None).cast("timestamp"))
    out = entities.update_appointments(t["appointments"], ups)
    assert out.count() == t["appointments"].count()


def test_dashboard_one_row(spark):
    t = load_tables(spark, SF_SMALL)
    rows = dashboard(t, AS_OF).collect()
    assert len(rows) == 1
    r = rows[0]
    assert r.month_start == dt.date(1998, 6, 1) and r.month_end == dt.date(1998, 6, 30)
    assert len(r.recent_transactions) == 10 and len(r.top_services) <= 5
    for name, listed in (("recent_appointments", listings.recent_appointments(t, AS_OF)),
                         ("recent_transactions", listings.recent_transactions(t)),
                         ("top_services", rollups.top_services(t, Period.month_of(AS_OF), 5)),
                         ("top_customers", rollups.top_customers(t, Period.month_of(AS_OF), 5))):
        rows = r[name]
        order = {"recent_appointments": lambda x: (x["appointment_date"], x["id"]),
                 "recent_transactions": lambda x: (str(x["created_at"] or ""), x["id"]),
                 "top_services": lambda x: (x["count"], -x["id"]),
                 "top_customers": lambda x: (x["total_spent"] is not None, x["total_spent"] or 0, -x["id"])}[name]
        assert [x["id"] for x in rows] == [x["id"] for x in sorted(listed.collect(), key=order, reverse=True)]
        assert set(rows[0].asDict()) == set(listed.columns) if rows else True


def test_cancel_and_delete_keep_earlier_marks(spark):
    stored = spark.createDataFrame([(1, "pending", 7, "2024-01-01", "u", 1), (2, "cancelled", 8, "2024-01-02", "v", 1)],
                                   "id long, status string, cancelled_by long, cancelled_at string, updated_at string, is_active int")
    asked = spark.createDataFrame([(5, 9, "2024-02-02", 1)], "request_seq long, actor_id long, now string, id long")
    got = {r.id: r for r in writes.cancel_appointments(stored, asked).collect()}
    assert sorted(got[1].asDict()) == sorted(stored.columns)
    assert (got[1].status, got[1].cancelled_by, got[1].cancelled_at, got[1].updated_at) == ("cancelled", 9, "2024-02-02", "2024-02-02")
    assert (got[2].cancelled_by, got[2].cancelled_at, got[2].updated_at) == (8, "2024-01-02", "v")
    gone = {r.id: r for r in writes.soft_delete(stored, asked).collect()}
    assert (gone[1].is_active, gone[1].deleted_by, gone[1].updated_at) == (0, 9, "2024-02-02")
    assert (gone[2].is_active, gone[2].deleted_by, gone[2].updated_at) == (1, None, "v")


def test_uploads_reject_unknown_values(spark):
    m = spark.createDataFrame([
        (1, None, "a.png", "image/png", 5, 3, None, 1), (2, "avatar", "a.png", None, 5, 3, None, 1),
        (3, "avatar", "a.png", "image/png", None, 3, None, 1), (4, "avatar", "a.png", "image/png", 5, 3, None, 1)],
        "upload_id long, kind string, file_name string, mime string, size_bytes long, "
        "user_id long, transaction_id long, uploaded_ms long")
    got = {r.upload_id: (r.reason, r.target) for r in uploads.check_uploads(m).collect()}
    assert got == {1: ("unknown_kind", None), 2: ("bad_type", None), 3: ("unknown_size", None), 4: (None, "bucket")}


def test_uploads_storage_fallback(spark):
    m = spark.createDataFrame([
        (1, "avatar", "a.png", "image/png", 500_000, 3, None, 1000),
        (2, "avatar", "b.png", "image/png", 2_000_000, 3, None, 2000),
        (3, "receipt", "c.pdf", "application/pdf", 100, 3, 8, 3000),
        (4, "receipt", "d.pdf", "application/pdf", 100, 3, None, 4000),
        (5, "avatar", "e.bmp", "image/bmp", 100, 3, None, 5000)],
        "upload_id long, kind string, file_name string, mime string, size_bytes long, "
        "user_id long, transaction_id long, uploaded_ms long")
    kv = {r.upload_id: (r.reason, r.target) for r in
          uploads.check_uploads(m, has_bucket=False, has_kv=True).collect()}
    assert kv == {1: (None, "kv"), 2: ("storage_unavailable", None),
                  3: ("storage_unavailable", None), 4: ("missing_transaction", None),
                  5: ("bad_type", None)}
    ok = uploads.check_uploads(m, has_bucket=True)
    keys = {r.upload_id: r.file_key for r in ok.collect()}
    assert keys[1] == "avatar-3-1000.png" and keys[3] == "receipt-8-3000.pdf"
    users = spark.createDataFrame([(3, None)], "id long, avatar_url string")
    linked = uploads.attach_uploads(users, ok, "avatar", "user_id", "avatar_url").first()
    assert linked.avatar_url == "/files/avatar-3-2000.png"


def test_cancel_outcome_and_stock_snapshot(spark):
    d = dt.date(2024, 1, 5)
    appts = spark.createDataFrame([(1, "scheduled"), (2, "confirmed")], "id long, status string")
    now = dt.datetime(2024, 1, 1)
    cancels = spark.createDataFrame([(1, 4, now, 1), (2, 5, now, 1), (3, 4, now, 9)],
                                    "request_seq long, actor_id long, now timestamp, id long")
    got = {r.id: (r.status, r.cancelled_by) for r in
           writes.cancel_appointments(appts, cancels).collect()}
    assert got == {1: ("cancelled", 5), 2: ("confirmed", None)}
    out = {r.request_seq: r.outcome for r in writes.outcome(cancels, appts).collect()}
    assert out == {1: "ok", 2: "ok", 3: "not_found"}
    inv = spark.createDataFrame([(1, 5), (2, 7)], "id long, quantity int")
    log = spark.createDataFrame([(1, 1, 9), (2, 1, 3)],
                                "request_seq long, inventory_id long, new_quantity int")
    snap = {r.id: r.quantity for r in writes.stock_after_sets(inv, log).collect()}
    assert snap == {1: 3, 2: 7}


def test_keyset_page_continues_offset_page(spark):
    from salonlake.operators import filters
    t = load_tables(spark, SF_SMALL)
    first = filters.customer_page(t["customers"], 20, 0).collect()
    second = filters.customer_page(t["customers"], 20, 20).collect()
    last = first[-1]
    after = filters.customer_page_after(t["customers"], last.created_at, last.id, 20).collect()
    assert [r.id for r in after] == [r.id for r in second]


def test_inventory_cards_nest_bounded_lists(spark):
    from salonlake.operators import stock
    t = load_tables(spark, SF_SMALL)
    cards = stock.inventory_cards(t, 10)
    assert cards.count() == t["inventory"].count()
    assert cards.select(F.max(F.size("changes"))).first()[0] <= 10


def test_mixed_batch_postings_only_for_accepted_updates(spark):
    from salonlake.operators.booking import apply_appointment_batch
    d = dt.date(2024, 1, 5)
    appts = spark.createDataFrame(
        [(1, 1, 1, 7, d, "scheduled", None), (2, 1, 1, 8, d, "scheduled", None)],
        "id long, customer_id long, service_id long, employee_id long, appointment_date date, "
        "status string, price decimal(18,2)")
    ledger = spark.createDataFrame([(10, None)], "id long, appointment_id long")
    batch = spark.createDataFrame([
        (1, 3, None, "update", 2, None, None, "7", None, "completed", "50"),   # conflict: no post
        (2, 3, None, "update", 1, None, None, None, None, "completed", "40")],  # posts
        "request_seq long, actor_id long, now timestamp, op string, id long, customer_id string, "
        "service_id string, employee_id string, appointment_date string, status string, "
        "price string")
    dec, snap, posts = apply_appointment_batch(appts, batch, ledger, d)
    assert {r.request_seq: r.decision for r in dec.collect()} == {1: "conflict", 2: "accepted"}
    assert [(r.appointment_id, float(r.amount), r.id) for r in posts.collect()] == [(1, 40.0, 11)]


def test_inventory_mixed_batch(spark):
    inv = spark.createDataFrame([(1, "Gel", 5, 10), (2, "Wax", 7, 10), (3, "Oil", 1, 10)],
                                "id long, name string, quantity int, min_stock_level int")
    now = dt.datetime(2024, 1, 1)
    rows = [
        (1, "set", 1, "5", None, None),        # no_change is logged by the short form
        (2, "update", 1, "9", None, None),     # 5 -> 9 increase
        (3, "update", 1, "9", "Gel2", None),   # 9 -> 9: full form logs nothing
        (4, "set", 1, "2", None, "count"),     # 9 -> 2 decrease, own reason
        (5, "delete", 2, None, None, None),
        (6, "set", 2, "3", None, None),        # item deleted: nothing
        (7, "set", 0, "3", None, None),        # id 0 counts as missing
        (8, "insert", None, "4", "Soap", None)]
    b = spark.createDataFrame(
        [(s, 9, now, op, i, q, n, r) for s, op, i, q, n, r in rows],
        "request_seq long, actor_id long, now timestamp, op string, id long, quantity string, "
        "name string, reason string")
    snap, log = entities.inventory_batch(inv, b)
    got = sorted((r.request_seq, r.inventory_id, r.change_type, r.previous_quantity,
                  r.new_quantity) for r in log.collect())
    assert got == [(1, 1, "no_change", 5, 5), (2, 1, "increase", 5, 9),
                   (4, 1, "decrease", 9, 2), (8, 4, "initial", 0, 4)]
    s = {r.id: (r.name, r.quantity) for r in snap.collect()}
    assert s == {1: ("Gel2", 2), 3: ("Oil", 1), 4: ("Soap", 4)}
