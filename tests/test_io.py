"""Sources, sinks, report envelope and replay-safe streaming application."""

import datetime as dt
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from salonlake.plans.reports import default_period, report
from salonlake.params import AS_OF, PERIOD, Period
from salonlake.sources import tables
from salonlake.sources.changes import read_changes, stream_changes
from salonlake.sources.fixtures import load_tables
from salonlake.streaming.changes import run_changes
from tests.conftest import SF_SMALL


def test_report_dispatch_and_envelope(spark):
    t = load_tables(spark, SF_SMALL)
    rows, summary = report(t, "revenue", PERIOD)
    s = summary.first()
    assert s.total_records == rows.count()
    assert abs(s.net_profit - (s.total_income - s.total_expense)) < 1e-6
    _, inv = report(t, "inventory", PERIOD)
    assert inv.first().total_income == 0.0
    with pytest.raises(ValueError):
        report(t, "nope", PERIOD)
    out = tempfile.mkdtemp(prefix="salonlake-report-")
    tables.write_report(rows, out, "revenue", PERIOD.start, PERIOD.end, dt.datetime(2026, 1, 1))
    env = tables.envelope_json(spark, out)
    assert env["summary"]["revenue"] == pytest.approx(
        {"totalIncome": s.total_income, "totalExpense": s.total_expense, "netProfit": s.net_profit})
    assert env["reportType"] == "revenue" and env["count"] == rows.count()
    assert spark.read.json(f"{out}/results").count() == rows.count()


def test_default_periods():
    assert default_period(AS_OF, ledger=True) == Period.month_of(AS_OF)
    assert default_period(AS_OF, "1998-06-01", None, ledger=True) == Period.month_of(AS_OF)
    p = default_period(AS_OF, "1998-06-03")
    assert p.start == p.end == dt.date(1998, 6, 3)
    with pytest.raises(ValueError):
        default_period(AS_OF, "1998-02-30", "1998-03-01", ledger=True)


def test_snapshot_versions_and_replay(spark):
    root = tempfile.mkdtemp(prefix="salonlake-snap-")
    t = load_tables(spark, SF_SMALL)
    assert tables.write_snapshot(t["customers"], root, "customers", 0)
    assert not tables.write_snapshot(t["customers"], root, "customers", 0)  # replay: skipped
    assert tables.committed_versions(spark, root, "customers") == [0]
    assert tables.load(spark, root, "customers").count() == t["customers"].count()


def test_json_changes_keep_corrupt_rows(spark):
    d = tempfile.mkdtemp(prefix="salonlake-json-")
    with open(os.path.join(d, "a.json"), "w") as f:
        f.write(json.dumps({"request_seq": 1, "actor_id": 2, "op": "update", "id": 3,
                            "full_name": "Zed"}) + "\n")
        f.write("{not json\n")
    df = read_changes(spark, d, "customers")
    assert df.count() == 2
    bad = df.where(F.col("_corrupt_record").isNotNull() & F.col("request_seq").isNull())
    assert bad.count() == 1


def test_streaming_change_application_is_replay_safe(spark):
    root = tempfile.mkdtemp(prefix="salonlake-stream-")
    src = tempfile.mkdtemp(prefix="salonlake-src-")
    t = load_tables(spark, SF_SMALL)
    tables.write_snapshot(t["customers"], root, "customers", 0)
    ids = [r.id for r in t["customers"].where("is_active = 1").select("id").limit(3).collect()]
    for i, cid in enumerate(ids):
        with open(os.path.join(src, f"{i}.json"), "w") as f:
            f.write(json.dumps({"request_seq": i, "actor_id": 7, "now": "2024-01-01T00:00:00",
                                "op": "update", "id": cid, "full_name": f"New <{i}>"}) + "\n")
    ck = tempfile.mkdtemp(prefix="salonlake-ck-")
    q = run_changes(stream_changes(spark, src, "customers", 1), root, ck)
    q.awaitTermination(120)
    vs = tables.committed_versions(spark, root, "customers")
    assert vs[0] == 0 and len(vs) == 4
    last = tables.load(spark, root, "customers")
    got = {r.id: r.full_name for r in last.where(F.col("id").isin(ids)).collect()}
    assert got == {cid: f"New &lt;{i}&gt;" for i, cid in enumerate(ids)}
    # Restart on the same checkpoint: nothing new is written.
    q2 = run_changes(stream_changes(spark, src, "customers", 1), root, ck)
    q2.awaitTermination(120)
    assert tables.committed_versions(spark, root, "customers") == vs


def test_streaming_appointment_batches_equal_one_batch(spark):
    from salonlake.operators.booking import apply_appointment_batch
    root = tempfile.mkdtemp(prefix="salonlake-appt-")
    src = tempfile.mkdtemp(prefix="salonlake-appt-src-")
    snap = spark.createDataFrame(
        [(1, 1, 1, 7, dt.date(2024, 1, 1), "scheduled", None),
         (2, 1, 1, 8, dt.date(2024, 1, 1), "confirmed", None)],
        "id long, customer_id long, service_id long, employee_id long, "
        "appointment_date date, status string, price decimal(18,2)")
    tables.write_snapshot(snap, root, "appointments", 0)
    reqs = [
        [{"request_seq": 1, "actor_id": 3, "op": "insert", "customer_id": "5", "service_id": "2",
          "employee_id": "7", "appointment_date": "2024-01-01"},            # conflict (id 1)
         {"request_seq": 2, "actor_id": 3, "op": "cancel", "id": 1}],
        [{"request_seq": 3, "actor_id": 3, "op": "insert", "customer_id": "5", "service_id": "2",
          "employee_id": "7", "appointment_date": "2024-01-01"},            # now free
         {"request_seq": 4, "actor_id": 3, "op": "update", "id": 2, "employee_id": "7"}]]  # conflict
    for i, batch in enumerate(reqs):
        path = os.path.join(src, f"{i}.json")
        with open(path, "w") as f:
            f.write("\n".join(json.dumps(r) for r in batch) + "\n")
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))  # arrival order
    q = run_changes(stream_changes(spark, src, "appointments", 1), root,
                    tempfile.mkdtemp(prefix="salonlake-appt-ck-"), entity="appointments")
    q.awaitTermination(300)
    assert tables.committed_versions(spark, root, "appointments") == [0, 1, 2]
    final = tables.load(spark, root, "appointments").collect()
    got = {r.id: (r.employee_id, r.status) for r in final}
    assert got == {1: (7, "cancelled"), 2: (8, "confirmed"), 3: (7, "scheduled")}
    assert {r.id: r.cancelled_by for r in final} == {1: 3, 2: None, 3: None}
    whole = read_changes(spark, src, "appointments")
    _, one = apply_appointment_batch(tables.load(spark, root, "appointments", 0), whole)
    assert {r.id: (r.employee_id, r.status) for r in one.collect()} == got


def test_streaming_ledger_changes(spark):
    root = tempfile.mkdtemp(prefix="salonlake-led-")
    src = tempfile.mkdtemp(prefix="salonlake-led-src-")
    led = spark.createDataFrame(
        [(1, "income", "a", 10.0, dt.date(2024, 1, 1)), (2, "expense", "b", 5.0, dt.date(2024, 1, 1))],
        "id long, type string, category string, amount double, date date")
    tables.write_snapshot(led, root, "transactions", 0)
    reqs = [[{"request_seq": 1, "actor_id": 3, "op": "update", "id": 1, "amount": "12.5"},
             {"request_seq": 2, "actor_id": 3, "op": "insert", "type": "income",
              "category": "tips", "amount": "3", "date": "2024-01-02"}],
            [{"request_seq": 3, "actor_id": 3, "op": "delete", "id": 2},
             {"request_seq": 4, "actor_id": 3, "op": "update", "id": 2, "category": "zz"}]]
    for i, batch in enumerate(reqs):
        path = os.path.join(src, f"{i}.json")
        with open(path, "w") as f:
            f.write("\n".join(json.dumps(r) for r in batch) + "\n")
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    q = run_changes(stream_changes(spark, src, "transactions", 1), root,
                    tempfile.mkdtemp(prefix="salonlake-led-ck-"), entity="transactions")
    q.awaitTermination(300)
    got = {r.id: (r.category, float(r.amount)) for r in tables.load(spark, root, "transactions").collect()}
    assert got == {1: ("a", 12.5), 3: ("tips", 3.0)}


def test_streaming_service_changes(spark):
    root = tempfile.mkdtemp(prefix="salonlake-svc-")
    src = tempfile.mkdtemp(prefix="salonlake-svc-src-")
    svc = spark.createDataFrame([(1, "Cut", 10.0, 30, "hair", 1), (2, "Dye", 20.0, 60, "hair", 1)],
                                "id long, name string, price double, duration_minutes int, "
                                "category string, is_active int")
    tables.write_snapshot(svc, root, "services", 0)
    reqs = [[{"request_seq": 1, "actor_id": 3, "op": "update", "id": 1, "price": "12"},
             {"request_seq": 2, "actor_id": 3, "op": "delete", "id": 2, "now": "2024-01-01T00:00:00"},
             {"request_seq": 3, "actor_id": 3, "op": "insert", "name": "Nails", "price": "7",
              "duration_minutes": "20"}]]
    with open(os.path.join(src, "0.json"), "w") as f:
        f.write("\n".join(json.dumps(r) for r in reqs[0]) + "\n")
    q = run_changes(stream_changes(spark, src, "services", 1), root,
                    tempfile.mkdtemp(prefix="salonlake-svc-ck-"), entity="services")
    q.awaitTermination(300)
    got = {r.id: (r.name, float(r.price), r.is_active, r.deleted_at is not None)
           for r in tables.load(spark, root, "services").collect()}
    assert got == {1: ("Cut", 12.0, 1, False), 2: ("Dye", 20.0, 0, True), 3: ("Nails", 7.0, 1, False)}


def test_streaming_inventory_changes_with_log(spark):
    root = tempfile.mkdtemp(prefix="salonlake-inv-")
    src = tempfile.mkdtemp(prefix="salonlake-inv-src-")
    inv = spark.createDataFrame([(1, "Gel", 5, 10)], "id long, name string, quantity int, "
                                                     "min_stock_level int")
    tables.write_snapshot(inv, root, "inventory", 0)
    reqs = [[{"request_seq": 1, "actor_id": 3, "op": "set", "id": 1, "quantity": "8"}],
            [{"request_seq": 2, "actor_id": 3, "op": "update", "id": 1, "quantity": "6"},
             {"request_seq": 3, "actor_id": 3, "op": "insert", "name": "Soap", "quantity": "4"}]]
    for i, batch in enumerate(reqs):
        path = os.path.join(src, f"{i}.json")
        with open(path, "w") as f:
            f.write("\n".join(json.dumps(r) for r in batch) + "\n")
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    ck = tempfile.mkdtemp(prefix="salonlake-inv-ck-")
    q = run_changes(stream_changes(spark, src, "inventory", 1), root, ck, entity="inventory")
    q.awaitTermination(300)
    got = {r.id: r.quantity for r in tables.load(spark, root, "inventory").collect()}
    assert got == {1: 6, 2: 4}
    log = sorted((r.inventory_id, r.change_type, r.previous_quantity, r.new_quantity)
                 for r in tables.load_log(spark, root, "inventory_changes").collect())
    assert log == [(1, "decrease", 8, 6), (1, "increase", 5, 8), (2, "initial", 0, 4)]


def test_streaming_customer_create_update_delete(spark):
    root = tempfile.mkdtemp(prefix="salonlake-cus-")
    src = tempfile.mkdtemp(prefix="salonlake-cus-src-")
    cur = spark.createDataFrame([(1, "Ann", 1), (2, "Bob", 1)], "id long, full_name string, is_active int")
    tables.write_snapshot(cur, root, "customers", 0)
    reqs = [{"request_seq": 1, "actor_id": 3, "op": "update", "id": 2, "full_name": "Bobby"},
            {"request_seq": 2, "actor_id": 4, "op": "delete", "id": 2, "now": "2024-01-01T00:00:00"},
            {"request_seq": 3, "actor_id": 3, "op": "update", "id": 2, "full_name": "Robert"},
            {"request_seq": 4, "actor_id": 3, "op": "insert", "full_name": "Cy <x>"}]
    with open(os.path.join(src, "0.json"), "w") as f:
        f.write("\n".join(json.dumps(r) for r in reqs) + "\n")
    q = run_changes(stream_changes(spark, src, "customers", 1), root,
                    tempfile.mkdtemp(prefix="salonlake-cus-ck-"), entity="customers")
    q.awaitTermination(300)
    got = {r.id: (r.full_name, r.is_active, r.deleted_by) for r in
           tables.load(spark, root, "customers").collect()}
    assert got == {1: ("Ann", 1, None), 2: ("Bobby", 0, 4), 3: ("Cy &lt;x&gt;", 1, None)}


def test_streaming_signups(spark):
    root = tempfile.mkdtemp(prefix="salonlake-usr-")
    src = tempfile.mkdtemp(prefix="salonlake-usr-src-")
    cur = spark.createDataFrame([(1, "Ann", "a@x.co", "admin", 1)],
                                "id long, full_name string, email string, role string, is_active int")
    tables.write_snapshot(cur, root, "users", 0)
    reqs = [{"request_seq": 1, "full_name": "Bo", "email": "b@x.co"},
            {"request_seq": 2, "full_name": "Bo2", "email": "b@x.co"},     # duplicate in batch
            {"request_seq": 3, "full_name": "An", "email": "a@x.co"},      # taken
            {"request_seq": 4, "full_name": "C", "email": "c@x.co"}]       # name too short
    with open(os.path.join(src, "0.json"), "w") as f:
        f.write("\n".join(json.dumps(r) for r in reqs) + "\n")
    q = run_changes(stream_changes(spark, src, "users", 1), root,
                    tempfile.mkdtemp(prefix="salonlake-usr-ck-"), entity="users")
    q.awaitTermination(300)
    got = {r.id: (r.email, r.role) for r in tables.load(spark, root, "users").collect()}
    assert got == {1: ("a@x.co", "admin"), 2: ("b@x.co", "employee")}


def test_stored_table_scan_prunes_and_pushes(spark):
    from salonlake.operators.filters import in_period
    root = tempfile.mkdtemp(prefix="salonlake-store-")
    t = load_tables(spark, SF_SMALL)
    tables.write_snapshot(t["appointments"], root, "appointments", 0)
    a = in_period(tables.load(spark, root, "appointments"), "appointment_date", PERIOD)
    df = a.select("id", "status")
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    scan = [ln for ln in plan.splitlines() if "FileScan parquet" in ln][0]
    assert "GreaterThanOrEqual(appointment_date" in scan and "LessThanOrEqual(ap" in scan
    assert "ReadSchema: struct<id:bigint,appointment_date:date,status:string>" in scan
    want = t["appointments"].where(
        F.col("appointment_date").between(F.lit(PERIOD.start), F.lit(PERIOD.end))).count()
    assert df.count() == want


def test_log_reads_appended_rows_and_batches(spark):
    root = tempfile.mkdtemp(prefix="salonlake-log-")
    row = spark.createDataFrame([(1, 5)], "id long, inventory_id long")
    tables.append(row, root, "inventory_changes")
    tables.append(row.withColumn("id", row.id + 1), root, "inventory_changes")
    tables.write_log_batch(row.withColumn("id", row.id + 2), root, "inventory_changes", 1)
    got = tables.load_log(spark, root, "inventory_changes")
    assert sorted(r.id for r in got.collect()) == [1, 2, 3]
    assert got.columns == tables.TABLES["inventory_changes"].fieldNames()


def test_batch_keeps_times_notes_and_order(spark):
    import datetime as dt
    from salonlake.operators.booking import apply_appointment_batch
    from salonlake.streaming import changes
    now = dt.datetime(2024, 5, 1, 9)
    appts = spark.createDataFrame(
        [(1, 1, 1, 7, dt.date(2024, 5, 2), "scheduled", "old", None, None)],
        "id long, customer_id long, service_id long, employee_id long, appointment_date date, status string, "
        "notes string, created_by long, created_at timestamp")
    batch = spark.createDataFrame(
        [(1, 3, now, "update", 1, None, None, None, None, None, "new"),
         (2, 4, now, "cancel", 1, None, None, "9", "2024-06-01", None, None),
         (3, 5, now, "insert", None, "1", "1", "7", "2024-05-02", None, "first")],
        "request_seq long, actor_id long, now timestamp, op string, id long, customer_id string, service_id string, "
        "employee_id string, appointment_date string, status string, notes string").withColumn("price", F.lit(None).cast("string"))
    got = {r.id: r for r in apply_appointment_batch(appts, batch)[1].collect()}
    assert (got[1].notes, got[1].status, got[1].employee_id, str(got[1].appointment_date)) == ("new", "cancelled", 7, "2024-05-02")
    assert (got[2].notes, got[2].created_by, got[2].created_at, got[2].updated_by) == ("first", 5, now, None)
    services = spark.createDataFrame([(1, "cut", None, 1)], "id long, name string, updated_at timestamp, is_active int")
    asked = spark.createDataFrame(
        [(1, 3, now, "update", 1, "early"), (2, 3, now, "delete", 1, None), (3, 3, now, "update", 1, "late")],
        "request_seq long, actor_id long, now timestamp, op string, id long, name string")
    for c in ("price", "duration_minutes", "category", "description"):
        asked = asked.withColumn(c, F.lit(None).cast("string"))
    r = changes._services({"services": services}, asked).tables["services"][0].first()
    assert (r["name"], r.is_active) == ("early", 0)


def test_cluster_without_shared_folder_is_an_error(monkeypatch):
    import pytest
    from types import SimpleNamespace
    from salonlake.session import ensure_checkpoint_dir
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: d),
                           sparkContext=SimpleNamespace(master="yarn", getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(fake)
