"""Change streams lose no request, and a batch is visible whole or not at all."""

import datetime as dt
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from salonlake.functions.validation import APPOINTMENT_UPDATE
from salonlake.operators import writes
from salonlake.operators.outcomes import decide_changes
from salonlake.sources import tables
from salonlake.sources.changes import read_changes, stream_changes
from salonlake.streaming import changes

NOW = "2024-05-01T09:00:00"


def _source(batches):
    src = tempfile.mkdtemp(prefix="salonlake-req-")
    for i, batch in enumerate(batches):
        path = os.path.join(src, f"{i}.json")
        with open(path, "w") as f:
            f.write("\n".join(r if isinstance(r, str) else json.dumps({"actor_id": 3, "now": NOW, **r}) for r in batch) + "\n")
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    return src


def _run(spark, src, root, entity, checkpoint=None):
    q = changes.run_changes(stream_changes(spark, src, entity, 1), root,
                            checkpoint or tempfile.mkdtemp(prefix="salonlake-ck-"), entity=entity)
    q.awaitTermination(300)


def _outcomes(spark, root):
    return sorted((r.request_seq if r.request_seq is not None else -1, r.outcome, r.reason, r.id)
                  for r in changes.load_outcomes(spark, root).collect())


CUSTOMERS = [
    [{"request_seq": 1, "op": "insert", "full_name": "Ann Lee"},
     {"request_seq": 2, "op": "insert", "full_name": "A"},                      # too short
     {"request_seq": 3, "op": "update", "id": 1, "notes": "x"},
     {"request_seq": 4, "op": "delete", "id": 1},
     {"request_seq": 5, "op": "update", "id": 1, "notes": "late"},              # deleted by then
     {"request_seq": 6, "op": "delete", "id": 1},                               # rewrites who/when
     {"request_seq": 7, "op": "update", "id": 99, "notes": "x"},                # unknown
     {"request_seq": 8, "op": "update", "id": 2, "notes": "x"},                 # inactive
     {"request_seq": 9, "op": "merge", "id": 1},
     {"op": "insert", "full_name": "No Place"},
     "{not json"],
    [{"request_seq": 12, "op": "update", "id": 3, "email": "bad"},
     {"request_seq": 13, "op": "update", "id": 3, "email": "a@b.co"}]]


def _customers(spark, root):
    cur = spark.createDataFrame([(1, "Zoe", 1), (2, "Bob", 0)], "id long, full_name string, is_active int")
    tables.write_snapshot(cur, root, "customers", 0)


def test_every_request_is_applied_or_rejected_once(spark):
    root, src, ck = tempfile.mkdtemp(), _source(CUSTOMERS), tempfile.mkdtemp()
    _customers(spark, root)
    _run(spark, src, root, "customers", ck)
    want = [(-1, "rejected", "corrupt", None), (-1, "rejected", "unsequenced", None),
            (1, "applied", None, 3), (2, "rejected", "invalid", None), (3, "applied", None, 1), (4, "applied", None, 1),
            (5, "rejected", "not_found", 1), (6, "applied", None, 1), (7, "rejected", "not_found", 99),
            (8, "rejected", "not_found", 2), (9, "rejected", "unknown_op", 1),
            (12, "rejected", "invalid", 3), (13, "applied", None, 3)]
    assert _outcomes(spark, root) == sorted(want, key=lambda r: (r[0], r[1], r[2] or ""))
    rows = changes.load_outcomes(spark, root).collect()
    assert {r.raw for r in rows if r.reason == "corrupt"} == {"{not json"}
    assert [r.errors for r in rows if r.request_seq == 2] == [["full_name:min_length"]]
    got = {r.id: (r.full_name, r.notes, r.email, r.is_active) for r in tables.load(spark, root, "customers").collect()}
    assert got == {1: ("Zoe", "x", None, 0), 2: ("Bob", None, None, 0), 3: ("Ann Lee", None, "a@b.co", 1)}
    # A replay of a batch that is there changes nothing.
    files = sorted(os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs)
    changes.apply_batch(read_changes(spark, os.path.join(src, "0.json"), "customers"), 0, root, "customers")
    assert sorted(os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs) == files


@pytest.mark.parametrize("entity,current,requests,want", [
    ("transactions", [(1, "income", "a", 10.0)],
     [{"request_seq": 1, "op": "delete", "id": 1}, {"request_seq": 2, "op": "update", "id": 1, "amount": "4"},
      {"request_seq": 3, "op": "delete", "id": 1}, {"request_seq": 4, "op": "insert", "type": "income", "category": "tips",
                                                    "amount": "Infinity", "date": "2024-01-01"}],
     ["applied", "not_found", "not_found", "invalid"]),
    ("users", [(5, "Al", "a@x.co", None)],
     [{"request_seq": 1, "full_name": "Bo", "email": "b@x.co"}, {"request_seq": 2, "full_name": "Bo", "email": "b@x.co"},
      {"request_seq": 3, "full_name": "An", "email": "a@x.co"}, {"request_seq": 4, "full_name": "C", "email": "c@x.co"}],
     ["applied", "duplicate", "duplicate", "invalid"]),
    ("inventory", [(1, "Gel", 5, None)],
     [{"request_seq": 1, "op": "set", "id": 1, "quantity": "7"}, {"request_seq": 2, "op": "set", "id": 1, "quantity": "x"},
      {"request_seq": 3, "op": "set", "quantity": "7"}, {"request_seq": 4, "op": "delete", "id": 1},
      {"request_seq": 5, "op": "set", "id": 1, "quantity": "9"}], ["applied", "invalid", "invalid", "applied", "not_found"])])
def test_reasons_of_other_entities(spark, entity, current, requests, want):
    kinds = {"transactions": "id long, type string, category string, amount double",
             "users": "id long, full_name string, email string, phone string", "inventory": "id long, name string, quantity int, category string"}
    root = tempfile.mkdtemp()
    tables.write_snapshot(spark.createDataFrame(current, kinds[entity]), root, entity, 0)
    _run(spark, _source([requests]), root, entity)
    assert [r[2] or r[1] for r in _outcomes(spark, root)] == want
    if entity == "users":  # the request's time is kept
        assert {r.created_at for r in tables.load(spark, root, "users").where("id = 6").collect()} == {dt.datetime(2024, 5, 1, 9)}


APPOINTMENTS = [
    [{"request_seq": 1, "op": "update", "id": 1, "status": "completed", "price": "40"},
     {"request_seq": 2, "op": "update", "id": 1, "status": "completed", "price": "50"},      # posted already
     {"request_seq": 3, "op": "insert", "customer_id": "5", "service_id": "2", "employee_id": "8", "appointment_date": "2024-05-02"},
     {"request_seq": 4, "op": "insert", "customer_id": "5", "employee_id": "8", "appointment_date": "2024-05-02"},
     {"request_seq": 5, "op": "cancel", "id": 77}, "{broken"],
    [{"request_seq": 6, "op": "update", "id": 2, "status": "completed", "price": "30"},
     {"request_seq": 7, "op": "insert", "customer_id": "5", "service_id": "2", "employee_id": "8", "appointment_date": "2024-05-02"}]]


def _bookings(spark, root):
    day = dt.date(2024, 5, 2)
    snap = spark.createDataFrame([(1, 1, 1, 7, day, "scheduled"), (2, 1, 1, 8, day, "confirmed")],
                                 "id long, customer_id long, service_id long, employee_id long, appointment_date date, status string")
    tables.write_snapshot(snap.withColumn("price", F.lit(None).cast("decimal(18,2)")), root, "appointments", 0)
    led = spark.createDataFrame([(10, "income", None)], "id long, type string, appointment_id long")
    tables.write_snapshot(led, root, "transactions", 0)


def test_bookings_post_to_the_ledger_in_the_same_batch(spark):
    root, src = tempfile.mkdtemp(), _source(APPOINTMENTS)
    _bookings(spark, root)
    before = {t: tables.load(spark, root, t) for t in ("appointments", "transactions")}
    _run(spark, src, root, "appointments")
    assert [(s, r or o, i) for s, o, r, i in _outcomes(spark, root)] == [
        (-1, "corrupt", None), (1, "applied", 1), (2, "applied", 1), (3, "conflict", None), (4, "invalid", None),
        (5, "not_found", 77), (6, "applied", 2), (7, "applied", 3)]
    updates = read_changes(spark, src, "appointments").where("op = 'update'")
    posts = writes.post_completed(before["appointments"], before["transactions"], updates, APPOINTMENT_UPDATE,
                                  F.to_date("now")).drop("request_seq")
    ledger = tables.load(spark, root, "transactions").where("id > 10")
    cols = ["id", "type", "category", "amount", "description", "date", "appointment_id", "created_by"]
    assert sorted(map(tuple, ledger.select(cols).collect())) == sorted(map(tuple, posts.select(cols).collect()))
    assert {(r.appointment_id, float(r.amount), str(r.date)) for r in ledger.collect()} == {(1, 40.0, "2024-05-01"), (2, 30.0, "2024-05-01")}
    assert tables.batch_note(spark, root, "appointments-0")["requests"] == {
        "applied": 2, "conflict": 1, "invalid": 1, "not_found": 1, "corrupt": 1}
    assert tables.batch_note(spark, root, "appointments-1") == {
        "requests": {"applied": 2}, "appointments": {"version": 2, "buckets": ["2024-05"]}, "transactions": {"version": 2, "buckets": ["2024-05"]}}


def test_crash_between_two_tables_shows_neither(spark, monkeypatch):
    root, src = tempfile.mkdtemp(), _source(APPOINTMENTS[:1])
    _bookings(spark, root)
    batch = read_changes(spark, src, "appointments")
    real = changes.write_change

    def broken(df, root, table, *rest):
        if table == "transactions":
            raise OSError("executor and driver lost")
        return real(df, root, table, *rest)

    monkeypatch.setattr(changes, "write_change", broken)
    with pytest.raises(OSError):
        changes.apply_batch(batch, 0, root, "appointments")
    for t in ("appointments", "transactions"):
        assert tables.committed_versions(spark, root, t) == [0]
    assert changes.load_outcomes(spark, root).count() == 0
    monkeypatch.undo()
    changes.apply_batch(batch, 0, root, "appointments")
    for t in ("appointments", "transactions"):
        assert tables.committed_versions(spark, root, t) == [0, 1]
    assert changes.load_outcomes(spark, root).count() == 6


def test_two_writers_of_one_version_are_noticed(spark):
    root = tempfile.mkdtemp()
    _customers(spark, root)
    for name in ("customers-0", "other-0"):
        tables.write_snapshot(tables.load(spark, root, "customers", 0), root, "customers", 1, name)
        tables.commit_batch(spark, root, name, {"customers": 1})
    with pytest.raises(RuntimeError):
        tables.load(spark, root, "customers")


def test_empty_batch_and_clashing_columns(spark):
    cur = spark.createDataFrame([(1, "Zoe", 1)], "id long, full_name string, is_active int")
    rows = spark.createDataFrame([(1, "insert", None, "Ann Lee", "mine", "x", "y")],
                                 "request_seq long, op string, id long, full_name string, outcome string, reason string, errors string")
    got = decide_changes(cur, rows, "customers")
    assert [(r.request_seq, r.outcome, r.reason) for r in got.collect()] == [(1, "applied", None)]
    assert decide_changes(cur, rows.limit(0), "customers").count() == 0


def _largest_share(df):
    """Rows of ``df`` and of its largest partition."""
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return sum(sizes), max(sizes)


@pytest.mark.parametrize("entity", ["transactions", "users"])
def test_requests_without_a_key_do_not_meet_in_one_task(spark, entity):
    """Inserts have no id and invalid e-mails no key; with a null join key all
    of them would be dealt to one partition."""
    had = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        k = F.col("id")
        rows = spark.range(0, 4000, 1, 4).select(
            k.alias("request_seq"), F.when(k % 10 == 0, "delete" if entity == "transactions" else "insert").otherwise("insert").alias("op"),
            F.when(k % 10 == 0, k).alias("id"), F.lit("income").alias("type"), F.lit("rent").alias("category"), F.lit("5").alias("amount"),
            F.lit("2024-01-05").alias("date"), F.lit("Ann Lee").alias("full_name"), F.lit("secret-Pass1").alias("password"),
            F.lit("manager").alias("role"), F.when(k % 10 == 0, F.concat(F.lit("a"), k, F.lit("@x.org"))).otherwise(F.lit("bad")).alias("email"))
        current = spark.range(0, 2000, 20).select("id", F.concat(F.lit("a"), "id", F.lit("@x.org")).alias("email"))
        got = decide_changes(current, rows, entity)
        total, most = _largest_share(got)
        assert total == 4000 and most <= 2000
        lost = got.where("id is not null and outcome = 'rejected'")
        assert {(r.id, r.reason) for r in lost.collect()} == {
            (i, "not_found" if entity == "transactions" else "duplicate") for i in range(0, 4000, 10)
            if (i < 2000 and i % 20 == 0) == (entity == "users")}
    finally:
        for name, v in had.items():
            spark.conf.set(name, v)


def _files(path):
    return {os.path.join(d, f)[len(path):] for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_one_row_batch_writes_one_bucket(spark, monkeypatch):
    root = tempfile.mkdtemp()
    rows = spark.range(2000).select("id", F.concat(F.lit("Name "), "id").alias("full_name"), F.lit(1).alias("is_active"))
    tables.write_snapshot(rows, root, "customers", 0)
    before = _files(f"{root}/customers")
    assert len({f.split("/")[2] for f in before}) == tables.ID_BUCKETS
    src = _source([[{"request_seq": 1, "op": "update", "id": 5, "notes": "x"}]])
    changes.apply_batch(read_changes(spark, src, "customers"), 0, root, "customers")
    new = _files(f"{root}/customers") - before
    assert before <= _files(f"{root}/customers") and len({f.split("/")[2] for f in new}) == 1
    got = tables.load(spark, root, "customers")
    assert got.count() == 2000 and [r.notes for r in got.where("id = 5").collect()] == ["x"]
    assert tables.load(spark, root, "customers", 0).where("notes is not null").count() == 0
    read = {f[f.index("/customers/"):] for f in got.inputFiles()}
    assert len([f for f in read if "/v=1~" in f]) == len(new)  # the rest is read where it was
    # Whole versions come in between, and hold the same rows.
    monkeypatch.setattr(tables, "WHOLE_EVERY", 1)
    changes.apply_batch(read_changes(spark, src, "customers"), 1, root, "customers")
    assert sorted(n.partition("@")[0] for n in os.listdir(f"{root}/customers")) == ["v=0", "v=1~", "v=2"]
    assert tables.load(spark, root, "customers").count() == 2000


def test_moves_between_months_and_emptied_buckets(spark):
    root = tempfile.mkdtemp()
    led = spark.createDataFrame([(1, "income", 5.0, dt.date(2024, 1, 5)), (2, "income", 6.0, dt.date(2024, 2, 5)),
                                 (3, "income", 7.0, None)], "id long, type string, amount double, date date")
    tables.write_snapshot(led, root, "transactions", 0)
    src = _source([[{"request_seq": 1, "op": "update", "id": 1, "date": "2024-02-07"}, {"request_seq": 2, "op": "delete", "id": 3}]])
    changes.apply_batch(read_changes(spark, src, "transactions"), 0, root, "transactions")
    assert tables.batch_note(spark, root, "transactions-0")["transactions"]["buckets"] == ["2024-01", "2024-02", "none"]
    got = {r.id: str(r.date) for r in tables.load(spark, root, "transactions").collect()}
    assert got == {1: "2024-02-07", 2: "2024-02-05"}
