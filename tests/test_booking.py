"""Mixed-batch booking decisions equal a one-by-one replay (hot slot included)."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from salonlake.operators.booking import apply_appointment_batch

OPEN = ("scheduled", "confirmed")


def _replay(snapshot, batch, table):
    out = {}
    for r in sorted(batch, key=lambda r: r["request_seq"]):
        op = r["op"]
        emp = None if r.get("employee_id") in (None, "") else int(r["employee_id"])
        date = None if r.get("appointment_date") in (None, "") else \
            dt.date.fromisoformat(r["appointment_date"])
        status = r.get("status") or None
        if op == "insert":
            if emp:
                clash = any(x["id"] != 0 and x["employee_id"] == emp and x["date"] == date
                            and x["status"] in OPEN for x in table.values())
                if clash:
                    out[r["request_seq"]] = "conflict"
                    continue
            table[-r["request_seq"]] = {"id": -r["request_seq"], "employee_id": emp or None,
                                        "date": date, "status": status or "scheduled"}
            out[r["request_seq"]] = "accepted"
            continue
        a = table.get(r["id"])
        if a is None:
            out[r["request_seq"]] = "not_found"
            continue
        if op == "cancel":
            a["status"] = "cancelled"
            out[r["request_seq"]] = "accepted"
            continue
        if date is not None or emp:
            new_emp = emp if r.get("employee_id") not in (None, "") else a["employee_id"]
            new_date = date if date is not None else a["date"]
            if new_emp:
                clash = any(x["id"] != a["id"] and x["employee_id"] == new_emp
                            and x["date"] == new_date and x["status"] in OPEN
                            for x in table.values())
                if clash:
                    out[r["request_seq"]] = "conflict"
                    continue
        if r.get("employee_id") not in (None, ""):
            a["employee_id"] = emp
        if date is not None:
            a["date"] = date
        if status:
            a["status"] = status
        out[r["request_seq"]] = "accepted"
    return out


def test_mixed_batch_matches_replay(spark):
    rnd = random.Random(7)
    d0 = dt.date(2024, 1, 1)
    snapshot = [{"id": i, "employee_id": rnd.choice([1, 2, 3, None]),
                 "date": d0 + dt.timedelta(days=rnd.randrange(3)),
                 "status": rnd.choice(["scheduled", "confirmed", "completed", "cancelled"])}
                for i in range(0, 40)]
    batch = []
    for seq in range(1, 160):
        op = rnd.choices(["insert", "update", "cancel"], [4, 5, 1])[0]
        hot = rnd.random() < 0.4  # employee 1 on day 0 is a hot slot
        emp = "1" if hot else rnd.choice(["1", "2", "3", "4", None, "0"])
        day = d0 if hot else d0 + dt.timedelta(days=rnd.randrange(3))
        r = {"request_seq": seq * 10, "op": op, "id": None, "employee_id": None,
             "appointment_date": None, "status": None}
        if op == "insert":
            r.update(employee_id=emp, appointment_date=day.isoformat(),
                     status=rnd.choice([None, "confirmed", "completed"]))
        else:
            r["id"] = rnd.choice(list(range(45)))
            if op == "update":
                if rnd.random() < 0.6:
                    r["employee_id"] = emp
                if rnd.random() < 0.6:
                    r["appointment_date"] = day.isoformat()
                if rnd.random() < 0.5:
                    r["status"] = rnd.choice(["scheduled", "confirmed", "completed", "cancelled"])
        batch.append(r)
    snap_df = spark.createDataFrame(
        [(a["id"], a["employee_id"], a["date"], a["status"]) for a in snapshot],
        "id long, employee_id long, appointment_date date, status string")
    batch_df = spark.createDataFrame(
        [(r["request_seq"], r["op"], r["id"], r["employee_id"], r["appointment_date"],
          r["status"], "1", "1") for r in batch],
        "request_seq long, op string, id long, employee_id string, appointment_date string, "
        "status string, customer_id string, service_id string")
    batch_df = batch_df.withColumn("actor_id", F.lit(1).cast("long")) \
        .withColumn("now", F.lit(None).cast("timestamp")).withColumn("price", F.lit(None).cast("string"))
    dec, snap = apply_appointment_batch(snap_df, batch_df)
    got = {r.request_seq: r.decision for r in dec.collect()}
    table = {a["id"]: dict(a) for a in snapshot}
    want = _replay(snapshot, batch, table)
    bad = {k: (got.get(k), v) for k, v in want.items() if got.get(k) != v}
    assert not bad, list(bad.items())[:10]
    final = {r.id: (r.employee_id, r.appointment_date, r.status)
             for r in snap.where("id < 40").collect()}
    assert final == {i: (a["employee_id"], a["date"], a["status"])
                     for i, a in table.items() if i >= 0}
    assert snap.where("id >= 40").count() == sum(1 for v in got.values() if v == "accepted") \
        - sum(1 for r in batch if r["op"] != "insert" and got[r["request_seq"]] == "accepted")


def _moves(n, blocked):
    """Appointment k holds slot k and moves to slot k - 1, one after the other;
    slot 0 is taken by another appointment if ``blocked``."""
    day = dt.date(2024, 1, 1)
    snapshot = [(k, k + 1, day, "scheduled") for k in range(1, n + 1)]
    snapshot += [(n + 1, 1, day, "confirmed")] if blocked else []
    batch = [(k, "update", k, str(k), None, None) for k in range(1, n + 1)]
    return snapshot, batch


def _frames(spark, snapshot, batch):
    snap = spark.createDataFrame(snapshot, "id long, employee_id long, appointment_date date, status string")
    req = spark.createDataFrame(batch, "request_seq long, op string, id long, employee_id string, appointment_date string, status string")
    for c in ("customer_id", "service_id", "price", "notes"):
        req = req.withColumn(c, F.lit(None).cast("string"))
    return snap, req


def test_chain_of_2000_moves_needs_no_round_for_each(spark, monkeypatch):
    from salonlake.operators import booking
    rounds = []
    real = booking._decide
    monkeypatch.setattr(booking, "_decide", lambda *a: rounds.append(1) or real(*a))
    for blocked, want in ((True, "conflict"), (False, "accepted")):
        rounds.clear()
        got = booking.decide_batch(*_frames(spark, *_moves(2000, blocked))).collect()
        assert len(got) == 2000 and {r.decision for r in got} == {want}
        assert len(rounds) <= 2


def test_components_settle_in_bulk_or_by_replay_alike(spark, monkeypatch):
    """The same batch with all components replayed, and with none."""
    from salonlake.operators import booking
    rnd = random.Random(11)
    day = dt.date(2024, 1, 1)
    snapshot = [(i, rnd.randrange(1, 7), day + dt.timedelta(days=rnd.randrange(2)), "scheduled") for i in range(30)]
    batch = []
    for seq in range(1, 120):
        op = rnd.choices(["insert", "update", "cancel"], [2, 6, 1])[0]
        emp = str(rnd.randrange(1, 7)) if op == "insert" or rnd.random() < 0.7 else None
        to = (day + dt.timedelta(days=rnd.randrange(2))).isoformat() if op == "insert" or rnd.random() < 0.5 else None
        batch.append((seq, op, None if op == "insert" else rnd.randrange(30), emp, to, None))
    snap, req = _frames(spark, snapshot, batch)
    req = req.withColumns({"customer_id": F.lit("1"), "service_id": F.lit("1")})
    table = {i: {"id": i, "employee_id": e, "date": d, "status": s} for i, e, d, s in snapshot}
    names = ("request_seq", "op", "id", "employee_id", "appointment_date", "status")
    want = _replay(snapshot, [dict(zip(names, r)) for r in batch], table)
    for most, reach in ((50_000, 64), (0, 64), (50_000, 1)):
        monkeypatch.setattr(booking, "REPLAY", most)
        monkeypatch.setattr(booking, "_REACH", reach)
        assert {r.request_seq: r.decision for r in booking.decide_batch(snap, req).collect()} == want


def test_contention_of_a_large_batch_settles_without_components(spark, monkeypatch):
    """Moves that hang on each other a few deep: two rounds do not settle them,
    some more do, and the components of the whole batch are not sought."""
    from salonlake.operators import booking
    monkeypatch.setattr(booking, "REPLAY", 20)
    monkeypatch.setattr(booking, "_components", lambda r: pytest.fail("components of the whole batch"))
    day = dt.date(2024, 1, 1)
    snapshot, batch = [], []
    for g in range(20):  # appointment k of a group moves to the slot of k - 1; the first slot is taken
        snapshot += [(10 * g + k, 10 * g + k + 1, day, "scheduled") for k in range(1, 5)] + [(10 * g + 5, 10 * g + 1, day, "confirmed")]
        batch += [(10 * g + k, "update", 10 * g + k, str(10 * g + k), None, None) for k in range(1, 5)]
    got = booking.decide_batch(*_frames(spark, snapshot, batch)).collect()
    assert len(got) == 80 and {r.decision for r in got} == {"conflict"}


def test_a_request_that_comes_twice_is_not_multiplied(spark):
    from salonlake.operators import booking
    snapshot, batch = _moves(3, False)
    got = booking.decide_batch(*_frames(spark, snapshot, batch + batch[:1])).collect()
    assert sorted(r.request_seq for r in got) == [1, 1, 2, 3]


def test_components_of_a_path_and_a_star(spark):
    from salonlake.operators.components import components
    edges = [(f"p{i}", f"p{i + 1}") for i in range(300)] + [("hub", f"x{i}") for i in range(200)] + [("z", "z")]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {got[f"p{i}"] for i in range(301)} == {"p0"} and {got[f"x{i}"] for i in range(200)} == {"hub"}
    assert got["hub"] == "hub" and got["z"] == "z"
