"""Quirks and rules on small hand-made frames (FIXTURES.md edge rows)."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from salonlake.functions import validation as V
from salonlake.functions.expressions import sanitize, stock_status3, stock_status4
from salonlake.operators import filters, rollups, writes
from salonlake.params import Period


def _errors(spark, rules, rows, cols):
    df = spark.createDataFrame(rows, ",".join(f"{c} string" for c in cols))
    out = V.validate(df, rules).select(F.array_join("errors", ",").alias("e")).collect()
    return [r.e for r in out]


def test_number_rule(spark):
    vals = ["5", " 5 ", "1e3", "5d", "NaN", "Infinity", "", None, "0"]
    got = _errors(spark, {"x": V.Rule(type="number")}, [(v,) for v in vals], ["x"])
    assert got == ["", "", "", "x:number", "x:number", "", "", "", ""]


def test_required_stops_other_rules(spark):
    got = _errors(spark, {"x": V.Rule(required=True, type="number", min=1)},
                  [("",), (None,), ("0",), ("abc",)], ["x"])
    assert got == ["x:required", "x:required", "x:min", "x:number"]


def test_date_rule(spark):
    vals = ["2024-02-29", "2024-02-30", "2024-13-01", "2024-1-1", "2024-01-01T10:00", "", None]
    got = _errors(spark, {"d": V.Rule(type="date")}, [(v,) for v in vals], ["d"])
    assert got == ["", "d:date", "d:date", "d:date", "d:date", "", ""]


def test_email_rule(spark):
    vals = ["a@b.co", "a@b", "a b@c.co", "@b.co", "a@@b.co"]
    got = _errors(spark, {"e": V.Rule(type="email")}, [(v,) for v in vals], ["e"])
    assert got == ["", "e:email", "e:email", "e:email", "e:email"]


def test_length_rule(spark):
    vals = ["a", "ab", "a" * 100, "a" * 101, "سل"]
    got = _errors(spark, {"n": V.Rule(min_length=2, max_length=100)}, [(v,) for v in vals], ["n"])
    assert got == ["n:min_length", "", "", "n:max_length", ""]


def test_enum_and_range(spark):
    rules = {"s": V.Rule(enum=("a", "b")), "p": V.Rule(type="number", min=5, max=480)}
    got = _errors(spark, rules, [("a", "5"), ("A", "4"), ("c", "481"), (None, "480")], ["s", "p"])
    assert got == ["", "s:enum,p:min", "s:enum,p:max", ""]


def test_markup_escaping_recurses(spark):
    df = spark.createDataFrame(
        [("<b a=\"x\">'/&", ("<i>", 3), 7), (None, None, None)],
        "t string, s struct<u:string,n:int>, k int")
    r = sanitize(df).collect()
    assert r[0].t == "&lt;b a=&quot;x&quot;&gt;&#39;&#x2F;&"
    assert r[0].s.u == "&lt;i&gt;" and r[0].s.n == 3 and r[0].k == 7
    assert r[1].t is None and r[1].s is None


def test_search_folds_ascii_only(spark):
    df = spark.createDataFrame(
        [(1, "Émile", None, None, 1, None), (2, "émile", None, None, 1, None),
         (3, "ANNA", None, None, 1, None), (4, "anna", None, None, 0, None),
         (5, "50% off", None, None, 1, None), (6, "a_b", None, None, 1, None)],
        "id long, full_name string, phone string, email string, is_active int, created_at timestamp")
    ids = lambda q: sorted(r.id for r in filters.search_customers(df, q).collect())
    assert ids("émile") == [2]
    assert ids("anna") == [3]
    assert ids("0%") == [5]
    assert ids("a_b") == [6]


def test_stock_bands(spark):
    df = spark.createDataFrame([(0, 10), (10, 10), (20, 10), (21, 10), (0, 0), (5, None)],
                               "q int, m int")
    r = df.select(stock_status3(F.col("q"), F.col("m")).alias("a"),
                  stock_status4(F.col("q"), F.col("m")).alias("b")).collect()
    assert [x.a for x in r] == ["low", "low", "warning", "ok", "low", "ok"]
    assert [x.b for x in r] == ["نفذ", "منخفض", "تحذير", "جيد", "نفذ", "جيد"]


def _appts(spark, rows):
    return spark.createDataFrame(
        rows, "id long, customer_id long, service_id long, employee_id long, "
              "appointment_date date, status string, price decimal(18,2)")


def test_rollup_null_rules(spark):
    d = dt.date(2024, 1, 5)
    services = spark.createDataFrame(
        [(1, "none", None, Decimal("1.00"), 1), (2, "nullprice", None, Decimal("1.00"), 1),
         (3, "cancelled", None, Decimal("1.00"), 1), (4, "inactive", None, Decimal("1.00"), 0)],
        "id long, name string, category string, price decimal(18,2), is_active int")
    appts = _appts(spark, [(10, 1, 2, 7, d, "completed", None),
                           (11, 1, 3, 7, d, "cancelled", Decimal("9.00")),
                           (12, 1, 4, 7, d, "completed", Decimal("5.00"))])
    t = {"services": services, "appointments": appts}
    r = {x.id: x for x in rollups.report_services(t, Period(d, d)).collect()}
    assert set(r) == {1, 2, 3}
    assert r[1].total_revenue == 0 and r[1].avg_price is None and r[1].appointment_count == 0
    assert r[2].total_revenue is None and r[2].completed == 1
    assert r[3].total_revenue == 0 and r[3].cancelled == 1


def test_booking_in_batch_rules(spark):
    d = "2024-01-05"
    appts = _appts(spark, [(0, 1, 1, 9, dt.date(2024, 1, 5), "scheduled", None),
                           (5, 1, 1, 8, dt.date(2024, 1, 5), "confirmed", None)])
    req = spark.createDataFrame([
        # key 1: (open, open) -> second refused
        (1, 1, "1", "1", "1", d, None), (2, 1, "1", "1", "1", d, "confirmed"),
        # key 2: (completed, open) -> both accepted; then (open after open) refused
        (3, 1, "1", "1", "2", d, "completed"), (4, 1, "1", "1", "2", d, None),
        (5, 1, "1", "1", "2", d, "completed"),
        # existing open row for employee 8; employee 9's only open row has id 0 (ignored)
        (6, 1, "1", "1", "8", d, None), (7, 1, "1", "1", "9", d, None),
        # no employee: exempt
        (8, 1, "1", "1", None, d, None), (9, 1, "1", "1", None, d, None),
        # invalid
        (10, 1, "x", "1", "3", d, None)],
        "request_seq long, actor_id long, customer_id string, service_id string, "
        "employee_id string, appointment_date string, status string")
    out = {r.request_seq: r.decision for r in
           writes.booking_accept(appts, req, V.APPOINTMENT_CREATE).collect()}
    assert out == {1: "accepted", 2: "conflict", 3: "accepted", 4: "accepted", 5: "conflict",
                   6: "conflict", 7: "accepted", 8: "accepted", 9: "accepted", 10: "invalid"}


def test_auto_posting(spark):
    d = dt.date(2024, 1, 5)
    appts = _appts(spark, [(i, 1, 1, 1, d, "scheduled", None) for i in (1, 2, 3, 4, 5, 6)])
    ledger = spark.createDataFrame([(100, 4)], "id long, appointment_id long")
    upd = spark.createDataFrame([
        (1, 7, 1, "completed", "12.5"),     # posts
        (2, 7, 2, "completed", None),       # no price: nothing
        (3, 7, 3, "completed", ""),         # empty price: nothing
        (4, 7, 4, "completed", "3"),        # already posted
        (5, 7, 5, "completed", "1"),        # two updates: first posts
        (6, 8, 5, "completed", "2"),
        (7, 7, 99, "completed", "2"),       # unknown appointment
        (8, 7, 6, "completed", "0")],       # zero price counts as absent
        "request_seq long, actor_id long, id long, status string, price string")
    rows = writes.post_completed(appts, ledger, upd, V.APPOINTMENT_UPDATE, d).collect()
    got = sorted((r.appointment_id, float(r.amount), r.id) for r in rows)
    assert got == [(1, 12.5, 101), (5, 1.0, 102)]


def test_partial_update(spark):
    cust = spark.createDataFrame(
        [(1, "Ann", "0500000001", None, 1), (2, "Bob", None, None, 1), (3, "Cy", None, None, 0)],
        "id long, full_name string, phone string, email string, is_active int")
    now = dt.datetime(2024, 1, 1)
    ch = spark.createDataFrame([
        (1, 5, now, 1, None, "0599999999", None, None),
        (2, 6, now, 1, "Anna", None, None, None),
        (3, 5, now, 3, "Cyd", None, None, None),       # inactive: ignored
        (4, 5, now, 9, "Nobody", None, None, None)],   # unknown id: ignored
        "request_seq long, actor_id long, now timestamp, id long, full_name string, "
        "phone string, email string, notes string")
    ch = ch.drop("notes")
    out = {r.id: r for r in writes.apply_updates(cust, ch, ["full_name", "phone", "email"],
                                                 require_active=True).collect()}
    assert (out[1].full_name, out[1].phone, out[1].updated_by, out[1].n_updates) == \
        ("Anna", "0599999999", 6, 2)
    assert out[2].full_name == "Bob" and out[2].n_updates == 0
    assert out[3].full_name == "Cy"
    assert 9 not in out


def test_search_escapes_markup_and_caps_page(spark):
    rows = [(1, "O'Neil", None, None, 1, None), (2, "O&#39;Brien", None, None, 1, None)]
    rows += [(10 + i, f"Name {i}", None, None, 1, None) for i in range(150)]
    df = spark.createDataFrame(
        rows, "id long, full_name string, phone string, email string, is_active int, "
              "created_at timestamp")
    # The term is escaped like stored text, so a quote matches its escaped form.
    assert [r.id for r in filters.search_customers(df, "o'").collect()] == [2]
    assert filters.search_customers(df, "name", limit=500).count() == 100
    assert filters.customer_page(df, limit=500, offset=0).count() == 100


def test_by_ids_never_duplicates(spark):
    t = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    ids = spark.createDataFrame([(1,), (1,), (3,), (None,)], "x long")
    assert sorted(r.id for r in filters.by_ids(t, ids).collect()) == [1, 3]


def test_day_rows_answer_any_period(spark, tmp_path):
    from salonlake.operators import daily, rollups
    from salonlake.params import PERIOD, Period
    from salonlake.sources.fixtures import load_tables
    from tests.conftest import SF_SMALL
    t = load_tables(spark, SF_SMALL)
    path = str(tmp_path / "days")
    daily.store_days(t["appointments"], "service_id", path)
    stored = daily.load_days(spark, "service_id", path)
    rough = daily.report_services(t["services"], stored, PERIOD).collect()
    exact = {r.id: r for r in rollups.report_services(t, PERIOD).collect()}
    assert len(rough) == len(exact) > 0
    for r in rough:
        e = exact[r.id]
        for c in r.asDict():
            if c in ("unique_customers", "employees_provided"):
                assert abs(r[c] - e[c]) <= 0.03 * e[c]
            elif isinstance(r[c], float):
                assert abs(r[c] - e[c]) < 1e-6
            else:
                assert r[c] == e[c]
    # Late bookings: the days' rows are replaced, others stay.
    day = t["appointments"].agg({"appointment_date": "min"}).first()[0]
    some = t["appointments"].where(t["appointments"].appointment_date != day)
    daily.store_days(some, "service_id", path, Period(day, day))
    left = daily.load_days(spark, "service_id", path)
    assert left.where(left.appointment_date == day).count() == 0
    assert left.count() == stored.sparkSession.read.parquet(path).count() > 0


def test_sketches_are_near_for_many_values(spark):
    from salonlake.operators import daily
    from salonlake.params import Period
    import datetime as dt
    from pyspark.sql import functions as F
    rows = spark.range(200_000).select(
        "id", F.lit(1).cast("long").alias("service_id"), (F.col("id") % 60_000).alias("customer_id"), (F.col("id") % 7).alias("employee_id"),
        F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") % 20).cast("int")).alias("appointment_date"),
        F.lit("completed").alias("status"), F.lit(1).cast("decimal(18,2)").alias("price"))
    days = daily.day_rows(rows, "service_id")
    got = daily.period_rows(days, "service_id", Period(dt.date(2024, 1, 1), dt.date(2024, 1, 31))).first()
    assert abs(got.n_customer_id - 60_000) <= 0.03 * 60_000 and got.n_employee_id == 7 and got.visits == 200_000


def test_infinities_meet_the_bounds(spark):
    rows = spark.createDataFrame([("-Infinity",), (" Infinity",), ("+Infinity",), ("5",), ("x",)], "duration_minutes string")
    rules = {"duration_minutes": V.SERVICE_UPDATE["duration_minutes"]}
    got = {r.duration_minutes: r.errors for r in V.validate(rows, rules).collect()}
    assert got == {"-Infinity": ["duration_minutes:min"], " Infinity": ["duration_minutes:max"],
                   "+Infinity": ["duration_minutes:max"], "5": [], "x": ["duration_minutes:number"]}
