"""Double-booking decisions for a mixed batch of appointment requests
(insert / update / cancel), exactly as replaying them one by one.

Rules of the source, per request in ``request_seq`` order:
* insert: refused when the employee (if any) already has an open
  appointment that day; existing rows with id 0 never count.
* update: checked only when a date or a non-zero employee is sent; the slot
  is (sent-or-current employee, sent-or-current date) and it is refused when
  another appointment is open in that slot at that moment. Fields are then
  set with COALESCE semantics (absent keeps the current value).
* cancel: sets the status to cancelled, never refused.
Unknown ids are 'not_found'.

A decision depends on the state of the table at that moment, i.e. on the
decisions of earlier requests. For a given set of decisions every request's
decision can be computed in bulk:
  1. each appointment's state before/after each request is a per-appointment
     "last sent value" scan (skew-safe ``operators.sequence`` scans);
  2. every accepted change is a -1 event on its previous slot (if open) and a
     +1 event on its new slot (if open); the snapshot's open appointments enter
     as one count per slot that the batch can reach; the occupancy a request
     meets is the running sum of its slot's events before it (again a skew-safe
     scan per slot, so a hot slot is split across tasks), minus itself.
Decision i depends only on decisions j < i, so a round that changes nothing has
found the sequential result. Rounds work on a shrinking frontier:
  * requests fall into components that share no appointment and no slot that
    one of their appointments could ever be in; a component in which a round
    changed nothing is settled and leaves the working set;
  * a batch of more than ``REPLAY`` requests goes through up to ``ROUNDS`` rounds
    whole, which settle ordinary contention; most batches end here;
  * after those (a smaller batch: after the second), components of at most ``REPLAY`` requests that are
    not settled (long chains in which each outcome hangs on the one before) are
    replayed one by one, each in one task, at a cost in proportion to their
    rows; a larger one, such as a hot slot, goes on in bulk rounds, which settle
    contention for a slot at once. Only a chain of more than ``REPLAY`` dependent
    outcomes in one component takes a round for each of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salonlake.functions.expressions import OPEN_STATUSES, blank, parse_date, parse_number
from salonlake.functions.validation import APPOINTMENT_CREATE, APPOINTMENT_UPDATE, validate
from salonlake.operators.components import components
from salonlake.operators.sequence import scan, sliced
from salonlake.session import ensure_checkpoint_dir

#: Requests of a component that one task replays.
REPLAY = 50_000
#: Bulk rounds of a batch of more than ``REPLAY`` requests before its components
#: are sought.
ROUNDS = 10
#: Slots an appointment may reach before its employees stand for them.
_REACH = 64
_NEVER = -(2 ** 62)  # event time of the snapshot: before every request


def _is_open(status: Column) -> Column:
    return status.isin(*OPEN_STATUSES)


def _normalise_op(batch: DataFrame) -> DataFrame:
    """op in insert / update / cancel (DELETE of an appointment cancels it)."""
    op = F.lower(F.col("op"))
    return batch.withColumn("op", F.when(op.isin("delete", "cancel"), F.lit("cancel"))
                            .when(op.isin("insert", "create", "post"), F.lit("insert"))
                            .otherwise(F.lit("update")))


def _prepare(appointments: DataFrame, batch: DataFrame) -> DataFrame:
    """Typed, validated requests with the snapshot state of their appointment."""
    batch = _normalise_op(batch)
    op = F.col("op")
    ins = validate(batch.where(op == "insert"), APPOINTMENT_CREATE)
    upd = validate(batch.where(op != "insert"), APPOINTMENT_UPDATE)
    cols = ["request_seq", "op", "id", "employee_id", "appointment_date", "status", "is_valid"]
    r = ins.select(*cols).unionByName(upd.select(*cols))
    # A cancellation has no fields of its own; what comes with it is ignored.
    moves = F.lower(F.col("op")) != "cancel"
    emp_sent = moves & ~blank(F.col("employee_id"))
    emp = parse_number(F.col("employee_id")).cast("bigint")
    r = r.select(
        "request_seq", F.lower(F.col("op")).alias("op"),
        F.when(F.lower(F.col("op")) == "insert", F.lit(None).cast("bigint"))
         .otherwise(F.col("id").cast("bigint")).alias("id"),
        "is_valid",
        emp_sent.alias("emp_sent"), F.when(emp_sent, emp).alias("emp_req"),
        F.when(moves & ~blank(F.col("appointment_date")), parse_date(F.col("appointment_date")))
         .alias("date_req"),
        F.when(F.lower(F.col("op")) == "cancel", F.lit("cancelled"))
         .when(~blank(F.col("status")), F.col("status"))
         .when(F.lower(F.col("op")) == "insert", F.lit("scheduled")).alias("status_req"))
    # Only the appointments the batch names: a semi join first, so the
    # (large) snapshot is filtered where it is read instead of shuffled whole
    # into the left join (AQE broadcasts the id list when it is small).
    ids = r.where(F.col("id").isNotNull()).select("id").distinct()
    snap = appointments.join(ids, "id", "left_semi").select(
        F.col("id").alias("_sid"), F.col("employee_id").alias("emp0"),
        F.col("appointment_date").alias("date0"), F.col("status").alias("status0"))
    r = r.join(snap, r["id"] == snap["_sid"], "left")
    found = (F.col("op") == "insert") | F.col("_sid").isNotNull()
    # Inserts act on a new appointment keyed by -request_seq; its "snapshot"
    # state is empty.
    return r.select(
        "*", found.alias("found"),
        F.coalesce(F.col("id"), -F.col("request_seq")).alias("akey")).drop("_sid")


def _states(s: DataFrame) -> DataFrame:
    """Given ``acc`` (accepted) on the sliced requests, the state of each
    request's appointment before it (``*_b``) and after it (``*_a``): per
    field, the last value sent by an accepted earlier request (one scan for
    the three fields), else the snapshot value."""
    fields = (("emp", "emp_req", "emp0"), ("date", "date_req", "date0"),
              ("status", "status_req", "status0"))
    sent = {"emp": F.col("emp_sent"), "date": F.col("date_req").isNotNull(),
            "status": F.col("status_req").isNotNull()}
    for f, req, _ in fields:
        s = s.withColumn("_v_" + f, F.when(F.col("acc") & sent[f], F.struct(
            F.col("request_seq").alias("q"), F.col(req).alias("v"))))
    s = scan(s, ["akey"], ["request_seq"], [f"_v_{f}" for f, _, _ in fields],
             [f"_l_{f}" for f, _, _ in fields], "max", inclusive=False)
    for f, req, base in fields:
        s = s.withColumn(f + "_b", F.when(F.col("_l_" + f).isNotNull(), F.col(f"_l_{f}.v"))
                         .otherwise(F.col(base)))
        s = s.withColumn(f + "_a", F.when(F.col("acc") & sent[f], F.col(req))
                         .otherwise(F.col(f + "_b")))
    return s.drop(*[f"_v_{f}" for f, _, _ in fields], *[f"_l_{f}" for f, _, _ in fields])


def _decide(s: DataFrame, open_snap: DataFrame) -> DataFrame:
    """One bulk round: decisions from the states implied by ``acc``."""
    st = _states(s)
    ins = F.col("op") == "insert"
    upd = F.col("op") == "update"
    # Slot the request is checked against (NULL = not checked).
    emp_t = F.when(ins, F.col("emp_req")).otherwise(
        F.when(F.col("emp_sent"), F.col("emp_req")).otherwise(F.col("emp_b")))
    date_t = F.when(ins, F.col("date_req")).otherwise(F.coalesce(F.col("date_req"),
                                                                 F.col("date_b")))
    checked = (F.col("is_valid") & F.col("found")
               & ((ins & F.coalesce(F.col("emp_req") != 0, F.lit(False)))
                  | (upd & (F.col("date_req").isNotNull()
                            | (F.col("emp_sent") & F.coalesce(F.col("emp_req") != 0,
                                                              F.lit(False)))))))
    checked = checked & emp_t.isNotNull() & (emp_t != 0) & date_t.isNotNull()
    st = st.withColumn("emp_t", F.when(checked, emp_t)).withColumn("date_t", F.when(checked, date_t))
    held = (F.col("emp_b") == F.col("emp_t")) & (F.col("date_b") == F.col("date_t")) & _is_open(F.col("status_b"))
    st = st.select(
        "request_seq", "akey", "acc", "is_valid", "found", "emp_t", "date_t", "emp_b", "date_b", "emp_a", "date_a",
        _is_open(F.col("status_b")).alias("open_b"), _is_open(F.col("status_a")).alias("open_a"),
        ins.alias("ins"), F.when(held, 1).otherwise(0).cast("bigint").alias("own"))
    st = st.checkpoint(eager=True)

    q = st.where(F.col("emp_t").isNotNull())
    targets = q.select(F.col("emp_t").alias("e"), F.col("date_t").alias("d")).distinct()
    # Events: +1/-1 when an accepted request moves its appointment in/out of
    # an open slot; the snapshot's open rows enter before every request.
    a = st.where(F.col("acc"))
    leave = a.where(F.col("open_b") & F.col("emp_b").isNotNull()).select(
        F.col("emp_b").alias("e"), F.col("date_b").alias("d"), "request_seq",
        F.lit(-1).alias("w"), F.col("akey").alias("tie"))
    enter = a.where(F.col("open_a") & F.col("emp_a").isNotNull()).select(
        F.col("emp_a").alias("e"), F.col("date_a").alias("d"), "request_seq",
        F.lit(1).alias("w"), F.col("akey").alias("tie"))
    # A request meets the events of strictly earlier requests: at equal
    # request_seq its query (kind 0) sorts before its own events (kind 1).
    # Appointment 0 does not block inserts (the source excludes id 0 there),
    # hence the second weight.
    moved = leave.unionByName(enter).select(
        "e", "d", "request_seq", "tie", F.col("w").cast("bigint").alias("w"),
        F.when(F.col("tie") == 0, F.lit(0)).otherwise(F.col("w")).cast("bigint").alias("w0"))
    snap = open_snap.select("e", "d", F.lit(_NEVER).alias("request_seq"), F.lit(0).cast("bigint").alias("tie"), "w", "w0")
    ev = moved.unionByName(snap).join(targets, ["e", "d"], "left_semi").select(
        "e", "d", "request_seq", F.lit(1).alias("kind"), "tie", "w", "w0", F.lit(False).alias("ins"),
        F.lit(0).cast("bigint").alias("own"))
    qs = q.select(F.col("emp_t").alias("e"), F.col("date_t").alias("d"), "request_seq",
                  F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("tie"),
                  F.lit(0).cast("bigint").alias("w"), F.lit(0).cast("bigint").alias("w0"), "ins", "own")
    order = ["request_seq", "kind", "tie"]
    u = sliced(ev.unionByName(qs), ["e", "d"], [F.col(c) for c in order])
    u = scan(u, ["e", "d"], order, ["w", "w0"], ["occ", "occ0"])
    # A request's row of the scan brings all that its decision needs: the wide
    # requests are not joined with it.
    others = F.when(F.col("ins"), F.coalesce(F.col("occ0"), F.lit(0))).otherwise(F.coalesce(F.col("occ"), F.lit(0)) - F.col("own"))
    met = u.where(F.col("kind") == 0).select(
        "request_seq", F.when(others > 0, F.lit("conflict")).otherwise(F.lit("accepted")).alias("decision"))
    free = st.where(F.col("emp_t").isNull()).select(
        "request_seq", F.when(~F.col("is_valid"), F.lit("invalid")).when(~F.col("found"), F.lit("not_found"))
        .otherwise(F.lit("accepted")).alias("decision"))
    return free.unionByName(met)


def decide_batch(appointments: DataFrame, batch: DataFrame) -> DataFrame:
    """Decision per request: accepted / conflict / invalid / not_found.

    ``batch``: request_seq, op (insert|update|cancel), id (updates, cancels),
    employee_id, appointment_date, status (+ any other appointment fields),
    all as text like a JSON body."""
    ensure_checkpoint_dir(batch.sparkSession)
    r = sliced(_prepare(appointments, batch), ["akey"], [F.col("request_seq")])
    open_snap = _open_counts(appointments, r)
    acts = F.col("is_valid") & F.col("found")
    first = _round(r, r.groupBy("request_seq").agg(F.min(acts).alias("acc")), open_snap)
    now = _round(r, _accepted(first), open_snap)
    done = _undecided(first, now)
    # Contention for slots settles in a few rounds of the whole batch, each far
    # cheaper than the components of a large one.
    rounds, left = 2, not done.isEmpty()
    if left and r.where(acts).count() > REPLAY:
        while left and rounds < ROUNDS:
            before, now = now, _round(r, _accepted(now), open_snap)
            done = _undecided(before, now)
            rounds, left = rounds + 1, not done.isEmpty()
    if not left:
        return _told(r, now)

    # The rest, by components: settled ones, short ones, long ones.
    part = _components(r.where(acts)).checkpoint(eager=True)
    hurt = part.join(done, "request_seq", "left_semi").select("component").distinct()
    size = part.join(hurt, "component", "left_semi").groupBy("component").agg(F.count(F.lit(1)).alias("n")).checkpoint(eager=True)
    small = part.join(size.where(F.col("n") <= REPLAY), "component", "left_semi")
    large = part.join(size.where(F.col("n") > REPLAY), "component", "left_semi").checkpoint(eager=True)
    replayed = _replayed(r.join(small.select("request_seq", "component"), "request_seq"), small, open_snap)
    settled = [replayed]
    while not large.isEmpty():
        work = r.join(large.select("request_seq"), "request_seq", "left_semi")
        new = _round(work, _accepted(now), open_snap)
        hurt = large.join(_undecided(now, new), "request_seq", "left_semi").select("component").distinct()
        hurt = hurt.checkpoint(eager=True)
        settled.append(new.join(large.join(hurt, "component", "left_anti").select("request_seq"), "request_seq", "left_semi"))
        large = large.join(hurt, "component", "left_semi").checkpoint(eager=True)
        now = now.join(new.select("request_seq"), "request_seq", "left_anti").unionByName(new).checkpoint(eager=True)
    for d in settled:
        d = d.checkpoint(eager=True)
        now = now.join(d.select("request_seq"), "request_seq", "left_anti").unionByName(d)
    return _told(r, now)


def _told(r: DataFrame, decisions: DataFrame) -> DataFrame:
    one = decisions.groupBy("request_seq").agg(F.max("decision").alias("decision"))
    return r.join(one, "request_seq").select("request_seq", "op", "id", "decision")


def _accepted(decisions: DataFrame) -> DataFrame:
    """One row for a ``request_seq``, also if its rows come more than once."""
    return decisions.groupBy("request_seq").agg(F.min(F.col("decision") == "accepted").alias("acc"))


def _undecided(before: DataFrame, now: DataFrame) -> DataFrame:
    """Requests that a round decided otherwise than the round before."""
    old = before.select("request_seq", F.col("decision").alias("_old"))
    return now.join(old, "request_seq").where(F.col("decision") != F.col("_old")).select("request_seq")


def _round(r: DataFrame, acc: DataFrame, open_snap: DataFrame) -> DataFrame:
    return _decide(r.join(acc, "request_seq", "left"), open_snap).checkpoint(eager=True)


def _reach(r: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct (akey, e) and (akey, d): employees and days that an appointment
    of the batch has or is sent."""
    e = r.select("akey", F.explode(F.array("emp0", "emp_req")).alias("e")).where(F.coalesce(F.col("e") != 0, F.lit(False)))
    d = r.select("akey", F.explode(F.array("date0", "date_req")).alias("d")).where("d is not null")
    return e.distinct(), d.distinct()


def _open_counts(appointments: DataFrame, r: DataFrame) -> DataFrame:
    """Open appointments per slot (``w``; ``w0`` without id 0) of the employees
    and days that the batch can reach: the table is cut by them where it is read."""
    e, d = _reach(r)
    held = appointments.where(_is_open(F.col("status"))).select(
        F.col("employee_id").alias("e"), F.col("appointment_date").alias("d"), "id")
    held = held.join(e.select("e").distinct(), "e", "left_semi").join(d.select("d").distinct(), "d", "left_semi")
    return held.groupBy("e", "d").agg(F.count(F.lit(1)).alias("w"), F.count(F.when(F.col("id") != 0, 1)).alias("w0")).checkpoint(eager=True)


def _slot(e: str = "e", d: str = "d") -> Column:
    return F.concat(F.lit("s:"), F.col(e).cast("string"), F.lit(":"), F.col(d).cast("string"))


def _person(e: str = "e") -> Column:
    return F.concat(F.lit("e:"), F.col(e).cast("string"))


def _components(r: DataFrame) -> DataFrame:
    """(request_seq, akey, component): requests that could ever meet share a
    component. An appointment with few reachable slots is tied to those slots,
    one with many to its employees, and their slots to them."""
    e, d = _reach(r)
    wide = e.groupBy("akey").agg(F.count(F.lit(1)).alias("_e")).join(d.groupBy("akey").agg(F.count(F.lit(1)).alias("_d")), "akey")
    wide = wide.where(F.col("_e") * F.col("_d") > _REACH).select("akey").checkpoint(eager=True)
    near = e.join(wide, "akey", "left_anti").join(d, "akey").select("akey", "e", "d").checkpoint(eager=True)
    node = F.concat(F.lit("a:"), F.col("akey").cast("string"))
    edges = near.select(node.alias("a"), _slot().alias("b"))
    far = e.join(wide, "akey", "left_semi").checkpoint(eager=True)
    edges = edges.unionByName(far.select(node.alias("a"), _person().alias("b")))
    edges = edges.unionByName(near.select("e", "d").distinct().join(far.select("e").distinct(), "e", "left_semi").select(
        _person().alias("a"), _slot().alias("b")))
    found = components(edges)
    alone = r.select("request_seq", "akey", node.alias("node")).join(found, "node", "left")
    return alone.select("request_seq", "akey", F.coalesce("component", "node").alias("component"))


def _replayed(r: DataFrame, part: DataFrame, open_snap: DataFrame) -> DataFrame:
    """Decisions of components of at most ``REPLAY`` requests, one task each:
    the requests in order over their appointments and over what others hold of
    the slots that these can reach."""
    r = r.checkpoint(eager=True)
    e, d = _reach(r)
    comp = part.select("akey", "component").distinct()
    # What the batch's own appointments hold is theirs to move: not counted here.
    mine = r.where(_is_open(F.col("status0")) & (F.col("op") != "insert")).select(
        "akey", F.col("emp0").alias("e"), F.col("date0").alias("d")).distinct().groupBy("e", "d").agg(
        (-F.count(F.lit(1))).alias("w"), (-F.count(F.when(F.col("akey") != 0, 1))).alias("w0"))
    rest = open_snap.unionByName(mine).groupBy("e", "d").agg(F.sum("w").alias("w"), F.sum("w0").alias("w0")).where("w > 0")
    # Slots go to the components whose employees and days they have: a superset
    # of what these can reach, at most what is stored for them.
    ec = e.join(comp, "akey").select("component", "e").distinct()
    dc = d.join(comp, "akey").select(F.col("component").alias("_c"), F.col("d").alias("_d")).distinct()
    held = rest.join(ec, "e").join(dc, (F.col("component") == F.col("_c")) & (F.col("d") == F.col("_d"))).select(
        "component", "e", "d", "w", "w0")
    asked = r.select("component", "request_seq", "op", "akey", "emp_sent", "emp_req", "date_req", "status_req", "emp0", "date0", "status0")
    open_statuses = tuple(OPEN_STATUSES)

    def replay(left, right):
        import pyarrow as pa

        others = {(x["e"], x["d"]): (x["w"], x["w0"]) for x in right.to_pylist()}
        rows = sorted(left.to_pylist(), key=lambda x: x["request_seq"])
        state, taken = {}, {}

        def enter(akey, by):
            emp, date, status = state[akey]
            if emp is not None and date is not None and status in open_statuses:
                n, n0 = taken.get((emp, date), (0, 0))
                taken[emp, date] = (n + by, n0 + (by if akey != 0 else 0))

        for x in rows:
            if x["op"] != "insert" and x["akey"] not in state:
                state[x["akey"]] = (x["emp0"], x["date0"], x["status0"])
                enter(x["akey"], 1)
        seqs, told = [], []
        for x in rows:
            key, op = x["akey"], x["op"]
            emp, date, status = state.get(key, (None, None, None))
            to_emp = x["emp_req"] if x["emp_sent"] else emp
            to_date = date if x["date_req"] is None else x["date_req"]
            checked = bool(x["emp_req"]) if op == "insert" else op == "update" and (
                x["date_req"] is not None or (x["emp_sent"] and bool(x["emp_req"])))
            clash = False
            if checked and to_emp and to_date is not None:
                n, n0 = taken.get((to_emp, to_date), (0, 0))
                w, w0 = others.get((to_emp, to_date), (0, 0))
                own = op != "insert" and (emp, date) == (to_emp, to_date) and status in open_statuses
                clash = (n0 + w0 if op == "insert" else n + w - own) > 0
            if not clash:
                if key in state:
                    enter(key, -1)
                state[key] = (to_emp, to_date, status if x["status_req"] is None else x["status_req"])
                enter(key, 1)
            seqs.append(x["request_seq"])
            told.append("conflict" if clash else "accepted")
        return pa.table({"request_seq": pa.array(seqs, pa.int64()), "decision": pa.array(told, pa.string())})

    return asked.groupBy("component").cogroup(held.groupBy("component")).applyInArrow(replay, "request_seq long, decision string")


def apply_appointment_batch(appointments: DataFrame, batch: DataFrame, ledger: DataFrame = None,
                            as_of=None, made_by: bool = False):
    """(decisions, new snapshot[, ledger postings]): accepted updates and
    cancellations are applied with COALESCE semantics in request order,
    accepted inserts get sequential ids after the largest existing id. With
    a ``ledger`` and ``as_of`` (a date or a column of the batch), accepted
    updates that complete an appointment with a price also yield the automatic
    income rows. ``made_by`` adds the request that made a row as ``_made_by``."""
    from salonlake.functions.expressions import parse_money, truthy
    from salonlake.operators.writes import apply_updates, assign_ids, max_id, post_completed

    batch = _normalise_op(batch)
    if "notes" not in batch.columns:
        batch = batch.withColumn("notes", F.lit(None).cast("string"))
    d = decide_batch(appointments, batch).checkpoint(eager=True)
    ok = batch.join(d.where(F.col("decision") == "accepted").select("request_seq"),
                    "request_seq", "left_semi")
    op = F.lower(F.col("op"))
    moves = op != "cancel"
    ch = ok.where(op != "insert").select(
        "request_seq", "actor_id", "now", F.col("id").cast("bigint").alias("id"),
        F.when(op == "cancel", F.lit("cancelled"))
         .when(~blank(F.col("status")), F.col("status")).alias("status"),
        F.when(moves & ~blank(F.col("appointment_date")), parse_date(F.col("appointment_date")))
         .alias("appointment_date"),
        F.when(moves & ~blank(F.col("employee_id")), parse_number(F.col("employee_id")).cast("bigint"))
         .alias("employee_id"),
        F.when(moves, F.col("notes")).alias("notes"),
        F.when(moves & truthy(F.col("price")), parse_money(F.col("price"))).alias("price"))
    cols = [c for c in ("status", "appointment_date", "employee_id", "notes", "price")
            if c in appointments.columns]
    updated = apply_updates(appointments, ch, cols)
    # A cancellation also records who cancelled and when (the last one wins).
    canc = (ok.where(op == "cancel").groupBy(F.col("id").cast("bigint").alias("_cid"))
            .agg(F.max_by("actor_id", "request_seq").alias("_cby"),
                 F.max_by("now", "request_seq").alias("_cat")))
    updated = updated.join(canc, updated["id"] == canc["_cid"], "left")
    for c, v in (("cancelled_by", "_cby"), ("cancelled_at", "_cat")):
        old = F.col(c) if c in appointments.columns else F.lit(None)
        typ = appointments.schema[c].dataType if c in appointments.columns else None
        newv = F.col(v).cast(typ) if typ is not None else F.col(v)
        updated = updated.withColumn(c, F.coalesce(newv, old))
    updated = updated.drop("_cid", "_cby", "_cat")
    new = ok.where(op == "insert").select(
        "request_seq",
        parse_number(F.col("customer_id")).cast("bigint").alias("customer_id"),
        parse_number(F.col("service_id")).cast("bigint").alias("service_id"),
        F.when(truthy(F.col("employee_id")), parse_number(F.col("employee_id")).cast("bigint"))
         .alias("employee_id"),
        parse_date(F.col("appointment_date")).alias("appointment_date"),
        F.coalesce(F.when(~blank(F.col("status")), F.col("status")), F.lit("scheduled"))
         .alias("status"),
        F.when(~blank(F.col("notes")), F.col("notes")).alias("notes"),
        F.when(truthy(F.col("price")), parse_money(F.col("price"))).alias("price"),
        F.col("actor_id").alias("created_by"), F.col("now").alias("created_at"))
    new = assign_ids(new, max_id(appointments)).withColumn("n_updates", F.lit(0))
    new = new.withColumnRenamed("request_seq", "_made_by") if made_by else new.drop("request_seq")
    snapshot = updated.unionByName(new, allowMissingColumns=True)
    if ledger is None:
        return d, snapshot
    posts = post_completed(appointments, ledger, ok.where(op == "update"), APPOINTMENT_UPDATE,
                           as_of)
    return d, snapshot, posts
