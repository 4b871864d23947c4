"""Continuous change application: a stream of change requests is validated
and applied to versioned snapshots, one batch after the other.

Every request of a micro-batch ends in the outcome log ``change_outcomes``,
exactly once: applied (with the id of the row it made, if any) or rejected with
a reason (``operators.outcomes``). A booking batch writes the appointments and
the ledger, since completing an appointment posts its income.

A batch rewrites the buckets of a table that hold rows it touches; all others
are read from where they are.

Replay safety without a transactional table format: micro-batch ``b`` writes its
tables and logs under its own name, ``<entity>-<b>``, and then one marker
(``sources.tables``). Readers see all of the batch or nothing. If the query
restarts and replays a batch whose marker is there, nothing is done; if it failed
half-way, what it left is invisible and is written again. One running query at
a time writes a table; so run bookings and direct ledger requests one after the
other, or in one query.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from salonlake.functions.validation import CUSTOMER_UPDATE, USER_CREATE
from salonlake.operators import entities
from salonlake.operators.booking import apply_appointment_batch
from salonlake.operators.outcomes import (OUTCOMES_SCHEMA, REASONS, appointment_outcomes, decide_changes, judge_appointments,
                                          outcome_rows)
from salonlake.operators.writes import assign_ids, hard_delete, insert_users, soft_delete, update_customers
from salonlake.session import ensure_checkpoint_dir
from salonlake.sources.tables import (batch_done, commit_batch, committed_versions, load, load_log, write_change,
                                      write_log_batch)

OUTCOMES = "change_outcomes"
#: Column that holds a stored row's bucket while a batch is applied.
BUCKET = "_bucket"


@dataclass
class Change:
    """What a batch makes: for each table its new contents and the ids (``id``)
    of the rows that are new, changed or gone; outcomes; log rows."""

    tables: dict[str, tuple[DataFrame, DataFrame]]
    outcomes: DataFrame
    logs: dict[str, DataFrame] = field(default_factory=dict)


def _ids(ok: DataFrame, *new: DataFrame) -> DataFrame:
    """Ids that applied requests name or that ``new`` rows have."""
    out = ok.where("id is not null").select(F.col("id").cast("bigint").alias("id"))
    for rows in new:
        out = out.unionByName(rows.select("id"))
    return out


def _op(batch: DataFrame, *names: str) -> DataFrame:
    return batch.where(F.lower(F.col("op")).isin(*names))


def _decided(current: DataFrame, batch: DataFrame, entity: str) -> tuple[DataFrame, DataFrame]:
    """(all requests with their outcomes, the applied ones). Both branches read
    one written copy."""
    ensure_checkpoint_dir(batch.sparkSession)
    decided = decide_changes(current, batch, entity).checkpoint(eager=True)
    return decided, decided.where("outcome = 'applied'").drop("outcome", "reason", "errors")


def _customers(held: dict[str, DataFrame], batch: DataFrame) -> Change:
    """Creates, partial updates (active customers only) and soft deletes.
    An update after a delete of the same customer finds it inactive and
    does nothing; one before it still lands; a delete only clears the
    active flag and records who/when, so applying updates (each checked
    against the customer being active at its own time) then deletes is
    exact."""
    current = held["customers"]
    decided, ok = _decided(current, batch, "customers")
    updated = update_customers(current, _op(ok, "update"), CUSTOMER_UPDATE).drop("n_updates")
    deleted = soft_delete(updated, _op(ok, "delete").select("request_seq", "actor_id", "now", "id"))
    new = entities.insert_customers(current, _op(ok, "insert"))
    out = deleted.unionByName(new.drop("request_seq"), allowMissingColumns=True)
    return Change({"customers": (out, _ids(ok, new))},
                  outcome_rows(decided, "customers", new))


def _services(held: dict[str, DataFrame], batch: DataFrame) -> Change:
    """Creates, partial updates (active rows only) and soft deletes."""
    current = held["services"]
    decided, ok = _decided(current, batch, "services")
    upd = entities.update_services(current, _op(ok, "update")).drop("n_updates", "updated_by")
    deleted = soft_delete(upd, _op(ok, "delete").select("request_seq", "actor_id", "now", "id"))
    new = entities.insert_services(current, _op(ok, "insert"))
    out = deleted.unionByName(new.drop("request_seq"), allowMissingColumns=True)
    return Change({"services": (out, _ids(ok, new))},
                  outcome_rows(decided, "services", new))


def _transactions(held: dict[str, DataFrame], batch: DataFrame) -> Change:
    """Creates, partial updates and hard deletes."""
    current = held["transactions"]
    decided, ok = _decided(current, batch, "transactions")
    upd = entities.update_ledger(current, _op(ok, "update")).drop("n_updates")
    kept = hard_delete(upd, _op(ok, "delete").select("id"))
    new = entities.insert_transactions(current, _op(ok, "insert"))
    out = kept.unionByName(new.drop("request_seq"), allowMissingColumns=True)
    return Change({"transactions": (out, _ids(ok, new))},
                  outcome_rows(decided, "transactions", new))


def _users(held: dict[str, DataFrame], batch: DataFrame) -> Change:
    """Sign-ups: valid, first of their email, email not taken."""
    current = held["users"]
    decided, ok = _decided(current, batch, "users")
    new = insert_users(current, ok, USER_CREATE)
    out = current.unionByName(new.drop("request_seq"), allowMissingColumns=True)
    return Change({"users": (out, new.select("id"))},
                  outcome_rows(decided, "users", new))


def _inventory(held: dict[str, DataFrame], batch: DataFrame) -> Change:
    """Quantity sets, full updates, creates and hard deletes, with the stock log."""
    current = held["inventory"]
    decided, ok = _decided(current, batch, "inventory")
    snap, log = entities.inventory_batch(current, ok)
    log = log.checkpoint(eager=True)
    made = log.where("change_type = 'initial'").select("request_seq", F.col("inventory_id").alias("id"))
    return Change({"inventory": (snap.drop("n_updates", "updated_by"), _ids(ok, made))}, outcome_rows(decided, "inventory", made),
                  {"inventory_changes": log})


def _appointments(held: dict[str, DataFrame], batch: DataFrame) -> Change:
    """Bookings, moves and cancellations, exact in request order; an accepted
    update that completes an appointment with a price posts its income to the
    ledger, once, dated as the request is."""
    current = held["appointments"]
    open_, lost = judge_appointments(batch)
    ledger = held.get("transactions")
    as_of = F.coalesce(F.to_date(F.col("now")), F.current_date())
    made = apply_appointment_batch(current, open_, ledger, as_of, made_by=True)
    d, snap = made[:2]
    new = snap.where("_made_by is not null").select(F.col("_made_by").alias("request_seq"), "id")
    ok = open_.join(d.where("decision = 'accepted'").select("request_seq"), "request_seq", "left_semi")
    tables = {"appointments": (snap.drop("n_updates", "_made_by"), _ids(ok, new))}
    if ledger is not None:
        posts = made[2].drop("request_seq").checkpoint(eager=True)
        tables["transactions"] = (ledger.unionByName(posts, allowMissingColumns=True), posts.select("id"))
    return Change(tables, outcome_rows(appointment_outcomes(open_, d, lost), "appointments", new))


APPLY: dict[str, Callable[[dict[str, DataFrame], DataFrame], Change]] = {
    "customers": _customers,
    "appointments": _appointments,
    "services": _services,
    "transactions": _transactions,
    "inventory": _inventory,
    "users": _users,
}
#: Tables that a batch reads and writes beside its own, where they are stored.
WITH = {"appointments": ("transactions",)}


def apply_batch(batch: DataFrame, batch_id: int, root: str, entity: str) -> None:
    spark = batch.sparkSession
    name = f"{entity}-{int(batch_id)}"
    if batch_done(spark, root, name):
        return  # replayed: all of it is there
    versions = {t: committed_versions(spark, root, t) for t in (entity, *WITH.get(entity, ()))}
    held = {t: load(spark, root, t, bucket=BUCKET) for t, vs in versions.items() if vs or t == entity}
    batch = batch.checkpoint(eager=True)  # a source may not give the same rows twice
    change = APPLY[entity](held, batch)
    # The batch's number in the stream keeps log ids ascending from batch to
    # batch, and a replay gives the same ones.
    first = (int(batch_id) + 1) << 32
    for table, log in change.logs.items():
        write_log_batch(assign_ids(log, first), root, table, name)
    seen = Observation()  # counted by the job that writes
    told = change.outcomes.observe(seen, F.count_if(F.col("outcome") == "applied").alias("applied"),
                                   *[F.count_if(F.col("reason") == r).alias(r) for r in REASONS])
    write_log_batch(told, root, OUTCOMES, name, OUTCOMES_SCHEMA)
    note: dict = {"requests": {k: n for k, n in seen.get.items() if n}}
    for table, (out, touched) in change.tables.items():
        version = versions[table][-1] + 1
        note[table] = {"version": version, "buckets": write_change(out, root, table, version, name, touched, BUCKET)}
    commit_batch(spark, root, name, note)


def load_outcomes(spark, root: str) -> DataFrame:
    """The outcome of every request of all committed batches."""
    return load_log(spark, root, OUTCOMES, OUTCOMES_SCHEMA)


def apply_customer_batch(batch: DataFrame, batch_id: int, root: str) -> None:
    apply_batch(batch, batch_id, root, "customers")


def run_changes(stream: DataFrame, root: str, checkpoint: str, available_now: bool = True,
                entity: str = "customers"):
    """Start the change-application query for ``entity``; returns the
    StreamingQuery."""
    w = (stream.writeStream
         .foreachBatch(lambda df, bid: apply_batch(df, bid, root, entity))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
