"""What became of every request of a change batch: applied, or rejected with
a reason, one row per request.

Reasons: ``corrupt`` (no JSON), ``unsequenced`` (no request_seq, so it has no
place in the order), ``unknown_op``, ``invalid`` (with the codes of the broken
rules), ``not_found`` (no such row at the request's own moment: unknown,
deleted or inactive by then), ``duplicate`` (an e-mail that is taken), and
``conflict`` (a double booking). A row that an earlier request of the same
batch creates has no id that its sender can know yet, so a request naming it is
``not_found``.

Decisions need only the ids and e-mails that the batch names: the stored table
is cut to them by a join before anything is shuffled (AQE broadcasts the list
when it is small), and what earlier requests of the batch did to a row is the
first delete of its id, a partial aggregate that comes with that list.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salonlake.functions import validation as V
from salonlake.functions.expressions import blank, escape_markup, parse_number
from salonlake.operators.sequence import slices
from salonlake.operators.writes import parse_int_prefix
from salonlake.sources.changes import CORRUPT

#: Columns that ``decide_changes`` adds.
OUTCOME = ("outcome", "reason", "errors")
REASONS = ("corrupt", "unsequenced", "unknown_op", "invalid", "not_found", "duplicate", "conflict")


@dataclass(frozen=True)
class Entity:
    """How one entity's requests are judged."""

    insert: dict[str, V.Rule]
    update: dict[str, V.Rule] | None = None
    insert_numbers: tuple[str, ...] = ()
    update_numbers: tuple[str, ...] = ()
    deletes: str | None = None  # "soft" (inactive rows refuse updates) or "hard"
    unique: str | None = None
    short_sets: bool = False
    default_op: str | None = None


ENTITIES = {
    "customers": Entity(V.CUSTOMER_CREATE, V.CUSTOMER_UPDATE, deletes="soft"),
    "services": Entity(V.SERVICE_CREATE, V.SERVICE_UPDATE, ("price", "duration_minutes"), ("price", "duration_minutes"), "soft"),
    "transactions": Entity(V.LEDGER_CREATE, V.LEDGER_UPDATE, ("amount",), ("amount",), "hard"),
    "inventory": Entity(V.INVENTORY_CREATE, V.INVENTORY_UPDATE, ("quantity", "unit_price", "min_stock_level"),
                        ("quantity", "unit_price", "min_stock_level"), "hard", short_sets=True),
    "users": Entity(V.USER_CREATE, unique="email", default_op="insert"),
}


def _with_columns(batch: DataFrame, names) -> DataFrame:
    """``batch`` with the columns that its requests may leave out."""
    missing = [c for c in names if c not in batch.columns]
    kinds = {"id": "bigint", "request_seq": "bigint"}
    return batch.withColumns({c: F.lit(None).cast(kinds.get(c, "string")) for c in missing}) if missing else batch


def _not_finite(*cols: str) -> list[Column]:
    """Codes of numeric fields that are sent and are no finite number."""
    return [F.when(~blank(F.col(c)) & parse_number(F.col(c)).isNull(), F.lit(f"{c}:finite")) for c in cols]


def _codes(rules: dict[str, V.Rule], numbers: tuple[str, ...]) -> Column:
    each = [c for name, rule in rules.items() for c in V.field_errors(name, rule)]
    return F.filter(F.array(*each, *_not_finite(*numbers)), lambda x: x.isNotNull())


def _no_codes() -> Column:
    return F.array().cast("array<string>")


def _judged(batch: DataFrame, e: Entity) -> DataFrame:
    """``_op`` and the codes of broken rules, by the request's own operation."""
    batch = _with_columns(batch, ["op", "id", "request_seq", CORRUPT, *e.insert, *(e.update or {}),
                                  *(["quantity"] if e.short_sets else [])])
    op = F.lower(F.col("op"))
    if e.default_op:
        op = F.coalesce(op, F.lit(e.default_op))
    known_ops = ["insert"] + ["update"] * bool(e.update) + ["delete"] * bool(e.deletes) + ["set"] * e.short_sets
    codes = F.when(op == "insert", _codes(e.insert, e.insert_numbers))
    if e.update:
        codes = codes.when(op == "update", _codes(e.update, e.update_numbers))
    if e.short_sets:
        sets = F.array(F.when(F.col("id").isNull() | (F.col("id") == 0), F.lit("id:required")),
                       F.when(parse_number(F.col("quantity")).isNull() | parse_int_prefix(F.col("quantity")).isNull(),
                              F.lit("quantity:number")))
        codes = codes.when(op == "set", F.filter(sets, lambda x: x.isNotNull()))
    early = (F.when(F.col(CORRUPT).isNotNull(), F.lit("corrupt")).when(F.col("request_seq").isNull(), F.lit("unsequenced"))
             .when(op.isNull() | ~op.isin(*known_ops), F.lit("unknown_op")))
    judged = batch.withColumns({"_op": op, "_early": early})
    codes = F.when(F.col("_early").isNull(), F.coalesce(codes, _no_codes())).otherwise(_no_codes())
    return judged.withColumn("errors", codes)


def _first(judged: DataFrame, *keys: str) -> DataFrame:
    return judged.groupBy(*keys).agg(F.min("request_seq").alias("_first"))


def _looked_up(judged: DataFrame, key: str, *tables: tuple[DataFrame, str]) -> DataFrame:
    """``judged`` left joined by ``key`` with each (table, its key). Requests
    without a key (every insert has no id) find nothing: they go past the
    joins, where the one null key would send them all to one task. The tables
    hold a narrow row or two for a key, so tasks hash those; a merge join would
    keep and sort the wide requests. They are dealt into all partitions of the
    session (AQE would merge them by compressed bytes, whatever their rows take
    in memory)."""
    found, rest = judged.where(F.col(key).isNotNull()), judged.where(F.col(key).isNull())
    found = found.repartition(slices(judged.sparkSession), key)
    for table, its in tables:
        found = found.join(table.hint("shuffle_hash"), F.col(key) == F.col(its), "left")
        rest = rest.withColumns({f.name: F.lit(None).cast(f.dataType) for f in table.schema.fields})
    return found.unionByName(rest)


def decide_changes(current: DataFrame, batch: DataFrame, entity: str) -> DataFrame:
    """``batch`` with outcome ('applied' or 'rejected'), reason (NULL when
    applied) and errors (rule codes): exactly one row for each of its rows.
    Requests of one batch have different ``request_seq``."""
    e = ENTITIES[entity]
    judged = _judged(batch, e)
    open_ = F.col("_early").isNull() & (F.size("errors") == 0)
    reason = F.coalesce(F.col("_early"), F.when(F.size("errors") > 0, F.lit("invalid")))
    if e.update or e.deletes:
        judged = judged.withColumn("_id", F.col("id").cast("bigint"))
        asked = judged.where((F.col("_op") != "insert") & F.col("_id").isNotNull()).groupBy(F.col("_id").alias("id")).agg(
            F.min(F.when(open_ & (F.col("_op") == "delete"), F.col("request_seq"))).alias("_first"))
        stored = current.join(asked, "id").select(
            F.col("id").alias("_sid"), ((F.col("is_active") == 1) if e.deletes == "soft" else F.lit(True)).alias("_live"), "_first").distinct()
        judged = _looked_up(judged, "_id", (stored, "_sid"))
        earlier = F.coalesce(F.col("request_seq") > F.col("_first"), F.lit(False))
        missing = F.col("_sid").isNull()
        if e.deletes == "soft":  # a second delete rewrites who and when
            missing = missing | ((F.col("_op") != "delete") & (~F.coalesce("_live", F.lit(False)) | earlier))
        else:
            missing = missing | earlier
        reason = F.coalesce(reason, F.when((F.col("_op") != "insert") & missing, F.lit("not_found")))
    if e.unique:
        key = escape_markup(F.col(e.unique))
        judged = judged.withColumn("_key", F.when(open_, key))
        asked = judged.select("_key").where("_key is not null").distinct()
        taken = current.select(F.col(e.unique).alias("_taken")).join(asked, F.col("_taken") == F.col("_key"), "left_semi").distinct()
        first = _first(judged.where("_key is not null"), "_key").withColumnRenamed("_key", "_mine")
        judged = _looked_up(judged, "_key", (taken, "_taken"), (first, "_mine"))
        again = F.col("_taken").isNotNull() | F.coalesce(F.col("request_seq") > F.col("_first"), F.lit(False))
        reason = F.coalesce(reason, F.when(again, F.lit("duplicate")))
    return _told(judged, reason, batch)


def _told(judged: DataFrame, reason: Column, batch: DataFrame) -> DataFrame:
    done = judged.withColumn("reason", reason)
    own = [c for c in batch.columns if c not in OUTCOME]
    return done.select(*own, F.when(F.col("reason").isNull(), F.lit("applied")).otherwise(F.lit("rejected")).alias("outcome"),
                       "reason", "errors")


def judge_appointments(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests that can be decided, those that never can, with outcome).
    The decidable ones go to ``booking``; see ``appointment_outcomes``."""
    batch = _with_columns(batch, ["op", "id", "request_seq", CORRUPT])
    op = F.lower(F.col("op"))
    early = (F.when(F.col(CORRUPT).isNotNull(), F.lit("corrupt")).when(F.col("request_seq").isNull(), F.lit("unsequenced"))
             .when(op.isNull() | ~op.isin("insert", "create", "post", "update", "cancel", "delete"), F.lit("unknown_op")))
    lost = batch.where(early.isNotNull()).select("*", F.lit("rejected").alias("outcome"), early.alias("reason"), _no_codes().alias("errors"))
    return batch.where(early.isNull()), lost


def appointment_outcomes(batch: DataFrame, decisions: DataFrame, lost: DataFrame) -> DataFrame:
    """Outcomes of a booking batch from its decisions and the undecidable rows."""
    full = _with_columns(batch, [*V.APPOINTMENT_CREATE, *V.APPOINTMENT_UPDATE])
    d = decisions.select("request_seq", F.when(F.col("decision") != "accepted", F.col("decision")).alias("reason"))
    insert = F.lower(F.col("op")).isin("insert", "create", "post")
    codes = F.when(insert, _codes(V.APPOINTMENT_CREATE, ())).otherwise(_codes(V.APPOINTMENT_UPDATE, ()))
    both = full.join(d, "request_seq")
    told = both.withColumn("errors", F.when(F.col("reason") == "invalid", codes).otherwise(_no_codes()))
    told = told.withColumn("outcome", F.when(F.col("reason").isNull(), F.lit("applied")).otherwise(F.lit("rejected")))
    return told.select(*lost.columns).unionByName(lost)


OUTCOMES_SCHEMA = T.StructType([
    T.StructField("entity", T.StringType()), T.StructField("request_seq", T.LongType()), T.StructField("op", T.StringType()),
    T.StructField("id", T.LongType()), T.StructField("actor_id", T.LongType()), T.StructField("now", T.TimestampType()),
    T.StructField("outcome", T.StringType()), T.StructField("reason", T.StringType()), T.StructField("errors", T.ArrayType(T.StringType())),
    T.StructField("raw", T.StringType())])


def outcome_rows(decided: DataFrame, entity: str, created: DataFrame | None = None) -> DataFrame:
    """``decided`` as rows of the outcome log. ``created`` (request_seq, id)
    gives applied inserts the id of the row that they made."""
    d = _with_columns(decided, ["op", "id", CORRUPT])
    d = d if "actor_id" in d.columns else d.withColumn("actor_id", F.lit(None).cast("bigint"))
    d = d if "now" in d.columns else d.withColumn("now", F.lit(None).cast("timestamp"))
    if created is not None:
        made = created.select(F.col("request_seq").alias("_made_by"), F.col("id").alias("_made"))
        d = d.join(made, (F.col("request_seq") == F.col("_made_by")) & (F.col("outcome") == "applied"), "left").withColumn(
            "id", F.coalesce("_made", F.col("id").cast("bigint")))
    d = d.withColumns({"entity": F.lit(entity), "raw": F.col(CORRUPT)})
    return d.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in OUTCOMES_SCHEMA.fields])
