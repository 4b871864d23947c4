"""Registered queries of the remaining write operators, rule sets, the
dashboard's lists and the nested inventory card, with their oracle SQL.

The rules below are the system's fixed limits, written out a second time and
apart from ``functions.validation``, so that the oracle checks them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from salonlake.functions import validation as V
from salonlake.operators import entities, outcomes, stock, uploads, writes
from salonlake.params import AS_OF
from salonlake.plans import dashboard
from salonlake.plans.catalog import ORACLE, _int_sql, _money_sql, _nums_ok_sql, _truthy_sql, money, register
from salonlake.plans.oracle import escape_sql, number_sql
from salonlake.sources import batches



# --------------------------------------------------------------- rule sets
def _codes(*fields: str) -> str:
    """DuckDB list of error codes. A field is ``name`` with ``!`` if required,
    then its checks in the order in which they are reported."""
    items = []
    for spec in fields:
        name, *checks = spec.split()
        required, name = name.endswith("!"), name.rstrip("!")
        v = f"CAST({name} AS VARCHAR)"
        there = f"({v} IS NOT NULL AND {v} <> '')"
        if required:
            items.append(f"CASE WHEN NOT {there} THEN '{name}:required' END")
        for check in checks:
            kind, _, arg = check.partition("=")
            number = number_sql(v)
            bad = {
                "email": rf"NOT regexp_matches({v}, '^[^\s@]+@[^\s@]+\.[^\s@]+$')",
                "number": rf"({number}) IS NULL AND NOT regexp_matches({v}, '^\s*[+-]?Infinity\s*$')",
                "date": rf"NOT regexp_matches({v}, '^\d{{4}}-\d{{2}}-\d{{2}}$') OR TRY_CAST({v} AS DATE) IS NULL",
                "min_length": f"length({v}) < {arg}", "max_length": f"length({v}) > {arg}",
                "min": f"COALESCE(({number}) < {arg}, trim({v}) = '-Infinity')",
                "max": f"COALESCE(({number}) > {arg}, trim({v}) IN ('Infinity', '+Infinity'))",
                "enum": f"{v} NOT IN ({', '.join(repr(x) for x in arg.split('|'))})"}[kind]
            items.append(f"CASE WHEN {there} AND ({bad}) THEN '{name}:{kind}' END")
    return f"list_filter([{', '.join(items)}]::VARCHAR[], lambda x: x IS NOT NULL)"


# The limits of each kind of request.
_STATUS = "enum=scheduled|confirmed|completed|cancelled"
RULES = {
    "users": ("full_name! min_length=2 max_length=100", "email! email", "phone min_length=10 max_length=20"),
    "customer_updates": ("full_name min_length=2 max_length=100", "phone min_length=10 max_length=20", "email email",
                         "notes max_length=500"),
    "appointments": ("customer_id! number", "service_id! number", "appointment_date! date", "employee_id number",
                     f"status {_STATUS}", "notes max_length=500", "price number min=0"),
    "appointment_updates": (f"status {_STATUS}", "appointment_date date", "employee_id number", "notes max_length=500",
                            "price number min=0"),
    "ledger_updates": ("type enum=income|expense", "category min_length=2 max_length=50", "amount number min=0.01",
                       "description max_length=500", "date date"),
    "services": ("name! min_length=2 max_length=100", "price! number min=0", "duration_minutes! number min=5 max=480",
                 "category max_length=50", "description max_length=500"),
    "service_updates": ("name min_length=2 max_length=100", "price number min=0", "duration_minutes number min=5 max=480",
                        "category max_length=50", "description max_length=500"),
    "inventory": ("name! min_length=2 max_length=100", "quantity! number min=0", "unit_price number min=0",
                  "min_stock_level number min=0", "category max_length=50", "description max_length=500"),
    "inventory_updates": ("name min_length=2 max_length=100", "quantity number min=0", "unit_price number min=0",
                          "min_stock_level number min=0", "category max_length=50", "description max_length=500"),
}
_SETS = {
    "users": ("new_users", V.USER_CREATE), "customer_updates": ("customer_changes", V.CUSTOMER_UPDATE),
    "appointments": ("appointment_requests", V.APPOINTMENT_CREATE),
    "appointment_updates": ("appointment_updates", V.APPOINTMENT_UPDATE), "ledger_updates": ("ledger_changes", V.LEDGER_UPDATE),
    "services": ("service_creates", V.SERVICE_CREATE), "service_updates": ("service_changes", V.SERVICE_UPDATE),
    "inventory": ("inventory_creates", V.INVENTORY_CREATE), "inventory_updates": ("inventory_updates", V.INVENTORY_UPDATE),
}


def _validated(name: str, batch: str, rules: dict) -> None:
    codes = _codes(*RULES[name])

    @register(f"validate_{name}", f"""
SELECT request_seq, array_to_string({codes}, ',') AS errors, len({codes}) = 0 AS is_valid FROM {batch}""")
    def q(t):
        v = V.validate(getattr(batches, batch)(t.spark, t.sf_dir), rules)
        return v.select("request_seq", F.array_join("errors", ",").alias("errors"), "is_valid")


for _name, (_batch, _rules) in _SETS.items():
    _validated(_name, _batch, _rules)


def _ok(name: str) -> str:
    return f"len({_codes(*RULES[name])}) = 0"


def _last(c: str) -> str:
    return f"arg_max({c}, request_seq) FILTER (WHERE {c} IS NOT NULL)"


def _next_id(table: str) -> str:
    return f"(SELECT COALESCE(MAX(id), 0) FROM {table}) + ROW_NUMBER() OVER (ORDER BY request_seq)"


# ------------------------------------------------------------------ creates
@register("insert_services", f"""
SELECT {_next_id('services')} AS id, {escape_sql('name')} AS name,
       {escape_sql("NULLIF(description, '')")} AS description, CAST({_money_sql('price')} AS DOUBLE) AS price,
       {_int_sql('duration_minutes')} AS duration_minutes, {escape_sql("NULLIF(category, '')")} AS category,
       1 AS is_active, now AS created_at, request_seq
FROM service_creates WHERE {_ok('services')} AND {_nums_ok_sql('price', 'duration_minutes')}""")
def q_insert_services(t):
    return entities.insert_services(t["services"], batches.service_creates(t.spark, t.sf_dir))


_LEDGER = ("type! enum=income|expense", "category! min_length=2 max_length=50", "amount! number min=0.01", "date! date",
           "description max_length=500", "appointment_id number")


@register("insert_transactions", f"""
SELECT {_next_id('transactions')} AS id, {escape_sql('type')} AS type, {escape_sql('category')} AS category,
       CAST({_money_sql('amount')} AS DOUBLE) AS amount, {escape_sql("NULLIF(description, '')")} AS description,
       CAST(date AS DATE) AS date,
       CASE WHEN {_truthy_sql('appointment_id')} THEN CAST({number_sql('appointment_id')} AS BIGINT) END AS appointment_id,
       request_seq % 20 AS created_by, request_seq
FROM ledger_creates WHERE len({_codes(*_LEDGER)}) = 0 AND {_nums_ok_sql('amount')}""")
def q_insert_transactions(t):
    new = batches.ledger_creates(t.spark, t.sf_dir)
    return entities.insert_transactions(t["transactions"], new.withColumn("actor_id", F.col("request_seq") % 20))


@register("insert_appointments", f"""
WITH b AS ({ORACLE['booking_accept']})
SELECT {_next_id('appointments').replace('request_seq', 'r.request_seq')} AS id,
       CAST({number_sql('customer_id')} AS BIGINT) AS customer_id, CAST({number_sql('service_id')} AS BIGINT) AS service_id,
       b.employee_id, b.appointment_date, b.status, NULLIF(notes, '') AS notes,
       CASE WHEN {_truthy_sql('price')} THEN CAST({_money_sql('price')} AS DOUBLE) END AS price,
       actor_id AS created_by, now AS created_at, r.request_seq
FROM b JOIN appointment_requests r ON b.request_seq = r.request_seq WHERE b.decision = 'accepted'""")
def q_insert_appointments(t):
    return entities.insert_appointments(t["appointments"], batches.appointment_requests(t.spark, t.sf_dir))


# ------------------------------------------------------------------ updates
@register("update_ledger", f"""
WITH v AS (
  SELECT request_seq, actor_id, now, id, type, category,
         CASE WHEN {_truthy_sql('amount')} THEN {_money_sql('amount')} END AS amount, TRY_CAST(date AS DATE) AS date
  FROM ledger_changes WHERE {_ok('ledger_updates')} AND {_nums_ok_sql('amount')} AND id IN (SELECT id FROM transactions)),
f AS (SELECT id AS fid, {', '.join(f'{_last(c)} AS n_{c}' for c in ('type', 'category', 'amount', 'date'))},
             arg_max(actor_id, request_seq) AS updated_by, arg_max(now, request_seq) AS updated_at, COUNT(*) AS n_updates
      FROM v GROUP BY id)
SELECT s.id, COALESCE(n_type, type) AS type, COALESCE(n_category, category) AS category,
       CAST(COALESCE(n_amount, amount) AS DOUBLE) AS amount, COALESCE(n_date, date) AS date, appointment_id, created_by,
       created_at, f.updated_by, f.updated_at, COALESCE(n_updates, 0) AS n_updates
FROM transactions s LEFT JOIN f ON s.id = fid""")
def q_update_ledger(t):
    return entities.update_ledger(t["transactions"], batches.ledger_changes(t.spark, t.sf_dir))


@register("update_appointments", f"""
WITH v AS (
  SELECT request_seq, actor_id, id, NULLIF(status, '') AS status,
         CASE WHEN {_truthy_sql('price')} THEN {_money_sql('price')} END AS price
  FROM appointment_updates WHERE {_ok('appointment_updates')} AND id IN (SELECT id FROM appointments)),
f AS (SELECT id AS fid, {_last('status')} AS n_status, {_last('price')} AS n_price,
             arg_max(actor_id, request_seq) AS updated_by, COUNT(*) AS n_updates FROM v GROUP BY id)
SELECT a.id, customer_id, service_id, employee_id, appointment_date, COALESCE(n_status, status) AS status,
       CAST(COALESCE(n_price, price) AS DOUBLE) AS price, f.updated_by, COALESCE(n_updates, 0) AS n_updates
FROM appointments a LEFT JOIN f ON a.id = fid""")
def q_update_appointments(t):
    changes = batches.appointment_updates(t.spark, t.sf_dir).withColumn("now", F.lit(None).cast("timestamp"))
    out = entities.update_appointments(t["appointments"], changes)
    return out.select("id", "customer_id", "service_id", "employee_id", "appointment_date", "status", "price", "updated_by", "n_updates")


@register("update_inventory", f"""
WITH v AS (
  SELECT request_seq, actor_id, now, id, CASE WHEN quantity <> '' THEN {_int_sql('quantity')} END AS quantity,
         CASE WHEN {_truthy_sql('min_stock_level')} THEN {_int_sql('min_stock_level')} END AS min_stock_level
  FROM inventory_updates
  WHERE {_ok('inventory_updates')} AND {_nums_ok_sql('quantity', 'unit_price', 'min_stock_level')}
    AND id IN (SELECT id FROM inventory)),
f AS (SELECT id AS fid, {_last('quantity')} AS n_quantity, {_last('min_stock_level')} AS n_level,
             arg_max(actor_id, request_seq) AS updated_by, arg_max(now, request_seq) AS updated_at, COUNT(*) AS n_updates
      FROM v GROUP BY id)
SELECT i.id, name, category, COALESCE(n_quantity, quantity) AS quantity, CAST(unit_price AS DOUBLE) AS unit_price,
       COALESCE(n_level, min_stock_level) AS min_stock_level, f.updated_by, f.updated_at, COALESCE(n_updates, 0) AS n_updates
FROM inventory i LEFT JOIN f ON i.id = fid""")
def q_update_inventory(t):
    return entities.update_inventory(t["inventory"], batches.inventory_updates(t.spark, t.sf_dir))[0]


@register("cancel_appointments", f"""
WITH c AS (SELECT id AS cid, arg_max(actor_id, request_seq) AS cancelled_by, arg_max(now, request_seq) AS cancelled_at
           FROM appointment_cancels GROUP BY id)
SELECT id, customer_id, service_id, employee_id, appointment_date,
       CASE WHEN cid IS NULL THEN status ELSE 'cancelled' END AS status, {money('price')}, cancelled_by, cancelled_at
FROM appointments LEFT JOIN c ON id = cid""")
def q_cancel_appointments(t):
    return writes.cancel_appointments(t["appointments"], batches.appointment_cancels(t.spark, t.sf_dir))


# ----------------------------------------------------------------- outcomes
_SET_CODES = (f"list_filter([CASE WHEN id IS NULL OR id = 0 THEN 'id:required' END, CASE WHEN ({number_sql('quantity')}) IS NULL "
              f"OR {_int_sql('quantity')} IS NULL THEN 'quantity:number' END]::VARCHAR[], lambda x: x IS NOT NULL)")


def _finite(*cols: str) -> str:
    each = ", ".join(f"CASE WHEN {c} <> '' AND ({number_sql(c)}) IS NULL THEN '{c}:finite' END" for c in cols)
    return f"list_filter([{each}]::VARCHAR[], lambda x: x IS NOT NULL)"


_INV_NUMBERS = _finite("quantity", "unit_price", "min_stock_level")


@register("inventory_outcomes", f"""
WITH c AS (
  SELECT *, CASE op WHEN 'set' THEN {_SET_CODES}
                    WHEN 'insert' THEN list_concat({_codes(*RULES['inventory'])}, {_INV_NUMBERS})
                    WHEN 'update' THEN list_concat({_codes(*RULES['inventory_updates'])}, {_INV_NUMBERS}) ELSE [] END AS codes
  FROM inventory_mixed),
g AS (SELECT id, MIN(request_seq) AS gone FROM c WHERE op = 'delete' GROUP BY id),
o AS (
  SELECT request_seq, op, c.id, codes,
         CASE WHEN len(codes) > 0 THEN 'invalid' WHEN op = 'insert' THEN NULL
              WHEN i.id IS NULL OR request_seq > gone THEN 'not_found' END AS reason
  FROM c LEFT JOIN inventory i ON c.id = i.id LEFT JOIN g ON c.id = g.id)
SELECT request_seq, op, id, CASE WHEN reason IS NULL THEN 'applied' ELSE 'rejected' END AS outcome, reason,
       array_to_string(codes, ',') AS errors FROM o""")
def q_inventory_outcomes(t):
    d = outcomes.decide_changes(t["inventory"], batches.inventory_mixed_batch(t.spark, t.sf_dir), "inventory")
    return d.select("request_seq", "op", "id", "outcome", "reason", F.array_join("errors", ",").alias("errors"))


# ------------------------------------------------------------------ uploads
def _attached(kind: str, owner: str) -> str:
    return f"""u AS (SELECT {owner} AS oid, '/files/' || arg_max(file_key, uploaded_ms) AS url
      FROM ({ORACLE['check_uploads']}) WHERE kind = '{kind}' AND target = 'bucket' GROUP BY {owner})"""


@register("attach_avatars", f"""
WITH {_attached('avatar', 'user_id')}
SELECT id, full_name, email, role, is_active, url AS avatar_url FROM users LEFT JOIN u ON id = oid""")
def q_attach_avatars(t):
    checked = uploads.check_uploads(batches.upload_manifest(t.spark, t.sf_dir))
    return uploads.attach_uploads(t["users"], checked, "avatar", "user_id", "avatar_url")


@register("attach_receipts", f"""
WITH {_attached('receipt', 'transaction_id')}
SELECT id, type, category, {money('amount')}, date, appointment_id, created_by, created_at, url AS receipt_url
FROM transactions LEFT JOIN u ON id = oid""")
def q_attach_receipts(t):
    checked = uploads.check_uploads(batches.upload_manifest(t.spark, t.sf_dir))
    return uploads.attach_uploads(t["transactions"], checked, "receipt", "transaction_id", "receipt_url")


# -------------------------------------------------------- dashboard and cards
@register("dashboard_lists", f"""
SELECT 'recent_appointments' AS list, ROW_NUMBER() OVER (ORDER BY appointment_date DESC, id DESC) - 1 AS place, id,
       concat_ws('|', status, customer_name, service_name, employee_name) AS label
FROM ({ORACLE['recent_appointments']})
UNION ALL
SELECT 'recent_transactions', ROW_NUMBER() OVER (ORDER BY created_at DESC NULLS LAST, id DESC) - 1, id, concat_ws('|', type, category)
FROM ({ORACLE['recent_transactions']})
UNION ALL
SELECT 'top_services', ROW_NUMBER() OVER (ORDER BY count DESC, id) - 1, id, concat_ws('|', name, count)
FROM ({ORACLE['top_services']})
UNION ALL
SELECT 'top_customers', ROW_NUMBER() OVER (ORDER BY total_spent DESC NULLS LAST, id) - 1, id, concat_ws('|', full_name, visits)
FROM ({ORACLE['top_customers']})""")
def q_dashboard_lists(t):
    """The lists of the one-row dashboard, unfolded in their order."""
    row = dashboard.dashboard(t, AS_OF)
    labels = {"recent_appointments": ("status", "customer_name", "service_name", "employee_name"),
              "recent_transactions": ("type", "category"), "top_services": ("name", "count"), "top_customers": ("full_name", "visits")}

    def unfolded(name: str, cols: tuple[str, ...]):
        return F.transform(F.col(name), lambda x, i: F.struct(
            F.lit(name).alias("list"), i.cast("bigint").alias("place"), x["id"].alias("id"),
            F.concat_ws("|", *[x[c].cast("string") for c in cols]).alias("label")))

    each = [unfolded(name, cols) for name, cols in labels.items()]
    return row.select(F.explode(F.concat(*each)).alias("x")).select("x.*")


@register("inventory_cards", f"""
WITH r AS ({ORACLE['inventory_recent_changes']})
SELECT i.id, i.name, CASE WHEN quantity <= min_stock_level THEN 'low'
            WHEN quantity <= min_stock_level * 2 THEN 'warning' ELSE 'ok' END AS stock_status,
       change_rank, r.id AS change_id, r.change_type, r.quantity_change, r.user_name
FROM inventory i LEFT JOIN r ON r.inventory_id = i.id""")
def q_inventory_cards(t):
    """The nested cards, a row for each nested change (one without changes: one row)."""
    cards = stock.inventory_cards(t)
    each = cards.select("id", "name", "stock_status", F.explode_outer("changes").alias("c"))
    return each.select("id", "name", "stock_status", "c.change_rank", F.col("c.id").alias("change_id"), "c.change_type",
                       "c.quantity_change", "c.user_name")
