"""DuckDB SQL for the correctness gate.

Each query's oracle is plain ANSI SQL over the driver's test tables; the seven
business tables enter as CTEs written from the FIXTURES.md mapping, and only
the CTEs a query references are emitted.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {
    "users": """
SELECT s_suppkey AS id, s_name AS full_name,
       'u' || CAST(s_suppkey AS VARCHAR) || '@example.com' AS email,
       CASE s_suppkey % 3 WHEN 0 THEN 'admin' WHEN 1 THEN 'manager' ELSE 'employee' END AS role,
       CASE WHEN s_acctbal >= 0 THEN 1 ELSE 0 END AS is_active
FROM supplier""",
    "customers": """
SELECT c.c_custkey AS id, c.c_name AS full_name,
       '05' || CAST(10000000 + c.c_custkey AS VARCHAR) AS phone,
       CASE WHEN c.c_custkey % 7 = 0 THEN NULL
            ELSE 'c' || CAST(c.c_custkey AS VARCHAR) || '@example.com' END AS email,
       c.c_mktsegment AS notes,
       CASE WHEN c.c_acctbal >= 0 THEN 1 ELSE 0 END AS is_active,
       o.created_at
FROM customer c
LEFT JOIN (SELECT o_custkey, MIN(o_orderdate) AS created_at FROM orders GROUP BY o_custkey) o
  ON c.c_custkey = o.o_custkey""",
    "services": """
SELECT p_partkey AS id, p_name AS name, CAST(p_retailprice AS DECIMAL(18,2)) AS price,
       5 + p_size AS duration_minutes,
       CASE WHEN p_type = 'PROMO' THEN NULL ELSE p_type END AS category,
       CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE 1 END AS is_active
FROM part""",
    "appointments": """
SELECT o.o_orderkey AS id, o.o_custkey AS customer_id, l.service_id, l.employee_id,
       CAST(o.o_orderdate AS DATE) AS appointment_date,
       CASE WHEN o.o_orderstatus = 'F' THEN 'completed'
            WHEN o.o_orderstatus = 'P' THEN 'cancelled'
            WHEN o.o_orderkey % 2 = 0 THEN 'scheduled' ELSE 'confirmed' END AS status,
       CASE WHEN o.o_orderkey % 11 = 0 THEN NULL
            ELSE CAST(o.o_totalprice AS DECIMAL(18,2)) END AS price
FROM orders o
LEFT JOIN (SELECT l_orderkey, MIN(l_partkey) AS service_id, MAX(l_suppkey) AS employee_id
           FROM lineitem GROUP BY l_orderkey) l
  ON o.o_orderkey = l.l_orderkey""",
    "transactions": """
SELECT event_id AS id,
       CASE WHEN event_type IN ('purchase','signup') THEN 'income' ELSE 'expense' END AS type,
       event_type AS category, CAST(value AS DECIMAL(18,2)) AS amount,
       CAST(ts AS DATE) - 9345 AS date,
       CASE WHEN event_type = 'purchase' THEN event_id END AS appointment_id,
       user_id AS created_by, ts AS created_at
FROM events""",
    "inventory": """
SELECT p_partkey AS id, p_name AS name, p_brand AS category, p_size - 1 AS quantity,
       CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST(p_retailprice AS DECIMAL(18,2)) END
         AS unit_price,
       10 AS min_stock_level
FROM part""",
    "inventory_changes": """
SELECT event_id AS id, user_id AS inventory_id,
       CASE WHEN event_id % 7 > 3 THEN 'increase' WHEN event_id % 7 < 3 THEN 'decrease'
            ELSE 'no_change' END AS change_type,
       CAST(event_id % 7 AS INT) - 3 AS quantity_change,
       CAST(100 + COALESCE(SUM(CAST(event_id % 7 AS INT) - 3) OVER (PARTITION BY user_id
            ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)
         AS previous_quantity,
       CAST(100 + SUM(CAST(event_id % 7 AS INT) - 3) OVER (PARTITION BY user_id
            ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT)
         AS new_quantity,
       event_id % 20 AS created_by, ts AS created_at
FROM events""",
}

# Change batches (write side), derived from the test tables.
VIEWS.update({
    "customer_changes": """
SELECT o_orderkey AS request_seq, o_orderkey % 100 AS actor_id, o_orderdate AS now,
       'update' AS op, o_custkey AS id,
       CASE WHEN o_orderkey % 5 = 0 THEN 'Client <' || CAST(o_orderkey AS VARCHAR) || '>' END
         AS full_name,
       CASE WHEN o_orderkey % 3 = 0 THEN '06' || CAST(20000000 + o_orderkey AS VARCHAR) END AS phone,
       CASE WHEN o_orderkey % 4 = 0 THEN 'n' || CAST(o_orderkey AS VARCHAR) || '@example.org'
            WHEN o_orderkey % 9 = 0 THEN 'bad-email' END AS email,
       CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS notes
FROM orders""",
    "customer_creates": """
SELECT c_custkey AS request_seq, c_custkey % 100 AS actor_id,
       CASE WHEN c_custkey % 10 = 0 THEN '' WHEN c_custkey % 10 = 1 THEN 'A' ELSE c_name END
         AS full_name,
       CASE WHEN c_custkey % 4 = 0 THEN '05' || CAST(c_custkey AS VARCHAR)
            ELSE '05' || CAST(10000000 + c_custkey AS VARCHAR) END AS phone,
       CASE WHEN c_custkey % 7 = 0 THEN NULL
            WHEN c_custkey % 5 = 0 THEN 'c' || CAST(c_custkey AS VARCHAR) || '@example'
            ELSE 'c' || CAST(c_custkey AS VARCHAR) || '@example.com' END AS email,
       c_mktsegment AS notes
FROM customer""",
    "ledger_creates": """
SELECT event_id AS request_seq,
       CASE WHEN event_id % 13 = 0 THEN 'refund'
            WHEN event_type IN ('purchase', 'signup') THEN 'income' ELSE 'expense' END AS type,
       CASE WHEN event_id % 17 = 0 THEN 'x' ELSE event_type END AS category,
       CASE WHEN event_id % 19 = 0 THEN '0' WHEN event_id % 23 = 0 THEN 'abc'
            ELSE CAST(value AS VARCHAR) END AS amount,
       CASE WHEN event_id % 29 = 0 THEN '2024-02-30' ELSE strftime(ts, '%Y-%m-%d') END AS date,
       props AS description,
       CASE WHEN event_type = 'purchase' THEN CAST(event_id AS VARCHAR) END AS appointment_id
FROM events""",
    "customer_deletes": """
SELECT o_orderkey AS request_seq, o_orderkey % 100 AS actor_id, o_orderdate AS now,
       CASE WHEN o_orderkey % 50 = 0 THEN o_custkey + 100000000 ELSE o_custkey END AS id
FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'""",
    "ledger_deletes": """
SELECT event_id AS request_seq,
       CASE WHEN event_id % 4 = 0 THEN event_id + 100000000 ELSE event_id END AS id
FROM events WHERE event_type = 'error' AND value > 300""",
    "new_users": """
SELECT c_custkey AS request_seq, make_timestamp((1700000000 + c_custkey) * 1000000) AS now,
       CASE WHEN c_custkey % 11 = 0 THEN 'B' ELSE c_name END AS full_name,
       'u' || CAST(c_custkey % 130 AS VARCHAR) || '@example.com' AS email,
       CAST(NULL AS VARCHAR) AS phone,
       CASE WHEN c_custkey % 3 = 0 THEN 'manager' END AS role
FROM customer""",
    "appointment_requests": """
SELECT event_id AS request_seq, event_id % 20 AS actor_id, ts AS now,
       CAST(user_id AS VARCHAR) AS customer_id, CAST(event_id % 200 AS VARCHAR) AS service_id,
       CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(user_id % 100 AS VARCHAR) END AS employee_id,
       strftime(CAST(ts AS DATE) - 9345, '%Y-%m-%d') AS appointment_date,
       CASE WHEN event_type = 'purchase' THEN 'completed' WHEN event_type = 'error' THEN 'cancelled'
            WHEN event_type = 'view' THEN 'scheduled' END AS status,
       CAST(value AS VARCHAR) AS price, CAST(NULL AS VARCHAR) AS notes
FROM events""",
    "appointment_updates": """
SELECT o_orderkey AS request_seq, o_orderkey % 100 AS actor_id, o_orderkey AS id,
       CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'confirmed' END
         AS status,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN ''
            ELSE CAST(o_totalprice AS VARCHAR) END AS price,
       CAST(NULL AS VARCHAR) AS appointment_date, CAST(NULL AS VARCHAR) AS employee_id,
       CAST(NULL AS VARCHAR) AS notes
FROM orders
UNION ALL
SELECT event_id + 1000000000, event_id % 100, event_id, 'completed', CAST(value AS VARCHAR),
       NULL, NULL, NULL
FROM events WHERE event_type = 'purchase'""",
    "appointment_mixed": """
SELECT event_id AS request_seq, event_id % 20 AS actor_id, ts AS now,
       CASE event_type WHEN 'view' THEN 'insert' WHEN 'error' THEN 'cancel' ELSE 'update' END AS op,
       CASE WHEN event_type <> 'view' THEN event_id END AS id,
       CASE WHEN event_type = 'view' THEN CAST(user_id AS VARCHAR) END AS customer_id,
       CASE WHEN event_type = 'view' THEN CAST(event_id % 200 AS VARCHAR) END AS service_id,
       CASE WHEN event_type IN ('view', 'click') THEN CAST(user_id % 100 AS VARCHAR) END AS employee_id,
       CASE WHEN event_type IN ('view', 'click') THEN strftime(CAST(ts AS DATE) - 9345, '%Y-%m-%d') END AS appointment_date,
       CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'confirmed' END AS status,
       CAST(NULL AS VARCHAR) AS notes, CAST(NULL AS VARCHAR) AS price
FROM events""",
    "customer_mixed": """
SELECT 2 * o_orderkey AS request_seq, 'update' AS op, o_custkey AS id, NULL AS raw,
       CASE WHEN o_orderkey % 5 = 0 THEN 'Client <' || CAST(o_orderkey AS VARCHAR) || '>' END AS full_name,
       CASE WHEN o_orderkey % 3 = 0 THEN '06' || CAST(20000000 + o_orderkey AS VARCHAR) END AS phone,
       CASE WHEN o_orderkey % 4 = 0 THEN 'n' || CAST(o_orderkey AS VARCHAR) || '@example.org'
            WHEN o_orderkey % 9 = 0 THEN 'bad-email' END AS email,
       CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS notes
FROM orders
UNION ALL
SELECT 2 * o_orderkey + 1, 'delete', CASE WHEN o_orderkey % 50 = 0 THEN o_custkey + 100000000 ELSE o_custkey END,
       NULL, NULL, NULL, NULL, NULL
FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'
UNION ALL
SELECT CASE WHEN c_custkey % 89 <> 0 THEN c_custkey + 1000000000 END,
       CASE WHEN c_custkey % 83 = 0 THEN 'merge' ELSE 'insert' END, NULL,
       CASE WHEN c_custkey % 97 = 0 THEN '{' || CAST(c_custkey AS VARCHAR) END,
       CASE WHEN c_custkey % 10 = 0 THEN '' WHEN c_custkey % 10 = 1 THEN 'A' ELSE c_name END,
       CASE WHEN c_custkey % 4 = 0 THEN '05' || CAST(c_custkey AS VARCHAR)
            ELSE '05' || CAST(10000000 + c_custkey AS VARCHAR) END,
       CASE WHEN c_custkey % 7 = 0 THEN NULL
            WHEN c_custkey % 5 = 0 THEN 'c' || CAST(c_custkey AS VARCHAR) || '@example'
            ELSE 'c' || CAST(c_custkey AS VARCHAR) || '@example.com' END, c_mktsegment
FROM customer""",
    "ledger_mixed": """
SELECT 3 * event_id AS request_seq, 'insert' AS op, NULL::BIGINT AS id,
       CASE WHEN event_id % 13 = 0 THEN 'refund'
            WHEN event_type IN ('purchase', 'signup') THEN 'income' ELSE 'expense' END AS type,
       CASE WHEN event_id % 17 = 0 THEN 'x' ELSE event_type END AS category,
       CASE WHEN event_id % 19 = 0 THEN '0' WHEN event_id % 23 = 0 THEN 'abc' ELSE CAST(value AS VARCHAR) END AS amount,
       CASE WHEN event_id % 29 = 0 THEN '2024-02-30' ELSE strftime(ts, '%Y-%m-%d') END AS date, props AS description,
       CASE WHEN event_type = 'purchase' THEN CAST(event_id AS VARCHAR) END AS appointment_id
FROM events
UNION ALL
SELECT 3 * event_id + 1, 'update', event_id - event_id % 2, CASE WHEN event_id % 11 = 0 THEN 'gift' END, NULL,
       CASE WHEN event_id % 5 = 0 THEN 'Infinity' WHEN event_id % 7 = 0 THEN '0' ELSE CAST(value AS VARCHAR) END,
       NULL, NULL, NULL
FROM events WHERE event_type IN ('view', 'error')
UNION ALL
SELECT 3 * event_id + 2, 'delete', CASE WHEN event_id % 4 = 0 THEN event_id + 100000000 ELSE event_id END,
       NULL, NULL, NULL, NULL, NULL, NULL
FROM events WHERE event_type = 'error' AND value > 300""",
    "service_creates": """
SELECT p_partkey AS request_seq, p_partkey % 20 AS actor_id, make_timestamp((1700000000 + p_partkey) * 1000000) AS now,
       CASE WHEN p_partkey % 17 = 0 THEN 'x' WHEN p_partkey % 5 = 0 THEN '<b>' || p_name ELSE p_name END AS name,
       CASE WHEN p_partkey % 19 = 0 THEN '-1' WHEN p_partkey % 23 = 0 THEN 'Infinity'
            ELSE CAST(p_retailprice AS VARCHAR) END AS price,
       CASE WHEN p_partkey % 13 = 0 THEN '4' WHEN p_partkey % 29 = 0 THEN '481'
            ELSE CAST(p_size + 5 AS VARCHAR) END AS duration_minutes,
       CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END AS category, p_type AS description
FROM part""",
    "ledger_changes": """
SELECT event_id AS request_seq, event_id % 20 AS actor_id, ts AS now,
       CASE WHEN event_id % 10 = 0 THEN event_id + 100000000 ELSE event_id - event_id % 4 END AS id,
       CASE WHEN event_id % 11 = 0 THEN 'gift' WHEN event_id % 3 = 0 THEN 'expense' END AS type,
       CASE WHEN event_id % 7 = 0 THEN 'c' WHEN event_id % 2 = 0 THEN event_type END AS category,
       CASE WHEN event_id % 13 = 0 THEN '0' WHEN event_id % 4 = 1 THEN CAST(value AS VARCHAR) END AS amount,
       CASE WHEN event_id % 17 = 0 THEN '2024-02-30' WHEN event_id % 5 = 0 THEN strftime(ts, '%Y-%m-%d') END AS date,
       CAST(NULL AS VARCHAR) AS description
FROM events""",
    "appointment_cancels": """
SELECT event_id AS request_seq, event_id % 20 AS actor_id, ts AS now, event_id - event_id % 3 AS id
FROM events WHERE event_type IN ('error', 'signup')""",
    "stock_sets": """
SELECT event_id AS request_seq, event_id % 20 AS actor_id,
       CASE WHEN event_id % 10 = 0 THEN user_id + 100000000 ELSE user_id END AS id,
       CASE WHEN event_id % 31 = 0 THEN 'abc'
            ELSE CAST(CAST(floor(value) AS BIGINT) % 60 AS VARCHAR) END AS quantity,
       event_type AS reason
FROM events""",
    "session_requests": """
SELECT event_id AS request_id, user_id AS actor_id, ts AS now,
       ts - to_hours(CAST(event_id % 30 AS BIGINT)) AS issued_at
FROM events""",
    "upload_manifest": """
SELECT page_id AS upload_id,
       CASE WHEN page_id % 2 = 0 THEN 'avatar' ELSE 'receipt' END AS kind,
       CASE WHEN page_id % 7 = 0 THEN NULL ELSE string_split(url, '/')[-1] END AS file_name,
       CASE page_id % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png'
            WHEN 2 THEN 'image/gif' WHEN 3 THEN 'image/jpeg' ELSE 'text/html' END AS mime,
       CAST(strlen(html) * 97 AS BIGINT) AS size_bytes,
       page_id % 100 AS user_id,
       CASE WHEN page_id % 3 = 0 THEN NULL ELSE page_id END AS transaction_id,
       1700000000000 + page_id * 1000 AS uploaded_ms
FROM pages""",
    "service_changes": """
SELECT event_id AS request_seq, event_id % 20 AS actor_id, ts AS now, user_id AS id,
       CASE WHEN event_id % 3 = 0 THEN 'Svc ' || CAST(event_id AS VARCHAR) END AS name,
       CASE WHEN event_id % 15 = 0 THEN '-1' WHEN event_id % 4 = 0 THEN CAST(value AS VARCHAR) END
         AS price,
       CASE WHEN event_id % 5 = 0 THEN CAST(5 + event_id % 500 AS VARCHAR) END AS duration_minutes,
       CASE WHEN event_id % 6 = 0 THEN event_type END AS category,
       CAST(NULL AS VARCHAR) AS description
FROM events""",
    "inventory_creates": """
SELECT p_partkey AS request_seq, p_partkey % 20 AS actor_id,
       CASE WHEN p_partkey % 17 = 0 THEN 'x' ELSE p_name END AS name,
       CASE WHEN p_partkey % 19 = 0 THEN 'many' ELSE CAST(p_size AS VARCHAR) END AS quantity,
       CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 23 = 0 THEN '0'
            ELSE CAST(p_retailprice AS VARCHAR) END AS unit_price,
       CASE WHEN p_partkey % 3 = 0 THEN '' ELSE CAST(p_size % 7 AS VARCHAR) END AS min_stock_level,
       p_brand AS category, p_type AS description
FROM part""",
    "inventory_updates": """
SELECT event_id AS request_seq, event_id % 20 AS actor_id, ts AS now,
       CASE WHEN event_id % 10 = 0 THEN user_id + 100000000 ELSE user_id END AS id,
       CAST(NULL AS VARCHAR) AS name,
       CASE WHEN event_id % 3 = 0 THEN CAST(CAST(floor(value) AS BIGINT) % 40 AS VARCHAR) END
         AS quantity,
       CAST(NULL AS VARCHAR) AS unit_price,
       CASE WHEN event_id % 7 = 0 THEN '5' END AS min_stock_level,
       CAST(NULL AS VARCHAR) AS category, CAST(NULL AS VARCHAR) AS description
FROM events""",
    "inventory_mixed": """
SELECT event_id AS request_seq, event_id % 20 AS actor_id, ts AS now,
       CASE WHEN event_type = 'purchase' THEN 'insert' WHEN event_type = 'click' THEN 'update'
            WHEN event_type = 'error' AND event_id % 10 = 0 THEN 'delete' ELSE 'set' END AS op,
       CASE WHEN event_type <> 'purchase' THEN user_id END AS id,
       CASE WHEN event_type = 'purchase' THEN 'Item ' || CAST(event_id AS VARCHAR)
            WHEN event_type = 'click' AND event_id % 5 = 0
              THEN 'Renamed ' || CAST(event_id AS VARCHAR) END AS name,
       CASE WHEN event_type = 'click' AND event_id % 4 = 0 THEN NULL
            WHEN event_id % 31 = 0 THEN 'abc'
            ELSE CAST(CAST(floor(value) AS BIGINT) % 60 AS VARCHAR) END AS quantity,
       CASE WHEN event_type = 'purchase' THEN CAST(value AS VARCHAR) END AS unit_price,
       CASE WHEN event_type = 'purchase' THEN '5' END AS min_stock_level,
       CAST(NULL AS VARCHAR) AS category, CAST(NULL AS VARCHAR) AS description,
       CASE WHEN event_type <> 'click' AND event_id % 3 = 0 THEN event_type END AS reason
FROM events""",
})

_ORDER = ["users", "customers", "services", "appointments", "transactions", "inventory",
          "inventory_changes", "customer_changes", "customer_creates", "ledger_creates",
          "customer_deletes", "ledger_deletes", "new_users", "appointment_requests",
          "appointment_updates", "appointment_mixed", "customer_mixed",
          "ledger_mixed", "ledger_changes", "service_creates", "appointment_cancels", "stock_sets", "session_requests", "upload_manifest", "service_changes",
          "inventory_creates", "inventory_updates", "inventory_mixed"]

_NUM = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_INF = r"^\s*[+-]?Infinity\s*$"
_EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
_DATE = r"^\d{4}-\d{2}-\d{2}$"


def escape_sql(expr: str) -> str:
    """Markup escaping as nested replace() calls."""
    for raw, rep in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"),
                     ("/", "&#x2F;")):
        q = raw.replace("'", "''")
        expr = f"replace({expr}, '{q}', '{rep}')"
    return expr


def number_sql(v: str) -> str:
    return f"CASE WHEN regexp_matches({v}, '{_NUM}') THEN TRY_CAST(trim({v}) AS DOUBLE) END"


def rule_errors_sql(rules) -> str:
    """DuckDB list of the error codes of ``rules`` (see functions.validation)."""
    items = []
    for name, r in rules.items():
        v = f"CAST({name} AS VARCHAR)"
        blank = f"({v} IS NULL OR {v} = '')"
        if r.required:
            items.append(f"CASE WHEN {blank} THEN '{name}:required' END")
        checks = []
        if r.type == "email":
            checks.append((f"NOT regexp_matches({v}, '{_EMAIL}')", "email"))
        elif r.type == "number":
            checks.append((f"NOT (regexp_matches({v}, '{_NUM}') OR regexp_matches({v}, '{_INF}'))",
                           "number"))
        elif r.type == "date":
            checks.append((f"NOT regexp_matches({v}, '{_DATE}') OR TRY_CAST({v} AS DATE) IS NULL",
                           "date"))
        if r.min_length is not None:
            checks.append((f"length({v}) < {r.min_length}", "min_length"))
        if r.max_length is not None:
            checks.append((f"length({v}) > {r.max_length}", "max_length"))
        if r.min is not None:
            checks.append((f"COALESCE({number_sql(v)} < {r.min}, trim({v}) = '-Infinity')", "min"))
        if r.max is not None:
            checks.append((f"COALESCE({number_sql(v)} > {r.max}, trim({v}) IN ('Infinity', '+Infinity'))", "max"))
        if r.enum is not None:
            lst = ", ".join(f"'{e}'" for e in r.enum)
            checks.append((f"{v} NOT IN ({lst})", "enum"))
        for cond, code in checks:
            items.append(f"CASE WHEN NOT {blank} AND COALESCE({cond}, false) "
                         f"THEN '{name}:{code}' END")
    return f"list_filter([{', '.join(items)}]::VARCHAR[], lambda x: x IS NOT NULL)"


def valid_sql(rules) -> str:
    return f"len({rule_errors_sql(rules)}) = 0"


def with_views(body: str) -> str:
    """Prefix ``body`` with the CTEs of the business tables it names."""
    used = [v for v in _ORDER if re.search(r"\b%s\b" % v, body)]
    if not used:
        return body
    ctes = ",\n".join(f"{v} AS ({VIEWS[v].strip()})" for v in used)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
