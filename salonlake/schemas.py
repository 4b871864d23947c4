"""Fixed schemas of the seven tables and of incoming change rows.

The source system never declares tables, so schema is fixed by convention:
money is DECIMAL(18,2), 0/1 flags stay INT, dates are DATE, ids BIGINT.
"""

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)


def _s(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


USERS = _s(("id", T.LongType()), ("full_name", T.StringType()), ("email", T.StringType()),
           ("phone", T.StringType()), ("role", T.StringType()), ("avatar_url", T.StringType()),
           ("is_active", T.IntegerType()), ("created_at", T.TimestampNTZType()),
           ("updated_at", T.TimestampNTZType()))

CUSTOMERS = _s(("id", T.LongType()), ("full_name", T.StringType()), ("phone", T.StringType()),
               ("email", T.StringType()), ("notes", T.StringType()), ("is_active", T.IntegerType()),
               ("created_at", T.TimestampNTZType()), ("updated_at", T.TimestampNTZType()),
               ("created_by", T.LongType()), ("updated_by", T.LongType()),
               ("deleted_by", T.LongType()), ("deleted_at", T.TimestampNTZType()))

SERVICES = _s(("id", T.LongType()), ("name", T.StringType()), ("description", T.StringType()),
              ("price", MONEY), ("duration_minutes", T.IntegerType()), ("category", T.StringType()),
              ("is_active", T.IntegerType()), ("created_at", T.TimestampNTZType()),
              ("updated_at", T.TimestampNTZType()), ("deleted_at", T.TimestampNTZType()))

APPOINTMENTS = _s(("id", T.LongType()), ("customer_id", T.LongType()), ("service_id", T.LongType()),
                  ("employee_id", T.LongType()), ("appointment_date", T.DateType()),
                  ("status", T.StringType()), ("notes", T.StringType()), ("price", MONEY),
                  ("created_at", T.TimestampNTZType()), ("updated_at", T.TimestampNTZType()),
                  ("created_by", T.LongType()), ("updated_by", T.LongType()),
                  ("cancelled_by", T.LongType()), ("cancelled_at", T.TimestampNTZType()))

TRANSACTIONS = _s(("id", T.LongType()), ("type", T.StringType()), ("category", T.StringType()),
                  ("amount", MONEY), ("description", T.StringType()), ("date", T.DateType()),
                  ("appointment_id", T.LongType()), ("receipt_url", T.StringType()),
                  ("created_by", T.LongType()), ("created_at", T.TimestampNTZType()),
                  ("updated_at", T.TimestampNTZType()), ("updated_by", T.LongType()))

INVENTORY = _s(("id", T.LongType()), ("name", T.StringType()), ("description", T.StringType()),
               ("quantity", T.IntegerType()), ("unit_price", MONEY), ("category", T.StringType()),
               ("min_stock_level", T.IntegerType()), ("created_at", T.TimestampNTZType()),
               ("updated_at", T.TimestampNTZType()))

INVENTORY_CHANGES = _s(("id", T.LongType()), ("inventory_id", T.LongType()),
                       ("change_type", T.StringType()), ("quantity_change", T.IntegerType()),
                       ("previous_quantity", T.LongType()), ("new_quantity", T.LongType()),
                       ("reason", T.StringType()), ("created_by", T.LongType()),
                       ("created_at", T.TimestampNTZType()))

TABLES = {
    "users": USERS,
    "customers": CUSTOMERS,
    "services": SERVICES,
    "appointments": APPOINTMENTS,
    "transactions": TRANSACTIONS,
    "inventory": INVENTORY,
    "inventory_changes": INVENTORY_CHANGES,
}

# Incoming change rows: every field arrives as text, as it would in a JSON body.
_META = (("request_seq", T.LongType()), ("actor_id", T.LongType()), ("now", T.TimestampType()))

CHANGES = {
    "customers": _s(*_META, ("op", T.StringType()), ("id", T.LongType()),
                    ("full_name", T.StringType()), ("phone", T.StringType()),
                    ("email", T.StringType()), ("notes", T.StringType())),
    "appointments": _s(*_META, ("op", T.StringType()), ("id", T.LongType()),
                       ("customer_id", T.StringType()), ("service_id", T.StringType()),
                       ("employee_id", T.StringType()), ("appointment_date", T.StringType()),
                       ("status", T.StringType()), ("notes", T.StringType()),
                       ("price", T.StringType())),
    "transactions": _s(*_META, ("op", T.StringType()), ("id", T.LongType()),
                       ("type", T.StringType()), ("category", T.StringType()),
                       ("amount", T.StringType()), ("date", T.StringType()),
                       ("description", T.StringType()), ("appointment_id", T.StringType())),
    "services": _s(*_META, ("op", T.StringType()), ("id", T.LongType()), ("name", T.StringType()),
                   ("price", T.StringType()), ("duration_minutes", T.StringType()),
                   ("category", T.StringType()), ("description", T.StringType())),
    "inventory": _s(*_META, ("op", T.StringType()), ("id", T.LongType()), ("name", T.StringType()),
                    ("quantity", T.StringType()), ("unit_price", T.StringType()),
                    ("min_stock_level", T.StringType()), ("category", T.StringType()),
                    ("description", T.StringType()), ("reason", T.StringType())),
    "stock_sets": _s(*_META, ("id", T.LongType()), ("quantity", T.StringType()),
                     ("reason", T.StringType())),
    "users": _s(*_META, ("full_name", T.StringType()), ("email", T.StringType()),
                ("phone", T.StringType()), ("role", T.StringType())),
    "uploads": _s(("kind", T.StringType()), ("file_name", T.StringType()), ("mime", T.StringType()),
                  ("size_bytes", T.LongType()), ("user_id", T.LongType()),
                  ("transaction_id", T.LongType()), ("uploaded_ms", T.LongType())),
    "requests": _s(("client_key", T.StringType()), ("ts", T.TimestampType()),
                   ("request_id", T.LongType())),
}
