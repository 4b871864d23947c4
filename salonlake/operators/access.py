"""Who may act: the session/actor rule kept from request authentication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salonlake.functions.expressions import epoch_seconds
from salonlake.params import SESSION_HOURS


def eligible_actors(requests: DataFrame, users: DataFrame,
                    session_hours: int = SESSION_HOURS) -> DataFrame:
    """Requests whose session has not expired at request time and whose actor
    is an existing active user. Sessions without an issue time never expire."""
    # Tokens carry whole seconds: expired when floor(issued) + hours * 3600
    # is below floor(now).
    exp = epoch_seconds(requests, "issued_at") + session_hours * 3600
    live = requests.where(F.col("issued_at").isNull()
                          | (exp >= epoch_seconds(requests, "now")))
    act = users.where(F.col("is_active") == 1).select(F.col("id").alias("actor_id"))
    return live.join(act, "actor_id", "left_semi")
