"""Request limiter: per client key, a counter that lives ``ttl`` after the
last *accepted* request. An accepted request adds one and renews the TTL; at
the limit a request is refused and renews nothing. So the counter resets at
the first request whose time is >= last accepted time + ttl.

Batch form (exact, skew-safe, no per-key collection)
----------------------------------------------------
Number each key's requests 1..m in (ts, request_id) order. A *start* is a
request that meets an empty counter. From a start s the requests s, s+1, ...
are accepted until either a gap >= ttl between neighbours (the counter
expired: that request is the next start) or L requests were accepted; then
requests are refused until the first one at or after t[s+L-1] + ttl, which is
the next start. So every request i is accepted iff i - S(i) < L, where S(i)
is the latest start <= i, and the starts are the chain 1, next(1), ...
with

    next(s) = first i in (s, s+L-1] with gap_i >= ttl, if any,
              else first j with t_j >= t[s+L-1] + ttl.

``next`` is computed for every request at once with ordered scans (skew-safe,
``operators.sequence``) and one equi-join on (key, s+L-1). The chain is then
followed by pointer doubling: level k holds next^(2^k); the reached set
doubles its chain length each level, so ceil(log2(chain length)) rounds of
equi-joins on the unique (key, idx) finish it. No key is ever gathered into
one task, however hot.

Stream form
-----------
``limit_requests_stream`` keeps (count, last accepted time) per key as one value,
and the rows that wait for the watermark as entries of their own, by their
millisecond, with an event-time timer each (``transformWithStateInPandas``). Timers
fire in time order, so on-time rows give the batch result, and an entry is written
and read once, however many others a hot key holds. A row that arrives behind the
watermark cannot be placed in the order any more: it is emitted with ``accepted``
NULL (``late_rows``), or, if it is behind the watermark of the batch before too,
dropped and counted by the engine; the listener ``record_dropped_rows`` keeps
those counts in a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salonlake.functions.expressions import epoch_micros
from salonlake.operators.sequence import lag_scan, scan, sliced
from salonlake.params import REQUEST_LIMIT, REQUEST_TTL_SECONDS

# Key used when a request carries no client key.
UNKNOWN_CLIENT = "unknown"


def _prepare(requests: DataFrame, key: str, ts: str, rid: str) -> DataFrame:
    return requests.select(
        F.coalesce(F.col(key).cast("string"), F.lit(UNKNOWN_CLIENT)).alias("_k"),
        F.col(ts).alias("_ts"),
        epoch_micros(requests, ts).alias("_us"),
        F.col(rid).alias("_rid"))


def limit_requests(requests: DataFrame, key: str = "client_key", ts: str = "ts",
                   rid: str = "request_id", limit: int = REQUEST_LIMIT,
                   ttl_seconds: int = REQUEST_TTL_SECONDS) -> DataFrame:
    """Every request with ``accepted`` (bool) and ``count_after`` (counter
    value after it). Exact equal of replaying the requests in order."""
    ttl = int(ttl_seconds) * 1_000_000
    L = int(limit)
    asc = [F.col("_us"), F.col("_rid")]
    # One slicing (one checkpoint) serves the three ordered scans.
    r = sliced(_prepare(requests, key, ts, rid).withColumn("_one", F.lit(1)), ["_k"], asc)
    r = scan(r, ["_k"], asc, "_one", "_idx").drop("_one")
    r = lag_scan(r, ["_k"], asc, "_us", "_prev_us")
    r = r.withColumn("_gap_idx", F.when(F.col("_prev_us").isNull()
                                        | (F.col("_us") - F.col("_prev_us") >= ttl), F.col("_idx")))
    # A scan reads its input twice (local window and carry table); writing
    # the input of the dependent scan once keeps the chain from recomputing.
    r = r.checkpoint(eager=True)
    # g(s): first gap strictly after s (suffix minimum, exclusive).
    r = scan(r, ["_k"], ["_us", "_rid"], "_gap_idx", "_g", "min", inclusive=False, reverse=True)
    r = r.checkpoint(eager=True)

    # T(s) = t[s+L-1] + ttl, by an equi-join on (key, idx): unique, no skew.
    end = r.select(F.col("_k").alias("_ek"), (F.col("_idx") - (L - 1)).alias("_eidx"),
                   (F.col("_us") + ttl).alias("_T"))
    probes = (r.select("_k", "_idx").join(end, (F.col("_k") == F.col("_ek"))
                                          & (F.col("_idx") == F.col("_eidx")), "inner")
              .select("_k", F.col("_T").alias("_t"), F.lit(0).alias("_kind"),
                      F.col("_idx").alias("_pos")))
    rows = r.select("_k", F.col("_us").alias("_t"), F.lit(1).alias("_kind"),
                    F.col("_idx").alias("_pos"))
    u = probes.unionByName(rows).withColumn(
        "_rowpos", F.when(F.col("_kind") == 1, F.col("_pos")))
    # a(s): first request at or after T(s): suffix minimum over the merged order.
    uo = ["_t", "_kind", "_pos"]
    u = scan(sliced(u, ["_k"], uo), ["_k"], uo, "_rowpos", "_a", "min", inclusive=True,
             reverse=True)
    a = u.where(F.col("_kind") == 0).select(F.col("_k").alias("_ak"), F.col("_pos").alias("_apos"),
                                            "_a")
    # A request after a gap >= ttl always meets an expired counter: it is a
    # start whatever came before. So the chain only has to be followed inside
    # the segments between such gap starts: from s the next start is the gap
    # start g(s) (already known) unless a(s) comes strictly before it.
    g, a_ = F.col("_g"), F.col("_a")
    inside = (a_.isNotNull() & (g.isNull() | ((g > F.col("_idx") + (L - 1)) & (a_ < g))))
    nxt = (r.join(a, (r["_k"] == a["_ak"]) & (r["_idx"] == a["_apos"]), "left")
           .select("_k", "_idx", F.col("_gap_idx").isNotNull().alias("_gap_start"),
                   F.when(inside, a_).alias("_next")))

    starts = _follow_chain(nxt.checkpoint(eager=True))
    s = r.join(starts.withColumn("_start", F.col("_idx")), ["_k", "_idx"], "left")
    s = scan(s, ["_k"], asc, "_start", "_S", "max", inclusive=True)
    pos = F.col("_idx") - F.col("_S")
    return s.select(F.col("_k").alias(key), F.col("_ts").alias(ts), F.col("_rid").alias(rid),
                    (pos < L).alias("accepted"),
                    F.least(pos + 1, F.lit(L)).cast("int").alias("count_after"))


def _follow_chain(nxt: DataFrame) -> DataFrame:
    """Nodes (key, idx) reached from the gap starts along ``_next`` (pointer
    doubling: after round k every chain prefix of 2**(k+1) nodes is in)."""
    jump = nxt.select("_k", "_idx", F.col("_next").alias("_j")).where(F.col("_j").isNotNull())
    reached = nxt.where(F.col("_gap_start")).select("_k", "_idx")
    if jump.isEmpty():
        return reached
    while True:  # a jump doubles each round, and chains end
        hop = (reached.join(jump, ["_k", "_idx"], "inner")
               .select("_k", F.col("_j").alias("_idx")))
        reached = reached.unionByName(hop).distinct().checkpoint(eager=True)
        j2 = jump.alias("x").join(jump.alias("y"), (F.col("x._k") == F.col("y._k"))
                                  & (F.col("x._j") == F.col("y._idx")), "inner")
        jump = j2.select(F.col("x._k").alias("_k"), F.col("x._idx").alias("_idx"),
                         F.col("y._j").alias("_j")).checkpoint(eager=True)
        if jump.isEmpty():
            return reached


# ----------------------------------------------------------------- streaming
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _processor(limit: int, ttl_us: int, id_type: str):
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["client_key", "ts", "request_id", "accepted", "count_after"])
        return out.astype({"accepted": "boolean", "count_after": "Int32"})

    class Limiter(StatefulProcessor):
        """Per client key: the counter, the rows that wait for the watermark by
        their millisecond, and a timer for each such millisecond. A row is
        written once, read once when its timer fires and removed; what else the
        key holds is not touched."""

        def init(self, handle) -> None:
            self.handle = handle
            self.counter = handle.getValueState("counter", "n int, last_us long")
            self.held = handle.getMapState("held", "ms long", f"us array<long>, rid array<{id_type}>, ts array<timestamp>")

        def handleInputRows(self, key, rows, timerValues):
            late = []
            for pdf in rows:
                pdf = pdf.set_axis(["_k", "_ts", "_us", "_rid"], axis=1)  # they come by place
                behind = pdf["_us"] // 1000 < timerValues.getCurrentWatermarkInMs()
                late += [(key[0], t.to_pydatetime(), i, None, None) for t, i in zip(pdf["_ts"][behind], pdf["_rid"][behind].tolist())]
                pdf = pdf[~behind]
                for ms, part in pdf.groupby(pdf["_us"] // 1000, sort=True):
                    at = (int(ms),)
                    us, rid, ts = self.held.getValue(at) if self.held.containsKey(at) else ((), (), ())
                    self.held.updateValue(at, ([*us, *map(int, part["_us"])], [*rid, *part["_rid"].tolist()],
                                               [*ts, *(t.to_pydatetime() for t in part["_ts"])]))
                    self.handle.registerTimer(int(ms) + 1)
            return iter([frame(late)] if late else [])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            at = (expiredTimerInfo.getExpiryTimeInMs() - 1,)
            n, last = self.counter.get() if self.counter.exists() else (0, None)
            if not self.held.containsKey(at):  # the time at which a counter may have expired
                if last is not None and last + ttl_us <= timerValues.getCurrentWatermarkInMs() * 1000:
                    self.counter.clear()
                return iter([])
            out = []
            for us, rid, ts in sorted(zip(*self.held.getValue(at)), key=lambda x: x[:2]):
                if last is not None and us >= last + ttl_us:
                    n = 0
                taken = n < limit
                if taken:
                    n, last = n + 1, us
                out.append((key[0], ts, rid, taken, n))
            self.held.removeKey(at)
            self.counter.update((n, last))
            self.handle.registerTimer((last + ttl_us) // 1000 + 2)
            return iter([frame(out)])

        def close(self) -> None:
            pass

    return Limiter()


def limit_requests_stream(stream: DataFrame, key: str = "client_key", ts: str = "ts",
                          rid: str = "request_id", limit: int = REQUEST_LIMIT,
                          ttl_seconds: int = REQUEST_TTL_SECONDS,
                          lateness: str = "10 minutes") -> DataFrame:
    """Streaming limiter (append mode). ``ts`` must be a TIMESTAMP column; request
    ids are of any type with an order. Selects the state store that its kind of
    state needs."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    s = (stream.select(F.coalesce(F.col(key).cast("string"), F.lit(UNKNOWN_CLIENT)).alias("_k"),
                       F.col(ts).cast("timestamp").alias("_ts"),
                       F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"),
                       F.col(rid).alias("_rid"))
         .withWatermark("_ts", lateness))
    id_type = s.schema["_rid"].dataType.simpleString()
    out = s.groupBy("_k").transformWithStateInPandas(
        statefulProcessor=_processor(int(limit), int(ttl_seconds) * 1_000_000, id_type),
        outputStructType=f"client_key string, ts timestamp, request_id {id_type}, accepted boolean, count_after int",
        outputMode="append", timeMode="EventTime")
    return out.withColumnsRenamed({"client_key": key, "request_id": rid, "ts": ts})


def late_rows(out: DataFrame) -> DataFrame:
    """The undecided (late) rows of a limiter stream's output."""
    return out.where(F.col("accepted").isNull())


_DROPPED = "query string, batch_id long, watermark string, dropped long"


def record_dropped_rows(spark, path: str):
    """Registers and returns a listener that writes, for every batch of any
    query in which the engine dropped rows behind the watermark, how many to the
    table ``dropped_rows`` reads. A batch's entry is overwritten if it is reported
    again."""
    from pyspark.sql.streaming import StreamingQueryListener

    class DroppedRows(StreamingQueryListener):
        def onQueryStarted(self, event) -> None:
            pass

        def onQueryIdle(self, event) -> None:
            pass

        def onQueryTerminated(self, event) -> None:
            pass

        def onQueryProgress(self, event) -> None:
            p = event.progress
            n = sum(op.numRowsDroppedByWatermark for op in p.stateOperators)
            if n:
                row = [(str(p.id), p.batchId, p.eventTime.get("watermark"), n)]
                spark.createDataFrame(row, _DROPPED).coalesce(1).write.mode("overwrite").parquet(
                    f"{path}/{p.id}-{p.batchId}")

    listener = DroppedRows()
    spark.streams.addListener(listener)
    return listener


def dropped_rows(spark, path: str) -> DataFrame:
    """(query, batch_id, watermark, dropped) that ``record_dropped_rows`` wrote."""
    return spark.read.schema(_DROPPED).option("recursiveFileLookup", "true").parquet(path)
