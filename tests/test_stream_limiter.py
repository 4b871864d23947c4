"""The streaming limiter gives the batch result for on-time rows."""

import datetime as dt
import os
import tempfile
import time

from pyspark.sql import functions as F

from salonlake.streaming.limiter import limit_requests, limit_requests_stream
from tests.conftest import SF_SMALL


def test_stream_equals_batch(spark):
    ev = (spark.read.parquet(f"{SF_SMALL}/events.parquet")
          .select(F.col("user_id").cast("string").alias("client_key"),
                  F.col("ts").cast("timestamp").alias("ts"),
                  F.col("event_id").alias("request_id")))
    src = tempfile.mkdtemp(prefix="salonlake-lim-src-")
    cut = dt.datetime(2024, 1, 15)
    ev.where(F.col("ts") < F.lit(cut)).coalesce(1).write.mode("append").parquet(src)
    ev.where(F.col("ts") >= F.lit(cut)).coalesce(1).write.mode("append").parquet(src)
    # Two far-future rows of another key push the watermark past every real row.
    far = spark.createDataFrame([("~end", dt.datetime(2030, 1, 1), -1),
                                 ("~end", dt.datetime(2031, 1, 1), -2)],
                                "client_key string, ts timestamp, request_id long")
    far.where("request_id = -1").coalesce(1).write.mode("append").parquet(src)
    far.where("request_id = -2").coalesce(1).write.mode("append").parquet(src)

    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", "1").parquet(src)
    out = limit_requests_stream(stream, limit=2, ttl_seconds=4 * 3600, lateness="0 seconds")
    q = (out.writeStream.format("memory").queryName("lim_out").outputMode("append")
         .option("checkpointLocation", tempfile.mkdtemp(prefix="salonlake-lim-ck-"))
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = {r.request_id: r.accepted for r in spark.sql("SELECT * FROM lim_out").collect()
           if r.request_id >= 0}
    want = {r.request_id: r.accepted for r in
            limit_requests(ev, limit=2, ttl_seconds=4 * 3600).collect()}
    assert len(got) == len(want)
    assert got == want


def test_late_row_is_dropped_and_counted(spark):
    from salonlake.streaming.limiter import dropped_rows, late_rows, record_dropped_rows
    told = tempfile.mkdtemp(prefix="salonlake-late-table-")
    listener = record_dropped_rows(spark, told)
    src = tempfile.mkdtemp(prefix="salonlake-late-")
    schema = "client_key string, ts timestamp, request_id long"
    base = dt.datetime(2024, 1, 1)
    files = [
        [("a", base, 1), ("a", base + dt.timedelta(minutes=1), 2)],
        [("b", base + dt.timedelta(days=1), 3)],                 # moves the watermark
        [("a", base + dt.timedelta(minutes=2), 4)],              # late: behind the watermark
        [("z", base + dt.timedelta(days=30), 5)],
        [("z", base + dt.timedelta(days=31), 6)],
        [("a", base + dt.timedelta(minutes=3), 7)],              # behind earlier watermarks too
        [("z", base + dt.timedelta(days=32), 8)],
    ]
    for i, rows in enumerate(files):
        p = os.path.join(src, f"part{i}")
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(p)
        for f in os.listdir(p):
            os.utime(os.path.join(p, f), (1_700_000_000 + i, 1_700_000_000 + i))
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", "1")
              .option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
              .parquet(src))
    out = limit_requests_stream(stream, limit=5, ttl_seconds=3600, lateness="0 seconds")
    q = (out.writeStream.format("memory").queryName("late_out").outputMode("append")
         .option("checkpointLocation", tempfile.mkdtemp(prefix="salonlake-late-ck-"))
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    res = spark.sql("SELECT * FROM late_out")
    got = {r.request_id: r.accepted for r in res.collect()}
    assert got[1] is True and got[2] is True and got[3] is True
    assert got[4] is None and 7 not in got
    assert [r.request_id for r in late_rows(res).collect()] == [4]
    # The engine's count of the row that it dropped is in the table, once.
    end = time.time() + 60
    while not any(n.startswith(str(q.id)) for n in os.listdir(told)) and time.time() < end:
        time.sleep(0.5)
    spark.streams.removeListener(listener)
    assert [(r.query, r.dropped) for r in dropped_rows(spark, told).collect()] == [(str(q.id), 1)]


def test_request_ids_of_text_and_a_hot_key(spark):
    """Ids of another type; one key with many rows held at once, some alike in time."""
    src, schema = tempfile.mkdtemp(prefix="salonlake-hot-"), "client_key string, ts timestamp, request_id string"
    base = dt.datetime(2024, 1, 1)
    rows = [("hot", base + dt.timedelta(milliseconds=i // 3), f"r{i:04d}") for i in range(900)]
    rows += [(None, base + dt.timedelta(seconds=i), f"n{i}") for i in range(5)]
    ev = spark.createDataFrame(rows, schema)
    ev.repartition(3).write.mode("append").parquet(src)
    spark.createDataFrame([("z", base + dt.timedelta(days=9), "z0")], schema).coalesce(1).write.mode("append").parquet(src)
    spark.createDataFrame([("z", base + dt.timedelta(days=10), "z1")], schema).coalesce(1).write.mode("append").parquet(src)
    out = limit_requests_stream(spark.readStream.schema(schema).parquet(src), limit=100, ttl_seconds=1, lateness="1 hour")
    q = (out.writeStream.format("memory").queryName("hot_out").outputMode("append")
         .option("checkpointLocation", tempfile.mkdtemp(prefix="salonlake-hot-ck-")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = {r.request_id: (r.client_key, r.accepted) for r in spark.sql("SELECT * FROM hot_out").collect() if r.client_key != "z"}
    want = {r.request_id: (r.client_key, r.accepted) for r in limit_requests(ev, limit=100, ttl_seconds=1).collect()}
    assert got == want
