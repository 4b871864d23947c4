"""Stored tables: fixed-schema Parquet scans, versioned snapshots, append
logs and report output.

Snapshots are immutable version folders ``<root>/<table>/v=<n>``; a version
is visible once its ``_SUCCESS`` marker exists (Spark writes it at job
commit), so readers never see a half-written version and a writer never
overwrites the folder it reads from. Replaying a write of a version that
already committed is a no-op.

Inside a version rows lie in buckets, ``k=<bucket>``: months of the date that
reports filter on, or else shares of the ids. A whole version (``v=<n>``) has all
buckets; a change (``v=<n>~``) has those that a batch touched, and the others are
read from where they were last written. So a batch writes in proportion to the
buckets it touches; after ``WHOLE_EVERY`` changes a whole version is written.

A batch of changes that writes several tables and logs gives its name to all
it writes (``v=<n>@<batch>``, ``log/batch=<batch>``), and readers skip folders of
a batch until its marker ``<root>/_batches/<batch>`` is there. The marker is
renamed into place after the last write, so readers see all of a batch or
nothing; what a failed attempt left is never visible and is overwritten by the
next one. A table is written by one running query at a time.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salonlake.schemas import TABLES

#: Folder of the markers, one for each whole batch.
BATCHES = "_batches"
#: Ends the number of a version that has only the buckets a batch touched.
_CHANGE = "~"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    fs, p = _fs(spark, path)
    return [st.getPath().getName() for st in fs.listStatus(p)] if fs.exists(p) else []


def batch_done(spark: SparkSession, root: str, batch: str) -> bool:
    return _exists(spark, f"{root}/{BATCHES}/{batch}")


def commit_batch(spark: SparkSession, root: str, batch: str, note: dict) -> None:
    """Makes all that ``batch`` wrote visible, with one rename."""
    fs, done = _fs(spark, f"{root}/{BATCHES}/{batch}")
    _, held = _fs(spark, f"{root}/{BATCHES}/.{batch}-{uuid.uuid4().hex}")
    out = fs.create(held, True)
    out.write(bytearray(json.dumps(note, sort_keys=True).encode()))
    out.close()
    if not fs.rename(held, done) and not fs.exists(done):
        raise OSError(f"the marker of {batch} could not be written under {root}")


def batch_note(spark: SparkSession, root: str, batch: str) -> dict:
    """What ``commit_batch`` noted."""
    return json.loads(spark.read.option("wholetext", "true").text(f"{root}/{BATCHES}/{batch}").first().value)


def _versions(spark: SparkSession, root: str, table: str) -> dict[int, str]:
    """Folder of each visible version."""
    names = [n for n in _names(spark, f"{root}/{table}") if n.startswith("v=")]
    done = set(_names(spark, f"{root}/{BATCHES}")) if any("@" in n for n in names) else set()
    out: dict[int, str] = {}
    for name in names:
        number, _, batch = name[2:].partition("@")
        number = number.rstrip(_CHANGE)
        if (batch and batch not in done) or not _exists(spark, f"{root}/{table}/{name}/_SUCCESS"):
            continue
        if int(number) in out:
            raise RuntimeError(f"two writers made version {number} of {table}: {out[int(number)]}, {name}")
        out[int(number)] = name
    return out


def committed_versions(spark: SparkSession, root: str, table: str) -> list[int]:
    return sorted(_versions(spark, root, table))


def _buckets(spark: SparkSession, root: str, table: str, version: int | None = None) -> tuple[dict[str, str], int]:
    """Where each bucket of a version was last written, and how many changes
    came after the last whole version."""
    found = _versions(spark, root, table)
    if not found or (version is not None and version not in found):
        raise FileNotFoundError(f"no committed version {'' if version is None else version} of {table} under {root}")
    out: dict[str, str] = {}
    changes = 0
    for n in sorted((n for n in found if version is None or n <= version), reverse=True):
        folder = f"{root}/{table}/{found[n]}"
        names = _names(spark, folder)
        for name in names:
            if name.startswith("k="):
                out.setdefault(name[2:], f"{folder}/{name}")
            elif name.endswith(".parquet"):
                raise RuntimeError(f"{folder} has rows outside buckets: write it again with write_snapshot")
        if not found[n].partition("@")[0].endswith(_CHANGE):
            return out, changes
        changes += 1
    raise FileNotFoundError(f"no whole version of {table} under {root}")


def load(spark: SparkSession, root: str, table: str, version: int | None = None, bucket: str | None = None) -> DataFrame:
    """Scan a stored table with its fixed schema (latest committed version
    unless ``version`` is given). Column pruning and filter pushdown reach
    the Parquet reader. ``bucket`` names a column for the bucket of each row,
    by which Spark prunes folders."""
    paths = sorted(_buckets(spark, root, table, version)[0].values())
    schema = TABLES[table]
    columns = [F.col(c) for c in schema.fieldNames()] + ([F.col("k").alias(bucket)] if bucket else [])
    if not paths:
        out = spark.createDataFrame([], schema)
        return out.withColumn(bucket, F.lit(None).cast("string")) if bucket else out
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("k", T.StringType())])).option(
        "basePath", f"{root}/{table}").parquet(*paths)
    return rows.select(*columns)


# Column each stored table is clustered on: files and row groups hold narrow
# ranges of it, so the period filters that reports push into the Parquet scan
# skip most of the table (min/max statistics), without a partition column.
CLUSTER_BY = {
    "appointments": "appointment_date",
    "transactions": "date",
    "inventory_changes": "created_at",
}


#: Buckets of a table that has no date to cluster on, and changes between whole versions.
ID_BUCKETS, WHOLE_EVERY = 64, 50


def bucket_of(table: str) -> Column:
    """The bucket of a row: a month, or a share of the ids."""
    date = CLUSTER_BY.get(table)
    own = F.date_format(date, "yyyy-MM") if date else F.lpad(F.pmod(F.xxhash64("id"), F.lit(ID_BUCKETS)).cast("string"), 2, "0")
    return F.coalesce(own, F.lit("none"))


def _typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns
                       else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])


def _write_buckets(df: DataFrame, table: str, path: str) -> None:
    key = CLUSTER_BY.get(table, "id")
    out = df.withColumn("k", bucket_of(table))
    out = out.repartitionByRange("k", key, "id").sortWithinPartitions("k", key, "id")
    out.write.mode("overwrite").partitionBy("k").parquet(path)


def write_snapshot(df: DataFrame, root: str, table: str, version: int, batch: str | None = None) -> bool:
    """Write ``df`` as whole version ``version`` of ``table``; returns False (and
    writes nothing) when that version already committed (replay). As part of
    ``batch`` it is visible once the batch is committed, and overwrites what a
    failed attempt of the batch left."""
    spark = df.sparkSession
    path = f"{root}/{table}/v={version}" + (f"@{batch}" if batch else "")
    if batch is None and _exists(spark, f"{path}/_SUCCESS"):
        return False
    _write_buckets(_typed(df, TABLES[table]), table, path)
    return True


def write_change(df: DataFrame, root: str, table: str, version: int, batch: str, touched: DataFrame, bucket: str) -> list[str]:
    """Write the buckets of ``df`` that hold, or held, a row whose id is in
    ``touched`` (id), as version ``version`` within ``batch``; returns them.
    ``df`` comes from ``load(..., bucket=bucket)`` rows, and new rows without a
    bucket: the filter on it prunes the folders that are read."""
    spark = df.sparkSession
    held, changes = _buckets(spark, root, table)
    rows = df.withColumn("_new_k", bucket_of(table))
    mine = rows.join(touched.select("id").distinct(), "id", "left_semi")
    old = load(spark, root, table, bucket="_k").join(touched.select("id").distinct(), "id", "left_semi")
    # Names of buckets: months, or at most ID_BUCKETS shares.
    names = sorted(r.k for r in mine.select(F.col("_new_k").alias("k")).union(old.select("_k")).distinct().collect())
    if changes + 1 >= WHOLE_EVERY:
        write_snapshot(df, root, table, version, batch)
        return names
    path = f"{root}/{table}/v={version}{_CHANGE}@{batch}"
    some = rows.where(F.col(bucket).isNull() | F.col(bucket).isin(names))
    _write_buckets(_typed(some, TABLES[table]), table, path)
    fs, _ = _fs(spark, path)
    for name in names:  # a bucket that has lost its last row
        fs.mkdirs(_fs(spark, f"{path}/k={name}")[1])
    return names


#: Log folder of rows that come outside change batches (those count from 1).
APPENDED = 0


def append(df: DataFrame, root: str, table: str) -> None:
    """Append rows to a log table (e.g. the stock change log)."""
    _typed(df, TABLES[table]).write.mode("append").parquet(f"{root}/{table}/log/batch={APPENDED}")


def write_log_batch(df: DataFrame, root: str, table: str, batch: int | str, schema: T.StructType | None = None) -> None:
    """Log rows of one change batch, written idempotently: a replay of the
    batch overwrites its own folder instead of appending twice. Under the name
    of a batch they are visible once it is committed."""
    _typed(df, schema or TABLES[table]).write.mode("overwrite").parquet(f"{root}/{table}/log/batch={batch}")


def load_log(spark: SparkSession, root: str, table: str, schema: T.StructType | None = None) -> DataFrame:
    """All rows of a log, appended ones and those of committed change batches."""
    schema = schema or TABLES[table]
    names = [n for n in _names(spark, f"{root}/{table}/log") if n.startswith("batch=")]
    done = set(_names(spark, f"{root}/{BATCHES}"))
    paths = [f"{root}/{table}/log/{n}" for n in names if n[6:].isdigit() or n[6:] in done]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*paths).select(*schema.fieldNames())


def write_report(results: DataFrame, path: str, kind: str, start: dt.date, end: dt.date, generated_at: dt.datetime) -> None:
    """Report output as JSON: the result rows are written by the executors as
    JSON lines under ``results/``; the envelope (type, period, summary, row
    count, generation time) is one JSON row under ``envelope/``. The totals and
    the count are observed by the job that writes the rows, so the report is
    computed once."""
    seen = Observation()
    totals = [c for c in ("income", "expense", "profit") if c in results.columns]
    results.observe(seen, F.count(F.lit(1)).alias("count"), *[F.sum(F.coalesce(c, F.lit(0.0))).alias(c) for c in totals]).write.mode(
        "overwrite").json(f"{path}/results")
    told = seen.get
    income, expense, profit = (float(told.get(c) or 0.0) for c in ("income", "expense", "profit"))
    envelope = {
        "reportType": kind, "period": {"startDate": start.isoformat(), "endDate": end.isoformat()},
        "summary": {"revenue": {"totalIncome": income, "totalExpense": expense, "netProfit": profit},
                    "counts": {"totalRecords": told["count"]}},
        "count": told["count"], "generatedAt": generated_at.isoformat()}
    spark = results.sparkSession
    spark.createDataFrame([(json.dumps(envelope),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/envelope")


def envelope_json(spark: SparkSession, path: str) -> dict:
    """Read back the (one-row) envelope."""
    row = spark.read.json(f"{path}/envelope").first()
    return json.loads(json.dumps(row.asDict(recursive=True), default=str))
