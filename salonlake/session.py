"""SparkSession settings used by tests and the bench.

On a cluster the session comes from the platform; only ``ensure_checkpoint_dir``
touches it, and only when ``spark.checkpoint.dir`` is unset.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_SQL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


# Settings we would give a 1000-executor job over ~100 TB (the platform owns the
# session; these are the knobs this library's plans are designed around).
CLUSTER_CONF = {
    # AQE coalesces small shuffle partitions, converts joins to broadcast only
    # from measured runtime sizes, and splits skewed partitions of joins.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    # Start with many shuffle partitions (AQE merges them): ~100 TB / 256 MB.
    # This is also the number of slices of the skew-safe ordered scans.
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.files.maxPartitionBytes": "256m",
    # Static broadcast only for small, measured relations; explicit broadcasts
    # in this library are limited to LIMIT-bounded lists and slice carries.
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    # Runtime bloom filters prune the big side of selective joins (e.g. a
    # one-month report joining the year's facts).
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "salonlake") -> SparkSession:
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.driver.memory", "16g")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions)))
    for k, v in _SQL_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster
    (``spark.checkpoint.dir``). A local folder is set only when the session
    names none and runs on this machine alone (tests, local runs); on a
    cluster that would be one machine's disk, so there a missing folder is an
    error."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    sc = None
    try:
        sc = spark.sparkContext  # absent on Spark Connect
        d = sc.getCheckpointDir() or d
    except Exception:  # noqa: BLE001 - Connect sessions expose no SparkContext
        sc = None
    if not d:
        master = sc.master if sc is not None else ""
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        d = tempfile.mkdtemp(prefix="salonlake-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d
