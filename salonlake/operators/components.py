"""Connected components by minimum labels with hooking and pointer jumping.

All state is one row per node and one per edge; each round is a handful of
equi-joins and partial aggregates, so a node with very many edges is only a
skewed join key (AQE splits it) and a partially aggregated group. The number of
rounds grows with the logarithm of the longest path, not with the path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salonlake.session import ensure_checkpoint_dir


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for ``edges`` (a, b) of text or number nodes; the
    component is the least node in it."""
    ensure_checkpoint_dir(edges.sparkSession)
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct().checkpoint(eager=True)
    label = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("_v")).select("node", F.least("node", "_v").alias("label"))
    label = label.checkpoint(eager=True)
    while True:
        # Each node's least label around it; told to the node and to its label.
        near = both.join(label.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("low"))
        seen = label.join(near, label["node"] == near["u"], "left").select("node", "label", F.least("label", "low").alias("low"))
        told = seen.select("node", "low").unionByName(seen.select(F.col("label").alias("node"), "low")).groupBy("node").agg(
            F.min("low").alias("low"))
        jump = told.select(F.col("node").alias("_n"), F.col("low").alias("_far"))
        new = told.join(jump, told["low"] == jump["_n"], "left").select("node", F.least("low", "_far").alias("label"))
        new = new.checkpoint(eager=True)
        changed = new.join(label.withColumnRenamed("label", "_old"), "node").where("label <> _old")
        if changed.isEmpty():
            return new.select("node", F.col("label").alias("component"))
        label = new
