"""Connected components by Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def components(edges: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """(node, label): for each node of the edges (a, b) the smallest node that it reaches.

    Labels spread over edges and then jump to their own label, so rounds grow with the logarithm of a path's length.
    Every round is a written table; nothing is collected but the number of changes."""
    both = ws.save(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), f"{name}_edges")
    labels = ws.save(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), f"{name}_0")
    i = 0
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near")).withColumnRenamed("a", "node")
        spread = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("new"))
        jumped = spread.join(labels.select(F.col("node").alias("new"), F.col("label").alias("far")), "new").select("node", F.least("new", "far").alias("new"), "label")
        after = ws.save(jumped, f"{name}_{i + 1}")
        changed = after.where("new <> label").limit(1).count()
        labels = after.select("node", F.col("new").alias("label"))
        ws.drop(f"{name}_{i}")
        i += 1
        if not changed:
            return labels
