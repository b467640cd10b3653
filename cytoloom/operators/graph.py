"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoloom.runtime import cut, free


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): the least node that links lead to. ``edges`` has a and b, in any direction; nodes without
    edges keep themselves. Each round a node takes the least label among its neighbours and then that label's own
    label, so that chains shorten geometrically; each round is written to the shared folder. Loops, repeated edges
    and an empty edge table are fine."""
    e = edges.where("a <> b").select("a", "b")
    e = cut(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(e.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")))
    while label.limit(1).count():
        near = e.join(label, e.b == label.node).groupBy("a").agg(F.min("label").alias("m"))
        was = label
        step = label.join(near, label.node == near.a, "left").select("node", F.least("label", F.coalesce("m", "label")).alias("label"), F.col("label").alias("was"))
        up = label.select(F.col("node").alias("n2"), F.col("label").alias("l2"))
        step = cut(step.join(up, step.label == up.n2, "left").select("node", F.least("label", F.coalesce("l2", "label")).alias("label"), "was"))
        free(was)
        label = step.select("node", "label")
        label._cut_path = step._cut_path  # the same table
        if not step.where("label <> was").limit(1).count():
            break
    return nodes.join(label, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
