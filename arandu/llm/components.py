"""Connected components of an undirected graph, as joins over tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node reachable) for each node that an edge names.

    Each round takes the smallest label among a node and its neighbours, then the label of that label, so that chains
    halve. Labels are stored after each of the two steps: a hot node's rows then sit on a plain side of a join, which
    adaptive execution can split. No edges give no rows; null ends are left out.
    """
    edges = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null")
    both = stored(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "cc-edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "cc-labels")
    while True:
        told = both.join(labels, both["a"] == labels["node"]).select(F.col("b").alias("node"), F.col("label"), F.lit(None).cast("long").alias("was"))
        own = labels.select("node", "label", F.col("label").alias("was"))
        near = stored(told.unionByName(own).groupBy("node").agg(F.min("label").alias("label"), F.max("was").alias("was")), "cc-near")
        up = near.select(F.col("node").alias("up"), F.col("label").alias("over"))
        far = near.join(up, near["label"] == up["up"], "left").select("node", F.least("label", "over").alias("label"), "was")
        far = stored(far, "cc-far")
        changed = far.where("label <> was").limit(1).count()
        drop_stored(near, labels)
        labels = far
        if not changed:
            drop_stored(both)
            return labels.select("node", F.col("label").alias("component"))
