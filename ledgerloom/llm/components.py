"""Connected components of an edge table, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.runtime import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); a component is named by its smallest node.

    Each round gives a node the smallest label among its neighbours' and then that label's own label (pointer jumping), so
    rounds grow with the logarithm of the longest path. Labels lie in written tables between rounds.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = materialise(both, "cc-edges")
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "cc")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b").hint("merge"), "b").groupBy("a").agg(F.min("component").alias("m"))
        lower = labels.join(near.withColumnRenamed("a", "node").hint("merge"), "node").select("node", F.least("component", "m").alias("new"), F.col("component").alias("old"))
        lower = materialise(lower, "cc")
        if lower.where("new <> old").isEmpty():
            return lower.select("node", F.col("new").alias("component"))
        jump = lower.select(F.col("node").alias("new"), F.col("new").alias("next"))
        labels = materialise(lower.join(jump.hint("merge"), "new").select("node", F.col("next").alias("component")), "cc")
