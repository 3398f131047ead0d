"""Graph operators over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.sources.tables import kept


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for all nodes of edges (a, b).

    Labels sink to the least of the neighbours', and each node then takes its label's label, so that the number of
    rounds goes with the logarithm of a chain's length. Each round's table is stored, which ends its lineage. Joins are
    hinted as merge joins: stored labels are small for their rows, and a broadcast a round would fill the driver.
    """
    both = kept(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a")).distinct(), "edges")
    labels = kept(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "component").hint("merge"), "other").groupBy("node").agg(F.min("component").alias("near"))
        lower = labels.join(near.hint("merge"), "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        after = kept(lower.join(up.hint("merge"), "component").select("node", F.least("component", "next").alias("component"), "was"), "labels")
        labels = after.drop("was")
        if after.filter("component <> was").isEmpty():
            return labels


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """root, node, depth: all nodes reachable from each root along (parent, child), at the least depth. Cycles end."""
    found = frontier = kept(start.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth")), "reach")
    depth = 0
    while True:
        depth += 1
        step = frontier.join(edges, frontier["node"] == edges["parent"]).select("root", F.col("child").alias("node")).distinct()
        frontier = kept(step.join(found, ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)), "reach")
        if frontier.isEmpty():
            return found.filter("depth > 0")
        found = found.union(frontier)
