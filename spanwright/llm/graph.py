"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ._shared import materialise


def components(links: DataFrame) -> DataFrame:
    """node, label (smallest node reachable) of every node in ``links`` (a, b), which is undirected.

    Every round takes the smallest label among a node's neighbours, then follows
    labels of labels; both steps aggregate before they shuffle. It ends when no label changes.
    """
    pairs = links.select("a", "b").where("a <> b")
    edges = materialise(pairs.union(pairs.select("b", "a")).distinct(), "cc-edges")
    labels = materialise(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "cc-labels")
    while True:
        other = labels.select(F.col("node").alias("b"), F.col("label").alias("near"))
        near = edges.join(other, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("before"), F.least("label", "near").alias("label"))
        far = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        moved = lower.join(far, "label", "left").select("node", "before", F.least("label", F.coalesce("far", "label")).alias("label"))
        change = Observation()
        moved = materialise(moved.observe(change, F.count_if(F.col("label") < F.col("before")).alias("moved")), "cc-labels")
        labels = moved.select("node", "label")
        if not change.get["moved"]:
            return labels
