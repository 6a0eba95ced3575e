"""Connected components of an edge table, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.plans.staging import stage, unstage


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is its smallest node.

    Each round hands the smallest label over every edge and then replaces each label by its
    own label (pointer jumping), so rounds grow with the logarithm of the longest chain.
    Minima combine before the shuffle; a node with very many edges is only a join key there,
    which adaptive execution may split.  Labels stand in staged tables between the rounds.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stage(both.where("a <> b").distinct(), "cc-edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")), "cc")
    while True:
        sent = both.join(labels.select(F.col("node").alias("a"), "component"), "a").select(F.col("b").alias("node"), "component")
        met = labels.union(sent).groupBy("node").agg(F.min("component").alias("component"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("top"))
        new = stage(
            met.join(up, "component", "left").join(labels.withColumnRenamed("component", "old"), "node")
            .select("node", F.least("component", "top").alias("component"), "old"),
            "cc",
        )
        moved = new.where("component <> old").limit(1).count()
        unstage(labels)
        labels = new.select("node", "component")
        if not moved:
            unstage(both)
            return labels
