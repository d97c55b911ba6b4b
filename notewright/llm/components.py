"""Connected components of an edge table: least label of the neighbours, then the label's own label, until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(v, label) for every vertex of the edges (a, b); label is the least vertex of its component.

    Rounds grow with the logarithm of the longest chain. Each round is cut with checkpoint(); nothing but a count reaches the driver.
    """
    both = edges.select("a", "b").filter("a <> b")
    both = cut_lineage(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("label"))
    labels = cut_lineage(labels)
    while True:
        near = both.join(labels, F.col("b") == F.col("v")).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, F.col("v") == F.col("a")).select("v", "label", F.least("label", "near").alias("lower"))
        jump = labels.select(F.col("v").alias("w"), F.col("label").alias("far"))
        moved = lower.join(jump, F.col("lower") == F.col("w"), "left").select("v", "label", F.least("lower", "far").alias("new"))
        moved = cut_lineage(moved)
        changed = moved.filter("new <> label").limit(1).count()
        labels = moved.select("v", F.col("new").alias("label"))
        if not changed:
            return labels
