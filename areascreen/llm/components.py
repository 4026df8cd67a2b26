"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from areascreen.llm.common import materialise


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label: the smallest node of its component, for every node of an edge.

    Every round takes the smallest label of the neighbours and then the label of that label, so chains shorten fast.
    Rounds are written tables; only the number of changed nodes comes to the driver. No edges give no rows.
    """
    pairs = edges.select(F.col(a).alias("node"), F.col(b).alias("other"))
    pairs = materialise(pairs.union(pairs.select(F.col("other").alias("node"), F.col("node").alias("other"))).filter("node != other").distinct())
    labels = materialise(pairs.groupBy("node").agg(F.least("node", F.min("other")).alias("label")))
    while True:
        reached = pairs.join(labels.select(F.col("node").alias("other"), F.col("label").alias("near")), "other").groupBy("node").agg(F.min("near").alias("near"))
        lower = labels.join(reached, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        moved = materialise(lower.join(jump, "label").select("node", "old", F.least("label", "next").alias("label")))
        changed = moved.agg(F.count_if(F.col("old") != F.col("label"))).first()[0]
        labels = moved.select("node", "label")
        if not changed:
            return labels
