"""How the choice of a threshold changes the selection and the ranking.

The threshold is a column: all thresholds run side by side in one pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from areascreen.operators.selection import balanced_selection, screen_score
from areascreen.plans.decision import evaluate, robustness, with_competition
from areascreen.session import cut_lineage


def threshold_selections(
    screen: DataFrame, *, merit_slots: int, coverage_slots: int, maximum: int
) -> DataFrame:
    """Balanced selection per threshold of eligible rows (threshold, node_id, measures, region)."""
    scored = screen_score(screen, by=["threshold"])
    return balanced_selection(
        scored, merit_slots=merit_slots, coverage_slots=coverage_slots, maximum=maximum, by=["threshold"]
    )


def selection_changes(selected: DataFrame, reference: str) -> DataFrame:
    """threshold, node_id, change against the reference threshold: entrant, exit or kept."""
    selected = cut_lineage(selected.select("threshold", "node_id"))
    fixed = selected.filter(F.col("threshold") == reference).select("node_id").withColumn("_fixed", F.lit(True))
    thresholds = selected.select("threshold").distinct()
    every = thresholds.agg(F.collect_set("threshold").alias("t"))  # one entry per threshold of the audit
    expected = fixed.withColumn("threshold", F.explode(every.scalar()))
    joined = selected.select("threshold", "node_id").withColumn("_now", F.lit(True)).join(
        expected, ["threshold", "node_id"], "full_outer"
    )
    change = F.when(F.col("_fixed").isNull(), "entrant").when(F.col("_now").isNull(), "exit").otherwise("kept")
    return joined.select("threshold", "node_id", change.alias("change"))


def rerank(cells: DataFrame, competition: DataFrame, *, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(results, status): robustness of every group whose nodes all have competition counts.

    A group with a node lacking them is listed as unavailable and not ranked.
    """
    joined = cut_lineage(with_competition(cells, competition, by=by))
    status = joined.groupBy(*by).agg(F.first("status").alias("status"), F.first("missing_nodes").alias("missing_nodes"))
    complete = joined.filter("status = 'complete'").drop("status", "missing_nodes")
    return robustness(evaluate(complete, by=by), by=by), status


def both_sets(screen: DataFrame, selected: DataFrame, reference: str) -> DataFrame:
    """The measures of two sets of nodes under every threshold, told apart by ``node_set``.

    ``fixed`` is the set selected at the reference threshold, carried through all thresholds; ``alternative`` is what
    each threshold selects itself. ``screen`` has the measures of all eligible nodes under every threshold.
    """
    fixed = selected.filter(F.col("threshold") == reference).select("node_id").distinct()
    kept = screen.join(fixed, "node_id").withColumn("node_set", F.lit("fixed"))
    own = screen.join(selected.select("threshold", "node_id").distinct(), ["threshold", "node_id"]).withColumn("node_set", F.lit("alternative"))
    return kept.unionByName(own)
