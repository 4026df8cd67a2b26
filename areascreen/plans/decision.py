"""Robust decision over a grid of access cases, competition cases and weight profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from areascreen.functions.finance import competition_value
from areascreen.operators.pareto import frontier_flag
from areascreen.operators.ranking import average_percentile, is_bounded, row_index
from areascreen.operators.skew import null_safe_join
from areascreen.session import cut_lineage

#: Competition case, walking minutes, zero-confirmed caution.
COMPETITION_CASES = [
    ("confirmed_10_min", 10, False),
    ("confirmed_15_min", 15, False),
    ("zero_confirmed_caution_10_min", 10, True),
    ("zero_confirmed_caution_15_min", 15, True),
]
OBSERVED_CASES = ["confirmed_10_min", "confirmed_15_min"]

#: Weights of demand, access, competition and finance.
PROFILES = {
    "balanced": (0.25, 0.25, 0.25, 0.25),
    "demand_led": (0.4, 0.2, 0.2, 0.2),
    "accessibility_led": (0.2, 0.4, 0.2, 0.2),
    "competition_led": (0.2, 0.2, 0.4, 0.2),
    "finance_led": (0.2, 0.2, 0.2, 0.4),
}
#: Finance does not tell nodes apart: a constant score.
FINANCE_SCORE = 0.5


def _competition_cases() -> Column:
    return F.explode(F.array(*[
        F.struct(
            F.lit(name).alias("competition_case"),
            competition_value(F.col(f"confirmed_{minutes}"), zero_caution=caution).alias("competition"),
        )
        for name, minutes, caution in COMPETITION_CASES
    ]))


def evaluate(cells: DataFrame, *, by: Sequence[str], profiles: dict[str, tuple] | None = None) -> DataFrame:
    """Rank every node in every evaluation.

    ``cells`` has one row per (by, node_id) with demand, accessible, confirmed_10 and
    confirmed_15. Scores and frontiers are computed at the grain they depend on, before the
    profiles multiply the rows. Ranks run over all nodes, the top three over frontier nodes.
    """
    profiles = profiles or PROFILES
    by = list(by)
    cells = cut_lineage(cells)
    bounded = is_bounded(cells, by)
    scored = average_percentile(cells, "demand", "node_id", by=by, name="demand_score", bounded=bounded)
    scored = average_percentile(scored, "accessible", "node_id", by=by, name="access_score", bounded=bounded)
    cases = scored.withColumn("_case", _competition_cases()).select("*", "_case.*").drop("_case")
    group = [*by, "competition_case"]
    cases = average_percentile(
        cases, "competition", "node_id", by=group, higher_is_better=False, name="competition_score", bounded=bounded
    ).withColumn("_relief", -F.col("competition"))
    cases = frontier_flag(cases, ["demand", "accessible", "_relief"], by=group)
    weights = F.explode(F.array(*[
        F.struct(F.lit(name).alias("profile"), *[F.lit(float(w)).alias(f"w{i}") for i, w in enumerate(values)])
        for name, values in profiles.items()
    ]))
    runs = cases.withColumn("_w", weights).select(
        *group, F.col("_w.profile").alias("profile"), "node_id", "on_frontier",
        (
            F.col("_w.w0") * F.col("demand_score") + F.col("_w.w1") * F.col("access_score")
            + F.col("_w.w2") * F.col("competition_score") + F.col("_w.w3") * F.lit(FINANCE_SCORE)
        ).alias("score"),
    )
    run = [*group, "profile"]
    ranked = row_index(runs, [F.col("score").desc(), F.col("node_id")], by=run, bounded=bounded)
    # row_number() <= 3 keeps three rows per map task, so no group is gathered whole.
    place = F.row_number().over(Window.partitionBy(*run).orderBy("rank"))
    top = ranked.filter("on_frontier").withColumn("_place", place).filter("_place <= 3").select(
        *run, "node_id", F.lit(True).alias("selected")
    )
    return ranked.join(top, [*run, "node_id"], "left").withColumn("selected", F.coalesce("selected", F.lit(False)))


def robustness(runs: DataFrame, *, by: Sequence[str] = (), profiles: int = len(PROFILES)) -> DataFrame:
    """Per node: how often it is selected and on the frontier, and its rank distribution."""
    first_profile = F.col("profile") == next(iter(PROFILES))
    observed = F.col("competition_case").isin(OBSERVED_CASES)
    totals = runs.groupBy(*by, "node_id").agg(
        F.count(F.lit(1)).alias("evaluations"),
        F.count_if("selected").alias("selection_count"),
        F.count_if(F.col("selected") & observed).alias("observed_count"),
        F.count_if(F.col("selected") & ~observed).alias("caution_count"),
        F.count_if(F.col("on_frontier") & first_profile).alias("pareto_count"),
        F.median("rank").alias("median_rank"), F.min("rank").alias("best_rank"), F.max("rank").alias("worst_rank"),
    )
    half = F.col("evaluations") / 2
    return totals.withColumns({
        "top_three_frequency": F.col("selection_count") / F.col("evaluations"),
        "observed_frequency": F.col("observed_count") / half,
        "caution_frequency": F.col("caution_count") / half,
        "pareto_frequency": F.col("pareto_count") * profiles / F.col("evaluations"),
    })


def unique_orderings(runs: DataFrame, *, by: Sequence[str]) -> DataFrame:
    """One row: evaluations and distinct full rank orderings.

    An ordering is told apart by a 128-bit order-free digest of its (rank, node) pairs, so no
    ordering is ever gathered in one place.
    """
    pair = [F.col("rank"), F.col("node_id")]
    digests = runs.groupBy(*by, "competition_case", "profile").agg(
        F.bit_xor(F.xxhash64(*pair)).alias("a"), F.bit_xor(F.xxhash64(F.lit("second"), *pair)).alias("b")
    )
    return digests.agg(
        F.count(F.lit(1)).alias("evaluations"), F.countDistinct("a", "b").alias("unique_orderings")
    )


def recommend(results: DataFrame, *, recommendations: int = 3, watch: int = 2) -> DataFrame:
    """Add overall order, and a list with position: recommended or recheck, else null.

    Recommended nodes are selected under both treatments of zero counts; fewer than the
    limit are reported as they are. Nodes selected under one treatment only are rechecks.
    """
    order = [F.col("selection_count").desc(), F.col("median_rank"), F.col("worst_rank"), F.col("node_id")]
    robust = (F.col("observed_count") > 0) & (F.col("caution_count") > 0)
    listed = row_index(results, order, name="position").withColumn(
        "_list", F.when(robust, "recommended").when(F.col("selection_count") > 0, "recheck")
    )
    # Only the few rows that make a list are numbered; a limit per list is the feature.
    heads = None
    for name, limit in (("recommended", recommendations), ("recheck", watch)):
        head = listed.filter(F.col("_list") == name).orderBy("position").limit(limit).select(
            "node_id", F.lit(name).alias("list_name"),
            F.row_number().over(Window.orderBy("position")).alias("list_rank"),
        )
        heads = head if heads is None else heads.unionByName(head)
    return listed.drop("_list").join(heads, "node_id", "left")


def with_competition(cells: DataFrame, competition: DataFrame, *, by: Sequence[str]) -> DataFrame:
    """Join competition counts; groups with a node lacking them become unavailable.

    Missing counts are never taken as zero: ``status`` marks the whole group.
    """
    joined = cells.join(competition, "node_id", "left")
    missing = joined.groupBy(*by).agg(F.count_if(F.col("confirmed_10").isNull()).alias("missing_nodes"))
    return joined.join(missing, list(by)).withColumn(
        "status", F.when(F.col("missing_nodes") > 0, "unavailable_missing_competition").otherwise("complete")
    )


def combine_days(results: DataFrame, *, by: Sequence[str], day: str, days: Sequence[str]) -> DataFrame:
    """Add the selection counts of a node's days, with a status per group of ``by``.

    A group in which a day of ``days`` was not ranked is one row with null counts and the status
    ``unavailable_missing_day``. In the others, nodes ranked on every day are combined.
    """
    wanted = results.filter(F.col(day).isin(*days))
    held = results.groupBy(*by).agg(F.countDistinct(F.when(F.col(day).isin(*days), F.col(day))).alias("_held"))
    complete = held.filter(F.col("_held") == len(days)).drop("_held")
    combined = null_safe_join(wanted, complete, by, "left_semi").groupBy(*by, "node_id").agg(
        F.sum("selection_count").alias("selection_count"), F.sum("observed_count").alias("observed_count"),
        F.sum("caution_count").alias("caution_count"), F.countDistinct(day).alias("_days"),
    ).filter(F.col("_days") == len(days)).drop("_days").withColumn("status", F.lit("combined"))
    missing = held.filter(F.col("_held") < len(days)).drop("_held").withColumn("status", F.lit("unavailable_missing_day"))
    return combined.unionByName(missing, allowMissingColumns=True)


def rank_movement(left: DataFrame, right: DataFrame, *, key: str = "node_id") -> DataFrame:
    """key, left_rank, right_rank, movement and its direction, between two rankings."""
    joined = left.select(key, F.col("rank").alias("left_rank")).join(
        right.select(key, F.col("rank").alias("right_rank")), key
    )
    movement = F.col("left_rank") - F.col("right_rank")
    return joined.withColumn("movement", movement).withColumn(
        "direction", F.when(F.col("movement") > 0, "up").when(F.col("movement") < 0, "down").otherwise("same")
    )
