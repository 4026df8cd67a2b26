"""Eligibility, balanced selection and stratified samples, without loops over rows.

A loop that always serves the group with the fewest picks is a sort: the k-th remaining
row of group g is taken at key ``(picks of g before + k - 1, g)``. A loop that serves the
stratum with the largest deficit is a sort of its slots by that slot's deficit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from areascreen.operators.pareto import frontier_flag
from areascreen.operators.ranking import band, descending_rank, group_size, is_bounded, ordinal_percentile, row_index
from areascreen.session import cut_lineage


def exclusion_reason(reasons: dict[str, Column]) -> Column:
    """Name of the first condition, in order, that excludes the row; null when eligible."""
    verdict = F.lit(None).cast("string")
    for name, test in reversed(reasons.items()):
        verdict = F.when(test, F.lit(name)).otherwise(verdict)
    return verdict


def eligible_screen(
    nodes: DataFrame, proximity: DataFrame, access: DataFrame, *, qualified: str = "qualified"
) -> DataFrame:
    """Nodes with both measures, the region and the first reason for exclusion, if any.

    Needs node_id and qualification_status; proximity gives population_proximity and region;
    access gives transit_accessibility and route_coverage_complete.
    """
    joined = nodes.join(proximity.withColumn("_p", F.lit(True)), "node_id", "left").join(
        access.withColumn("_a", F.lit(True)), "node_id", "left"
    )
    region = F.trim(F.coalesce("region", F.lit("")))
    return joined.withColumn("exclusion_reason", exclusion_reason({
        "not_qualified": ~F.col("qualification_status").eqNullSafe(F.lit(qualified)),
        "missing_screen_input": F.col("_p").isNull() | F.col("_a").isNull(),
        "missing_region": region == "",
        "incomplete_route_coverage": ~F.coalesce("route_coverage_complete", F.lit(False)),
    })).drop("_p", "_a")


def screen_score(
    eligible: DataFrame, *, weights: tuple[float, float] = (0.5, 0.5), by: Sequence[str] = ()
) -> DataFrame:
    """Ranks and percentiles of both measures, their weighted score and the two-way frontier."""
    eligible = cut_lineage(eligible)  # read by the ranks and by the frontier
    bounded = is_bounded(eligible, by)
    ranked = descending_rank(eligible, "population_proximity", "node_id", by=by, name="population_rank", bounded=bounded)
    ranked = descending_rank(ranked, "transit_accessibility", "node_id", by=by, name="accessibility_rank", bounded=bounded)
    sized = group_size(ranked, by, name="_n", bounded=bounded)
    for measure in ("population", "accessibility"):
        sized = sized.withColumn(
            f"{measure}_percentile", ordinal_percentile(F.col(f"{measure}_rank"), F.col("_n"), single=1.0)
        )
    scored = sized.withColumn(
        "screen_score",
        F.lit(weights[0]) * F.col("population_percentile") + F.lit(weights[1]) * F.col("accessibility_percentile"),
    ).drop("_n")
    return frontier_flag(scored, ["population_proximity", "transit_accessibility"], by=by, name="nondominated")


def balanced_selection(
    scored: DataFrame, *, merit_slots: int, coverage_slots: int, maximum: int, by: Sequence[str] = ()
) -> DataFrame:
    """Add selection_stage and selection_slot: merit, then regional coverage, then global fill.

    ``by`` runs independent selections side by side. Rows not selected keep null.
    """
    by = list(by)
    scored = cut_lineage(scored)  # read by every stage below
    bounded = is_bounded(scored, by)
    ranked = descending_rank(scored, "screen_score", "node_id", by=by, name="_rank", bounded=bounded)
    ordered = group_size(ranked, by, "_n", bounded=bounded)
    merit = F.least(F.lit(merit_slots), F.col("_n"))
    target = F.least(F.lit(maximum), F.col("_n"))
    coverage = F.greatest(F.lit(0), F.least(F.lit(coverage_slots), target - merit))
    staged = ordered.withColumns({"_merit": F.col("_rank") <= merit, "_merit_n": merit, "_cover_n": coverage, "_target": target})

    chosen = staged.filter("_merit").groupBy(*by, "region").agg(F.count(F.lit(1)).alias("_picked"))
    rest = staged.filter(~F.col("_merit")).join(chosen, [*by, "region"], "left")
    rest = row_index(rest, [F.col("_rank")], by=[*by, "region"], name="_k", bounded=bounded)
    rest = rest.withColumn("_turn", F.coalesce("_picked", F.lit(0)) + F.col("_k") - 1)
    rest = row_index(rest, [F.col("_turn"), F.col("region")], by=by, name="_cover", bounded=bounded)
    rest = rest.withColumn("_covered", F.col("_cover") <= F.col("_cover_n"))
    fill = row_index(rest.filter(~F.col("_covered")), [F.col("_rank")], by=by, name="_fill", bounded=bounded)
    filled = F.col("_merit_n") + F.col("_cover_n") + F.col("_fill") <= F.col("_target")

    def stage(df: DataFrame, label: Column, slot: Column) -> DataFrame:
        return df.withColumn("selection_stage", label).withColumn("selection_slot", slot.cast("bigint")).select(
            *scored.columns, "selection_stage", "selection_slot"
        )

    parts = [
        stage(staged.filter("_merit"), F.lit("merit"), F.col("_rank")),
        stage(rest.filter("_covered"), F.lit("regional_coverage"), F.col("_merit_n") + F.col("_cover")),
        stage(fill, F.when(filled, "global_shortfall_fill"), F.when(filled, F.col("_merit_n") + F.col("_cover_n") + F.col("_fill"))),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def stratified_allocation(universe: DataFrame, strata: Sequence[str], *, sample_size: int, minimum: int) -> DataFrame:
    """Population, sample count, inclusion probability and design weight per stratum.

    Every stratum starts with ``minimum``; the other slots go to the largest deficits
    ``N_s / U - j / n``. Raises when the sample cannot be drawn.
    """
    sizes = universe.groupBy(*strata).agg(F.count(F.lit(1)).alias("population_count"))
    total = sizes.agg(F.sum("population_count").alias("t"), F.count(F.lit(1)).alias("s")).first()
    if total["t"] is None or sample_size > total["t"]:
        raise ValueError("the sample exceeds the universe")
    if total["s"] * minimum > sample_size:
        raise ValueError("the minimum allocation exceeds the sample")
    # A stratum can win at most sample_size slots, so the slot table is bounded by strata x sample.
    last = F.least("population_count", F.lit(sample_size)) - 1
    slots = sizes.filter(last >= minimum).withColumn("_j", F.explode(F.sequence(F.lit(minimum), last.cast("int"))))
    deficit = F.col("population_count") / F.lit(float(total["t"])) - F.col("_j") / F.lit(float(sample_size))
    order = [F.col("_deficit").desc(), *[F.col(s) for s in strata], F.col("_j")]
    won = slots.withColumn("_deficit", deficit).orderBy(*order).limit(sample_size - total["s"] * minimum)
    extra = won.groupBy(*strata).agg(F.count(F.lit(1)).alias("_extra"))
    counted = sizes.join(extra, list(strata), "left").withColumn(
        "sample_count", F.lit(minimum).cast("bigint") + F.coalesce("_extra", F.lit(0))
    ).drop("_extra")
    return counted.withColumn("inclusion_probability", F.col("sample_count") / F.col("population_count")).withColumn(
        "design_weight", F.lit(1.0) / F.col("inclusion_probability")
    )


def outside_sample(
    eligible: DataFrame, candidates: DataFrame, *, labels: Sequence[str], sample_size: int, minimum: int, seed: str
) -> tuple[DataFrame, DataFrame]:
    """(sample, strata) of the eligible rows that are not candidates.

    Strata are region x ordinal score band. The draw takes the least SHA-256 of seed and id
    inside each stratum: reproducible, independent of input order and of cluster layout.
    """
    eligible = cut_lineage(eligible)
    bounded = is_bounded(eligible)
    ranked = group_size(descending_rank(eligible, "screen_score", "node_id", name="_rank", bounded=bounded), name="_n", bounded=bounded)
    banded = ranked.withColumn("screen_band", band(F.col("_rank"), F.col("_n"), labels)).drop("_rank", "_n")
    universe = banded.join(candidates.select("node_id"), "node_id", "left_anti")
    strata = stratified_allocation(universe, ["region", "screen_band"], sample_size=sample_size, minimum=minimum)
    draw = universe.withColumn("_draw", F.sha2(F.concat_ws("|", F.lit(seed), F.col("node_id")), 256))
    placed = row_index(draw, [F.col("_draw"), F.col("node_id")], by=["region", "screen_band"], name="_place", bounded=bounded)
    sample = placed.join(strata, ["region", "screen_band"]).filter(F.col("_place") <= F.col("sample_count"))
    stratum = F.concat_ws("|", "region", "screen_band")
    return (
        sample.withColumn("stratum_id", stratum).drop("_draw", "_place"),
        strata.withColumn("stratum_id", stratum),
    )


def selection_change(reference: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """key, change: entrant, exit or kept, comparing two selections."""
    a = reference.select(key).distinct().withColumn("_in_reference", F.lit(True))
    b = other.select(key).distinct().withColumn("_in_other", F.lit(True))
    joined = a.join(b, key, "full_outer")
    change = F.when(F.col("_in_reference").isNull(), "entrant").when(F.col("_in_other").isNull(), "exit").otherwise("kept")
    return joined.select(key, change.alias("change"))
