"""Accessibility of nodes from trip outcomes with an explicit fallback chain.

A trip is reached by public transport when that succeeded within the threshold; only
when it gave no route or an unusable answer does the walking outcome count, and only
when that walk also failed does straight-line proximity count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from areascreen.operators.ranking import average_rank, exact_median, is_bounded
from areascreen.operators.stats import null_if_constant
from areascreen.session import cut_lineage

#: Fixed vocabularies of outcome categories.
WALK_FALLBACK_CATEGORIES = ["missing_route", "invalid_response"]
FINAL_WALK_CATEGORIES = ["success", "missing_route", "http_error", "invalid_response"]

Case = tuple[str, int, int, bool]


#: Sums that differ relatively by no more than this are one rank: rounding must not part them.
TIE = 1e-9


def threshold_cases(pt_minutes: int, walk_minutes: int, pt_variants: Sequence[int], walk_variants: Sequence[int]) -> list[Case]:
    """The primary case and one-way variations of either threshold; ids must be unique."""
    cases: list[Case] = [(f"pt{pt_minutes}_walk{walk_minutes}_primary", pt_minutes, walk_minutes, True)]
    cases += [(f"pt{value}_walk{walk_minutes}", value, walk_minutes, False) for value in pt_variants]
    cases += [(f"pt{pt_minutes}_walk{value}", pt_minutes, value, False) for value in walk_variants]
    if len({case[0] for case in cases}) < len(cases):
        raise ValueError("threshold case ids are not unique")
    return cases


def case_column(cases: Sequence[Case]) -> Column:
    """The cases as an array literal: exploding it needs no join."""
    return F.array(*[
        F.struct(
            F.lit(case_id).alias("threshold_case_id"), F.lit(pt).alias("pt_minutes"),
            F.lit(walk).alias("walk_minutes"), F.lit(primary).alias("is_primary"),
        )
        for case_id, pt, walk, primary in cases
    ])


def outcomes_by_trip(outcomes: DataFrame) -> DataFrame:
    """One row per trip with the public-transport and walking outcome side by side."""
    pt, walk = F.col("method") == "pt", F.col("method") == "walk"
    return outcomes.groupBy("od_plan_id").agg(
        F.count_if(pt).alias("pt_rows"), F.count_if(walk).alias("walk_rows"),
        F.max(F.when(pt, F.col("category"))).alias("pt_category"),
        F.max(F.when(pt, F.col("duration_seconds"))).alias("pt_seconds"),
        F.max(F.when(walk, F.col("category"))).alias("walk_category"),
        F.max(F.when(walk, F.col("duration_seconds"))).alias("walk_seconds"),
    )


def resolve_outcomes(plan: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Plan rows with their outcomes; the walk is consulted only where it is the fallback."""
    joined = plan.join(outcomes_by_trip(outcomes), "od_plan_id", "left")
    fallback = F.col("pt_category").isin(WALK_FALLBACK_CATEGORIES)
    return joined.withColumn("needs_walk", F.coalesce(fallback, F.lit(False))).withColumns({
        "walk_category": F.when(F.col("needs_walk"), F.col("walk_category")),
        "walk_seconds": F.when(F.col("needs_walk"), F.col("walk_seconds")),
    })


#: Name of a rule and the condition under which a resolved row breaks it.
def outcome_rules() -> dict[str, Column]:
    pt, walk = F.col("pt_category"), F.col("walk_category")
    return {
        "duplicate_outcome": (F.col("pt_rows") > 1) | (F.col("walk_rows") > 1),
        "missing_pt_outcome": pt.isNull(),
        "non_final_pt_outcome": pt.isNotNull() & ~pt.isin("success", *WALK_FALLBACK_CATEGORIES),
        "missing_walk_outcome": F.col("needs_walk") & walk.isNull(),
        "non_final_walk_outcome": walk.isNotNull() & ~walk.isin(FINAL_WALK_CATEGORIES),
    }


def outcome_violations(resolved: DataFrame) -> DataFrame:
    """rule, violations: how many resolved rows break each completeness rule."""
    rules = outcome_rules()
    counts = resolved.agg(*[F.count_if(broken).alias(rule) for rule, broken in rules.items()])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.col(rule).alias("violations")) for rule in rules
    ])))


def national_population(plan: DataFrame) -> DataFrame:
    """One row: distinct origins, their population and how many carry differing values."""
    per_origin = plan.groupBy("origin_id").agg(
        F.min("population").alias("low"), F.max("population").alias("high")
    )
    scale = F.greatest(F.abs("low"), F.abs("high"))
    return per_origin.agg(
        F.count(F.lit(1)).alias("origin_count"), F.sum("low").alias("national_population"),
        F.count_if(F.col("high") - F.col("low") > scale * 1e-9).alias("inconsistent_origin_count"),
    )


def coverage_completeness(plan: DataFrame) -> DataFrame:
    """Per node and scenario: origins present, origins expected, whether complete."""
    expected = plan.agg(F.countDistinct("origin_id").alias("n")).scalar()
    return plan.groupBy("node_id", "scenario_id").agg(
        F.countDistinct("origin_id").alias("origin_count")
    ).withColumn("expected_origin_count", expected).withColumn(
        "coverage_complete", F.col("origin_count") == F.col("expected_origin_count")
    )


def reach_flags(proximity_metres: float, pt_minutes: Column | None = None, walk_minutes: Column | None = None) -> dict[str, Column]:
    """Which means reaches the node within the case's thresholds, as exclusive flags; by default the thresholds are columns."""
    pt_minutes = F.col("pt_minutes") if pt_minutes is None else pt_minutes
    walk_minutes = F.col("walk_minutes") if walk_minutes is None else walk_minutes
    close = F.col("distance") <= proximity_metres
    walked = F.coalesce(F.col("walk_category") == "success", F.lit(False))
    return {
        "by_pt": (F.col("pt_category") == "success") & (F.col("pt_seconds") <= pt_minutes * 60),
        "by_walk": walked & (F.col("walk_seconds") <= walk_minutes * 60),
        "by_proximity": F.col("walk_category").isNotNull() & ~walked & close,
        "centroid_close": close,
    }


def accessibility_metrics(
    resolved: DataFrame, plan: DataFrame, cases: Sequence[Case], *, proximity_metres: float
) -> DataFrame:
    """Accessible population per node, scenario and threshold case, in one aggregate.

    The sums of all cases are columns of one row per node and scenario; only the finished rows are
    multiplied by the cases, so neither the rows nor the only shuffle grow with their number.
    """
    national = national_population(plan).select("national_population").scalar()
    flags = reach_flags(proximity_metres)

    def people(reached: Column) -> Column:
        return F.coalesce(F.sum(F.when(reached, F.col("population"))), F.lit(0))

    by_case = []
    for number, (_, pt, walk, _) in enumerate(cases):
        within = reach_flags(proximity_metres, F.lit(pt), F.lit(walk))
        by_case += [people(within["by_pt"]).alias(f"_pt{number}"), people(within["by_walk"]).alias(f"_walk{number}")]
    grouped = resolved.groupBy("node_id", "scenario_id").agg(
        *by_case,
        people(flags["by_proximity"]).alias("proximity_population"),
        people(flags["centroid_close"]).alias("centroid_population"),
        F.count(F.lit(1)).alias("origin_count"),
        F.count_if(F.col("pt_category") == "success").alias("pt_success_count"),
        F.count_if(F.col("pt_category") == "missing_route").alias("pt_missing_route_count"),
        F.count_if(F.col("pt_category") == "invalid_response").alias("pt_invalid_response_count"),
        F.count_if(F.col("walk_category") == "success").alias("walk_success_count"),
        F.count_if(flags["by_proximity"]).alias("proximity_pair_count"),
    )
    rows = F.inline(F.array(*[
        F.struct(
            F.lit(case_id).alias("threshold_case_id"), F.lit(primary).alias("is_primary"),
            F.lit(pt).cast("bigint").alias("pt_minutes"), F.lit(walk).cast("bigint").alias("walk_minutes"),
            F.col(f"_pt{number}").alias("pt_population"), F.col(f"_walk{number}").alias("walk_population"),
        )
        for number, (case_id, pt, walk, primary) in enumerate(cases)
    ]))
    sums = grouped.select(
        "node_id", "scenario_id", rows, "proximity_population", "centroid_population", "origin_count", "pt_success_count",
        "pt_missing_route_count", "pt_invalid_response_count", "walk_success_count", "proximity_pair_count",
    )
    transport = F.col("pt_population") + F.col("walk_population")
    return sums.withColumn("transport_population", transport).withColumn(
        "accessible_population", F.col("transport_population") + F.col("proximity_population")
    ).withColumn("national_population", national).withColumns({
        "transit_reach_share": F.when(F.col("national_population") > 0, F.col("transport_population") / F.col("national_population")),
        "combined_reach_share": F.when(F.col("national_population") > 0, F.col("accessible_population") / F.col("national_population")),
    })


def scenario_slice(metrics: DataFrame, scenario_id: str, threshold_case_id: str) -> DataFrame:
    """Rows of one scenario and threshold case."""
    return metrics.filter((F.col("scenario_id") == scenario_id) & (F.col("threshold_case_id") == threshold_case_id))


def transit_versus_proximity(metrics: DataFrame, scenario_id: str, *, materiality: float, rank_shift: int = 10) -> DataFrame:
    """One row: does transit-aware reach differ from straight-line proximity?

    Median relative difference over nodes with a positive baseline, Spearman
    correlation of average ranks, and how many nodes move by ``rank_shift`` or more.
    """
    chosen = cut_lineage(metrics.filter((F.col("scenario_id") == scenario_id) & F.col("is_primary")).select(
        "node_id", "accessible_population", "centroid_population"
    ))  # one row per node, read by every statistic below
    bounded = is_bounded(chosen)
    valid = chosen.filter(F.col("centroid_population") > 0).withColumn(
        "difference",
        F.abs(F.col("accessible_population") - F.col("centroid_population")) / F.col("centroid_population"),
    )
    ranked = average_rank(valid, "accessible_population", "node_id", name="transit_rank", bounded=bounded, tolerance=TIE)
    ranked = average_rank(ranked, "centroid_population", "node_id", name="proximity_rank", bounded=bounded, tolerance=TIE)
    moved = F.abs(F.col("transit_rank") - F.col("proximity_rank")) >= rank_shift
    total = chosen.agg(F.count(F.lit(1)).alias("n")).scalar()
    median = exact_median(valid, "difference", "node_id", bounded=bounded).scalar()
    return ranked.agg(
        F.count(F.lit(1)).alias("valid_node_count"),
        null_if_constant("transit_rank", "proximity_rank").alias("spearman"),
        F.count_if(moved).alias("moved_count"),
    ).select(
        "valid_node_count", (total - F.col("valid_node_count")).alias("excluded_node_count"),
        median.alias("median_difference"), F.coalesce(median >= materiality, F.lit(False)).alias("material_difference"),
        "spearman", "moved_count",
        F.when(F.col("valid_node_count") > 0, F.col("moved_count") / F.col("valid_node_count")).alias("moved_share"),
    )


def ledger_progress(plan: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row: how far the outcome ledger covers the plan."""
    trips = outcomes_by_trip(outcomes)
    needs_walk = F.col("pt_category").isin(WALK_FALLBACK_CATEGORIES)
    planned = plan.agg(F.count(F.lit(1)).alias("n")).scalar()
    return trips.agg(
        F.count_if(F.col("pt_rows") > 0).alias("completed_pt"),
        F.count_if(F.col("pt_category") == "success").alias("pt_success"),
        F.count_if(F.col("pt_category") == "missing_route").alias("pt_missing_route"),
        F.count_if(F.col("pt_category") == "invalid_response").alias("pt_invalid_response"),
        F.count_if(needs_walk).alias("fallbacks_required"),
        F.count_if(needs_walk & (F.col("walk_rows") > 0)).alias("fallbacks_completed"),
        F.sum(F.col("pt_rows") + F.col("walk_rows")).alias("outcome_count"),
    ).withColumn("planned_pt", planned).withColumn(
        "completed_percent", F.round(F.col("completed_pt") * 100 / F.col("planned_pt"), 3)
    ).withColumn(
        "status",
        F.when(
            (F.col("completed_pt") == F.col("planned_pt"))
            & (F.col("fallbacks_completed") == F.col("fallbacks_required")), "complete",
        ).otherwise("in_progress"),
    )


def pending_requests(plan: DataFrame, outcomes: DataFrame) -> DataFrame:
    """od_plan_id, method: the requests still to be made, public transport before walking."""
    trips = outcomes_by_trip(outcomes)
    joined = plan.select("od_plan_id").join(trips, "od_plan_id", "left")
    needs_walk = F.col("pt_category").isin(WALK_FALLBACK_CATEGORIES) & (F.col("walk_rows") == 0)
    method = F.when(F.coalesce(F.col("pt_rows"), F.lit(0)) == 0, "pt").when(needs_walk, "walk")
    return joined.select("od_plan_id", method.alias("method")).filter(F.col("method").isNotNull())
