"""Evidence classes of an entity from its observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from areascreen.functions.documents import flag_array
from areascreen.functions.numbers import is_fresh

#: Fixed vocabularies.
ELEMENTS = ["branch_address_or_existence", "mathematics_subject", "level_overlap"]
EXCLUSIONS = [
    "branch_closed", "branch_online_only", "branch_preschool_only", "branch_adult_only", "branch_no_mathematics",
    "branch_no_p1_s4_level", "branch_future_not_yet_open",
]
OPERATOR_SCOPE = "operator_controlled"


def classify(observations: DataFrame, *, cutoff: str, freshness_days: int = 30) -> DataFrame:
    """branch_id, status, missing_elements: confirmed, possible, excluded or unresolved.

    Needs branch_id, observation_type, evidence_scope, polarity, observed_at. An exclusion
    beside positive evidence is unresolved; all elements fresh and under the operator's control
    confirm; any positive evidence is possible.
    """
    kind, scope = F.col("observation_type"), F.col("evidence_scope")
    supports = F.coalesce("polarity", F.lit("supports")) == "supports"
    fresh = is_fresh(F.col("observed_at"), F.lit(cutoff), freshness_days)
    flags = [F.bool_or(kind.isin(EXCLUSIONS) & (scope != "search_snippet")).alias("excluded")]
    for element in ELEMENTS:
        hit = (kind == element) & supports
        flags.append(F.bool_or(hit).alias(f"any_{element}"))
        flags.append(F.bool_or(hit & (scope == OPERATOR_SCOPE) & fresh).alias(f"met_{element}"))
    grouped = observations.groupBy("branch_id").agg(*flags)
    any_positive, all_met = F.lit(False), F.lit(True)
    for element in ELEMENTS:
        any_positive = any_positive | F.col(f"any_{element}")
        all_met = all_met & F.col(f"met_{element}")
    status = (
        F.when(F.col("excluded") & any_positive, "unresolved").when(F.col("excluded"), "excluded")
        .when(all_met, "confirmed").when(any_positive, "possible").otherwise("unresolved")
    )
    missing = F.when(F.col("excluded"), F.array().cast("array<string>")).otherwise(
        flag_array({element: ~F.col(f"met_{element}") for element in ELEMENTS})
    )
    return grouped.select("branch_id", status.alias("status"), missing.alias("missing_elements"))


def status_from_validation(address: Column, subject: Column, level: Column, *, confirmed_address: str) -> Column:
    """Status from three validation texts; ``not_mapped`` blocks the level."""
    confirmed = (
        (address == confirmed_address) & F.contains(subject, F.lit("confirmed"))
        & F.contains(level, F.lit("confirmed")) & ~F.contains(level, F.lit("not_mapped"))
    )
    tried = F.lit(False)
    for value in (address, subject, level):
        tried = tried | value.startswith("attempted_") | F.contains(value, F.lit("possible"))
    verdict = F.when(confirmed, "confirmed").when(tried, "possible").otherwise("unresolved")
    return F.when(address.isNull() | subject.isNull() | level.isNull(), "unresolved").otherwise(verdict)


def directory_floor(status: Column, in_directory: Column) -> Column:
    """A listing in a directory alone makes an unresolved branch possible, never confirmed."""
    return F.when((status == "unresolved") & in_directory, "possible").otherwise(status)


def signal_rollup(evidence: DataFrame, *, largest_buffer: int) -> DataFrame:
    """Per node: distinct positive and missing signal families at the largest buffer.

    Two buffers of one family count once.
    """
    rows = evidence.filter(F.col("buffer_metres") == largest_buffer)
    positive = (F.col("measurement_status") == "observed") & F.coalesce("positive_signal", F.lit(False))
    missing = F.col("measurement_status") == "missing"
    return rows.groupBy("node_id").agg(
        F.countDistinct(F.when(positive, F.col("signal_key"))).alias("positive_signals"),
        F.countDistinct(F.when(missing, F.col("signal_key"))).alias("missing_signals"),
    )


def qualification(positive_signals: Column, open_reviews: Column, *, required: int) -> Column:
    """Open reviews and nodes without any signal need a person; enough signals qualify."""
    return (
        F.when(open_reviews > 0, "needs_manual_review").when(positive_signals >= required, "qualified")
        .when(positive_signals > 0, "provisional").otherwise("needs_manual_review")
    )
