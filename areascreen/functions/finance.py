"""Break-even arithmetic of an operator scenario as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def financial_outputs(scenarios: DataFrame, *, capacity: int, target: int) -> DataFrame:
    """Add contribution, break-even, utilisation, feasibility and affordable occupancy.

    Needs fee, variable_cost, fixed_cost and occupancy_cost. Without a positive
    contribution there is no break-even. The surplus starts from the affordable cost,
    which is floored at zero.
    """
    contribution = F.col("fee") - F.col("variable_cost")
    break_even = F.when(
        F.col("contribution") > 0,
        F.ceil((F.col("fixed_cost") + F.col("occupancy_cost")) / F.col("contribution")),
    ).cast("bigint")
    affordable = F.greatest(F.lit(0), F.lit(target) * F.col("contribution") - F.col("fixed_cost"))
    return (
        scenarios.withColumn("contribution", contribution)
        .withColumn("break_even", break_even)
        .withColumn("break_even_utilisation", F.col("break_even") / F.lit(capacity))
        .withColumn("capacity_feasible", F.coalesce(F.col("break_even") <= capacity, F.lit(False)))
        .withColumn("affordable_occupancy", affordable)
        .withColumn("surplus_after_occupancy", F.col("affordable_occupancy") - F.col("occupancy_cost"))
    )


def required_capture_share(break_even: Column, population: Column) -> Column:
    """Break-even as a share of the population; null when nobody is reachable, never clamped."""
    return F.when(population > 0, break_even / population)


def competition_value(confirmed: Column, *, zero_caution: bool) -> Column:
    """Confirmed count; under caution a count of zero is scored as one."""
    value = confirmed.cast("double")
    return F.greatest(F.lit(1.0), value) if zero_caution else value
