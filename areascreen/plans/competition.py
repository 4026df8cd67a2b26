"""Competition counts of target sets from numbered batch ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def ledger_totals(batches: DataFrame, leads: DataFrame) -> DataFrame:
    """One row: run totals and distinct physical branches (operator, label, postal; case ignored).

    Needs one row per batch with status, queries, routes_planned and routes_completed.
    """
    def text(name: str):
        return F.lower(F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))))

    distinct = leads.filter(F.coalesce("eligible", F.lit(False))).select(
        text("operator_name").alias("o"), text("branch_label").alias("b"), text("postal_code").alias("p")
    ).distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    totals = batches.agg(
        F.count(F.lit(1)).alias("batches"), F.count_if(F.col("status") != "complete").alias("incomplete_batches"),
        F.sum("queries").alias("queries"), F.sum("routes_planned").alias("routes_planned"), F.sum("routes_completed").alias("routes_completed"),
    )
    return totals.withColumn("distinct_branches", distinct).withColumn(
        "routes_reconcile", F.col("routes_planned") == F.col("routes_completed")
    )


def target_sets(counts: DataFrame, candidates: DataFrame, audit: DataFrame) -> DataFrame:
    """Add target_set: candidate first, then outside audit, else benchmark."""
    marked = counts.join(candidates.select("node_id", F.lit(True).alias("_c")), "node_id", "left").join(
        audit.select("node_id", F.lit(True).alias("_a")), "node_id", "left"
    )
    target = F.when(F.col("_c"), "candidate").when(F.col("_a"), "outside_audit").otherwise("benchmark")
    return marked.withColumn("target_set", target).drop("_c", "_a")
