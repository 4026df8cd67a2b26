"""Unions of intervals on many lines, without a line in one task's memory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F


def condense(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exact map-side union of spans before any sort.

    Spans at least ``2**j`` long that start in the same bin of ``2**j`` overlap each other,
    so their union is one span. However many copies a hot key holds, each bin leaves one.
    """
    size = F.col("x1") - F.col("x0")
    level = F.floor(F.log2(F.greatest(size, F.lit(1e-6))))
    return (
        spans.withColumn("_level", level).withColumn("_bin", F.floor(F.col("x0") / F.pow(F.lit(2.0), F.col("_level"))))
        .groupBy(*keys, "k", "_level", "_bin").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
        .drop("_level", "_bin")
    )


def merge(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union of the clipped spans of each key, line and column (gaps and islands)."""
    group = [*keys, "k", "column"]
    order = Window.partitionBy(*group).orderBy("x0", "x1")
    reach = F.max("x1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = spans.withColumn("_new", F.when(F.col("x0") <= reach, 0).otherwise(1))
    islands = starts.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*group, "_island").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_island")
