"""Weighted association and agreement statistics as single-pass or two-pass aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def null_if_constant(left: str, right: str) -> Column:
    """Pearson correlation; null with fewer than two rows or when a side does not vary."""
    varies = (F.min(left) < F.max(left)) & (F.min(right) < F.max(right))
    return F.when(varies, F.covar_pop(left, right) / (F.stddev_pop(left) * F.stddev_pop(right)))


def weighted_association(df: DataFrame, x: str, y: str, weight: str, *, slope_per: float = 10_000) -> DataFrame:
    """Weighted correlation, slope per ``slope_per`` units of x and effective sample size.

    Moments are centred on the weighted means (a scalar of the first pass), which avoids
    the cancellation of raw moments. Zero variance gives 0.
    """
    w, total = F.col(weight), F.sum(weight)
    means = df.agg((F.sum(w * F.col(x)) / total).alias("mx"), (F.sum(w * F.col(y)) / total).alias("my"))
    dx, dy = F.col(x) - means.select("mx").scalar(), F.col(y) - means.select("my").scalar()
    moments = df.select(w.alias("w"), dx.alias("dx"), dy.alias("dy")).agg(
        F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("w")).alias("sww"),
        (F.sum(F.col("w") * F.col("dx") * F.col("dy")) / F.sum("w")).alias("cov"),
        (F.sum(F.col("w") * F.col("dx") * F.col("dx")) / F.sum("w")).alias("var_x"),
        (F.sum(F.col("w") * F.col("dy") * F.col("dy")) / F.sum("w")).alias("var_y"),
    )
    varies = (F.col("var_x") != 0) & (F.col("var_y") != 0)
    return moments.select(
        F.when(varies, F.col("cov") / F.sqrt(F.col("var_x") * F.col("var_y"))).otherwise(0.0).alias("weighted_correlation"),
        (F.when(F.col("var_x") != 0, F.col("cov") / F.col("var_x")).otherwise(0.0) * slope_per).alias("weighted_slope"),
        (F.col("sw") * F.col("sw") / F.col("sww")).alias("effective_sample_size"),
    )


def channel_overlap(members: DataFrame, item: str, in_a: Column, in_b: Column) -> DataFrame:
    """Sizes, overlap and Jaccard index of two discovery channels; no population estimate."""
    per_item = members.groupBy(item).agg(F.bool_or(in_a).alias("a"), F.bool_or(in_b).alias("b"))
    counts = per_item.agg(
        F.count_if("a").alias("a_count"), F.count_if("b").alias("b_count"),
        F.count_if(F.col("a") & F.col("b")).alias("overlap_count"),
        F.count_if(F.col("a") & ~F.col("b")).alias("unique_to_a"),
        F.count_if(F.col("b") & ~F.col("a")).alias("unique_to_b"),
        F.count_if(F.col("a") | F.col("b")).alias("union_count"),
    )
    return counts.withColumn(
        "jaccard", F.when(F.col("union_count") > 0, F.col("overlap_count") / F.col("union_count")).otherwise(0.0)
    )
