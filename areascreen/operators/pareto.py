"""Pareto frontier (skyline): rows that no other row of the group dominates.

All dimensions are higher-is-better; equal rows are kept together. The work is done on
distinct points. A group that fits one chunk is solved in one vectorised step. In larger
groups each dimension is cut into a few bins, so that a group has a bounded number of cells;
a whole cell falls when another non-empty cell lies above it in every dimension. What remains
is thinned chunk by chunk until it fits, or else each survivor is compared, by a semi-join on
the cell, with the cells that can still hold something better.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from areascreen.operators.ranking import group_size
from areascreen.operators.skew import null_safe_join
from areascreen.session import cut_lineage

_BINS = 8
_CHUNK_ROWS = 4096


def _undominated(values: np.ndarray) -> np.ndarray:
    """Mask of the rows that no other row dominates."""
    order = np.lexsort(tuple(-values[:, i] for i in reversed(range(values.shape[1]))))
    kept: list[int] = []
    while len(order):  # a row can be dominated only by rows sorted before it, so the first one left is kept
        first, order = order[0], order[1:]
        kept.append(int(first))
        rest, best = values[order], values[first]
        order = order[~(np.all(best >= rest, axis=1) & np.any(best > rest, axis=1))]
    mask = np.zeros(len(values), dtype=bool)
    mask[kept] = True
    return mask


def _thin(points: DataFrame, by: Sequence[str], dimensions: Sequence[str], *, fits: bool = False) -> DataFrame:
    """Drop points dominated inside their own chunk; exact when each group fits one chunk."""
    columns = list(dimensions)
    schema = points.select(*by, *columns, *[c for c in points.columns if c == "cell"]).schema

    def frontier(chunk: pd.DataFrame) -> pd.DataFrame:
        return chunk[_undominated(chunk[columns].to_numpy(dtype="float64"))]

    if fits:
        one = points.withColumn("_chunk", F.lit(0))
        return one.groupBy(*by, "_chunk").applyInPandas(lambda chunk: frontier(chunk).drop(columns="_chunk"), schema)
    size = group_size(points, by, "_n")
    chunks = F.ceil(F.col("_n") / _CHUNK_ROWS)
    salted = size.withColumn("_chunk", F.pmod(F.xxhash64(*columns), chunks)).drop("_n")
    return salted.groupBy(*by, "_chunk").applyInPandas(
        lambda chunk: frontier(chunk).drop(columns="_chunk"), schema
    )


def _fits(points: DataFrame, by: Sequence[str]) -> bool:
    """Whether every group fits one chunk: one count, read as one number."""
    counts = points.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return (counts.agg(F.max("n").alias("n")).first()["n"] or 0) <= _CHUNK_ROWS


def pareto_frontier(df: DataFrame, dimensions: Sequence[str], *, by: Sequence[str] = ()) -> DataFrame:
    """Distinct (by, dimensions) on the frontier; rows with a null dimension do not take part."""
    known = df.select(*by, *[F.col(d).cast("double").alias(d) for d in dimensions]).na.drop(subset=list(dimensions))
    points = cut_lineage(known.distinct())
    if _fits(points, by):
        return _thin(points, by, dimensions, fits=True)
    ranges = points.groupBy(*by).agg(
        *[F.min(d).alias(f"lo_{d}") for d in dimensions], *[F.max(d).alias(f"hi_{d}") for d in dimensions],
        *[F.percentile_approx(d, [i / _BINS for i in range(1, _BINS)], 1000).alias(f"cuts_{d}") for d in dimensions],
    )
    # Cut points are approximate but fixed once written: binning is monotone, so the result is exact.
    ranges = cut_lineage(ranges).select(*by, *[f"cuts_{d}" for d in dimensions])
    if by:
        binned = null_safe_join(points, ranges, by)
    else:
        row = ranges.first()
        binned = points
        for d in dimensions:
            binned = binned.withColumn(f"cuts_{d}", F.array(*[F.lit(c) for c in (row[f"cuts_{d}"] if row else None) or []]))

    def bin_of(d: str) -> Column:
        return F.size(F.filter(f"cuts_{d}", lambda c: c <= F.col(d)))

    cell = F.array(*[bin_of(d) for d in dimensions])
    celled = cut_lineage(binned.withColumn("cell", cell).select(*by, *dimensions, "cell"))

    # At most _BINS ** len(dimensions) cells per group: a bounded list.
    filled = celled.groupBy(*by).agg(F.collect_set("cell").alias("cells"))

    def above_everywhere(other: Column, own: Column) -> Column:
        return F.forall(F.zip_with(other, own, lambda a, b: a > b), lambda x: x)

    def at_least(other: Column, own: Column) -> Column:
        return F.forall(F.zip_with(other, own, lambda a, b: a >= b), lambda x: x)

    def with_cells(left: DataFrame) -> DataFrame:
        return null_safe_join(left, filled, by) if by else left.withColumn("cells", filled.scalar())

    own = celled.select(*by, "cell").distinct()
    living = with_cells(own).filter(~F.exists("cells", lambda c: above_everywhere(c, F.col("cell")))).select(*by, "cell")
    survivors = cut_lineage(_thin(null_safe_join(celled, living, [*by, "cell"], "left_semi"), by, dimensions))
    if _fits(survivors, by):
        return _thin(survivors.drop("cell"), by, dimensions, fits=True)

    # Candidates for dominating a point lie in cells at least as high in every dimension.
    living_lists = living.groupBy(*by).agg(F.collect_set("cell").alias("cells"))
    rivals_of = null_safe_join(living, living_lists, by) if by else living.withColumn("cells", living_lists.scalar())
    rivals_of = rivals_of.select(*by, "cell", F.filter("cells", lambda c: at_least(c, F.col("cell"))).alias("rivals"))
    seekers = null_safe_join(survivors, rivals_of, [*by, "cell"]).withColumn("rival", F.explode("rivals")).drop("rivals")
    others = survivors.select(*by, F.col("cell").alias("rival"), *[F.col(d).alias(f"_{d}") for d in dimensions])
    keys = [*by, "rival"]
    better = F.lit(True)
    strictly = F.lit(False)
    for d in dimensions:
        better = better & (F.col(f"o._{d}") >= F.col(f"s.{d}"))
        strictly = strictly | (F.col(f"o._{d}") > F.col(f"s.{d}"))
    condition = better & strictly
    for k in keys:
        condition = condition & F.col(f"s.{k}").eqNullSafe(F.col(f"o.{k}"))
    beaten = seekers.alias("s").join(others.alias("o"), condition, "left_semi").select(*by, *dimensions).distinct()
    return null_safe_join(survivors.select(*by, *dimensions), beaten, [*by, *dimensions], "left_anti")


def frontier_flag(df: DataFrame, dimensions: Sequence[str], *, by: Sequence[str] = (), name: str = "on_frontier") -> DataFrame:
    """Add whether each row is on its group's frontier."""
    frontier = pareto_frontier(df, dimensions, by=by).withColumn(name, F.lit(True))
    aliased = frontier.select(
        *[F.col(c).alias(f"_{c}") for c in [*by, *dimensions]], name
    )
    condition = F.lit(True)
    for c in by:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_{c}"))
    for d in dimensions:
        condition = condition & (F.col(d).cast("double") == F.col(f"_{d}"))
    joined = df.join(aliased, condition, "left")
    return joined.select(*df.columns, F.coalesce(name, F.lit(False)).alias(name))
