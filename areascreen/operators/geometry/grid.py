"""Grid cells that turn spatial conditions into equi-joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from areascreen.operators.skew import salted_join


def cell(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(float(size)))


def neighbours(df: DataFrame, size: float, rings: int = 1) -> DataFrame:
    """A row per cell around each point: its own and ``rings`` rings of neighbours, as ``cx, cy``."""
    offsets = range(-rings, rings + 1)
    around = F.explode(F.array(*[
        F.struct((cell(F.col("x"), size) + dx).alias("cx"), (cell(F.col("y"), size) + dy).alias("cy"))
        for dx in offsets for dy in offsets
    ]))
    return df.withColumn("_cell", around).select("*", "_cell.cx", "_cell.cy").drop("_cell")


def box_cells(df: DataFrame, size: float, margin: float = 0.0) -> DataFrame:
    """One row per cell touched by the box ``lo_x, hi_x, lo_y, hi_y``, widened by ``margin``."""
    def span(low: str, high: str) -> Column:
        return F.explode(F.sequence(cell(F.col(low) - margin, size), cell(F.col(high) + margin, size)))

    return df.withColumn("cx", span("lo_x", "hi_x")).withColumn("cy", span("lo_y", "hi_y"))


def sites(points: DataFrame, by: Sequence[str] = (), count: str = "n") -> DataFrame:
    """Distinct positions with the number of points on each: copies are counted, not joined."""
    return points.groupBy(*by, "x", "y").agg(F.count(F.lit(1)).alias(count))


def pairs_within(centres: DataFrame, located: DataFrame, radius: float) -> DataFrame:
    """Pairs of a centre and a located row at most ``radius`` apart, with the squared distance ``d2``.

    Cells of half the radius keep the candidates close to the circle. Columns of ``centres`` other
    than x and y are kept, as are all columns of ``located`` and the cell ``cx, cy`` of the located row: the
    pairs are spread by it, so a grouping that has it among its keys needs no shuffle of pairs.
    """
    size = radius / 2
    placed = located.withColumn("cx", cell(F.col("x"), size)).withColumn("cy", cell(F.col("y"), size))
    kept = [c for c in centres.columns if c not in ("x", "y")]
    spots = neighbours(centres, size, 2).select(*kept, F.col("x").alias("_x"), F.col("y").alias("_y"), "cx", "cy")
    dx, dy = F.col("x") - F.col("_x"), F.col("y") - F.col("_y")
    pairs = salted_join(placed, spots, ["cx", "cy"], spread=["x", "y"], multiplies=True).withColumn("d2", dx * dx + dy * dy)
    return pairs.filter(F.col("d2") <= radius * radius).drop("_x", "_y")


def distances_within(
    centres: DataFrame, points: DataFrame, radius: float, *, key: str, by: Sequence[str] = ()
) -> DataFrame:
    """key, by, x, y, n, distance: for each position within ``radius`` of any of the key's
    centres, the least distance. A position near several centres appears once.
    """
    pairs = pairs_within(centres.select(key, "x", "y").distinct(), sites(points, by), radius)
    return pairs.groupBy("cx", "cy", key, *by, "x", "y").agg(F.first("n").alias("n"), F.sqrt(F.min("d2")).alias("distance")).drop("cx", "cy")


def counts_within(
    centres: DataFrame, points: DataFrame, radii: Sequence[float], *, key: str, prefix: str
) -> DataFrame:
    """Per key the number of points within each radius of the union of its centres, in one pass."""
    near = distances_within(centres, points, max(radii), key=key)
    counted = near.groupBy(key).agg(*[
        F.coalesce(F.sum(F.when(F.col("distance") <= r, F.col("n"))), F.lit(0)).alias(f"{prefix}_{int(r)}m") for r in radii
    ])
    everyone = centres.select(key).distinct().join(counted, key, "left")
    return everyone.na.fill(0, [f"{prefix}_{int(r)}m" for r in radii])
