"""Polygon measures and point-in-polygon joins over edge rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from areascreen.operators.geometry.grid import box_cells, cell
from areascreen.operators.skew import salted_join


def boxes(edges: DataFrame, key: str = "geo_id") -> DataFrame:
    """Bounding box per polygon."""
    return edges.groupBy(key).agg(
        F.min(F.least("x1", "x2")).alias("lo_x"), F.max(F.greatest("x1", "x2")).alias("hi_x"),
        F.min(F.least("y1", "y2")).alias("lo_y"), F.max(F.greatest("y1", "y2")).alias("hi_y"),
    )


def distinct_polygons(edges: DataFrame, by: Sequence[str] = (), polygon: str = "geo_id") -> DataFrame:
    """by, polygon: one polygon of each set of equal edges, so that copies of a polygon are one."""
    coordinates = ["x1", "y1", "x2", "y2"]
    told = edges.groupBy(*by, polygon).agg(
        F.bit_xor(F.xxhash64(*coordinates)).alias("_a"), F.sum(F.xxhash64(F.lit(1), *coordinates).cast("decimal(38,0)")).alias("_b"), F.count(F.lit(1)).alias("_n"))
    return told.groupBy(*by, "_a", "_b", "_n").agg(F.min(polygon).alias(polygon)).select(*by, polygon)


def measures(edges: DataFrame, key: str = "geo_id") -> DataFrame:
    """Area, centroid, edge count, closure and degeneracy per polygon (shoelace sums).

    Positions are taken relative to the polygon's own box, so that the sums keep
    their precision far from the origin. With ``part`` and ``ring`` columns every ring is
    summed by itself: the first ring of a part counts, the others are holes and are taken
    off, whichever way they are wound. A null ring counts as the first.
    """
    relative = edges.join(boxes(edges, key), key)
    x1, y1 = F.col("x1") - F.col("lo_x"), F.col("y1") - F.col("lo_y")
    x2, y2 = F.col("x2") - F.col("lo_x"), F.col("y2") - F.col("lo_y")
    cross = x1 * y2 - x2 * y1
    rings = [c for c in ("part", "ring") if c in edges.columns]
    each = relative.groupBy(key, *rings).agg(
        F.first("lo_x").alias("lo_x"), F.first("lo_y").alias("lo_y"),
        F.sum(cross).alias("double_area"), F.sum((x1 + x2) * cross).alias("mx"), F.sum((y1 + y2) * cross).alias("my"),
        F.count(F.lit(1)).alias("edge_count"),
        F.count_if((F.col("x1") == F.col("x2")) & (F.col("y1") == F.col("y2"))).alias("degenerate_edge_count"),
        (F.abs(F.sum(x2 - x1)) + F.abs(F.sum(y2 - y1))).alias("gap"),
    )
    wound = F.when(F.col("double_area") < 0, -1).otherwise(1)
    sign = wound * (F.when(F.col("ring") > 0, -1).otherwise(1) if "ring" in rings else F.lit(1))
    sums = each.groupBy(key).agg(
        F.first("lo_x").alias("lo_x"), F.first("lo_y").alias("lo_y"), *[F.sum(F.col(c) * sign).alias(c) for c in ("double_area", "mx", "my")],
        F.sum("edge_count").alias("edge_count"), F.sum("degenerate_edge_count").alias("degenerate_edge_count"), F.max("gap").alias("gap"),
    )
    return sums.select(
        key, F.abs(F.col("double_area") / 2).alias("area"),
        F.when(F.col("double_area") != 0, F.col("lo_x") + F.col("mx") / (F.col("double_area") * 3)).alias("centroid_x"),
        F.when(F.col("double_area") != 0, F.col("lo_y") + F.col("my") / (F.col("double_area") * 3)).alias("centroid_y"),
        "edge_count", "degenerate_edge_count", (F.col("gap") < 1e-6).alias("closed"),
    )


def crosses(px: Column, py: Column) -> Column:
    """Whether a ray from the point towards +x crosses the edge (half-open in y)."""
    straddles = (F.col("y1") <= py) != (F.col("y2") <= py)
    at = F.col("x1") + (py - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    return F.when(straddles, px < at).otherwise(F.lit(False))


def on_edge(px: Column, py: Column) -> Column:
    """Whether the point lies on the edge, its ends included."""
    ex, ey = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    between = px.between(F.least("x1", "x2"), F.greatest("x1", "x2")) & py.between(F.least("y1", "y2"), F.greatest("y1", "y2"))
    return between & (ex * (py - F.col("y1")) == ey * (px - F.col("x1")))


def points_in_polygons(points: DataFrame, edges: DataFrame, *, cell_size: float, key: str = "geo_id", border: bool = False) -> DataFrame:
    """x, y, key: every distinct position and each polygon that contains it.

    Positions meet polygons through the cells of the bounding boxes; the surviving pairs
    meet only the edges of their own horizontal band. With ``border`` a position on an edge or
    corner belongs to every polygon that has it there; otherwise one on a shared border belongs to one.
    """
    spots = points.select("x", "y").distinct().withColumn("cx", cell(F.col("x"), cell_size)).withColumn(
        "cy", cell(F.col("y"), cell_size)
    )
    areas = box_cells(boxes(edges, key), cell_size)
    inside_box = F.col("x").between(F.col("lo_x"), F.col("hi_x")) & F.col("y").between(F.col("lo_y"), F.col("hi_y"))
    candidates = salted_join(spots, areas, ["cx", "cy"], spread=["x", "y"], condition=inside_box, multiplies=True).select(
        "x", "y", key, F.col("cy").alias("band")
    )
    banded = (edges if border else edges.filter(F.col("y1") != F.col("y2"))).withColumn(
        "band", F.explode(F.sequence(cell(F.least("y1", "y2"), cell_size), cell(F.greatest("y1", "y2"), cell_size)))
    ).select(key, "band", "x1", "y1", "x2", "y2")
    crossing = crosses(F.col("x"), F.col("y"))
    touching = on_edge(F.col("x"), F.col("y")) if border else F.lit(False)
    met = salted_join(candidates, banded, [key, "band"], spread=["x", "y"], condition=crossing | touching, multiplies=True)
    found = met.groupBy("x", "y", key).agg(F.count_if(crossing).alias("_c"), F.max(touching).alias("_on"))
    return found.filter((F.col("_c") % 2 == 1) | F.col("_on")).drop("_c", "_on")


def assign_polygon(
    points: DataFrame, edges: DataFrame, names: DataFrame, *, policy: str, cell_size: float,
    attributes: Sequence[str], key: str = "geo_id",
) -> DataFrame:
    """Add the attributes of the containing polygon to every point.

    A polygon covers its border, so a point on a shared border has several matches. ``least``
    takes the match with the least attributes; ``unique`` gives null unless exactly one polygon
    matches; ``inside`` is ``unique`` with every border point in one polygon only. Points without
    a match keep null.
    """
    found = points_in_polygons(points, edges, cell_size=cell_size, key=key, border=policy != "inside")
    matches = found.join(names.select(key, *attributes), key)
    chosen = matches.groupBy("x", "y").agg(
        F.min(F.struct(*attributes, key)).alias("_match"), F.count(F.lit(1)).alias("match_count")
    )
    if policy in ("unique", "inside"):
        chosen = chosen.withColumn("_match", F.when(F.col("match_count") == 1, F.col("_match")))
    elif policy != "least":
        raise ValueError(f"unknown policy: {policy}")
    assigned = points.join(chosen, ["x", "y"], "left")
    return assigned.select(
        *points.columns, *[F.col(f"_match.{name}").alias(name) for name in attributes],
        F.coalesce("match_count", F.lit(0)).alias("match_count"),
    )


def segment_distance(px: Column, py: Column) -> Column:
    """Distance from a point to the edge ``x1, y1, x2, y2``."""
    ex, ey = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    along = F.try_divide((px - F.col("x1")) * ex + (py - F.col("y1")) * ey, ex * ex + ey * ey)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(along, F.lit(0.0))))
    dx, dy = px - (F.col("x1") + t * ex), py - (F.col("y1") + t * ey)
    return F.sqrt(dx * dx + dy * dy)


def polygon_distances(centres: DataFrame, edges: DataFrame, radius: float, *, key: str, polygon: str = "geo_id") -> DataFrame:
    """key, polygon, distance for every polygon closer than ``radius`` to a centre of the key.

    Exact: the least distance to an edge, 0 with a centre inside the polygon.
    """
    spots = centres.select(key, "x", "y").distinct()
    boxed = edges.select(
        polygon, "x1", "y1", "x2", "y2", F.least("x1", "x2").alias("lo_x"), F.greatest("x1", "x2").alias("hi_x"),
        F.least("y1", "y2").alias("lo_y"), F.greatest("y1", "y2").alias("hi_y"),
    )
    near_cells = box_cells(boxed, radius, radius).drop("lo_x", "hi_x", "lo_y", "hi_y")
    placed = spots.withColumn("cx", cell(F.col("x"), radius)).withColumn("cy", cell(F.col("y"), radius))
    close = salted_join(near_cells, placed, ["cx", "cy"], spread=[polygon, "x1", "y1"], multiplies=True).select(
        key, polygon, segment_distance(F.col("x"), F.col("y")).alias("distance")
    ).filter(F.col("distance") < radius)
    inside = points_in_polygons(spots, edges, cell_size=radius, key=polygon).join(spots, ["x", "y"]).select(
        key, polygon, F.lit(0.0).alias("distance")
    )
    return close.unionByName(inside).groupBy(key, polygon).agg(F.min("distance").alias("distance"))
