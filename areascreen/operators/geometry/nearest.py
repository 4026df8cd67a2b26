"""Exact nearest-object distance by descending a hierarchy of grid cells.

Each level splits a cell 8 x 8. A candidate cell survives when its least possible distance
does not exceed the best guaranteed distance of any other candidate, so only few cells per
position reach the last level, whatever the density of the objects.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from areascreen.operators.skew import fan_out, salted_join
from areascreen.session import cut_lineage

_SPLIT = 8
_TOLERANCE = 1 + 1e-12


def nearest_distance(queries: DataFrame, objects: DataFrame, distance: Column, *, key: str, leaf: float) -> DataFrame:
    """key, distance: the least distance from any position of the key to any object.

    ``queries`` has ``key, x, y``; ``objects`` has ``lo_x, hi_x, lo_y, hi_y`` and the columns that
    ``distance`` reads next to ``x, y``.
    """
    extent = objects.agg(F.min("lo_x"), F.min("lo_y"), F.max("hi_x"), F.max("hi_y")).first()
    if extent[0] is None:
        return queries.select(key).distinct().withColumn("distance", F.lit(None).cast("double"))
    x0, y0, reach = extent[0], extent[1], max(extent[2] - extent[0], extent[3] - extent[1])
    levels = max(1, math.ceil(math.log(max(reach / leaf, 1.0) + 1, _SPLIT)))

    placed = objects.withColumn("cx", F.floor(((F.col("lo_x") + F.col("hi_x")) / 2 - x0) / leaf)).withColumn(
        "cy", F.floor(((F.col("lo_y") + F.col("hi_y")) / 2 - y0) / leaf)
    )
    box = [F.min("lo_x").alias("lo_x"), F.max("hi_x").alias("hi_x"), F.min("lo_y").alias("lo_y"), F.max("hi_y").alias("hi_y")]
    cells = [cut_lineage(placed.groupBy("cx", "cy").agg(*box))]
    for _ in range(levels - 1):
        parents = cells[-1].withColumn("cx", F.floor(F.col("cx") / _SPLIT)).withColumn("cy", F.floor(F.col("cy") / _SPLIT))
        cells.append(parents.groupBy("cx", "cy").agg(*box))

    x, y = F.col("x"), F.col("y")
    near_x = F.greatest(F.lit(0.0), F.col("lo_x") - x, x - F.col("hi_x"))
    near_y = F.greatest(F.lit(0.0), F.col("lo_y") - y, y - F.col("hi_y"))
    far_x = F.greatest(F.abs(x - F.col("lo_x")), F.abs(x - F.col("hi_x")))
    far_y = F.greatest(F.abs(y - F.col("lo_y")), F.abs(y - F.col("hi_y")))
    # At most 64 children of each surviving cell of one position: a bounded group.
    position = Window.partitionBy("x", "y")
    # Each step multiplies the rows; the partitioning by position serves the windows of the broadcast levels as well.
    candidates = fan_out(queries.select("x", "y").distinct(), ["x", "y"]).withColumn("px", F.lit(0).cast("bigint")).withColumn(
        "py", F.lit(0).cast("bigint")
    )
    for depth, level in enumerate(reversed(range(levels)), start=1):
        children = cells[level].withColumn("px", F.floor(F.col("cx") / _SPLIT)).withColumn("py", F.floor(F.col("cy") / _SPLIT))
        if depth <= 2:  # at most 64 ** depth cells exist at this depth
            joined = candidates.join(F.broadcast(children), ["px", "py"])
        else:
            joined = salted_join(candidates, children, ["px", "py"], spread=["x", "y"])
        bounded = joined.withColumn("_near", near_x * near_x + near_y * near_y).withColumn(
            "_best", F.min(far_x * far_x + far_y * far_y).over(position)
        )
        candidates = bounded.filter(F.col("_near") <= F.col("_best") * _TOLERANCE).select(
            "x", "y", F.col("cx").alias("px"), F.col("cy").alias("py")
        )
    leaves = candidates.withColumnRenamed("px", "cx").withColumnRenamed("py", "cy")
    pairs = salted_join(placed, leaves, ["cx", "cy"], spread=["lo_x", "lo_y", "hi_x", "hi_y"])
    best = pairs.groupBy("x", "y").agg(F.min(distance).alias("distance"))
    return queries.select(key, "x", "y").distinct().join(best, ["x", "y"]).groupBy(key).agg(
        F.min("distance").alias("distance")
    )


def point_boxes(points: DataFrame) -> DataFrame:
    """Distinct positions as objects of :func:`nearest_distance`, named ``ox, oy``."""
    spots = points.select(F.col("x").alias("ox"), F.col("y").alias("oy")).distinct()
    return spots.select(
        "ox", "oy", F.col("ox").alias("lo_x"), F.col("ox").alias("hi_x"), F.col("oy").alias("lo_y"), F.col("oy").alias("hi_y")
    )


def nearest_point(queries: DataFrame, points: DataFrame, *, key: str, leaf: float) -> DataFrame:
    dx, dy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
    return nearest_distance(queries, point_boxes(points), F.sqrt(dx * dx + dy * dy), key=key, leaf=leaf)


def nearest_polygon(queries: DataFrame, edges: DataFrame, *, key: str, leaf: float) -> DataFrame:
    """Least distance to any polygon; 0 for a key with a position inside one.

    Only keys without a position inside look for a border, and copies of a polygon are looked at once.
    """
    from areascreen.operators.geometry.polygons import distinct_polygons, points_in_polygons, segment_distance

    spots = cut_lineage(queries.select(key, "x", "y").distinct())
    shapes = edges.join(distinct_polygons(edges), "geo_id", "left_semi")
    held = points_in_polygons(spots, shapes, cell_size=leaf).select("x", "y").distinct()
    inside = cut_lineage(spots.filter(F.col(key).isNotNull()).join(held, ["x", "y"], "left_semi").select(key).distinct())
    segments = edges.select(
        "x1", "y1", "x2", "y2", F.least("x1", "x2").alias("lo_x"), F.greatest("x1", "x2").alias("hi_x"),
        F.least("y1", "y2").alias("lo_y"), F.greatest("y1", "y2").alias("hi_y"),
    ).distinct()
    outside = spots.join(inside, key, "left_anti")
    border = nearest_distance(outside, segments, segment_distance(F.col("x"), F.col("y")), key=key, leaf=leaf)
    return border.unionByName(inside.withColumn("distance", F.lit(0.0)))
