"""Boundaries of unions of polygons, over edge rows.

Every edge is cut where other edges meet it. A piece belongs to the boundary of the union if the ground just outside of it
lies in no polygon of the union. That one rule drops pieces inside other polygons and borders between neighbours, and keeps
one of several equal pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from areascreen.operators.geometry.grid import box_cells, cell
from areascreen.operators.geometry.polygons import boxes, distinct_polygons, points_in_polygons
from areascreen.operators.skew import salted_join
from areascreen.session import cut_lineage

#: Metres outside a piece at which the ground is looked at, and decimals to which equal points are equal.
OUTSIDE, DECIMALS = 1e-6, 6


def oriented(edges: DataFrame, key: str = "geo_id") -> DataFrame:
    """Edges with the polygon's inside on their left: shells counter-clockwise, holes clockwise.

    ``part`` and ``ring`` tell shells (ring 0 or null) from holes; without them every polygon is one shell.
    """
    rings = [c for c in ("part", "ring") if c in edges.columns]
    placed = edges.join(boxes(edges, key).select(key, F.col("lo_x").alias("ox"), F.col("lo_y").alias("oy")), key)
    cross = (F.col("x1") - F.col("ox")) * (F.col("y2") - F.col("oy")) - (F.col("x2") - F.col("ox")) * (F.col("y1") - F.col("oy"))
    filled = [F.coalesce(F.col(c), F.lit(0)).alias(f"_{c}") for c in rings]
    wound = placed.groupBy(key, *filled).agg((F.sum(cross) >= 0).alias("_left"))
    joined = placed.select("*", *filled).join(wound, [key, *[f"_{c}" for c in rings]])
    keep = F.col("_left") != (F.col("_ring") > 0) if "ring" in rings else F.col("_left")
    ends = {"x1": ("x1", "x2"), "y1": ("y1", "y2"), "x2": ("x2", "x1"), "y2": ("y2", "y1")}
    turned = joined.withColumns({f"_{c}": F.when(keep, F.col(a)).otherwise(F.col(b)) for c, (a, b) in ends.items()})
    return turned.select(*[F.col(f"_{c}").alias(c) if c in ends else F.col(c) for c in edges.columns])


def _met(pairs: DataFrame) -> Column:
    """Places, in shares of the edge e, where the edge f meets it: a crossing, or the ends of f where both lie in one line."""
    ex, ey = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    fx, fy = F.col("u2") - F.col("u1"), F.col("v2") - F.col("v1")
    gx, gy = F.col("u1") - F.col("x1"), F.col("v1") - F.col("y1")
    e2, f2 = ex * ex + ey * ey, fx * fx + fy * fy
    turn = ex * fy - ey * fx
    parallel = F.abs(turn) <= F.sqrt(e2 * f2) * 1e-12
    t, u = F.try_divide(gx * fy - gy * fx, turn), F.try_divide(gx * ey - gy * ex, turn)
    crossing = F.when((u >= -1e-12) & (u <= 1 + 1e-12), F.array(t))
    in_line = F.abs(gx * ey - gy * ex) <= F.sqrt(e2) * 1e-7
    ends = F.when(in_line, F.array(F.try_divide(gx * ex + gy * ey, e2), F.try_divide((gx + fx) * ex + (gy + fy) * ey, e2)))
    return F.coalesce(F.when(parallel, ends).otherwise(crossing), F.array().cast("array<double>"))


def union_edges(edges: DataFrame, by: str, *, cell_size: float, polygon: str = "geo_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Boundary of the union of all polygons of each ``by``, with the inside on the left: by, x1, y1, x2, y2.

    Also returns the edges of the distinct polygons and the table (by, polygon) of which belong to which union. Polygons
    may overlap, touch, share borders, lie inside each other or be copies; one polygon may belong to several unions.
    Pieces closer to another boundary than OUTSIDE metres count as lying on it.
    """
    names = cut_lineage(distinct_polygons(edges, [by], polygon))
    sided = cut_lineage(oriented(edges.join(names, [by, polygon]).withColumn("_own", F.struct(by, polygon)), "_own"))
    holders = sided.drop("_own", by).distinct()
    lines = sided.select(by, "x1", "y1", "x2", "y2").filter("x1 != x2 OR y1 != y2").distinct()
    low_high = {"lo_x": F.least("x1", "x2"), "hi_x": F.greatest("x1", "x2"), "lo_y": F.least("y1", "y2"), "hi_y": F.greatest("y1", "y2")}
    celled = cut_lineage(box_cells(lines.withColumns(low_high), cell_size))
    other = celled.select(by, "cx", "cy", *[F.col(a).alias(b) for a, b in zip(("x1", "y1", "x2", "y2", "lo_x", "hi_x", "lo_y", "hi_y"), ("u1", "v1", "u2", "v2", "lo_u", "hi_u", "lo_v", "hi_v"))])
    touch = (F.col("lo_x") <= F.col("hi_u")) & (F.col("lo_u") <= F.col("hi_x")) & (F.col("lo_y") <= F.col("hi_v")) & (F.col("lo_v") <= F.col("hi_y"))
    # A pair that shares several cells counts in the one that holds the lower corner of what both boxes share.
    here = (cell(F.greatest("lo_x", "lo_u"), cell_size) == F.col("cx")) & (cell(F.greatest("lo_y", "lo_v"), cell_size) == F.col("cy"))
    pairs = salted_join(celled, other, [by, "cx", "cy"], spread=["x1", "y1", "x2", "y2"], condition=touch & here, multiplies=True)
    edge = [by, "x1", "y1", "x2", "y2"]
    cuts = pairs.select(*edge, F.explode(_met(pairs)).alias("t")).filter("t > 0 AND t < 1")
    ends = lines.select(*edge, F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("t"))
    length = F.sqrt((F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2)
    places = cuts.unionByName(ends).groupBy(*edge, F.round(F.col("t") * length, DECIMALS).alias("_at")).agg(F.when(F.max("t") == 1, 1.0).otherwise(F.min("t")).alias("t"))
    until = F.lead("t").over(Window.partitionBy(*edge).orderBy("t"))
    parts = places.withColumn("_t", until).filter("_t IS NOT NULL")

    def point(t: str, a: str, b: str) -> Column:
        return F.when(F.col(t) == 0, F.col(a)).when(F.col(t) == 1, F.col(b)).otherwise(F.col(a) + F.col(t) * (F.col(b) - F.col(a)))

    pieces = parts.select(by, point("t", "x1", "x2").alias("x1"), point("t", "y1", "y2").alias("y1"), point("_t", "x1", "x2").alias("x2"), point("_t", "y1", "y2").alias("y2"))
    named = [F.round(c, DECIMALS).alias(f"_{c}") for c in ("x1", "y1", "x2", "y2")]
    pieces = pieces.groupBy(by, *named).agg(F.min(F.struct("x1", "y1", "x2", "y2")).alias("p")).select(by, "p.*").filter("x1 != x2 OR y1 != y2")
    length = F.sqrt((F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2)
    pieces = cut_lineage(pieces.withColumns({
        "x": (F.col("x1") + F.col("x2")) / 2 + (F.col("y2") - F.col("y1")) / length * OUTSIDE, "y": (F.col("y1") + F.col("y2")) / 2 - (F.col("x2") - F.col("x1")) / length * OUTSIDE}))
    covered = points_in_unions(pieces, holders, names, cell_size=cell_size)
    return pieces.join(covered, ["x", "y", by], "left_anti").select(*edge), holders, names


def points_in_unions(points: DataFrame, holders: DataFrame, names: DataFrame, *, cell_size: float, polygon: str = "geo_id") -> DataFrame:
    """x, y, by: every distinct position and each union that holds it (``names``: by, polygon)."""
    by = next(c for c in names.columns if c != polygon)
    found = points_in_polygons(points, holders, cell_size=cell_size, key=polygon)
    return found.join(names, polygon).select("x", "y", by).distinct()
