"""Exact overlap areas of polygons with unions of equal discs, as sums over boundaries.

The area of a region is the integral of (x dy - y dx) / 2 along its boundary. The boundary of a polygon's overlap with a
union of discs consists of the parts of the polygon's edges inside the union and of the arcs of the union inside the
polygon. Both are sums of closed forms, one for each edge near a disc and one for each arc that an edge crosses, so the
work is joins and aggregates without any raster: no shape is too thin to count.

An edge is in or out of a disc by its end points, judged alike for both edges that meet there, so the crossings of a
circle with a closed ring always come in pairs, through vertices and touching corners as well.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from areascreen.operators.geometry.grid import box_cells, cell
from areascreen.operators.geometry.polygons import points_in_polygons, segment_distance
from areascreen.operators.geometry.spans import condense, merge
from areascreen.operators.geometry.unions import oriented, points_in_unions, union_edges
from areascreen.operators.skew import salted_join
from areascreen.session import cut_lineage

#: Angles are counted from here: a direction in which no corner of a plan lies.
START = 0.7390851332151607
_TURN = 2 * math.pi
#: Directions whose outermost centres of a key are tried first against all its circles.
_OUTER = 16
#: Overlaps up to this many square metres are rounding.
LEAST_AREA = 1e-6


def _angle(y: Column, x: Column) -> Column:
    """Direction as an angle from START, 0 to a full turn."""
    return F.pmod(F.atan2(y, x) - START, F.lit(_TURN))


def _turned(angle: Column, cx: Column, cy: Column, r: Column) -> Column:
    """Integral of (x dy - y dx) / 2 along the circle from START to ``angle``; the centre is relative to the origin."""
    a = angle + START
    moved = cx * (F.sin(a) - math.sin(START)) - cy * (F.cos(a) - math.cos(START))
    return (r * r * angle + r * moved) / 2


def _covered(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, k, x0, x1: the angles of each circle (centre x, y) that other discs of its radius (centre ``_x``, ``_y``) cover."""
    dx, dy = F.col("_x") - F.col("x"), F.col("_y") - F.col("y")
    gap = F.sqrt(dx * dx + dy * dy)
    half = F.acos(F.least(F.lit(1.0), gap / (2 * F.col("radius"))))
    near = pairs.filter((gap > 0) & (gap < 2 * F.col("radius")))
    start = F.pmod(_angle(dy, dx) - half, F.lit(_TURN))
    parts = near.select(*keys, start.alias("_a"), (start + 2 * half).alias("_b"))
    cut = F.array(F.struct(F.col("_a").alias("x0"), F.least(F.col("_b"), F.lit(_TURN)).alias("x1")), F.struct(F.lit(0.0).alias("x0"), (F.col("_b") - _TURN).alias("x1")))
    split = parts.select(*keys, F.lit(0).alias("k"), F.inline(cut)).filter("x1 > x0")
    return condense(split, keys)


def _free(circles: DataFrame, covered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, start, end: what the covered angles leave of each circle."""
    ends = circles.select(*keys, F.lit(0).alias("k"), F.inline(F.array(*[F.struct(F.lit(a).alias("x0"), F.lit(a).alias("x1")) for a in (0.0, _TURN)])))
    islands = merge(covered.unionByName(ends).withColumn("column", F.lit(0)), keys)
    before = F.lag("x1").over(Window.partitionBy(*keys).orderBy("x0", "x1"))
    return islands.select(*keys, before.alias("start"), F.col("x0").alias("end")).filter("end > start")


def union_arcs(centres: DataFrame, radii: Sequence[float], *, key: str) -> DataFrame:
    """key, radius, x, y, start, end: the arcs that bound the union of the discs around the key's centres.

    Circles are first compared with a few outermost centres of their key. Only those left with a free arc meet the other
    centres of the key, so a key with very many centres is not paired with itself.
    """
    spots = cut_lineage(centres.select(key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).distinct())
    circles = spots.withColumn("radius", F.explode(F.array(*[F.lit(float(r)) for r in radii])))
    keys = [key, "radius", "x", "y"]
    lean = [F.col("x") * math.cos(_TURN * i / _OUTER) + F.col("y") * math.sin(_TURN * i / _OUTER) for i in range(_OUTER)]
    outer = spots.groupBy(key).agg(F.array_distinct(F.array(*[F.max_by(F.struct(F.col("x").alias("_x"), F.col("y").alias("_y")), d) for d in lean])).alias("outer"))
    tried = salted_join(circles, outer, [key], spread=["x", "y", "radius"]).select(*keys, F.inline("outer"))
    left = cut_lineage(_free(circles, _covered(tried, keys), keys).select(*keys).distinct())
    size = 2 * max(radii)
    around = left.withColumns({"lo_x": F.col("x"), "hi_x": F.col("x"), "lo_y": F.col("y"), "hi_y": F.col("y")})
    around = box_cells(around, size, size).drop("lo_x", "hi_x", "lo_y", "hi_y")
    others = spots.select(key, F.col("x").alias("_x"), F.col("y").alias("_y"), cell(F.col("x"), size).alias("cx"), cell(F.col("y"), size).alias("cy"))
    pairs = salted_join(others, around, [key, "cx", "cy"], spread=["_x", "_y"], multiplies=True).select(*keys, "_x", "_y")
    return _free(left, _covered(pairs, keys), keys)


def union_area(arcs: DataFrame, key: str, name: str = "area") -> DataFrame:
    """key, radius, area of the union that the arcs bound."""
    origin = arcs.groupBy(key).agg(F.min("x").alias("ox"), F.min("y").alias("oy"))
    cx, cy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
    swept = _turned(F.col("end"), cx, cy, F.col("radius")) - _turned(F.col("start"), cx, cy, F.col("radius"))
    return arcs.join(origin, key).groupBy(key, "radius").agg(F.sum(swept).alias(name))


def _chords(pairs: DataFrame) -> DataFrame:
    """Add t0, t1, leaves, enters: the part of each edge inside the disc around (x, y), and whether the edge crosses the
    circle there on its way out and in."""
    fx, fy = F.col("x1") - F.col("x"), F.col("y1") - F.col("y")
    gx, gy = F.col("x2") - F.col("x"), F.col("y2") - F.col("y")
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    r2 = F.col("radius") * F.col("radius")
    pairs = pairs.withColumns({"_in1": fx * fx + fy * fy <= r2, "_in2": gx * gx + gy * gy <= r2, "_a": dx * dx + dy * dy, "_b": fx * dx + fy * dy, "_c": fx * fx + fy * fy - r2})
    reached = (F.col("_b") * F.col("_b") - F.col("_a") * F.col("_c")) > 0
    root = F.sqrt(F.greatest(F.lit(0.0), F.col("_b") * F.col("_b") - F.col("_a") * F.col("_c")))
    within = lambda t: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(t, F.lit(0.0))))
    first, last = within(F.try_divide(-F.col("_b") - root, F.col("_a"))), within(F.try_divide(root - F.col("_b"), F.col("_a")))
    passes = ~F.col("_in1") & ~F.col("_in2") & reached & (F.col("_b") < 0) & (F.col("_b") + F.col("_a") > 0)
    met = pairs.filter(F.col("_in1") | F.col("_in2") | passes)
    return met.withColumns({
        "t0": F.when(F.col("_in1"), 0.0).otherwise(first), "t1": F.when(F.col("_in2"), 1.0).otherwise(last), "enters": ~F.col("_in1"), "leaves": ~F.col("_in2"),
    }).drop("_in1", "_in2", "_a", "_b", "_c")


def overlap_areas(
    centres: DataFrame, edges: DataFrame, radii: Sequence[float], *, key: str, polygon: str = "geo_id", arcs: DataFrame | None = None,
    holders: DataFrame | None = None, names: DataFrame | None = None,
) -> DataFrame:
    """key, radius, polygon, overlap_area: area of each polygon inside the union of the discs around each key's centres.

    ``edges`` are rows of simple rings (x1, y1, x2, y2; ``part`` and ``ring`` where there are holes) of the same
    ``polygon``; holes and several parts count as they should. Pairs that share at most LEAST_AREA have no row. Copies
    of a centre add nothing. Rows without coordinates or key take no part.

    Edges of a union of polygons (``union_edges``) come with ``holders``, the edges of the polygons in it, and ``names``,
    which polygon (``geo_id``) belongs to which union (``polygon``).
    """
    edges = edges.dropna(subset=[polygon, "x1", "y1", "x2", "y2"])
    centres = centres.select(key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna().distinct()
    origin = centres.groupBy(key).agg(F.min("x").alias("ox"), F.min("y").alias("oy"))
    spots = cut_lineage(centres.join(origin, key))
    if arcs is None:
        arcs = union_arcs(centres, radii, key=key)
    arcs = cut_lineage(arcs.join(spots, [key, "x", "y"]))
    sided = (oriented(edges, polygon) if holders is None else edges).select(polygon, "x1", "y1", "x2", "y2")
    size = float(max(radii))
    boxed = sided.select("*", F.least("x1", "x2").alias("lo_x"), F.greatest("x1", "x2").alias("hi_x"), F.least("y1", "y2").alias("lo_y"), F.greatest("y1", "y2").alias("hi_y"))
    cells = cut_lineage(box_cells(boxed, size, size).drop("lo_x", "hi_x", "lo_y", "hi_y"))
    placed = spots.withColumn("cx", cell(F.col("x"), size)).withColumn("cy", cell(F.col("y"), size))
    near = salted_join(cells, placed, ["cx", "cy"], spread=[polygon, "x1", "y1"], multiplies=True).drop("cx", "cy")
    near = near.withColumn("_d", segment_distance(F.col("x"), F.col("y"))).withColumn("radius", F.explode(F.array(*[F.lit(float(r)) for r in radii])))
    chords = cut_lineage(_chords(near.filter(F.col("_d") <= F.col("radius")).drop("_d")))

    # Edges inside the union: lengths of united chords, in metres along the edge.
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    length = F.sqrt(dx * dx + dy * dy)
    edge = [key, "radius", polygon, "ox", "oy", "x1", "y1", "x2", "y2"]
    spans = chords.select(*edge, F.lit(0).alias("k"), (F.col("t0") * length).alias("x0"), (F.col("t1") * length).alias("x9")).filter("x9 > x0")
    # condense and merge name the ends x0 and x1; the edge's own x1 is kept under another name meanwhile.
    named = ["px", *[c for c in edge if c != "x1"]]
    spans = spans.withColumnRenamed("x1", "px").withColumnRenamed("x9", "x1")
    united = merge(condense(spans, named).withColumn("column", F.lit(0)), named)
    inside = united.groupBy(*named).agg(F.sum(F.col("x1") - F.col("x0")).alias("_inside")).withColumnRenamed("px", "x1")
    cross = (F.col("x1") - F.col("ox")) * dy - (F.col("y1") - F.col("oy")) * dx
    along = inside.groupBy(key, "radius", polygon).agg(F.sum(cross * F.least(F.lit(1.0), F.col("_inside") / length) / 2).alias("part"))

    # Arcs inside the polygon: an edge that leaves a disc opens the inside for the angles behind it, one that enters closes it.
    cx, cy, r = F.col("x") - F.col("ox"), F.col("y") - F.col("oy"), F.col("radius")

    def crossing(t: str) -> Column:
        return _angle(F.col("y1") + F.col(t) * dy - F.col("y"), F.col("x1") + F.col(t) * dx - F.col("x"))

    turns = F.array(F.struct(F.col("leaves").alias("real"), crossing("t1").alias("at"), F.lit(1).alias("sign")), F.struct(F.col("enters").alias("real"), crossing("t0").alias("at"), F.lit(-1).alias("sign")))
    crossings = chords.select(key, "radius", "x", "y", polygon, "ox", "oy", F.inline(turns)).filter("real")
    met = crossings.join(arcs.drop("ox", "oy"), [key, "radius", "x", "y"])
    at = F.greatest(F.col("start"), F.least(F.col("end"), F.col("at")))
    opened = met.groupBy(key, "radius", polygon).agg(F.sum(F.col("sign") * (_turned(F.col("end"), cx, cy, r) - _turned(at, cx, cy, r))).alias("part"))
    # The polygons that hold a circle's point at START hold its arcs from there on.
    marked = arcs.withColumns({"sx": F.col("x") + r * math.cos(START), "sy": F.col("y") + r * math.sin(START)})
    starts = marked.select(F.col("sx").alias("x"), F.col("sy").alias("y"))
    held = points_in_polygons(starts, edges, cell_size=size, key=polygon) if holders is None else points_in_unions(starts, holders, names, cell_size=size)
    based = marked.join(held.select(F.col("x").alias("sx"), F.col("y").alias("sy"), polygon), ["sx", "sy"])
    whole = based.groupBy(key, "radius", polygon).agg(F.sum(_turned(F.col("end"), cx, cy, r) - _turned(F.col("start"), cx, cy, r)).alias("part"))

    total = along.unionByName(opened).unionByName(whole).groupBy(key, "radius", polygon).agg(F.sum("part").alias("overlap_area"))
    return total.filter(F.col("overlap_area") > LEAST_AREA)


def area_weighted_population(centres: DataFrame, zones: DataFrame, radii: Sequence[int], *, key: str) -> DataFrame:
    """key, radius, population, zone_count: zone population allocated by the share of zone area covered.

    ``zones`` are edge rows with ``geo_id`` and ``population`` (null counts as 0). Zones without area take no part.
    """
    from areascreen.operators.geometry.reach import within_reach

    found = within_reach(centres, zones, radii, key=key, distances=False).filter("zone_count > 0")
    return found.select(key, F.col("radius").cast("int").alias("radius"), "population", "zone_count")


def category_overlap(centres: DataFrame, parcels: DataFrame, radii: Sequence[int], *, key: str, cell_size: float = 500.0) -> DataFrame:
    """key, radius, category, area, buffer_area, area_share: parcel area inside the buffer.

    ``parcels`` are edge rows with geo_id and category. Parcels that overlap count once per category; the row with a
    null category is the union over all categories. Categories that share nothing with a buffer have no row.

    The unions are tiles (``tiles``), the overlaps sums over tiles in reach. Parcels with more than ``reach.EDGES`` edges are not
    held in one row: then all goes through joins of edges, in grid cells of ``cell_size``.
    """
    from areascreen.operators.geometry import reach
    from areascreen.operators.geometry.tiles import union_tiles

    parcels = parcels.dropna(subset=["geo_id", "x1", "y1", "x2", "y2"])
    if parcels.groupBy("geo_id").count().filter(F.col("count") > reach.EDGES).isEmpty():
        tiles = union_tiles(parcels, F.concat(F.lit("="), F.coalesce("category", F.lit(""))), all_as="all", size=2 * cell_size)
        found = reach.union_overlap(centres, tiles, radii, key=key)
        return found.select(
            key, F.col("radius").cast("int").alias("radius"), F.when(F.col("_by") != "all", F.substr("_by", F.lit(2))).alias("category"),
            "area", "buffer_area", (F.col("area") / F.col("buffer_area")).alias("area_share"))
    labelled = F.explode(F.array(F.concat(F.lit("="), F.coalesce("category", F.lit(""))), F.lit("all"))).alias("_by")
    parcels = cut_lineage(parcels.dropna(subset=["geo_id", "x1", "y1", "x2", "y2"]).select("geo_id", *[c for c in ("part", "ring") if c in parcels.columns], labelled, "x1", "y1", "x2", "y2"))
    boundary, holders, names = union_edges(parcels, "_by", cell_size=cell_size)
    arcs = cut_lineage(union_arcs(centres.dropna(subset=[key, "x", "y"]), radii, key=key))
    buffers = union_area(arcs, key, "buffer_area")
    found = overlap_areas(centres, boundary, radii, key=key, polygon="_by", arcs=arcs, holders=holders, names=names)
    return found.join(buffers, [key, "radius"]).select(
        key, F.col("radius").cast("int").alias("radius"), F.when(F.col("_by") != "all", F.substr("_by", F.lit(2))).alias("category"),
        F.col("overlap_area").alias("area"), "buffer_area", (F.col("overlap_area") / F.col("buffer_area")).alias("area_share"))
