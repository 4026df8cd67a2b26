"""What is wrong with a polygon, and where: rows for a report, no repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from areascreen.operators.geometry.grid import box_cells, cell
from areascreen.operators.skew import salted_join
from areascreen.session import cut_lineage


def problems(edges: DataFrame, *, key: str = "geo_id", cell_size: float) -> DataFrame:
    """key, reason, x, y: every place at which a polygon is not valid.

    ``edges`` have x1, y1, x2, y2 and may have part and ring. Reasons:

    - ``missing_coordinate``: an edge without one (no place),
    - ``degenerate_edge``: an edge of no length,
    - ``unclosed_ring``: a corner at which not as many edges end as begin,
    - ``repeated_corner``: a corner at which a ring begins more than one edge, so it touches itself there,
    - ``touching_edge``: a corner inside another edge of the polygon,
    - ``crossing_edges``: two edges that cross, at the crossing,
    - ``overlapping_edges``: two edges that share a stretch, as in a spike, at the lower end of what they share.

    Edges meet through the cells of their boxes, so a polygon of very many edges is not paired with itself; a pair counts
    in one cell only. Positions are compared exactly.
    """
    rings = [F.coalesce(F.col(c), F.lit(0)).alias(f"_{c}") if c in edges.columns else F.lit(0).alias(f"_{c}") for c in ("part", "ring")]
    coordinates = ["x1", "y1", "x2", "y2"]
    known = cut_lineage(edges.select(key, *rings, *coordinates, F.monotonically_increasing_id().alias("_id")))
    whole = known.dropna(subset=coordinates)
    short = (F.col("x1") == F.col("x2")) & (F.col("y1") == F.col("y2"))
    missing = known.filter(F.greatest(*[F.col(c).isNull() for c in coordinates])).select(
        key, F.lit("missing_coordinate").alias("reason"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))
    degenerate = whole.filter(short).select(key, F.lit("degenerate_edge").alias("reason"), F.col("x1").alias("x"), F.col("y1").alias("y"))

    real = whole.filter(~short)
    corners = F.inline(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"), F.lit(1).alias("out")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"), F.lit(-1).alias("out"))))
    at = real.select(key, "_part", "_ring", corners).groupBy(key, "_part", "_ring", "x", "y").agg(F.sum("out").alias("over"), F.count_if(F.col("out") == 1).alias("starts"))
    reasons = F.array_compact(F.array(F.when(F.col("over") != 0, F.lit("unclosed_ring")), F.when(F.col("starts") > 1, F.lit("repeated_corner"))))
    corner = at.select(key, F.explode(reasons).alias("reason"), "x", "y")

    boxed = real.withColumns({"lo_x": F.least("x1", "x2"), "hi_x": F.greatest("x1", "x2"), "lo_y": F.least("y1", "y2"), "hi_y": F.greatest("y1", "y2")})
    celled = cut_lineage(box_cells(boxed, cell_size))
    renamed = {"_id": "_other", "x1": "u1", "y1": "v1", "x2": "u2", "y2": "v2", "lo_x": "lo_u", "hi_x": "hi_u", "lo_y": "lo_v", "hi_y": "hi_v"}
    other = celled.select(key, "cx", "cy", *[F.col(a).alias(b) for a, b in renamed.items()])
    touch = (F.col("lo_x") <= F.col("hi_u")) & (F.col("lo_u") <= F.col("hi_x")) & (F.col("lo_y") <= F.col("hi_v")) & (F.col("lo_v") <= F.col("hi_y"))
    here = (cell(F.greatest("lo_x", "lo_u"), cell_size) == F.col("cx")) & (cell(F.greatest("lo_y", "lo_v"), cell_size) == F.col("cy"))
    pairs = salted_join(celled, other, [key, "cx", "cy"], spread=["_id"], condition=touch & here & (F.col("_id") < F.col("_other")), multiplies=True)

    def side(px: str, py: str, a: tuple[str, str], b: tuple[str, str]):
        """Positive on the left of the line from a to b, zero on it."""
        return (F.col(b[0]) - F.col(a[0])) * (F.col(py) - F.col(a[1])) - (F.col(b[1]) - F.col(a[1])) * (F.col(px) - F.col(a[0]))

    e, f = (("x1", "y1"), ("x2", "y2")), (("u1", "v1"), ("u2", "v2"))
    sides = {"_s1": side("u1", "v1", *e), "_s2": side("u2", "v2", *e), "_t1": side("x1", "y1", *f), "_t2": side("x2", "y2", *f)}
    met = pairs.withColumns(sides)
    crossing = (F.signum("_s1") * F.signum("_s2") < 0) & (F.signum("_t1") * F.signum("_t2") < 0)
    share = F.col("_s1") / (F.col("_s1") - F.col("_s2"))
    cross = met.filter(crossing).select(
        key, F.lit("crossing_edges").alias("reason"), (F.col("u1") + share * (F.col("u2") - F.col("u1"))).alias("x"), (F.col("v1") + share * (F.col("v2") - F.col("v1"))).alias("y"))
    in_line = (F.col("_s1") == 0) & (F.col("_s2") == 0)
    low = F.greatest(*[F.least(F.struct(F.col(a).alias("x"), F.col(b).alias("y")), F.struct(F.col(c).alias("x"), F.col(d).alias("y"))) for (a, b), (c, d) in (e, f)])
    high = F.least(*[F.greatest(F.struct(F.col(a).alias("x"), F.col(b).alias("y")), F.struct(F.col(c).alias("x"), F.col(d).alias("y"))) for (a, b), (c, d) in (e, f)])
    overlap = met.filter(in_line).withColumns({"_low": low, "_high": high}).filter("_low < _high").select(key, F.lit("overlapping_edges").alias("reason"), "_low.x", "_low.y")

    def inside(px: str, py: str, on: str, a: tuple[str, str], b: tuple[str, str]):
        point, ends = F.struct(F.col(px).alias("x"), F.col(py).alias("y")), [F.struct(F.col(c).alias("x"), F.col(d).alias("y")) for c, d in (a, b)]
        return F.when((F.col(on) == 0) & (F.least(*ends) < point) & (point < F.greatest(*ends)), point)

    tips = F.array_compact(F.array(inside("u1", "v1", "_s1", *e), inside("u2", "v2", "_s2", *e), inside("x1", "y1", "_t1", *f), inside("x2", "y2", "_t2", *f)))
    tip = met.filter(~in_line).select(key, F.explode(tips).alias("p")).select(key, F.lit("touching_edge").alias("reason"), "p.x", "p.y")
    found = missing
    for part in (degenerate, corner, cross, overlap, tip):
        found = found.unionByName(part)
    return found.distinct()


def validity(edges: DataFrame, *, key: str = "geo_id", cell_size: float) -> DataFrame:
    """key, valid, reason, x, y, problem_count for every polygon: the first reason by name and its lowest place."""
    each = problems(edges, key=key, cell_size=cell_size).groupBy(key).agg(F.min(F.struct("reason", "x", "y")).alias("first"), F.count(F.lit(1)).alias("problem_count"))
    rows = edges.select(key).distinct().join(each, key, "left")
    return rows.select(key, F.col("first").isNull().alias("valid"), "first.reason", "first.x", "first.y", F.coalesce("problem_count", F.lit(0)).alias("problem_count"))
