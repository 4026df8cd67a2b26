from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from areascreen.functions.projection import TransverseMercator, to_degrees, to_metres
from areascreen.operators.geometry import areas, grid, nearest, polygons, reach
from areascreen.operators.ranking import quartile_from_percentile  # noqa: F401
from areascreen.plans.proximity import add_demand_ranks, proximity_checks


def edges_of(spark, shapes, extra=""):
    rows = []
    for key, (corners, *rest) in shapes.items():
        for i, (a, b) in enumerate(zip(corners, corners[1:] + corners[:1])):
            rows.append((key, *rest, *map(float, a), *map(float, b)))
    return spark.createDataFrame(rows, f"geo_id string{extra}, x1 double, y1 double, x2 double, y2 double")


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def points(spark, rows, schema="node_id string, x double, y double"):
    return spark.createDataFrame(rows, schema)


def test_projection_origin_and_round_trip(spark):
    tm = TransverseMercator()
    df = spark.createDataFrame([(tm.origin_longitude, tm.origin_latitude), (103.6, 1.15), (104.1, 1.48)], "lon double, lat double")
    rows = df.withColumn("m", to_metres(F.col("lon"), F.col("lat"))).withColumn("d", to_degrees(F.col("m.easting"), F.col("m.northing"))).collect()
    assert rows[0]["m"]["easting"] == pytest.approx(28001.642, abs=1e-6)
    assert rows[0]["m"]["northing"] == pytest.approx(38744.572, abs=1e-6)
    for r in rows:  # a millimetre is about 1e-8 degrees
        assert r["d"]["longitude"] == pytest.approx(r["lon"], abs=1e-9)
        assert r["d"]["latitude"] == pytest.approx(r["lat"], abs=1e-9)


def test_area_and_centroid(spark):
    edges = edges_of(spark, {"a": (box(1000, 2000, 1010, 2020),)})
    row = polygons.measures(edges).first()
    assert (row["area"], row["centroid_x"], row["centroid_y"], row["closed"]) == (200.0, 1005.0, 2010.0, True)
    broken = polygons.measures(edges.filter("x1 = 1000")).first()
    assert broken["closed"] is False


def test_point_in_polygon_policies(spark):
    shapes = {"a": (box(0, 0, 10, 10),), "b": (box(5, 0, 15, 10),), "u": ([(20, 0), (30, 0), (30, 10), (26, 10), (25, 2), (24, 10), (20, 10)],)}
    edges = edges_of(spark, shapes)
    names = edges.select("geo_id", F.col("geo_id").alias("name")).distinct()
    pts = points(spark, [("p", 2.0, 5.0), ("q", 7.0, 5.0), ("r", 25.0, 8.0), ("s", 21.0, 8.0), ("t", 99.0, 1.0), ("q2", 7.0, 5.0)])
    for policy, q in (("least", "a"), ("unique", None)):
        got = {r["node_id"]: r["name"] for r in polygons.assign_polygon(pts, edges, names, policy=policy, cell_size=4.0, attributes=["name"]).collect()}
        assert got == {"p": "a", "q": q, "q2": q, "r": None, "s": "u", "t": None}


def test_border_points_under_three_policies(spark):
    edges = edges_of(spark, {"a": (box(0, 0, 10, 10),), "b": (box(10, 0, 20, 10),), "c": ([(0, 10), (10, 10), (5, 20)],)})
    names = edges.select("geo_id", F.col("geo_id").alias("name")).distinct()
    pts = points(spark, [("side", 10.0, 5.0), ("low", 5.0, 0.0), ("corner", 10.0, 10.0), ("end", 20.0, 10.0), ("slant", 7.5, 15.0), ("flat", 4.0, 10.0), ("in", 1.0, 1.0), ("out", 21.0, 10.0), ("beside", 30.0, 0.0)])
    want = {  # policy least, policy unique, number of matches
        "side": ("a", None, 2), "low": ("a", "a", 1), "corner": ("a", None, 3), "end": ("b", "b", 1), "slant": ("c", "c", 1), "flat": ("a", None, 2), "in": ("a", "a", 1), "out": (None, None, 0), "beside": (None, None, 0)}
    for k, policy in enumerate(("least", "unique")):
        got = {r["node_id"]: (r["name"], r["match_count"]) for r in polygons.assign_polygon(pts, edges, names, policy=policy, cell_size=4.0, attributes=["name"]).collect()}
        assert got == {n: (w[k], w[2]) for n, w in want.items()}
    one = {r["node_id"]: r["match_count"] for r in polygons.assign_polygon(pts, edges, names, policy="inside", cell_size=4.0, attributes=["name"]).collect()}
    assert one["side"] == one["flat"] == one["in"] == 1 and one["corner"] <= 1 and one["out"] == 0
    with pytest.raises(ValueError):
        polygons.assign_polygon(pts, edges, names, policy="any", cell_size=4.0, attributes=["name"])


def lens(r, d):
    return 2 * r * r * math.acos(d / (2 * r)) - d / 2 * math.sqrt(4 * r * r - d * d)


def test_population_is_allocated_by_exact_area(spark):
    zones = edges_of(spark, {"a": (box(0, 0, 1000, 1000), 100.0), "b": (box(1000, 0, 2000, 1000), 200.0), "thin": (box(0, 100.25, 500, 100.5), 500.0), "far": (box(9000, 0, 9001, 1), 7.0), "flat": ([(0, 0), (5, 5)], 3.0)}, ", population double")
    row = areas.area_weighted_population(points(spark, [("n", 0.0, 500.0)]), zones, [1500], key="node_id").first()
    # Area of the second zone inside the disc of radius 1500 around (0, 500), by slices in closed form.
    strip = lambda y: (y * math.sqrt(1500**2 - y * y) + 1500**2 * math.asin(y / 1500)) / 2 - 1000 * y
    assert row["zone_count"] == 3
    assert row["population"] == pytest.approx(100 + 500 + 200 * 2 * strip(500) / 1e6, rel=1e-12)


def test_exact_overlaps_of_hard_shapes(spark):
    shapes = {
        "inside": (box(0, 0, 100, 100),), "clockwise": (box(0, 0, 100, 100)[::-1],), "around": (box(-5000, -5000, 5000, 5000),),
        "corner_on_circle": (box(480, 640, 900, 900),), "touching": (box(800, -50, 900, 50),), "through_corner": ([(480, 640), (-480, 640), (0, 0)],),
        "inscribed": ([(800, 0), (0, 800), (-800, 0), (0, -800)],), "twice_in_and_out": ([(-900, 700), (900, 700), (900, 710), (-900, 710)],), "away": (box(2000, 0, 2001, 1),)}
    got = {r["geo_id"]: r["overlap_area"] for r in areas.overlap_areas(points(spark, [("n", 0.0, 0.0)] * 3), edges_of(spark, shapes), [800], key="node_id").collect()}
    half = lambda y: (y * math.sqrt(800**2 - y * y) + 800**2 * math.asin(y / 800)) / 2
    assert got == pytest.approx({
        "inside": 1e4, "clockwise": 1e4, "around": math.pi * 640000, "through_corner": 480 * 640.0, "inscribed": 1280000.0, "twice_in_and_out": 2 * (half(710) - half(700))}, rel=1e-12)


def test_a_hole_and_a_second_part_count(spark):
    rows = [("a", 0, 0, *map(float, p), *map(float, q)) for c in [box(0, 0, 100, 100)] for p, q in zip(c, c[1:] + c[:1])]
    rows += [("a", 0, 1, *map(float, p), *map(float, q)) for c in [box(40, 40, 60, 60)] for p, q in zip(c, c[1:] + c[:1])]
    rows += [("a", 1, 0, *map(float, p), *map(float, q)) for c in [box(200, 0, 210, 10)[::-1]] for p, q in zip(c, c[1:] + c[:1])]
    edges = spark.createDataFrame(rows, "geo_id string, part int, ring int, x1 double, y1 double, x2 double, y2 double")
    found = areas.overlap_areas(points(spark, [("n", 50.0, 50.0), ("m", 50.0, 1050.0)]), edges, [5, 800, 1000], key="node_id").collect()
    got = {(r["node_id"], int(r["radius"])): r["overlap_area"] for r in found}
    assert got.keys() == {("n", 800), ("n", 1000), ("m", 1000)} and got["n", 800] == got["n", 1000] == pytest.approx(9700.0, rel=1e-12)


def test_random_overlaps_against_slices(spark):
    """Many discs and a star: areas by a fine midpoint rule over exact widths."""
    rng = random.Random(8)
    centres = [("n", rng.uniform(0, 900), rng.uniform(0, 900)) for _ in range(25)] + [("m", rng.uniform(0, 300), rng.uniform(0, 300)) for _ in range(120)]
    star = [(450 + (700 if k % 2 else 150) * math.cos(k * math.pi / 7 + 0.1), 450 + (700 if k % 2 else 150) * math.sin(k * math.pi / 7 + 0.1)) for k in range(14)]
    frame = points(spark, centres)
    got = {(r["node_id"], int(r["radius"])): r["overlap_area"] for r in areas.overlap_areas(frame, edges_of(spark, {"s": (star,)}), [90, 200], key="node_id").collect()}
    whole = {(r["node_id"], int(r["radius"])): r["area"] for r in areas.union_area(areas.union_arcs(frame, [90, 200], key="node_id"), "node_id").collect()}

    def merged(parts):
        out = []
        for a, b in sorted(parts):
            if out and a <= out[-1][1]:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        return out

    n, low, high = 20_000, -400.0, 1400.0
    for key in ("n", "m"):
        for r in (90, 200):
            overlap = total = 0.0
            for k in range(n):
                y = low + (k + 0.5) * (high - low) / n
                discs = merged((x - math.sqrt(r * r - (y - v) ** 2), x + math.sqrt(r * r - (y - v) ** 2)) for c, x, v in centres if c == key and abs(y - v) < r)
                xs = sorted(a + (y - b) * (c - a) / (d - b) for (a, b), (c, d) in zip(star, star[1:] + star[:1]) if (b <= y) != (d <= y))
                total += sum(b - a for a, b in discs)
                overlap += sum(max(0.0, min(b, d) - max(a, c)) for a, b in discs for c, d in zip(xs[::2], xs[1::2]))
            assert got[key, r] == pytest.approx(overlap * (high - low) / n, rel=1e-5) and whole[key, r] == pytest.approx(total * (high - low) / n, rel=1e-5)


def test_copies_of_an_exit_add_no_area(spark):
    one, many = points(spark, [("n", 0.0, 0.0)]), points(spark, [("n", 0.0, 0.0)] * 50 + [("n", 0.001, 0.0)])
    area = lambda df: areas.union_area(areas.union_arcs(df, [800], key="node_id"), "node_id").first()["area"]
    assert area(one) == pytest.approx(math.pi * 800**2, rel=1e-12)
    assert area(many) == pytest.approx(2 * math.pi * 800**2 - lens(800, 0.001), rel=1e-9)


def test_union_of_two_discs_and_a_ring_with_a_gap_inside(spark):
    rows = [("n", 0.0, 0.0), ("n", 300.0, 0.0)] + [("ring", 1000 * math.cos(k * math.pi / 6), 1000 * math.sin(k * math.pi / 6)) for k in range(12)] + [("inner", 0.0, 0.0)]
    got = {r["node_id"]: r["area"] for r in areas.union_area(areas.union_arcs(points(spark, rows), [400], key="node_id"), "node_id").collect()}
    side = 2 * 1000 * math.sin(math.pi / 12)
    assert got == pytest.approx({"n": 2 * math.pi * 400**2 - lens(400, 300), "ring": 12 * (math.pi * 400**2 - lens(400, side)), "inner": math.pi * 400**2}, rel=1e-9)


def test_overlapping_parcels_count_once(spark):
    parcels = edges_of(spark, {
        "a": (box(0, 0, 100, 100), "shop"), "b": (box(50, 0, 150, 100), "shop"), "c": (box(50, 0, 100, 100), "office"), "d": (box(100, 20, 150, 80), "shop"),
        "e": (box(0, 100, 50, 120), "shop"), "copy": (box(0, 0, 100, 100), "shop"), "none": (box(-50, 0, -40, 10), None)}, ", category string")
    found = areas.category_overlap(points(spark, [("n", 75.0, 50.0)]), parcels, [400], key="node_id", cell_size=60.0).collect()
    got = {r["category"]: r["area"] for r in found}
    assert got == pytest.approx({"shop": 16000.0, "office": 5000.0, "": 100.0, None: 16100.0}, rel=1e-9)
    assert found[0]["buffer_area"] == pytest.approx(math.pi * 400**2, rel=1e-12)


def test_borders_of_a_union(spark):
    from areascreen.operators.geometry.unions import union_edges

    ring = {f"r{k}": (c, "x") for k, c in enumerate([box(0, 0, 30, 10), box(0, 20, 30, 30), box(0, 10, 10, 20), box(20, 10, 30, 20)])}  # leaves a hole
    edges, _, _ = union_edges(edges_of(spark, {**ring, "cross": ([(-5, -5), (40, -5), (40, 5)], "y"), "cut": ([(-5, 5), (-5, -6), (40, -6)], "y")}, ", category string"), "category", cell_size=7.0)
    area = {r["category"]: r["a"] for r in edges.groupBy("category").agg((F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2).alias("a")).collect()}
    assert area["x"] == pytest.approx(900 - 100) and edges.filter("category = 'x'").agg(F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))).first()[0] == pytest.approx(160)
    assert area["y"] == pytest.approx(225 + 247.5 - _shared(), rel=1e-6)


def _shared(n=400_000):
    """Overlap of the two triangles by slices along x."""
    total = 0.0
    for k in range(n):
        x = -5 + 45 * (k + 0.5) / n
        total += max(0.0, min(-5 + (x + 5) / 45 * 10, 5 - (x + 5) / 45 * 11) - max(-5.0, -6.0))
    return total * 45 / n


def test_counts_within_a_union_of_buffers(spark):
    exits = points(spark, [("n", 0.0, 0.0), ("n", 100.0, 0.0), ("m", 9000.0, 0.0)])
    stops = points(spark, [("a", 50.0, 0.0), ("b", 50.0, 0.0), ("c", 899.0, 0.0), ("d", 1300.0, 0.0), ("e", 1301.0, 0.0)])
    got = {r["node_id"]: (r["stop_800m"], r["stop_1200m"]) for r in grid.counts_within(exits, stops, [800.0, 1200.0], key="node_id", prefix="stop").collect()}
    assert got == {"n": (3, 4), "m": (0, 0)}


def test_nearest_point_and_polygon_against_brute_force(spark):
    rng = random.Random(3)
    queries = [(f"n{i % 9}", rng.uniform(-5000, 60000), rng.uniform(-5000, 60000)) for i in range(40)]
    stops = [("s", rng.gauss(20000, 300), rng.gauss(20000, 300)) for _ in range(300)] + [("s", 50000.0, 1000.0)]
    got = {r["node_id"]: r["distance"] for r in nearest.nearest_point(points(spark, queries), points(spark, stops), key="node_id", leaf=100.0).collect()}
    expected: dict = {}
    for n, x, y in queries:
        expected[n] = min(expected.get(n, 1e99), min(math.hypot(x - a, y - b) for _, a, b in stops))
    assert got == pytest.approx(expected)
    edges = edges_of(spark, {"a": (box(0, 0, 100, 100),), "b": (box(5000, 5000, 5100, 5100),)})
    places = points(spark, [("in", 50.0, 50.0), ("near", 103.0, 104.0), ("far", 5050.0, 4000.0)])
    found = {r["node_id"]: r["distance"] for r in nearest.nearest_polygon(places, edges, key="node_id", leaf=50.0).collect()}
    assert found == pytest.approx({"in": 0.0, "near": 5.0, "far": 1000.0})


def test_demand_ranks_and_gates(spark):
    df = spark.createDataFrame([("A", 5.0, 9.0), ("C", 5.0, 4.0), ("B", 5.0, 6.0)], "node_id string, population_800m double, population_1200m double")
    got = sorted((r["rank"], r["node_id"], r["percentile"], r["quartile"]) for r in add_demand_ranks(df, "population_800m").collect())
    assert got == [(1, "A", 1.0, 4), (2, "B", 0.5, 3), (3, "C", 0.0, 1)]
    checks = {r["check_id"]: r["violations"] for r in proximity_checks(df, radii=(800, 1200), expected_nodes=3, national_population=8.0).collect()}
    assert checks == {"row_count": 0, "duplicate_nodes": 0, "negative_population": 0, "above_national": 1, "not_monotone": 1}


def test_area_of_a_ring_with_a_hole_wound_either_way(spark, tmp_path):
    import json

    from areascreen.operators.geometry.polygons import measures
    from areascreen.sources import readers

    shell, hole = [[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]], [[4, 4], [6, 4], [6, 6], [4, 6], [4, 4]]
    shapes = [("a", "Polygon", [shell, hole]), ("b", "Polygon", [shell, hole[::-1]]), ("c", "MultiPolygon", [[shell[::-1], hole], [[[20, 0], [22, 0], [22, 2], [20, 2], [20, 0]]]])]
    features = [{"type": "Feature", "properties": {"ID": i}, "geometry": {"type": t, "coordinates": c}} for i, t, c in shapes]
    (tmp_path / "mixed.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    _, edges = readers.read_polygon_features(spark, str(tmp_path / "mixed.json"), identifier="ID", required=["ID"])
    got = {r.geo_id: r for r in measures(edges).collect()}
    assert {k: round(r.area, 9) for k, r in got.items()} == {"a": 96.0, "b": 96.0, "c": 100.0}
    assert round(got["a"].centroid_x, 9) == round(got["b"].centroid_x, 9) == 5.0 and got["c"].closed


def test_problems_of_polygons_and_their_places(spark):
    from areascreen.operators.geometry.validity import problems, validity

    shapes = {
        "good": (box(0, 0, 100, 100),), "bow_tie": ([(0, 0), (10, 10), (10, 0), (0, 10)],), "spike": ([(0, 0), (10, 0), (10, 10), (10, 30), (10, 10), (0, 10)],),
        "pinched": ([(0, 0), (5, 5), (10, 0), (10, 10), (5, 5), (0, 10)],), "corner_on_edge": ([(0, 0), (10, 0), (10, 10), (5, 0), (0, 10)],), "point_twice": ([(0, 0), (10, 0), (10, 0), (0, 10)],)}
    edges = edges_of(spark, shapes).unionByName(edges_of(spark, {"open": (box(0, 0, 10, 10),)}).filter("x1 != 10 OR y1 != 10"))
    edges = edges.unionByName(spark.createDataFrame([("lost", None, 1.0, 2.0, 3.0)], edges.schema))
    got: dict = {}
    for r in problems(edges, cell_size=3.0).collect():
        got.setdefault(r["geo_id"], set()).add((r["reason"], r["x"], r["y"]))
    assert got == {
        "bow_tie": {("crossing_edges", 5.0, 5.0)}, "pinched": {("repeated_corner", 5.0, 5.0)}, "corner_on_edge": {("touching_edge", 5.0, 0.0)},
        "spike": {("overlapping_edges", 10.0, 10.0), ("repeated_corner", 10.0, 10.0)}, "point_twice": {("degenerate_edge", 10.0, 0.0)},
        "open": {("unclosed_ring", 10.0, 10.0), ("unclosed_ring", 0.0, 10.0)}, "lost": {("missing_coordinate", None, None)}}
    first = {r["geo_id"]: (r["valid"], r["reason"], r["x"], r["problem_count"]) for r in validity(edges, cell_size=50.0).collect()}
    assert first["good"] == (True, None, None, 0) and first["open"] == (False, "unclosed_ring", 0.0, 2) and len(first) == 8


def test_only_keys_outside_all_polygons_look_for_a_border(spark, monkeypatch):
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    rows = [(g, *square[i], *square[(i + 1) % 4]) for g in (1, 2) for i in range(4)]  # a polygon and its copy
    edges = spark.createDataFrame(rows, "geo_id int, x1 double, y1 double, x2 double, y2 double")
    places = spark.createDataFrame([("in", 5.0, 5.0), ("in", 90.0, 5.0), ("out", 13.0, 14.0), (None, 5.0, 5.0)], "node_id string, x double, y double")
    seen, descend = [], nearest.nearest_distance

    def spy(queries, *rest, **named):
        seen.extend(r["node_id"] for r in queries.collect())
        return descend(queries, *rest, **named)

    monkeypatch.setattr(nearest, "nearest_distance", spy)
    found = {r["node_id"]: r["distance"] for r in nearest.nearest_polygon(places, edges, key="node_id", leaf=4.0).collect()}
    assert found == {"in": 0.0, "out": 5.0, None: 5.0} and "in" not in seen


@pytest.fixture()
def reach_case(spark):
    rng = random.Random(3)
    exits = [("n", rng.uniform(0, 900), rng.uniform(0, 900)) for _ in range(25)] + [("m", rng.uniform(0, 60), rng.uniform(0, 60)) for _ in range(9)] + [("ring", 500 + 400 * math.cos(k), 500 + 400 * math.sin(k)) for k in range(12)] + [("lost", None, 1.0)]
    star = lambda x, y, r: [(x + (r if k % 2 else r / 4) * math.cos(k * math.pi / 5), y + (r if k % 2 else r / 4) * math.sin(k * math.pi / 5)) for k in range(10)]
    shapes = {f"s{i}": (star(rng.uniform(-300, 1200), rng.uniform(-300, 1200), rng.uniform(5, 150)), float(i)) for i in range(40)}
    shapes |= {"huge": (box(-3000, -3000, 3000, 3000), 1e6), "copy": (shapes["s1"][0], None), "again": (shapes["s1"][0][::-1], 7.0), "flat": ([(500, 500), (510, 510)], 3.0)}
    return points(spark, exits + exits[:9]), edges_of(spark, shapes, ", population double")


def test_reach_agrees_with_joins_of_edges_and_discs(spark, reach_case, monkeypatch):
    exits, zones = reach_case
    sized = polygons.measures(zones).join(zones.groupBy("geo_id").agg(F.coalesce(F.max("population"), F.lit(0.0)).alias("population")), "geo_id")
    shared = areas.overlap_areas(exits, zones, [90, 200], key="node_id").join(sized, "geo_id").filter("area > 0").groupBy("node_id", "radius").agg(F.sum(F.col("population") * F.col("overlap_area") / F.col("area")), F.count(F.lit(1)))
    want = {(r[0], r[1]): (r[2], r[3]) for r in shared.collect()}
    far = polygons.polygon_distances(exits.dropna(), zones, 200.0, key="node_id").collect()
    near = {(k, r): sum(x["node_id"] == k and x["distance"] < r for x in far) for k in ("n", "m", "ring") for r in (90.0, 200.0)}
    for limits in ((256, 512, 1024, 1 << 18), (10, 8, 1, 7)):  # one row each; then most by joins, pieces of one row and steps of a few edges
        for name, value in zip(("CENTRES", "EDGES", "KEY_ROWS", "STEP"), limits):
            monkeypatch.setattr(reach, name, value)
        got = {(r["node_id"], r["radius"]): (r["population"], r["zone_count"], r["reached"]) for r in reach.within_reach(exits, zones, [90, 200], key="node_id").collect()}
        assert {k: v[2] for k, v in got.items()} == near and {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
        assert {k: v[0] for k, v in got.items()} == pytest.approx({k: v[0] for k, v in want.items()}, rel=1e-9)


def test_population_writes_no_row_for_an_edge_and_a_disc(spark, reach_case, monkeypatch):
    monkeypatch.setattr(areas, "_chords", lambda pairs: pytest.fail("a row for every edge and disc"))
    assert areas.area_weighted_population(*reach_case, [200], key="node_id").count() == 3


def test_distances_write_no_row_for_a_node_and_a_polygon(spark, monkeypatch):
    from areascreen.catalog import spatial

    monkeypatch.setattr(polygons, "polygon_distances", lambda *a, **k: pytest.fail("a row for every node and polygon"))
    assert spatial.zones_reached(spark, "/root/testdata/sf0.001").agg(F.sum("zone_count")).first()[0] > 0


def test_edges_meet_only_discs_that_face_them(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(5)
    shapes, met = [], []
    for _ in range(300):
        (cx, cy), (w, h) = rng.uniform(-400, 400, 2), rng.uniform(5, 150, 2)
        corners = box(cx, cy, cx + w, cy + h)
        shapes.append({"edges": [dict(zip(("x1", "y1", "x2", "y2"), map(float, a + b))) for a, b in zip(corners, corners[1:] + corners[:1])], "lo_x": cx, "hi_x": cx + w, "lo_y": cy, "hi_y": cy + h, "population": 7.0, "copies": 1})
    piece, cut = reach._Piece(pa.Table.from_pylist(shapes)), reach._Piece._cut
    monkeypatch.setattr(reach._Piece, "_cut", staticmethod(lambda lines, in1, *rest: met.append(in1.size) or cut(lines, in1, *rest)))

    def sums():
        met.clear()
        found = []
        for r, spread in ((200.0, 60), (120.0, 100), (300.0, 1)):
            k = np.arange(12) * math.pi / 6
            x, y = spread * np.cos(k), spread * np.sin(k)
            circle, start, end = reach.free_arcs(x, y, r)
            found.append(piece.sums(x, y, r, circle, start, end, x.min(), y.min(), (x.min() - r, x.max() + r, y.min() - r, y.max() + r), lambda a, b: np.ones(len(a), dtype=bool), True, True))
        return found, sum(met)

    got, pairs = sums()
    monkeypatch.setattr(reach, "_facing", lambda x, *rest: [np.arange(len(x))])
    want, all_pairs = sums()
    assert [g[1:] for g in got] == [w[1:] for w in want] and [g[0] for g in got] == pytest.approx([w[0] for w in want], rel=1e-12)
    assert pairs < 0.6 * all_pairs


@pytest.fixture(scope="module")
def category_case(spark):
    rng = random.Random(11)
    corner = lambda: 10.0 * rng.randrange(-20, 60)
    rings = []
    for i in range(40):  # boxes on a lattice, so that borders and corners coincide; some with a hole
        x, y, w, h = corner(), corner(), 10.0 * rng.randrange(1, 20), 10.0 * rng.randrange(1, 20)
        rings.append((f"b{i}", "xyz"[i % 3], 0, box(x, y, x + w, y + h)[::rng.choice((1, -1))]))
        if i % 4 == 0:
            rings.append((f"b{i}", "xyz"[i % 3], 1, box(x + w / 4, y + h / 4, x + w / 2, y + h / 2)))
    for i in range(40):
        x, y, r = rng.uniform(-200, 600), rng.uniform(-200, 600), rng.uniform(5, 120)
        rings.append((f"s{i}", "xy"[i % 2], 0, [(x + (r if k % 2 else r / 3) * math.cos(k * math.pi / 5), y + (r if k % 2 else r / 3) * math.sin(k * math.pi / 5)) for k in range(10)]))
    rings += [("copy", "x", 0, rings[0][3]), ("flat", None, 0, [(500, 500), (510, 510)]), ("none", None, 0, box(100, 100, 140, 150))]
    rows = [(key, kind, 0, ring, *map(float, a), *map(float, b)) for key, kind, ring, corners in rings for a, b in zip(corners, corners[1:] + corners[:1])]
    exits = [("n", rng.uniform(0, 400), rng.uniform(0, 400)) for _ in range(12)] + [("m", 100.0, 100.0), ("m", 140.0, 100.0), ("far", 1e5, 0.0), ("lost", None, 1.0)]
    return points(spark, exits), spark.createDataFrame(rows, "geo_id string, category string, part int, ring int, x1 double, y1 double, x2 double, y2 double")


def test_category_tiles_agree_with_joins_of_edges(spark, category_case, monkeypatch):
    from areascreen.operators.geometry import tiles

    told = lambda: {(r["node_id"], r["radius"], r["category"]): (r["area"], r["buffer_area"], r["area_share"]) for r in areas.category_overlap(*category_case, [60, 200], key="node_id", cell_size=250.0).collect()}
    with monkeypatch.context() as patch:
        patch.setattr(reach, "EDGES", 3)  # the joins
        want = told()
    assert {k[2] for k in want} == {"x", "y", "z", "", None} and {k[0] for k in want} == {"n", "m"}
    for held, leaf, step, centres in ((16384, 128, 1 << 20, 256), (6, 4, 50, 256), (1, 1, 1 << 20, 8)):  # as is; squares quartered before and after they are held; keys by joins
        for module, name, value in ((tiles, "HELD", held), (tiles, "LEAF", leaf), (tiles, "STEP", step), (tiles, "LEAST", 8.0), (reach, "CENTRES", centres)):
            monkeypatch.setattr(module, name, value)
        got = told()
        assert got.keys() == want.keys()
        for k, values in want.items():
            assert got[k] == pytest.approx(values, rel=1e-9, abs=1e-4)


def test_category_overlap_pairs_no_edges_in_rows(spark, category_case, monkeypatch):
    from areascreen.operators.geometry import unions

    monkeypatch.setattr(areas, "_chords", lambda pairs: pytest.fail("a row for every edge and disc"))
    monkeypatch.setattr(unions, "_met", lambda pairs: pytest.fail("a row for every pair of edges"))
    assert areas.category_overlap(*category_case, [200], key="node_id").count() == 10
