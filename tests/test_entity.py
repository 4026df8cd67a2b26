from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from areascreen.functions import text
from areascreen.operators import catchment, entity, evidence, od, skew, stations
from areascreen.sources.schemas import CANDIDATES


def candidate(i, brand="Alpha", address="12 Main St #01-02", postal="123456", unit="#01-02", canonical=None, conflict=False):
    address_c, postal_c, unit_c = canonical or (None, None, None)
    return (f"c{i}", i, brand, address, postal, unit, address_c, postal_c, unit_c, conflict)


def resolve(spark, rows, aliases=None):
    return entity.deduplicate(spark.createDataFrame(rows, CANDIDATES), aliases)


def test_text_rules(spark):
    row = spark.createDataFrame([("  Blk 5, Lor  3 St (Mall) #01 - 02", "23456", "S(123456)", "x")], "a string, p string, q string, r string").select(
        text.normalize_address(F.col("a")).alias("a"), text.normalize_building_address(F.col("a")).alias("b"),
        text.normalize_postal_code(F.col("p")).alias("p"), text.normalize_postal_code(F.col("q")).alias("q"), text.normalize_postal_code(F.col("r")).alias("r"),
    ).first()
    assert tuple(row) == ("BLK 5, LOR 3 ST (MALL) #01-02", "5 LORONG 3 STREET", "023456", "123456", None)


def test_spelling_variants_merge_and_units_stay_apart(spark):
    result = resolve(spark, [candidate(1), candidate(2, brand=" alpha "), candidate(3, unit="#09-09")])
    got = {r["unit"]: r["source_candidate_count"] for r in result.branches.collect()}
    assert got == {"#01-02": 2, "#09-09": 1}
    assert result.memberships.count() == 3 and result.reviews.count() == 0


def test_missing_unit_beside_a_known_one_is_reviewed(spark):
    result = resolve(spark, [candidate(1), candidate(2, unit=None)])
    assert [r["issue_category"] for r in result.reviews.collect()] == ["ambiguous_unit_within_postal"]
    assert result.branches.count() == 2


def test_one_supported_identity_fills_the_unit(spark):
    support = ("12 Main Street", "123456", "#01-02")
    rows = [candidate(1, address="12 Main St", canonical=support), candidate(2, address="12 Main St", unit=None, postal=None)]
    result = resolve(spark, rows)
    assert result.branches.count() == 1 and result.reviews.count() == 0
    assert result.resolutions.first()["supporting_candidate_id"] == "c1"
    conflicting = resolve(spark, [*rows, candidate(3, address="12 Main St", conflict=True)])
    assert "conflicting_identity_evidence" in {r["issue_category"] for r in conflicting.reviews.collect()}


def test_without_postal_code_only_identical_text_merges(spark):
    rows = [candidate(1, postal="12"), candidate(2, postal=None), candidate(3, postal=None, address="13 Main St #01-02")]
    result = resolve(spark, rows)
    assert sorted(r["source_candidate_count"] for r in result.branches.collect()) == [1, 2]
    assert {r["issue_category"] for r in result.reviews.collect()} == {"missing_or_invalid_postal_code"}


def test_aliases_join_brands(spark):
    aliases = spark.createDataFrame([("BETA", "ALPHA")], "alias string, canonical_brand string")
    assert resolve(spark, [candidate(1), candidate(2, brand="beta")], aliases).branches.count() == 1


OBS = "branch_id string, observation_type string, evidence_scope string, polarity string, observed_at string"
ELEMENTS = evidence.ELEMENTS


@pytest.mark.parametrize("rows, expected", [
    ([(e, "operator_controlled", "supports", "2024-01-10") for e in ELEMENTS], "confirmed"),
    ([(e, "operator_controlled", "supports", "2023-01-10") for e in ELEMENTS], "possible"),
    ([(e, "directory", "supports", "2024-01-10") for e in ELEMENTS], "possible"),
    ([(ELEMENTS[0], "operator_controlled", None, "not a date")], "possible"),
    ([("branch_closed", "operator_controlled", None, "2024-01-10")], "excluded"),
    ([("branch_closed", "search_snippet", None, "2024-01-10")], "unresolved"),
    ([("branch_closed", "directory", None, "2024-01-10"), (ELEMENTS[1], "directory", None, "2024-01-10")], "unresolved"),
    ([(ELEMENTS[1], "directory", "contradicts", "2024-01-10")], "unresolved"),
])
def test_evidence_classes(spark, rows, expected):
    df = spark.createDataFrame([("b", *r) for r in rows], OBS)
    assert evidence.classify(df, cutoff="2024-01-20").first()["status"] == expected


def test_qualification_rules(spark):
    rows = [("a", 2, 0), ("b", 1, 0), ("c", 0, 0), ("d", 2, 1)]
    df = spark.createDataFrame(rows, "n string, p int, o int")
    got = {r["n"]: r["q"] for r in df.select("n", evidence.qualification(F.col("p"), F.col("o"), required=2).alias("q")).collect()}
    assert got == {"a": "qualified", "b": "provisional", "c": "needs_manual_review", "d": "needs_manual_review"}


def test_geocode_decisions(spark):
    bounds = {"minimum_longitude": 103.0, "maximum_longitude": 104.0, "minimum_latitude": 1.0, "maximum_latitude": 2.0}
    entities = spark.createDataFrame([("one", "111111"), ("two", "222222"), ("out", "333333"), ("none", None), ("limited", "444444"), ("lost", "555555")], "entity_id string, postal_code string")
    hit = lambda p, x, y: (p, x, y)
    responses = spark.createDataFrame([
        ("one", 200, [hit("111111", 103.5, 1.5), hit("111111", 103.50000001, 1.5), hit("999999", 1.0, 1.0)]),
        ("two", 200, [hit("222222", 103.5, 1.5), hit("222222", 103.6, 1.5)]), ("out", 200, [hit("333333", 99.0, 1.5)]), ("limited", 429, None),
    ], "entity_id string, http_status int, results array<struct<postal: string, longitude: double, latitude: double>>")
    got = {r["entity_id"]: r["status"] for r in entity.geocode_decision(entities, responses, bounds).collect()}
    assert got == {
        "one": "resolved_exact_postal_unique_coordinate", "two": "ambiguous_exact_postal_coordinates", "out": "out_of_bounds",
        "none": "missing_postal_code", "limited": "rate_limited", "lost": "network_error",
    }
    blocked = {r["entity_id"]: r["status"] for r in entity.geocode_decision(entities, responses, bounds, blocked="auth").collect()}
    assert blocked["none"] == "missing_postal_code" and blocked["one"] == "blocked_auth"


def exits_frame(spark, rows):
    return spark.createDataFrame(rows, "exit_id int, station_name string, label string, x double, y double")


def overrides_frame(spark, rows=()):
    return spark.createDataFrame(list(rows), "source_label string, target_label string")


def test_every_exit_belongs_to_one_complex(spark):
    exits = exits_frame(spark, [(1, "Alpha MRT Station", "A", 0.0, 0.0), (2, " alpha  mrt station", "a ", 3.0, 4.0), (3, "NE17", "1", 9.0, 9.0)])
    named = stations.apply_overrides(exits, overrides_frame(spark, [("ne17", "Alpha MRT Station")]))
    built = {r["complex_name"]: r for r in stations.complexes(named, dispersed_metres=8.0, implausible_metres=50.0).collect()}
    row = built["ALPHA MRT STATION"]
    assert len(built) == 1 and row["exit_count"] == 3 and row["representative_exit_id"] == 2
    assert row["flags"] == ["unusually_dispersed", "repeated_exit_labels", "normalized_name_collision"]


def test_status_precedence(spark):
    rows = [("A MRT STATION", "mrt"), ("B MRT STATION", "mrt"), ("C MRT STATION", "mrt"), ("D MRT STATION", "mrt"), ("NE1", "mrt_code_only_unverified")]
    built = spark.createDataFrame(rows, "complex_name string, rail_mode string")
    pick = lambda *p: spark.createDataFrame(list(p), "complex_name string, status string")
    roster = spark.createDataFrame([("A",), ("B",), ("C",), ("NE1",)], "base_name string")
    result = stations.operational_status(built, pick(("A MRT STATION", "x"), ("B MRT STATION", "not_operational")), roster, pick(("A MRT STATION", "verified_operational")))
    got = {r["complex_name"]: (r["operational_status"], r["basis"]) for r in result.collect()}
    assert got == {
        "A MRT STATION": ("verified_operational", "override"), "B MRT STATION": ("not_operational", "exception"),
        "C MRT STATION": ("verified_operational", "roster"), "D MRT STATION": ("unresolved", "none"), "NE1": ("unresolved", "none"),
    }
    assert {r["complex_name"] for r in stations.candidate_nodes(result).collect()} == {"A MRT STATION", "C MRT STATION", "D MRT STATION", "NE1"}


def test_medoid_and_extent_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["hot", "hot", "cold"]), rng.gauss(0, 500), rng.gauss(0, 900)) for i in range(400)]
    rows += [(1000 + i, "hot", 3.0, 4.0) for i in range(150)] + [(2000, "one", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "exit_id int, complex_name string, x double, y double")
    far = {r["complex_name"]: r["maximum_distance"] for r in stations.maximum_distance(df).collect()}
    mid = {r["complex_name"]: r["exit_id"] for r in stations.medoid(df).collect()}
    for name in ("hot", "cold", "one"):
        own = [r for r in rows if r[1] == name]
        gap = lambda a, b: ((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2) ** 0.5
        assert far[name] == pytest.approx(max(gap(a, b) for a in own for b in own))
        assert mid[name] == min(own, key=lambda a: (round(sum(gap(a, b) for b in own), 6), a[0]))[0]


def _pairs_compared(monkeypatch, points):
    """The result, and the rows of the last join: pairs that were compared."""
    joins = []
    monkeypatch.setattr(stations, "salted_join", lambda left, right, keys, **more: joins.append(out := skew.salted_join(left, right, keys, **more)) or out)
    far = {r[0]: r[1] for r in stations.maximum_distance(points).collect()}
    return far, joins[-1].count()


def test_corners_of_a_circle_do_not_meet_all(spark, monkeypatch):
    monkeypatch.setattr(stations, "_PAIRS_PER_END", 4)
    for size in (500, 2000):
        turn = [2 * math.pi * i / size for i in range(size)]
        rows = [("ring", 30_000 + 700 * math.cos(t), 25_000 + 700 * math.sin(t)) for t in turn]
        far, pairs = _pairs_compared(monkeypatch, spark.createDataFrame(rows, "complex_name string, x double, y double"))
        assert far == {"ring": pytest.approx(1400.0, abs=1e-6)}
        assert pairs < 16 * size


def test_extent_of_far_clusters_lines_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(stations, "_PAIRS_PER_END", 1)
    rng = random.Random(9)
    rows = [("two", 9000.0 * (i % 2) + rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(300)]
    rows += [("line", 3.0 * i, 4.0 * i) for i in range(200)] * 2 + [("same", 5.0, 5.0)] * 3
    rows += [("square", x, y) for x in (0.0, 1.0) for y in (0.0, 1.0)] + [("none", None, None), ("some", None, 1.0), ("some", 1.0, 1.0), (None, 0.0, 0.0)]
    far, pairs = _pairs_compared(monkeypatch, spark.createDataFrame(rows, "complex_name string, x double, y double"))
    own = [r for r in rows if r[0] == "two"]
    assert far["two"] == pytest.approx(max(math.dist(a[1:], b[1:]) for a in own for b in own), abs=1e-9)
    assert far["line"] == pytest.approx(5.0 * 199) and far["same"] == far["none"] == far["some"] == 0.0
    assert far["square"] == pytest.approx(2**0.5) and len(far) == 6
    assert pairs < 1000
    empty = spark.createDataFrame([], "complex_name string, x double, y double")
    assert stations.maximum_distance(empty).count() == 0


def test_nearest_exit_ties_by_id(spark):
    pairs = spark.createDataFrame([("o", "n", 0.0, 0.0)], "origin_id string, node_id string, x double, y double")
    exits = spark.createDataFrame([("B", "n", -3.0, -4.0), ("A", "n", 3.0, 4.0), ("C", "n", 9.0, 9.0)], "exit_id string, node_id string, x double, y double")
    row = od.nearest_exit(pairs, exits).first()
    assert (row["exit_id"], row["nearest_distance"]) == ("A", 5.0)


def test_a_wide_reach_gives_every_pair_and_scenario(spark):
    origins = spark.createDataFrame([(f"o{i}", 1.0, float(i * 900), 0.0) for i in range(4)], "origin_id string, population double, x double, y double")
    exits = spark.createDataFrame([("A", "n", 0.0, 0.0), ("B", "n", 10.0, 0.0), ("C", "m", 0.0, 2000.0)], "exit_id string, node_id string, x double, y double")
    plan = od.routing_plan(origins, exits, ["weekday", "weekend"], reach_metres=50_000.0)
    assert plan.count() == 4 * 2 * 2 and plan.select("od_plan_id").distinct().count() == 16
    assert od.routing_plan(origins, exits, ["weekday"], reach_metres=100.0).count() == 1


def test_balanced_pairs_ignore_input_order_and_report_short_bands(spark):
    rows = [(f"p{i}", f"o{i}", "n", "e", "s", float(i * 10)) for i in range(30)]
    plan = spark.createDataFrame(rows, "od_plan_id string, origin_id string, node_id string, exit_id string, scenario_id string, nearest_distance double")
    bands = [("near", 0.0, 100.0), ("far", 100.0, None)]
    pick = lambda df: sorted(r["sample_pair_id"] for r in od.balanced_pairs(df, scenario_id="s", bands=bands, pairs_per_band=4, seed="x").collect())
    assert pick(plan) == pick(plan.repartition(3)) and len(pick(plan)) == 8
    with pytest.raises(ValueError):
        od.balanced_pairs(plan, scenario_id="s", bands=bands, pairs_per_band=11, seed="x")


def test_route_outcomes(spark):
    rows = [
        (200, "ok", "pt", '{"plan": {"itineraries": [{"duration": 60, "legs": [{"distance": 1.5}, {}]}]}}'), (200, "ok", "pt", '{"plan": {"itineraries": []}}'),
        (404, "ok", "pt", None), (429, "ok", "pt", None), (401, "ok", "walk", None), (0, "error", "walk", None), (502, "ok", "walk", None),
        (200, "bad", "walk", None), (200, "ok", "walk", '{"route_summary": {"total_time": 30, "total_distance": 40}}'),
    ]
    got = [tuple(r) for r in od.route_outcome(spark.createDataFrame(rows, "http_status int, outcome string, mode string, body string")).select("category", "duration_seconds", "distance_metres").collect()]
    assert got == [
        ("success", 60.0, 1.5), ("invalid_response", None, None), ("missing_route", None, None), ("rate_limited", None, None), ("authorization_error", None, None),
        ("network_error", None, None), ("http_error", None, None), ("invalid_response", None, None), ("success", 30.0, 40.0),
    ]


def test_fastest_exit_decides_membership(spark):
    outcomes = spark.createDataFrame(
        [("n", "k", "E1", "success", 950.0, 900.0), ("n", "k", "E2", "success", 700.0, 650.0), ("n", "z", "E1", "missing_route", None, None)],
        "node_id string, coordinate_key string, exit_id string, category string, duration_seconds double, distance_metres double",
    )
    got = {r["coordinate_key"]: r for r in catchment.best_routes(outcomes).collect()}
    assert (got["k"]["best_exit_id"], got["k"]["inside_10_minute_walk"], got["k"]["inside_15_minute_walk"]) == ("E2", False, True)
    assert got["z"]["route_status"] == "unresolved" and got["z"]["inside_10_minute_walk"] is None


def test_branches_of_one_building_share_its_requests(spark):
    branches = spark.createDataFrame([("b1", 0.0, 0.0), ("b2", 0.0, 0.0), ("b3", None, None)], "branch_id string, x double, y double")
    exits = spark.createDataFrame([("e1", "c1", 10.0, 0.0), ("e2", "c9", 5.0, 0.0)], "exit_id string, complex_id string, x double, y double")
    members = spark.createDataFrame([("c1", "n1")], "complex_id string, node_id string")
    requests = catchment.walk_requests(branches, exits, members, reach_metres=100.0)
    assert requests.count() == 1
    outcomes = requests.select("node_id", "coordinate_key", "exit_id", F.lit("success").alias("category"), F.lit(60.0).alias("duration_seconds"), F.lit(50.0).alias("distance_metres"))
    members_of = catchment.memberships(branches.filter("x IS NOT NULL"), catchment.best_routes(outcomes))
    assert members_of.count() == 2
    assert catchment.branch_counts(members_of).first()["confirmed_10"] == 2


def test_counting_by_building_equals_counting_memberships(spark):
    rows = [(i, float(i % 3), 1.0) for i in range(12)] + [(None, 1.0, 1.0), (99, None, 1.0)]
    branches = spark.createDataFrame(rows, "branch_id int, x double, y double")
    known = branches.filter("x IS NOT NULL")
    places = known.select(catchment.coordinate_key(F.col("x"), F.col("y")).alias("coordinate_key"), "x").distinct()
    outcomes = places.crossJoin(spark.range(3).select(F.col("id").alias("node_id"))).select(
        "node_id", "coordinate_key", F.lit(1).alias("exit_id"), F.when(F.col("node_id") + F.col("x") == 2, "http_error").otherwise("success").alias("category"),
        F.lit(10.0).alias("distance_metres"), (F.col("node_id") * 300 + F.col("x") * 250).alias("duration_seconds"))
    routes = catchment.best_routes(outcomes)
    for moved in (False, True):  # a branch in two buildings is one branch
        here = known.unionByName(known.filter("branch_id = 3").withColumn("x", F.lit(1.0))) if moved else known
        expected = catchment.branch_counts(catchment.memberships(here, routes))
        assert sorted(map(tuple, catchment.building_counts(here, routes).collect())) == sorted(map(tuple, expected.collect()))


def test_rare_bands_are_chosen_from_all_pairs(spark, monkeypatch):
    plan = spark.range(400).select(
        F.col("id").alias("origin_id"), F.lit("n").alias("node_id"), F.lit("e").alias("exit_id"), F.lit("s").alias("scenario_id"),
        F.when(F.col("id") % 100 == 0, 10.0).otherwise(90.0).alias("nearest_distance"))
    picked = []
    for head in (64, 1):
        monkeypatch.setattr(od, "HEAD", head)
        chosen = od.balanced_pairs(plan, scenario_id="s", bands=[("near", 0.0, 50.0), ("far", 50.0, None)], pairs_per_band=3, seed="x")
        picked.append(sorted(map(tuple, chosen.collect())))
    assert picked[0] == picked[1] and len(picked[0]) == 6


def test_exits_of_a_node_are_met_in_bundles(spark, monkeypatch):
    import random

    draw = random.Random(3)
    monkeypatch.setattr(od, "BUNDLE", 4)
    exits = [(k, k % 3, float(draw.randint(0, 60)), float(draw.randint(0, 60))) for k in range(90)]
    origins = [(k, 5, float(draw.randint(0, 60)), float(draw.randint(0, 60))) for k in range(30)]
    doors = spark.createDataFrame(exits, "exit_id long, node_id long, x double, y double")
    homes = spark.createDataFrame(origins, "origin_id long, population long, x double, y double")
    wanted = {(o, n): min((x - ex) ** 2 + (y - ey) ** 2 for _, m, ex, ey in exits if m == n) for o, _, x, y in origins for n in range(3)}
    first = {(o, n): min(e for e, m, ex, ey in exits if m == n and (x - ex) ** 2 + (y - ey) ** 2 == wanted[o, n]) for o, _, x, y in origins for n in range(3)}
    pairs = homes.crossJoin(doors.select("node_id").distinct()).drop("population")
    near = od.nearest_exit(pairs, doors, rows=90)
    assert {(r["origin_id"], r["node_id"]): r["exit_id"] for r in near.collect()} == first
    plan = od.routing_plan(homes, doors, ["s"], reach_metres=9.0)
    assert {(r["origin_id"], r["node_id"]): r["exit_id"] for r in plan.collect()} == {p: e for p, e in first.items() if wanted[p] <= 81}


def test_resolutions_read_the_candidates_without_a_search_for_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(entity, "salted_join", lambda *a, **k: pytest.fail("rows counted by key or shuffled"))
    support = ("12 Main Street", "123456", "#01-02")
    aliases = spark.createDataFrame([("ALFA", "ALPHA")], "alias string, canonical_brand string")
    result = resolve(spark, [candidate(1, canonical=support, address="12 Main Street"), candidate(2, brand="Alfa", address="12 Main Street", unit=None)], aliases)
    assert [(r["brand"], r["missing_units"]) for r in result.resolutions.collect()] == [("ALPHA", 1)]


def test_reviews_search_no_hot_keys_and_long_tables_give_the_same(spark, monkeypatch):
    support = ("12 Main Street", "123456", "#01-02")
    rows = [candidate(1, canonical=support, address="12 Main Street"), candidate(2, address="12 Main Street", unit=None), candidate(3, postal=None), candidate(4, brand="B", unit=None), candidate(5, brand="B")]
    told = lambda: sorted(tuple(r) for r in resolve(spark, rows).reviews.collect())
    monkeypatch.setattr(entity, "LOOKUP_ROWS", 0, raising=False)
    long = told()
    monkeypatch.setattr(entity, "LOOKUP_ROWS", 10, raising=False)
    monkeypatch.setattr(entity, "salted_join", lambda *a, **k: pytest.fail("rows counted by key or shuffled"))
    assert told() == long and len(long) > 0


def test_routing_plan_keeps_every_exit_that_is_closest_somewhere(spark):
    draw = random.Random(11)
    homes = [(n, 1, float(draw.randrange(40)), float(draw.randrange(40))) for n in range(150)] + [(900, 2, None, 3.0)]
    doors = [(n, n % 6, float(draw.randrange(40)), float(draw.randrange(40))) for n in range(300)]  # many ties, nodes on both sides
    plan = od.routing_plan(
        spark.createDataFrame(homes, "origin_id int, population int, x double, y double"),
        spark.createDataFrame(doors, "exit_id int, node_id int, x double, y double"), ["s"], reach_metres=7.0)
    best = {}
    for o, _, x, y in homes[:-1]:
        for e, node, ex, ey in doors:
            d2 = (x - ex) ** 2 + (y - ey) ** 2
            if d2 <= 49:
                best[o, node] = min(best.get((o, node), (d2, e)), (d2, e))
    assert {(r["origin_id"], r["node_id"]): (r["nearest_distance"], r["exit_id"]) for r in plan.collect()} == {
        k: (math.sqrt(d2), e) for k, (d2, e) in best.items()}


def test_pairs_of_a_routing_plan_are_neither_shuffled_nor_sorted(spark):
    homes = spark.createDataFrame([(1, 1, 0.0, 0.0)], "origin_id int, population int, x double, y double")
    doors = spark.createDataFrame([(1, 1, 1.0, 1.0)], "exit_id int, node_id int, x double, y double")
    plan = od.routing_plan(homes, doors, ["s"], reach_metres=9.0)._jdf.queryExecution().optimizedPlan().toString()
    above = plan.split("Union")[0]  # what follows the join with the cells, for nodes of one part
    whole = plan.split("Union")[1].split("Join")[0]
    assert "Union" in plan and not any(step in above + whole for step in ("Join", "Aggregate", "Repartition", "Sort"))
