from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from areascreen.functions import finance
from areascreen.operators import pareto, selection, stats
from areascreen.plans import decision
from pyspark.sql import functions as F


def brute_frontier(points):
    def beaten(p):
        return any(all(b >= a for a, b in zip(p, q)) and any(b > a for a, b in zip(p, q)) for q in points)

    return {p for p in points if not beaten(p)}


def test_trade_offs_stay_and_dominated_points_go(spark):
    df = spark.createDataFrame([(2.0, 2.0, 2.0), (3.0, 1.0, 2.0), (1.0, 2.0, 1.0)], "a double, b double, c double")
    got = {tuple(r) for r in pareto.pareto_frontier(df, ["a", "b", "c"]).collect()}
    assert got == {(2.0, 2.0, 2.0), (3.0, 1.0, 2.0)}


@pytest.mark.parametrize("chunk", [4096, 40, 3])
def test_frontier_equals_brute_force_on_every_path(spark, monkeypatch, chunk):
    monkeypatch.setattr(pareto, "_CHUNK_ROWS", chunk)
    rng = np.random.default_rng(chunk)
    values = rng.integers(0, 12, (300, 3)).astype(float)
    values[:100] = values[0]  # a third of all rows are copies
    groups = rng.integers(0, 2, 300)
    df = spark.createDataFrame(pd.DataFrame({"g": groups, "a": values[:, 0], "b": values[:, 1], "c": values[:, 2]}))
    got = defaultdict(set)
    for r in pareto.pareto_frontier(df, ["a", "b", "c"], by=["g"]).collect():
        got[r["g"]].add((r["a"], r["b"], r["c"]))
    for g in (0, 1):
        assert got[g] == brute_frontier({tuple(v) for v in values[groups == g]})


def scored_frame(spark, rows):
    return spark.createDataFrame(rows, "node_id string, region string, screen_score double")


def greedy(rows, merit, cover, maximum):
    ordered = sorted(rows, key=lambda r: (-r[2], r[0]))
    target = min(maximum, len(ordered))
    picked = [(r, "merit") for r in ordered[:min(merit, len(ordered))]]
    counts = Counter(r[1] for r, _ in picked)
    rest = ordered[len(picked):]
    for _ in range(max(0, min(cover, target - len(picked)))):
        region = min({r[1] for r in rest}, key=lambda g: (counts[g], g))
        row = next(r for r in rest if r[1] == region)
        rest.remove(row)
        counts[region] += 1
        picked.append((row, "regional_coverage"))
    while len(picked) < target:
        picked.append((rest.pop(0), "global_shortfall_fill"))
    return [(r[0], stage, slot) for slot, (r, stage) in enumerate(picked, 1)]


def test_merit_then_the_regions_with_fewest_picks(spark):
    rows = [("N1", "A", 0.9), ("N2", "A", 0.8), ("N3", "A", 0.7), ("N4", "B", 0.6), ("N5", "C", 0.5), ("N6", "C", 0.4)]
    chosen = selection.balanced_selection(scored_frame(spark, rows), merit_slots=2, coverage_slots=2, maximum=4)
    got = sorted((r["selection_slot"], r["node_id"]) for r in chosen.filter("selection_slot IS NOT NULL").collect())
    assert [n for _, n in got] == ["N1", "N2", "N4", "N5"]


@pytest.mark.parametrize("seed", range(4))
def test_selection_equals_the_greedy_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(f"N{i:03d}", rng.choice("ABCDE"), rng.randrange(30) / 30) for i in range(rng.randrange(5, 60))]
    merit, cover, maximum = rng.randrange(1, 10), rng.randrange(0, 12), rng.randrange(10, 30)
    chosen = selection.balanced_selection(scored_frame(spark, rows), merit_slots=merit, coverage_slots=cover, maximum=maximum)
    got = sorted(((r["node_id"], r["selection_stage"], r["selection_slot"]) for r in chosen.filter("selection_slot IS NOT NULL").collect()), key=lambda r: r[2])
    assert got == greedy(rows, merit, cover, maximum)


@pytest.mark.parametrize("seed", range(3))
def test_allocation_equals_the_deficit_loop(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.randrange(1, 20) for i in range(5)}
    total, sample = sum(sizes.values()), min(sum(sizes.values()), 5 + rng.randrange(20))
    rows = [(f"{s}-{i}", s) for s, n in sizes.items() for i in range(n)]
    expected = {s: 1 for s in sizes}
    while sum(expected.values()) < sample:
        open_strata = [s for s in sizes if expected[s] < sizes[s]]
        best = min(open_strata, key=lambda s: (-(sizes[s] / total - expected[s] / sample), s))
        expected[best] += 1
    got = selection.stratified_allocation(spark.createDataFrame(rows, "node_id string, s string"), ["s"], sample_size=sample, minimum=1)
    assert {r["s"]: r["sample_count"] for r in got.collect()} == expected


def test_sample_is_reproducible_disjoint_and_weighted(spark):
    rows = [(f"N{i}", "AB"[i % 2], i / 20) for i in range(20)]
    eligible = scored_frame(spark, rows)
    candidates = eligible.filter("node_id IN ('N1', 'N2', 'N3')")

    def draw(frame):
        sample, _ = selection.outside_sample(frame, candidates, labels=["high", "low"], sample_size=6, minimum=1, seed="7")
        return sorted((r["node_id"], r["inclusion_probability"], r["design_weight"]) for r in sample.collect())

    first = draw(eligible)
    assert first == draw(eligible.repartition(5)) and len(first) == 6
    assert not {n for n, _, _ in first} & {"N1", "N2", "N3"}
    assert all(0 < p <= 1 and w >= 1 for _, p, w in first)
    with pytest.raises(ValueError):
        selection.outside_sample(eligible, candidates, labels=["high"], sample_size=99, minimum=1, seed="7")


def test_eligibility_reports_the_first_reason(spark):
    nodes = spark.createDataFrame([(f"n{i}", "provisional" if i == 0 else "qualified") for i in range(5)], "node_id string, qualification_status string")
    proximity = spark.createDataFrame([("n0", 1.0, "R"), ("n2", 1.0, " "), ("n3", 1.0, "R"), ("n4", 1.0, "R")], "node_id string, population_proximity double, region string")
    access = spark.createDataFrame([("n0", 1.0, True), ("n2", 1.0, True), ("n3", 1.0, False), ("n4", 1.0, True)], "node_id string, transit_accessibility double, route_coverage_complete boolean")
    got = {r["node_id"]: r["exclusion_reason"] for r in selection.eligible_screen(nodes, proximity, access).collect()}
    assert got == {"n0": "not_qualified", "n1": "missing_screen_input", "n2": "missing_region", "n3": "incomplete_route_coverage", "n4": None}


def test_finance_of_the_base_scenario(spark):
    df = spark.createDataFrame([(320, 30, 15000, 9000), (30, 30, 1, 1)], "fee int, variable_cost int, fixed_cost int, occupancy_cost int")
    rows = finance.financial_outputs(df, capacity=180, target=120).collect()
    assert (rows[0]["break_even"], rows[0]["affordable_occupancy"], rows[0]["surplus_after_occupancy"]) == (83, 19800, 10800)
    assert rows[1]["break_even"] is None and rows[1]["capacity_feasible"] is False
    caution = spark.createDataFrame([(0,), (3,)], "c int").select(finance.competition_value(F.col("c"), zero_caution=True).alias("v"))
    assert [r["v"] for r in caution.collect()] == [1.0, 3.0]


def test_weighted_association_matches_direct_sums(spark):
    data = [(1.0, 2.0, 1.0), (2.0, 1.0, 3.0), (4.0, 5.0, 0.5)]
    row = stats.weighted_association(spark.createDataFrame(data, "x double, y double, w double"), "x", "y", "w").first()
    a = np.array(data)
    w = a[:, 2]
    mx, my = np.average(a[:, 0], weights=w), np.average(a[:, 1], weights=w)
    cov = np.average((a[:, 0] - mx) * (a[:, 1] - my), weights=w)
    vx, vy = np.average((a[:, 0] - mx) ** 2, weights=w), np.average((a[:, 1] - my) ** 2, weights=w)
    assert row["weighted_correlation"] == pytest.approx(cov / np.sqrt(vx * vy))
    assert row["weighted_slope"] == pytest.approx(cov / vx * 10000)
    assert row["effective_sample_size"] == pytest.approx(w.sum() ** 2 / (w**2).sum())
    flat = stats.weighted_association(spark.createDataFrame([(1.0, 2.0, 1.0)], "x double, y double, w double"), "x", "y", "w").first()
    assert flat["weighted_correlation"] == 0.0


def test_recommendations_need_both_treatments_and_are_not_padded(spark):
    rows = [("a", 9, 9, 0, 1.0, 2), ("b", 5, 3, 2, 2.0, 4), ("c", 0, 0, 0, 3.0, 3)]
    results = spark.createDataFrame(rows, "node_id string, selection_count int, observed_count int, caution_count int, median_rank double, worst_rank int")
    got = {r["node_id"]: (r["position"], r["list_name"], r["list_rank"]) for r in decision.recommend(results).collect()}
    assert got == {"a": (1, "recheck", 1), "b": (2, "recommended", 1), "c": (3, None, None)}


def test_missing_competition_makes_a_ranking_unavailable(spark):
    cells = spark.createDataFrame([("t", "a"), ("t", "b"), ("u", "a")], "threshold string, node_id string")
    counts = spark.createDataFrame([("a", 1, 2)], "node_id string, confirmed_10 int, confirmed_15 int")
    got = {(r["threshold"], r["status"]) for r in decision.with_competition(cells, counts, by=["threshold"]).collect()}
    assert got == {("t", "unavailable_missing_competition"), ("u", "complete")}


def test_a_dominated_row_is_dropped_by_the_step_of_the_row_above_it(monkeypatch):
    import numpy as np

    from areascreen.operators import pareto

    rng = np.random.default_rng(4)
    for values in (np.arange(3000.0).repeat(3).reshape(-1, 3), rng.integers(0, 9, (300, 3)).astype(float), np.zeros((5, 2)), np.empty((0, 3))):
        want = [not any((o >= v).all() and (o > v).any() for o in values[-300:]) for v in values]
        assert pareto._undominated(values).tolist() == want
    steps, every = [], np.all
    monkeypatch.setattr(np, "all", lambda *a, **k: steps.append(1) or every(*a, **k))
    assert pareto._undominated(np.arange(3000.0).repeat(3).reshape(-1, 3)).sum() == 1 and len(steps) == 1
