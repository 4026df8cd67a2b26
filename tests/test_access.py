from __future__ import annotations

import pytest

from areascreen.operators import access

PLAN = "od_plan_id string, origin_id string, node_id string, scenario_id string, population double, distance double"
OUTCOME = "od_plan_id string, method string, category string, duration_seconds double"
CASES = access.threshold_cases(20, 10, [15, 25], [5, 15])


def metrics(spark, plan_rows, outcome_rows):
    plan = spark.createDataFrame(plan_rows, PLAN)
    resolved = access.resolve_outcomes(plan, spark.createDataFrame(outcome_rows, OUTCOME))
    return resolved, access.accessibility_metrics(resolved, plan, CASES, proximity_metres=800.0)


def primary(df):
    return df.filter("is_primary").first()


def test_five_cases_with_one_primary():
    assert len(CASES) == 5 and sum(c[3] for c in CASES) == 1
    with pytest.raises(ValueError):
        access.threshold_cases(20, 10, [15, 15], [])


def test_public_transport_and_walk_add_up(spark):
    plan = [("p1", "o1", "n", "s", 100.0, 500.0), ("p2", "o2", "n", "s", 200.0, 900.0)]
    outcomes = [("p1", "pt", "success", 600.0), ("p2", "pt", "missing_route", None), ("p2", "walk", "success", 500.0)]
    row = primary(metrics(spark, plan, outcomes)[1])
    assert (row["accessible_population"], row["pt_population"], row["walk_population"]) == (300, 100, 200)
    assert row["centroid_population"] == 100 and row["combined_reach_share"] == 1.0


def test_proximity_only_after_a_failed_walk(spark):
    plan = [("p1", "o1", "n", "s", 100.0, 500.0)]
    outcomes = [("p1", "pt", "missing_route", None), ("p1", "walk", "missing_route", None)]
    row = primary(metrics(spark, plan, outcomes)[1])
    assert (row["proximity_population"], row["transit_reach_share"]) == (100, 0.0)


def test_slow_public_transport_gets_no_fallback(spark):
    plan = [("p1", "o1", "n", "s", 100.0, 500.0)]
    row = primary(metrics(spark, plan, [("p1", "pt", "success", 9999.0)])[1])
    assert row["accessible_population"] == 0 and row["centroid_population"] == 100


def test_missing_outcomes_are_violations(spark):
    plan = [("p1", "o1", "n", "s", 100.0, 500.0), ("p2", "o2", "n", "s", 1.0, 5.0)]
    resolved, _ = metrics(spark, plan, [("p1", "pt", "invalid_response", None)])
    counts = {r["rule"]: r["violations"] for r in access.outcome_violations(resolved).collect()}
    assert counts["missing_pt_outcome"] == 1 and counts["missing_walk_outcome"] == 1 and counts["duplicate_outcome"] == 0


def test_reversed_ranking_of_twelve_nodes(spark):
    rows = [(f"N{i:02d}", "s", True, float(i), float(13 - i)) for i in range(1, 13)]
    df = spark.createDataFrame(
        rows + [("N99", "s", True, 5.0, 0.0)],
        "node_id string, scenario_id string, is_primary boolean, accessible_population double, centroid_population double",
    )
    row = access.transit_versus_proximity(df, "s", materiality=0.1).first()
    assert (row["valid_node_count"], row["excluded_node_count"], row["moved_count"]) == (12, 1, 2)
    assert row["material_difference"] and round(row["spearman"], 9) == -1.0


def test_pending_requests_follow_the_fallback(spark):
    plan = spark.createDataFrame([(f"p{i}",) for i in range(1, 5)], "od_plan_id string")
    outcomes = spark.createDataFrame([
        ("p1", "pt", "success", 1.0), ("p2", "pt", "missing_route", None), ("p3", "pt", "missing_route", None), ("p3", "walk", "success", 1.0),
    ], OUTCOME)
    got = sorted(tuple(r) for r in access.pending_requests(plan, outcomes).collect())
    assert got == [("p2", "walk"), ("p4", "pt")]
    progress = access.ledger_progress(plan, outcomes).first()
    assert progress["status"] == "in_progress" and progress["fallbacks_required"] == 2 and progress["fallbacks_completed"] == 1


def test_trip_steps_grow_in_partitions_not_in_rows_a_task(spark, monkeypatch):
    from areascreen.catalog import access as queries, views
    from areascreen.operators import skew

    monkeypatch.setattr(skew, "TASK_ROWS", 500)
    sf_dir = "/root/testdata/sf0.001"
    lines = views.table(spark, sf_dir, "lineitem").count()
    assert views.trip_pairs(spark, sf_dir).rdd.getNumPartitions() >= lines // 500
    assert queries.resolved_trips(spark, sf_dir).rdd.getNumPartitions() >= 2 * lines // 500


def test_cases_multiply_finished_rows_only(spark):
    plan = [(f"p{k}", f"o{k}", "n", "s", 1.0, 500.0) for k in range(40)]
    outcomes = [(f"p{k}", "pt", "success", 60.0 * k) for k in range(40)]
    _, found = metrics(spark, plan, outcomes)
    rows = {r["threshold_case_id"]: r for r in found.collect()}
    assert {c: r["pt_population"] for c, r in rows.items()} == {c[0]: c[1] + 1.0 for c in CASES}
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Generate inline") < text.index("Aggregate [node_id")  # above it in the plan: after it in the run
