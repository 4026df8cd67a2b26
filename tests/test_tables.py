from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from areascreen.operators import joins, population, quality
from areascreen.sources import manifest, readers, writers
from areascreen.sources.schemas import OUTCOMES, POPULATION
from areascreen.streaming import ledger


def population_rows(age7="-", repeat=False):
    rows = [("Area", "Zone", str(a), "Total", "20" if a > 7 else age7) for a in range(7, 17)]
    rows += [("Area", "Total", "7", "Total", "5"), ("Total", "Total", "7", "Total", "9"), ("Note", " ", "", "", "")]
    return rows + ([rows[3]] if repeat else [])


def test_nil_counts_as_zero_and_missing_blocks(spark):
    parsed = population.parsed_rows(spark.createDataFrame(population_rows(), POPULATION))
    row = population.population_proxy(parsed, low=7, high=16).first()
    assert (row["population"], row["nil_count"], row["complete"]) == (180, 1, True)
    blocked = population.parsed_rows(spark.createDataFrame(population_rows(age7="n.a."), POPULATION))
    assert population.population_proxy(blocked, low=7, high=16).first()["population"] is None
    repeated = population.parsed_rows(spark.createDataFrame(population_rows(repeat=True), POPULATION))
    assert joins.duplicate_keys(repeated, ["planning_area", "subzone", "age", "sex"]).count() == 1
    totals = {r["planning_area"]: (r["published"], r["detail"]) for r in population.published_reconciliation(parsed, low=7, high=16).collect()}
    assert totals == {"Area": (5, 0), "Total": (9, 180)}


def test_crosswalk_is_exact_and_reports_ambiguity(spark):
    left = spark.createDataFrame([(" alpha  east",), ("alpha eat",), ("beta",)], "name string")
    right = spark.createDataFrame([("g1", "Alpha East"), ("g2", "Beta"), ("g3", "BETA "), ("g4", "gamma")], "geo_id string, area string")
    matched = joins.exact_crosswalk(left, right, names=[("name", "area")], identifier="geo_id")
    got = {r["name"]: (r["match_status"], r["geo_id"]) for r in matched.collect()}
    assert got == {" alpha  east": ("matched", "g1"), "alpha eat": ("unmatched", None), "beta": ("ambiguous", None)}
    assert {r["geo_id"] for r in joins.never_matched(right, matched, "geo_id").collect()} == {"g2", "g3", "g4"}


def test_partition_report(spark):
    ids = lambda *v: spark.createDataFrame([(i,) for i in v], "id string")
    good = joins.partition_report(ids("a", "b"), ids("a"), ids("b"), "id").first()
    bad = joins.partition_report(ids("a", "b", "c"), ids("a", "x"), ids("a"), "id").first()
    assert good["valid"] and not bad["valid"]
    assert (bad["missing"], bad["duplicated"], bad["unexpected"]) == (2, 1, 1)


def test_gates_accept_only_when_all_pass(spark):
    gates = [("n", ">=", 10), ("rate", "<=", 0.1), ("nothing", ">=", 0)]
    frame = lambda n, rate, nothing: spark.createDataFrame([(n, rate, nothing)], "n int, rate double, nothing double")
    assert quality.all_gates_met(quality.threshold_gates(frame(10, 0.1, 0.0), gates)).first()["accepted"]
    failed = quality.threshold_gates(frame(9, 0.1, None), gates)
    assert {r["gate"]: r["status"] for r in failed.collect()} == {"n": "fail", "rate": "pass", "nothing": "fail"}


def test_checks_raise_only_on_failures(spark):
    df = spark.createDataFrame([(1,), (1,)], "k int")
    rows = quality.checks(df, {"unique": (F.count(F.lit(1)) - F.countDistinct("k"), "warning")}, table="t")
    quality.fail_on(rows)
    assert quality.overall_status(rows).first()["overall_status"] == "passed_with_warnings"
    with pytest.raises(ValueError):
        quality.fail_on(quality.checks(df, {"unique": (F.count(F.lit(1)) - F.countDistinct("k"), "fail")}, table="t"))


def test_secret_scan_never_returns_text(spark):
    df = spark.createDataFrame([("a", "password = hunter2"), ("b", "fine"), ("c", "has KEY123 inside")], "path string, body string")
    findings, summary = quality.secret_scan(df, path="path", content="body", credentials=["KEY123"])
    assert sorted(tuple(r) for r in findings.collect()) == [("a", True, False), ("c", False, True)]
    assert summary.first()["status"] == "fail" and summary.first()["assurance"] == "full"
    clean = quality.secret_scan(df.filter("path = 'b'"), path="path", content="body")[1].first()
    assert (clean["status"], clean["assurance"]) == ("warning", "limited")


def test_schedule_merges_roles_and_reports_conflicts(spark):
    roles = spark.createDataFrame([("n", "N", "outside_audit"), ("n", "N", "candidate"), ("m", "M", "benchmark"), ("m", "M2", "benchmark")], "node_id string, node_name string, role string")
    schedule, conflicts = joins.target_schedule(roles, ["T1", "T2"], ["candidate", "outside_audit", "benchmark"])
    assert {(r["node_id"], r["role"], r["template"]) for r in schedule.collect()} == {(n, r, t) for n, r in (("n", "candidate"), ("m", "benchmark")) for t in ("T1", "T2")}
    assert [r["node_id"] for r in conflicts.collect()] == ["m"]


def feature(kind, coordinates, **properties):
    return {"type": "Feature", "properties": properties, "geometry": {"type": kind, "coordinates": coordinates}}


def test_polygon_collection_becomes_edges(spark, tmp_path):
    ring = [[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 0.0]]
    path = tmp_path / "zones.json"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [feature("Polygon", [ring], ID="z", NAME="Zone")]}, indent=1))
    attributes, edges = readers.read_polygon_features(spark, str(path), identifier="ID", required=["ID", "NAME"])
    assert attributes.first()["NAME"] == "Zone" and edges.count() == 3
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [feature("Polygon", [ring], ID="z", NAME=" ")]}))
    broken, _ = readers.read_polygon_features(spark, str(path), identifier="ID", required=["ID", "NAME"])
    with pytest.raises(Exception, match="NAME"):
        broken.collect()


def test_invalid_points_are_dropped_and_counted(spark, tmp_path):
    path = tmp_path / "points.json"
    rows = [feature("Point", [103.8, 1.3], id="a"), feature("Point", [0.0, 0.0], id="b"), feature("LineString", [1.0, 2.0], id="c"), feature("Point", [1.0], id="d")]
    path.write_text(json.dumps({"type": "FeatureCollection", "features": rows}))
    box = {"minimum_longitude": 103.6, "maximum_longitude": 104.1, "minimum_latitude": 1.15, "maximum_latitude": 1.48}
    points, counts = readers.read_point_features(spark, str(path), ["id"], bounds=box)
    assert {r["id"]: r["in_bounds"] for r in points.collect()} == {"a": True, "b": False}
    assert tuple(counts.first()) == (4, 2, 1)


def test_failed_snapshots_and_incomplete_batches_stop_the_read(spark, tmp_path):
    path = tmp_path / "snapshot.json"
    path.write_text(json.dumps({"success": False, "result": {"records": [{"a": "1"}]}}))
    with pytest.raises(Exception, match="success"):
        readers.read_records(spark, str(path), ["a"]).collect()
    for number, status in ((1, "complete"), (2, "open")):
        (tmp_path / f"batch_{number:02d}.json").write_text(json.dumps({"status": status, "queries": 3}))
    good = readers.read_batch_ledgers(spark, str(tmp_path / "batch_01.json"), "status string, queries int")
    assert (good.first()["batch_number"], good.first()["queries"]) == (1, 3)
    with pytest.raises(Exception, match="incomplete"):
        readers.read_batch_ledgers(spark, str(tmp_path / "batch_*.json"), "status string, queries int").collect()


def test_csv_refuses_extra_columns_and_runs_are_never_overwritten(spark, tmp_path):
    df = spark.createDataFrame([(1, ["b", "a"])], "id int, tags array<string>")
    with pytest.raises(ValueError):
        writers.write_csv(df, str(tmp_path / "x"), ["id"])
    writers.write_csv(df, str(tmp_path / "out"), ["id", "tags"])
    assert readers.read_csv(spark, str(tmp_path / "out"), ["id", "tags"]).first()["tags"] == '["b","a"]'
    with pytest.raises(FileExistsError):
        writers.require_new(spark, [str(tmp_path / "fresh"), str(tmp_path / "out")])


def test_csv_keeps_blanks_empty_texts_nulls_and_escapes(spark, tmp_path):
    texts = [None, "", " ", " a ", "\n", "a\r\nb", "\t\x00", '\x00"b', 'x\x00\n"\\', "\\", "#", '""']
    df = spark.createDataFrame([(str(n), text) for n, text in enumerate(texts)], "id string, text string").coalesce(1)
    writers.write_csv(df, str(tmp_path / "out"), ["id", "text"])
    rows = readers.read_csv(spark, str(tmp_path / "out"), ["id", "text"], multi_line=True).collect()
    assert {r["id"]: r["text"] for r in rows} == {str(n): text for n, text in enumerate(texts)}
    writers.write_csv(df.select("text"), str(tmp_path / "one"), ["text"])  # a blank line would be no row
    assert readers.read_csv(spark, str(tmp_path / "one"), ["text"], multi_line=True).count() == len(texts)


def test_csv_query_gives_the_values_of_its_sql(spark, tmp_path):
    rows = [(1, " a ", "", None), (2, "", "en", 'q"\\'), (3, None, None, "src")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in contract.queries()["S2_S8_csv"](spark, str(tmp_path)).collect()}
    digest = lambda text: None if text is None else hashlib.sha256(text.encode()).hexdigest()
    assert {k: (r["digest"], r["lang"], r["tags"]) for k, r in got.items()} == {
        str(k): (digest(text), lang, None if source is None else f'["{source}"]') for k, text, lang, source in rows}


def test_manifest_finds_changed_missing_and_unexpected_files(spark):
    columns = "file_name string, byte_size bigint, sha256 string"
    recorded = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y"), ("c", 1, "z")], columns)
    observed = spark.createDataFrame([("a", 1, "x"), ("b", 1, "q"), ("d", 1, "w")], columns)
    got = {r["file_name"]: r["status"] for r in manifest.verify_manifest(observed, recorded).collect()}
    assert got == {"a": "match", "b": "changed", "c": "missing", "d": "unexpected"}


def outcome(trip, category, at):
    return (trip, "pt", category, 200, 1.0, None, at)


def test_ledger_keeps_the_first_write_in_batch_and_stream(spark, tmp_path):
    import datetime as dt

    day = lambda d: dt.datetime(2024, 1, d)
    path, source = str(tmp_path / "ledger"), tmp_path / "source"
    ledger.insert_if_absent(spark.createDataFrame([outcome("t1", "first", day(1)), outcome("t1", "second", day(2))], OUTCOMES), path, batch="seed")

    def add(name, rows):
        spark.createDataFrame(rows, OUTCOMES).coalesce(1).write.parquet(str(source / name))

    def run():
        stream = spark.readStream.schema(OUTCOMES).option("recursiveFileLookup", "true").parquet(str(source))
        ledger.stream_into_ledger(stream, path, str(tmp_path / "progress")).awaitTermination()

    add("one", [outcome("t1", "late", day(3)), outcome("t2", "new", day(3))])
    run()
    add("two", [outcome("t2", "again", day(4)), outcome("t3", "new", day(4))])
    run()
    got = {r["od_plan_id"]: r["category"] for r in ledger.read_ledger(spark, path, OUTCOMES).collect()}
    assert got == {"t1": "first", "t2": "new", "t3": "new"}
    ledger.insert_if_absent(spark.createDataFrame([outcome("t9", "x", day(5))], OUTCOMES), path, batch="seed9")
    ledger.insert_if_absent(spark.createDataFrame([outcome("t9", "x", day(5))], OUTCOMES), path, batch="seed9")
    assert ledger.read_ledger(spark, path, OUTCOMES).count() == 4


def test_equal_file_names_in_two_folders_stay_apart(spark, tmp_path):
    from areascreen.sources.manifest import file_manifest, verify_manifest

    for folder, text in (("a", "one"), ("b", "two")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "part-0").write_text(text)
    first = file_manifest(spark, str(tmp_path))
    recorded = spark.createDataFrame(first.collect())
    assert {r.file_name for r in recorded.collect()} == {"a/part-0", "b/part-0"}
    assert {r.status for r in verify_manifest(first, recorded).collect()} == {"match"}
    (tmp_path / "b" / "part-0").write_text("three")
    (tmp_path / "c").write_text("new")
    statuses = {r.file_name: r.status for r in verify_manifest(file_manifest(spark, str(tmp_path)), recorded).collect()}
    assert statuses == {"a/part-0": "match", "b/part-0": "changed", "c": "unexpected"}


def test_all_acceptance_gates(spark):
    from areascreen.operators import joins, quality
    from areascreen.sources.manifest import verify_manifest

    branches = spark.createDataFrame(
        [("b1", "https://a/b", "1", None, True, "A", "coordinate_derived", "confirmed", True, "current", True), ("b2", None, None, "2", True, None, "unresolved", "possible", False, "current", False)],
        "branch_id string, url string, postal_code string, unit string, exact_address boolean, planning_area string, planning_area_source string, evidence_status string, fresh_operator_evidence boolean, status string, counts_as_primary boolean")
    reviews = spark.createDataFrame([("b2", "evidence_status_possible")], "entity_reference string, issue_category string")
    ids = spark.createDataFrame([("q1",), ("q2",)], "query_id string")
    people = spark.createDataFrame([(1,), (2,)], "candidate_id int")
    files = spark.createDataFrame([("f", "aa", 1)], "file_name string, sha256 string, byte_size int")
    texts = spark.createDataFrame([("p", "plain words")], "path string, content string")
    owned = spark.createDataFrame([(1, 9)], "branch_id int, brand_id int")

    def gates(reviews=reviews, log=ids, source="cache", attempts=people, manifest=files, content=texts):
        rows = quality.acceptance_gates(
            branches, reviews, ["A"], expected=ids, log=log, log_errors=ids.limit(0), candidates=people, attempts=attempts,
            partition=joins.partition_report(people, people.limit(1), people.filter("candidate_id = 2"), "candidate_id"), integrity=joins.referential_integrity(owned, owned, owned, owned),
            copies=quality.parity(people, people), manifest=verify_manifest(manifest, files), secrets=quality.secret_scan(content, path="path", content="content")[1], geocoding_source=source)
        return {r["gate"]: r["violations"] for r in rows.collect()}

    assert len(gates()) == 17 and set(gates().values()) == {0}
    bad = gates(reviews.limit(0), ids.limit(1), None, people.limit(1), files.withColumn("sha256", F.lit("bb")), texts.withColumn("content", F.lit("password=abc")))
    assert {g for g, n in bad.items() if n} == {
        "possible_not_primary", "review_items_enumerated", "all_queries_logged", "geocoding_executed_or_validated_cache", "validation_attempts_complete", "checksums_verify", "secret_scan_pass"}


def test_release_checks_and_their_status(spark):
    from areascreen.operators import quality

    nodes = spark.createDataFrame([(1,), (2,)], "node_id int")
    shown = spark.createDataFrame([(1, 0.5), (2, None)], "node_id int, score double")
    totals = spark.createDataFrame([("n", 2, 2, "pass")], "total string, observed int, expected int, status string")
    held = spark.createDataFrame([(1, 1, 1)], "node_id int, observed_count int, caution_count int")

    def checks(published=shown, totals=totals, held=held, expected=2, **more):
        rows = quality.release_checks(nodes, published, totals, held, expected_candidates=expected, **more)
        return {r["check_id"] for r in rows.filter("status = 'blocker'").collect()}, quality.release_status(rows).first()["release_status"]

    assert checks() == (set(), "pass") and checks(accepted=["bounded_search"]) == (set(), "pass_with_accepted_limitations")
    assert checks(shown.limit(1))[0] == {"candidates_represented"} == checks(expected=3)[0] == checks(shown.union(shown))[0]
    assert checks(shown.withColumn("score", F.lit(float("nan"))))[0] == {"numbers_finite"}
    assert checks(shown.withColumn("contact", F.array(F.struct(F.lit("x").alias("email")))))[0] == {"no_private_fields"}
    assert checks(held=held.withColumn("caution_count", F.lit(None).cast("int")), totals=totals.withColumn("status", F.lit("fail")), association_label="causal") == (
        {"recommendations_hold_both_ways", "totals_reconcile", "association_not_causal"}, "blocker")


def test_publication_gates_and_register_values(spark):
    from areascreen.operators import quality, stations

    plan = spark.createDataFrame([("t1", 1, 1, 5, 2.0), ("t2", 1, 2, -1, None), ("t2", 2, 1, None, 1.0)], "od_plan_id string, origin_id int, node_id int, population int, distance double")
    got = {r["check_id"]: r["violations"] for r in quality.routing_plan_checks(plan, origins=plan, nodes=plan, scenarios=1).collect()}
    assert got == {"row_count": 1, "duplicate_trips": 1, "negative_population": 2, "negative_distance": 1}
    metrics = spark.createDataFrame([(1, "s", "c", True), (1, "s", "c", None)], "node_id int, scenario_id string, threshold_case_id string, route_coverage_complete boolean")
    assert {r["check_id"]: r["violations"] for r in quality.accessibility_checks(metrics, nodes=1, scenarios=2, cases=1).collect()} == {"row_count": 0, "duplicate_metrics": 1, "incomplete_routes": 1}
    named = spark.createDataFrame([("BEDOK MRT STATION",)], "complex_name string")
    base = stations.corroboration(named, spark.createDataFrame([], "base_name string, code string, line string")).first()["base_name"]
    register = spark.createDataFrame([(base, "EW5", "Red"), (base, "EW5", "Green"), (base, "", None), ("OTHER", "X", "Y")], "base_name string, code string, line string")
    rows = {tuple(r) for r in stations.register_values(named, register, ["code", "line"]).collect()}
    assert rows == {("BEDOK MRT STATION", "code", "EW5", 2), ("BEDOK MRT STATION", "line", "Red", 1), ("BEDOK MRT STATION", "line", "Green", 1)}


def test_both_sets_under_every_threshold(spark):
    from areascreen.plans.sensitivity import both_sets

    screen = spark.createDataFrame([(t, n, n * 10) for t in ("low", "high") for n in (1, 2, 3)], "threshold string, node_id int, access int")
    selected = spark.createDataFrame([("low", 1), ("low", 2), ("high", 3)], "threshold string, node_id int")
    got = sorted((r["node_set"], r["threshold"], r["node_id"]) for r in both_sets(screen, selected, "low").collect())
    assert got == [("alternative", "high", 3), ("alternative", "low", 1), ("alternative", "low", 2), ("fixed", "high", 1), ("fixed", "high", 2), ("fixed", "low", 1), ("fixed", "low", 2)]


def test_trip_ids_are_told_apart_in_partitions_by_rows(spark, monkeypatch):
    from areascreen.operators import quality, skew

    monkeypatch.setattr(skew, "TASK_ROWS", 10)
    plan = spark.createDataFrame([("a", 1, 2.0), ("a", None, -1.0), (None, -3, None), ("b", 0, 1.0)], "od_plan_id string, population int, distance double")
    one = spark.createDataFrame([(1, 1)], "origin_id int, node_id int")
    seen, dealt = [], skew.sized
    monkeypatch.setattr(quality, "sized", lambda df, keys, rows: seen.append(dealt(df, keys, rows)) or seen[-1])
    told = lambda p, n: {r["check_id"]: r["violations"] for r in quality.routing_plan_checks(p, origins=one, nodes=one, scenarios=2, rows=n).collect()}
    assert told(plan, 200) == {"row_count": 2, "duplicate_trips": 2, "negative_population": 2, "negative_distance": 2}
    assert seen[0].rdd.getNumPartitions() == 20
    assert told(plan.limit(0), 0) == {"row_count": 2, "duplicate_trips": 0, "negative_population": 0, "negative_distance": 0}
