from __future__ import annotations

import hashlib

import duckdb
import pytest

import __spark_entry__ as contract
from areascreen.catalog import network

SMALL = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
#: A cheap query of every catalog module; tools/compare.py runs them all.
SAMPLE = ["A4_accessibility_sums", "F6_count_markers", "J6_points_within_union", "W5_average_percentile", "E5_evidence_classes", "J4_nearest_exit", "U6_partition", "S1_S7_parquet"]


def test_every_statement_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, name):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    result = connection.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    frame = contract.queries()[name](spark, SMALL)
    assert sorted(frame.columns) == sorted(columns)
    got = sorted(tuple(str(v) for v in row) for row in frame.select(*columns).collect())
    assert got == sorted(tuple(str(v) for v in row) for row in result.fetchall())


def test_geography_policy_takes_the_least_area_on_a_border():
    connection = duckdb.connect()
    for table in ("region", "nation"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    # Customer 52800 lies at (9600, 14400), on the border of NATION_11 (selected) and NATION_16 (not selected).
    connection.execute(f"CREATE VIEW customer AS SELECT * REPLACE (52800::BIGINT AS c_custkey) FROM '{SMALL}/customer.parquet' LIMIT 1")
    result = connection.execute(contract.oracle_sql()["E7_geography_policy"])
    row = dict(zip([c[0] for c in result.description], result.fetchone()))
    assert row["outcome"] == "retained"


def test_entry_runs(spark):
    assert contract.entry(spark).count() > 0


def test_balanced_pairs_make_no_trip_id_for_pairs_that_are_not_chosen(spark, monkeypatch):
    monkeypatch.setattr(network.od, "routing_plan", lambda *a, **k: pytest.fail("ids of all pairs"))
    rows = network.balanced(spark, "/root/testdata/sf0.01").collect()
    told = lambda r: hashlib.sha256(f"{r['origin_id']}|{r['node_id']}|{r['exit_id']}|{r['scenario_id']}".encode()).hexdigest()
    assert len(rows) == 36 and {r["scenario_id"] for r in rows} == {network.SCENARIOS[0]}
    assert all(r["od_plan_id"] == "OD_" + told(r)[:16].upper() for r in rows)
