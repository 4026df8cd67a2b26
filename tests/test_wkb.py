from __future__ import annotations

import json
import struct

import pytest

from areascreen.catalog.views import zone_edges
from areascreen.sources import wkb, writers

SQUARE = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
HOLE = [(1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (2.0, 1.0)]


def edge_rows(name, part, ring, corners):
    return [(name, part, ring, n, *corners[n], *corners[(n + 1) % len(corners)]) for n in range(len(corners))]


def plain_bytes(order: str, rings) -> bytes:
    mark = b"\x01" if order == "<" else b"\x00"
    out = mark + struct.pack(f"{order}II", 3, len(rings))
    for ring in rings:
        closed = [*ring, ring[0]]
        out += struct.pack(f"{order}I", len(closed)) + b"".join(struct.pack(f"{order}dd", *p) for p in closed)
    return out


ROWS = [
    *edge_rows("holed", 0, 0, SQUARE), *edge_rows("holed", 0, 1, HOLE),
    *edge_rows("two", 0, 0, SQUARE), *edge_rows("two", 1, 0, [(x + 9, y) for x, y in SQUARE]), *edge_rows("two", 1, 1, [(x + 9, y) for x, y in HOLE]),
]
SCHEMA = "geo_id string, part int, ring int, seq int, x1 double, y1 double, x2 double, y2 double"


def test_bytes_equal_a_fixed_sample_and_a_plain_writer(spark):
    unit = spark.createDataFrame(edge_rows("u", 0, 0, [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)]), SCHEMA)
    assert bytes(wkb.to_wkb(unit).first()["geometry"]).hex() == (
        "01" "03000000" "01000000" "04000000" + "0000000000000000" * 2 + "000000000000f03f" + "0000000000000000" * 2 + "000000000000f03f" + "0000000000000000" * 2)
    got = {r.geo_id: bytes(r.geometry) for r in wkb.to_wkb(spark.createDataFrame(ROWS[::-1], SCHEMA)).collect()}
    shifted = [[(x + 9, y) for x, y in ring] for ring in (SQUARE, HOLE)]
    assert got["holed"] == plain_bytes("<", [SQUARE, HOLE])
    assert got["two"] == b"\x01" + struct.pack("<II", 6, 2) + plain_bytes("<", [SQUARE]) + plain_bytes("<", shifted)


def test_round_trip_of_holes_parts_nulls_and_empty_tables(spark):
    edges = spark.createDataFrame([*ROWS, *edge_rows(None, 0, 0, SQUARE)], SCHEMA)
    back = wkb.from_wkb(wkb.to_wkb(edges))
    assert sorted(tuple(r) for r in back.collect()) == sorted(ROWS)
    assert wkb.to_wkb(edges.limit(0)).count() == 0
    assert wkb.from_wkb(spark.createDataFrame([("a", None)], "geo_id string, geometry binary")).count() == 0


def test_big_endian_bytes_and_errors():
    assert wkb.decode_polygon(plain_bytes(">", [SQUARE, HOLE])).equals(wkb.decode_polygon(plain_bytes("<", [SQUARE, HOLE])))
    with pytest.raises(ValueError, match="not a polygon"):
        wkb.decode_polygon(b"\x01" + struct.pack("<II", 1, 0))
    with pytest.raises(ValueError, match="left over"):
        wkb.decode_polygon(plain_bytes("<", [SQUARE]) + b"x")


def test_written_column_carries_its_metadata(spark, tmp_path):
    edges = zone_edges(spark, "/root/testdata/sf0.001")
    path = str(tmp_path / "zones")
    names = edges.select("geo_id", "category").distinct()
    wkb.write_wkb(names, edges, writers.geometry_metadata(edges.selectExpr("*", "0 AS part"), "EPSG:3414"), path)
    stored = spark.read.parquet(path)
    geo = json.loads(stored.schema["geometry"].metadata["geo"])
    assert geo["columns"]["geometry"]["encoding"] == "WKB" and geo["columns"]["geometry"]["geometry_types"] == ["Polygon"]
    pick = ["geo_id", "seq", "x1", "y1", "x2", "y2"]
    ranked = {tuple(r)[:1] + tuple(r)[2:] for r in edges.select(*pick).collect()}
    assert {tuple(r)[:1] + tuple(r)[2:] for r in wkb.from_wkb(stored).select(*pick).collect()} == ranked
    with pytest.raises(FileExistsError):
        wkb.write_wkb(names, edges, writers.geometry_metadata(edges.selectExpr("*", "0 AS part"), "EPSG:3414"), path)

def test_features_are_encoded_in_batches_like_one_by_one(spark, monkeypatch):
    import random

    import pyarrow as pa

    draw = random.Random(5)
    rows = []
    for name in range(300):
        for part in range(draw.choice([1, 1, 2, 3])):
            for ring in range(draw.choice([1, 1, 2])):
                corners = [(draw.random(), draw.random()) for _ in range(draw.randint(3, 9))]
                rows += edge_rows(f"g{name}", part, ring, corners)
    draw.shuffle(rows)
    monkeypatch.setattr(wkb, "_BATCH_EDGES", 50)
    edges = spark.createDataFrame(rows, SCHEMA)
    frame = edges.toPandas().sort_values(["geo_id", "part", "ring", "seq"], kind="stable")
    wanted = {name: wkb.encode_polygon(group) for name, group in frame.groupby("geo_id")}
    features = wkb.to_wkb(edges)
    assert {r["geo_id"]: bytes(r["geometry"]) for r in features.collect()} == wanted
    assert sorted(tuple(r) for r in wkb.from_wkb(features).collect()) == sorted(rows)
    assert "FlatMapGroups" not in features._jdf.queryExecution().toString()  # no Python call for each feature
    empty = [pa.array([], pa.list_(pa.int32()))] * 2 + [pa.array([], pa.list_(pa.float64()))] * 2
    assert len(wkb.encode_batch(*empty)) == 0
