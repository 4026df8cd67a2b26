"""Polygons as well-known binary: a binary column made from edge rows, and edge rows made from it."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from areascreen.sources.writers import require_new, write_parquet

_POLYGON, _MULTI = 3, 6
#: Edges that a task lays out at once; a feature of more is laid out by itself.
_BATCH_EDGES = 100_000
_EDGES = "part int, ring int, seq int, x1 double, y1 double, x2 double, y2 double"


def _polygon(rings: list[np.ndarray]) -> bytes:
    out = [b"\x01", np.array([_POLYGON, len(rings)], "<u4").tobytes()]
    for ring in rings:
        out += [np.array([len(ring)], "<u4").tobytes(), ring.astype("<f8").tobytes()]
    return b"".join(out)


def encode_polygon(edges: pd.DataFrame) -> bytes:
    """Little-endian bytes of one feature whose edges (part, ring, seq, x1, y1, x2, y2) are sorted; a feature of several
    parts is a MultiPolygon. Every ring is closed: its first position stands again at its end."""
    points = edges[["x1", "y1"]].to_numpy(float)
    part, ring = edges["part"].to_numpy(), edges["ring"].to_numpy()
    cuts = np.flatnonzero((np.diff(part) != 0) | (np.diff(ring) != 0)) + 1
    polygons: list[list[np.ndarray]] = []
    last = None
    for rows in np.split(np.arange(len(points)), cuts):
        if part[rows[0]] != last:
            polygons.append([])
            last = part[rows[0]]
        polygons[-1].append(points[np.append(rows, rows[0])])
    if len(polygons) == 1:
        return _polygon(polygons[0])
    return b"\x01" + np.array([_MULTI, len(polygons)], "<u4").tobytes() + b"".join(map(_polygon, polygons))


def _rings(raw: bytes) -> list[tuple[int, int, np.ndarray]]:
    """part, ring and positions of every ring of one feature, in either byte order."""
    rings: list[tuple[int, int, np.ndarray]] = []

    def read(at: int, part: int) -> int:
        order = "<" if raw[at] == 1 else ">"
        kind, count = np.frombuffer(raw, f"{order}u4", 2, at + 1).tolist()
        at += 9
        if kind == _MULTI and part < 0:
            for number in range(count):
                at = read(at, number)
        elif kind == _POLYGON:
            for number in range(count):
                length = int(np.frombuffer(raw, f"{order}u4", 1, at)[0])
                rings.append((max(part, 0), number, np.frombuffer(raw, f"{order}f8", 2 * length, at + 4).reshape(-1, 2)))
                at += 4 + 16 * length
        else:
            raise ValueError(f"not a polygon: geometry type {kind}")
        return at

    if read(0, -1) != len(raw):
        raise ValueError("bytes left over after the geometry")
    return rings


def decode_polygon(raw: bytes) -> pd.DataFrame:
    """Edges of one feature, in either byte order. Other geometries, and bytes that do not fit, are an error."""
    made = [pd.DataFrame({
        "part": part, "ring": ring, "seq": np.arange(max(len(p) - 1, 0)), "x1": p[:-1, 0], "y1": p[:-1, 1], "x2": p[1:, 0], "y2": p[1:, 1],
    }) for part, ring, p in _rings(raw)]
    return pd.concat(made, ignore_index=True) if made else pd.DataFrame(columns=[f.split()[0] for f in _EDGES.split(", ")])


def encode_batch(part: pa.ListArray, ring: pa.ListArray, x: pa.ListArray, y: pa.ListArray) -> pa.Array:
    """The bytes of :func:`encode_polygon` for every feature; its sorted edges are one entry of each list.

    Bytes of all features are laid out at once: rings are runs of equal part and ring, and every place is a running sum."""
    sizes = part.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    parts, rings = np.asarray(part.flatten()), np.asarray(ring.flatten())
    points = np.column_stack([np.asarray(x.flatten()), np.asarray(y.flatten())]).astype("<f8")
    feature = np.repeat(np.arange(len(sizes)), sizes)
    count = len(feature)

    def begins(*columns: np.ndarray) -> np.ndarray:
        changed = np.zeros(count, bool)
        changed[:1] = True
        for column in columns:
            changed[1:] |= column[1:] != column[:-1]
        return np.flatnonzero(changed)

    ring_at, part_at = begins(feature, parts, rings), begins(feature, parts)
    length = np.diff(np.append(ring_at, count))
    ring_feature, part_feature = feature[ring_at], feature[part_at]
    multi = np.bincount(part_feature, minlength=len(sizes)) > 1
    opens = np.isin(ring_at, part_at)  # rings that begin a part, and with it a polygon
    first = np.isin(ring_at, begins(feature))
    head = 9 * opens + 9 * (first & multi[ring_feature])
    size = head + 4 + 16 * (length + 1)
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)

    def put(at: np.ndarray, values: np.ndarray) -> None:
        raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(at), values.itemsize * values.shape[1])
        out[at[:, None] + np.arange(raw.shape[1])] = raw

    def header(at: np.ndarray, kind: int, counts: np.ndarray) -> None:
        out[at] = 1
        put(at + 1, np.column_stack([np.full(len(at), kind), counts]).astype("<u4"))

    start = end - size
    shells = np.flatnonzero(first & multi[ring_feature])
    header(start[shells], _MULTI, np.bincount(part_feature, minlength=len(sizes))[ring_feature[shells]])
    polygons = np.flatnonzero(opens)
    header(start[polygons] + head[polygons] - 9, _POLYGON, np.diff(np.append(polygons, len(ring_at))))
    body = start + head
    put(body, (length + 1).astype("<u4")[:, None])
    inside = np.repeat(body + 4, length) + 16 * (np.arange(count) - np.repeat(ring_at, length))
    put(inside, points)
    put(body + 4 + 16 * length, points[ring_at])  # the first position again
    ends = np.zeros(len(sizes), np.int64)
    np.add.at(ends, ring_feature, size)
    offsets = np.concatenate([[0], np.cumsum(ends)])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(out)]).cast(pa.binary())


def to_wkb(edges: DataFrame, *, key: str = "geo_id") -> DataFrame:
    """key, geometry (binary): one row per feature, rings in the order of part, ring and seq.

    ``part`` and ``ring`` may be absent or null (0). A feature is one value, so one task holds the edges of one feature at a
    time. Rows without a key take no part.
    """
    whole = lambda name: F.coalesce(name, F.lit(0)).cast("int") if name in edges.columns else F.lit(0)
    kind = edges.schema[key].dataType.simpleString()
    lists = ["part", "ring", "x1", "y1"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edge_lists = [batch.column(name) for name in lists]
            # A slice of features at a time; a large feature is a slice of its own.
            ends = np.cumsum(edge_lists[0].value_lengths().to_numpy(zero_copy_only=False))
            row = 0
            while row < batch.num_rows:
                held = ends[row - 1] if row else 0
                until = max(row + 1, int(np.searchsorted(ends, held + _BATCH_EDGES, side="right")))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key).slice(row, until - row), encode_batch(*[c.slice(row, until - row) for c in edge_lists])], [key, "geometry"])
                row = until

    placed = edges.filter(F.col(key).isNotNull()).select(
        key, F.struct(whole("part").alias("part"), whole("ring").alias("ring"), F.col("seq"), F.col("x1").cast("double").alias("x1"), F.col("y1").cast("double").alias("y1")).alias("_e"))
    sorted_lists = placed.groupBy(key).agg(F.sort_array(F.collect_list("_e")).alias("_e"))
    return sorted_lists.select(key, *[F.col(f"_e.{name}").alias(name) for name in lists]).mapInArrow(encode, f"`{key}` {kind}, geometry binary")


def from_wkb(features: DataFrame, *, key: str = "geo_id", geometry: str = "geometry") -> DataFrame:
    """key, part, ring, seq, x1, y1, x2, y2: the edges of every feature; a null geometry has none."""
    kind = features.schema[key].dataType.simpleString()
    names = [field.split()[0] for field in _EDGES.split(", ")]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            while row < batch.num_rows:
                rings: list[tuple[int, int, np.ndarray]] = []
                owner: list[int] = []
                held = 0
                while row < batch.num_rows and held < _BATCH_EDGES:
                    found = _rings(batch.column(geometry)[row].as_py())
                    rings += found
                    owner += [row] * len(found)
                    held += sum(len(p) for _, _, p in found)
                    row += 1
                sizes = np.array([max(len(p) - 1, 0) for _, _, p in rings], np.int64)
                if not sizes.sum():
                    continue
                starts = np.cumsum(sizes) - sizes
                a = np.concatenate([p[:-1] for _, _, p in rings]).astype(float)
                b = np.concatenate([p[1:] for _, _, p in rings]).astype(float)
                columns = [np.repeat([r[0] for r in rings], sizes), np.repeat([r[1] for r in rings], sizes), np.arange(len(a)) - np.repeat(starts, sizes)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key).take(pa.array(np.repeat(owner, sizes))), *[pa.array(c.astype(np.int32)) for c in columns],
                     *[pa.array(np.ascontiguousarray(c)) for c in (a[:, 0], a[:, 1], b[:, 0], b[:, 1])]], [key, *names])

    return features.filter(F.col(geometry).isNotNull()).select(key, geometry).mapInArrow(decode, f"`{key}` {kind}, {_EDGES}")


def geo_metadata(metadata: DataFrame, column: str = "geometry") -> str:
    """The ``geo`` text that describes the binary column, from the row of ``writers.geometry_metadata``."""
    row = metadata.first()
    described = {"encoding": "WKB", "geometry_types": row["geometry_types"], "crs": row["crs"], "bbox": row["bbox"]}
    return json.dumps({"version": "1.1.0", "primary_column": column, "columns": {column: described}}, sort_keys=True)


def write_wkb(attributes: DataFrame, edges: DataFrame, metadata: DataFrame, path: str, *, key: str = "geo_id") -> None:
    """Attributes with a geometry column at a new path. The ``geo`` text is metadata of that column, which Spark keeps
    with the schema in the file footers, so a reader needs no table beside it."""
    require_new(attributes.sparkSession, [path])
    joined = attributes.join(to_wkb(edges, key=key), key, "left")
    described = F.col("geometry").alias("geometry", metadata={"geo": geo_metadata(metadata)})
    write_parquet(joined.select(*attributes.columns, described), path)
