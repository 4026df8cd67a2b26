"""Typed readers: Parquet, CSV, GeoJSON-like features, API records and batch ledgers."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


POINT_FEATURES = "features array<struct<type: string, properties: map<string, string>, geometry: struct<type: string, coordinates: array<double>>>>"
#: Coordinates stay text until the type of the geometry is known.
POLYGON_FEATURES = "features array<struct<type: string, properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"
RINGS = "array<array<array<double>>>"
RECORDS = "success boolean, result struct<records: array<map<string, string>>>"


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | str, columns: Sequence[str]) -> DataFrame:
    """Declared schema, only the named columns: the scan reads nothing else."""
    return spark.read.schema(schema).parquet(path).select(*columns)


def read_csv(spark: SparkSession, path: str, columns: Sequence[str], *, multi_line: bool = False) -> DataFrame:
    """Header CSV with every column as text; a malformed row fails the read.

    An empty cell is null and a pair of quotes is an empty text: the parser marks nulls with a name that no file holds. In
    a file of one column both are null. Large files are split over tasks. ``multi_line`` allows line breaks inside quotes
    and reads a file in one task.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.csv(
        path, header=True, schema=schema, mode="FAILFAST", enforceSchema=False, multiLine=multi_line, escape='"',
        charToEscapeQuoteEscaping='"', nullValue=uuid.uuid4().hex if len(columns) > 1 else "")


def _features(spark: SparkSession, path: str, schema: str, *, lines: bool) -> DataFrame:
    """One row per feature; ``lines`` reads newline-delimited features, which can be split over tasks."""
    if lines:
        element = T.StructType.fromDDL(schema)["features"].dataType.elementType
        return spark.read.schema(element).json(path)
    collection = spark.read.schema(schema).json(path, multiLine=True)
    return collection.select(F.explode("features").alias("f")).select("f.*")


def require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """Fail the job on the first row that breaks the condition."""
    return df.withColumn("_ok", F.assert_true(condition, F.lit(message))).filter(F.col("_ok").isNull()).drop("_ok")


def read_point_features(
    spark: SparkSession, path: str, properties: Sequence[str], *, bounds: dict[str, float] | None = None, lines: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(points, one-row counts): rows with finite coordinates; the rest is dropped and counted.

    Points outside the bounds are counted; whether to drop them is the caller's choice.
    """
    from areascreen.functions.numbers import in_bounds

    rows = _features(spark, path, POINT_FEATURES, lines=lines)
    x, y = F.get("geometry.coordinates", F.lit(0)), F.get("geometry.coordinates", F.lit(1))
    finite = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y) & (F.abs(x) < float("inf")) & (F.abs(y) < float("inf"))
    valid = F.coalesce((F.col("geometry.type") == "Point") & finite, F.lit(False))
    inside = in_bounds(x, y, bounds) if bounds else F.lit(True)
    flat = rows.select(
        *[F.col("properties").getItem(p).alias(p) for p in properties], x.alias("longitude"), y.alias("latitude"),
        valid.alias("valid_geometry"), inside.alias("in_bounds"),
    )
    counts = flat.agg(
        F.count(F.lit(1)).alias("source_features"), F.count_if(~F.col("valid_geometry")).alias("invalid_geometry"),
        F.count_if(F.col("valid_geometry") & ~F.col("in_bounds")).alias("out_of_bounds"),
    )
    return flat.filter("valid_geometry").drop("valid_geometry"), counts


def _ring_edges(ring: Column) -> Column:
    """Edges between consecutive corners of a ring."""
    starts = F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0)))
    ends = F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0)))
    return F.transform(
        F.arrays_zip(starts.alias("a"), ends.alias("b")),
        lambda p: F.struct(p["a"][0].alias("x1"), p["a"][1].alias("y1"), p["b"][0].alias("x2"), p["b"][1].alias("y2")),
    )


def read_polygon_features(
    spark: SparkSession, path: str, *, identifier: str, required: Sequence[str], lines: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(attributes, edges): one attribute row per feature, one edge row per ring segment.

    A feature without a required property fails the read. Polygon and MultiPolygon features
    may stand in one file.
    """
    rows = _features(spark, path, POLYGON_FEATURES, lines=lines)
    for name in required:
        value = F.col("properties").getItem(name)
        rows = require(rows, value.isNotNull() & (F.trim(value) != ""), f"a feature lacks the property {name}")
    key = F.col("properties").getItem(identifier).alias("geo_id")
    attributes = rows.select(key, *[F.col("properties").getItem(p).alias(p) for p in required if p != identifier])
    text = F.col("geometry.coordinates")
    parts = F.when(F.col("geometry.type") == "MultiPolygon", F.from_json(text, f"array<{RINGS}>")).otherwise(F.array(F.from_json(text, RINGS)))
    rings = rows.select(key, F.posexplode(parts).alias("part", "rings")).select("geo_id", "part", F.posexplode("rings").alias("ring", "corners"))
    edges = rings.select("geo_id", "part", "ring", F.posexplode(_ring_edges(F.col("corners"))).alias("seq", "e")).select(
        "geo_id", "part", "ring", "seq", "e.*"
    )
    return attributes, edges


def read_records(spark: SparkSession, path: str, fields: Sequence[str], *, lines: bool = False) -> DataFrame:
    """Records of an API snapshot; a payload that does not report success fails the read.

    ``lines`` reads one payload per line, otherwise one per file.
    """
    payload = spark.read.schema(RECORDS).json(path, multiLine=not lines)
    checked = require(payload, F.coalesce("success", F.lit(False)), "the snapshot did not report success")
    return checked.select(F.explode("result.records").alias("r")).select(*[F.trim(F.col("r").getItem(f)).alias(f) for f in fields])


def read_batch_ledgers(
    spark: SparkSession, pattern: str, schema: str, *, number_pattern: str = r"batch[_-](\d+)", lines: bool = False
) -> DataFrame:
    """Numbered batch files stacked, each row tagged with its batch; incomplete batches fail the read."""
    rows = spark.read.schema(schema).json(pattern, multiLine=not lines).withColumn(
        "batch_number", F.regexp_extract(F.col("_metadata.file_path"), number_pattern, 1).cast("int")
    )
    return require(rows, F.coalesce(F.col("status") == "complete", F.lit(False)), "a batch is incomplete")


def accepted_category_counts(df: DataFrame, column: str, accepted: Sequence[str]) -> DataFrame:
    """category, rows, never_observed for each accepted category."""
    value = F.upper(F.trim(column))
    row = df.agg(*[F.count_if(value == c).alias(f"c{i}") for i, c in enumerate(accepted)])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("category"), F.col(f"c{i}").alias("rows"), (F.col(f"c{i}") == 0).alias("never_observed"))
        for i, c in enumerate(accepted)
    ])))
