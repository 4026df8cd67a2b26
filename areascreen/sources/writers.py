"""Sinks: Parquet, CSV, edge tables with metadata, GeoJSON lines; runs are never overwritten."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from areascreen.functions.documents import feature_json


def run_folder(root: str, run_id: str) -> str:
    return f"{root}/run_id={run_id}"


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def require_new(spark: SparkSession, paths: Sequence[str]) -> None:
    """Stop before anything is written when one of the targets exists."""
    existing = [path for path in paths if path_exists(spark, path)]
    if existing:
        raise FileExistsError(f"refusing to overwrite: {existing}")


def write_parquet(df: DataFrame, path: str, types: dict[str, str] | None = None) -> None:
    """Compressed Parquet at a path that must be new; ``types`` pins the types of named columns."""
    casts = {name: F.col(name).cast(kind) for name, kind in (types or {}).items()}
    df.withColumns(casts).write.mode("errorifexists").option("compression", "zstd").parquet(path)


def write_csv(df: DataFrame, path: str, fields: Sequence[str]) -> None:
    """Header CSV with exactly the given fields; a column left over is an error.

    Arrays, maps and structs become JSON cells. Blanks around a value are kept. A null is an empty cell and an empty text
    a pair of quotes, so that ``read_csv`` can tell them apart; both are quoted in a file of one field, where a blank line
    is no row.
    """
    extra = sorted(set(df.columns) - set(fields))
    if extra:
        raise ValueError(f"columns without a field: {extra}")
    cells = [
        F.to_json(name).alias(name) if isinstance(df.schema[name].dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(name)
        for name in fields
    ]
    df.select(*cells).write.mode("errorifexists").csv(
        path, header=True, quoteAll=len(fields) == 1, escape='"', charToEscapeQuoteEscaping='"',
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def geometry_metadata(edges: DataFrame, crs: str) -> DataFrame:
    """One row: coordinate system, geometry types, feature count and total bounding box.

    A feature with several parts is a MultiPolygon; both names come from one flag each.
    """
    parts = edges.groupBy("geo_id").agg(F.countDistinct("part").alias("parts"), *[
        aggregate for aggregate in (
            F.min(F.least("x1", "x2")).alias("lo_x"), F.min(F.least("y1", "y2")).alias("lo_y"),
            F.max(F.greatest("x1", "x2")).alias("hi_x"), F.max(F.greatest("y1", "y2")).alias("hi_y"),
        )
    ])
    kinds = F.array_compact(F.array(
        F.when(F.bool_or(F.col("parts") > 1), "MultiPolygon"), F.when(F.bool_or(F.col("parts") == 1), "Polygon")
    ))
    return parts.agg(
        F.lit(crs).alias("crs"), kinds.alias("geometry_types"), F.count(F.lit(1)).alias("features"),
        F.array(F.min("lo_x"), F.min("lo_y"), F.max("hi_x"), F.max("hi_y")).alias("bbox"),
    )


def write_geometries(attributes: DataFrame, edges: DataFrame, path: str, *, crs: str) -> None:
    """Attributes, edges and metadata under one new folder."""
    require_new(attributes.sparkSession, [path])
    write_parquet(attributes, f"{path}/attributes")
    write_parquet(edges, f"{path}/edges")
    write_parquet(geometry_metadata(edges, crs), f"{path}/metadata")


def write_point_features(df: DataFrame, path: str, *, identifier: str, longitude: str, latitude: str, properties: Sequence[str]) -> None:
    """One GeoJSON feature per line: a file of any size can be read back in pieces."""
    line = feature_json(F.col(identifier), F.col(longitude), F.col(latitude), F.struct(*properties))
    df.select(line.alias("value")).write.mode("errorifexists").text(path)
