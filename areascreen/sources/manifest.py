"""Content-addressed run ids, file manifests and checksum verification."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from areascreen.operators.skew import fan_out

#: Bytes of a range that one task digests, digests under one node of a file's tree, and bytes read at once.
RANGE_BYTES, FAN, _PIECE_BYTES = 256 << 20, 1024, 4 << 20


def run_id(prefix: str, fingerprints: DataFrame, config: Mapping, decisions: Sequence[str] = ()) -> str:
    """Prefix and 16 hex digits over input fingerprints, configuration and decisions.

    ``fingerprints`` has one row per input table: name and the columns of
    :func:`areascreen.operators.quality.table_fingerprint`.
    """
    rows = sorted(json.dumps(row.asDict(), sort_keys=True, default=str) for row in fingerprints.collect())
    text = "|".join([*rows, json.dumps(config, sort_keys=True, default=str), *decisions])
    return prefix + hashlib.sha256(text.encode()).hexdigest()[:16]


def _files(spark: SparkSession, path: str) -> DataFrame:
    """path, file_name, length, content of every data file below a path; ``content`` is read only where it is selected.

    Spark's reader gives no row for an empty file, so a file that was emptied shows as missing.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = path.split(":", 1)[-1].strip("/") + "/"
    return files.select("path", F.substr("path", F.instr("path", root) + len(root)).alias("file_name"), "length", "content")


def _read_range(path: str, start: int, length: int) -> str:
    """Digest of one byte range, read in pieces from the file's own file system."""
    system, name = pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    digest, left = hashlib.sha256(), length
    with system.open_input_file(name) as source:
        source.seek(start)
        while left:
            piece = source.read(min(left, _PIECE_BYTES))
            if not piece:
                raise OSError(f"{path} ends before byte {start + length}")
            digest.update(piece)
            left -= len(piece)
    return digest.hexdigest()


def range_digests(spark: SparkSession, path: str, *, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """file_name, start, length, sha256 of every byte range of every data file below a path; empty files have none.

    Ranges of one file are rows, dealt over all tasks, and each task reads only its own range.
    """
    listed = _files(spark, path).select("path", "file_name", "length").filter("length > 0")
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long")))
    ranges = listed.withColumn("start", first).withColumn("length", F.least(F.col("length") - F.col("start"), F.lit(range_bytes).cast("long")))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_read_range(p, s, n) for p, s, n in zip(batch["path"], batch["start"].tolist(), batch["length"].tolist())]
            yield batch.drop(columns="path").assign(sha256=found)

    return fan_out(ranges, ["file_name", "start"]).select("path", "file_name", "start", "length").mapInPandas(
        digest, "file_name string, start long, length long, sha256 string")


def fold_digests(ranges: DataFrame) -> DataFrame:
    """file_name, byte_size, sha256: the root of each file's tree of digests.

    A node is the digest of at most ``FAN`` digests below it, in order, so no row grows with the file.
    """
    widths = ranges.groupBy("file_name").agg(F.max("length").alias("_width"))  # all ranges but the last are this wide
    placed = ranges.join(widths, "file_name").select("file_name", F.expr("start div _width").alias("place"), "length", "sha256")
    top = ranges.join(widths, "file_name").agg(F.max(F.expr("start div _width"))).first()[0]
    while top is not None:
        placed = placed.groupBy("file_name", F.expr(f"place div {FAN}").alias("place")).agg(
            F.sum("length").alias("length"), F.sort_array(F.collect_list(F.struct("place", "sha256"))).alias("_below"),
        ).select("file_name", "place", "length", F.sha2(F.concat_ws("", F.col("_below")["sha256"]), 256).alias("sha256"))
        top = None if top < FAN else top // FAN
    return placed.select("file_name", F.col("length").alias("byte_size"), "sha256")


def file_manifest(spark: SparkSession, path: str, *, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """file_name, byte_size, sha256 of every data file below a path; hashing runs in the tasks.

    ``file_name`` is the path below the root, so equal names in different folders stay apart. A file of up to
    ``range_bytes`` has its plain digest; a larger one the root of :func:`fold_digests`, whose value depends on
    ``range_bytes``, so both manifests of a comparison take the same.
    """
    files = _files(spark, path)
    small = files.filter(F.col("length") <= range_bytes).select("file_name", F.col("length").alias("byte_size"), F.sha2("content", 256).alias("sha256"))
    if files.filter(F.col("length") > range_bytes).select("path").isEmpty():
        return small
    ranges = range_digests(spark, path, range_bytes=range_bytes)
    large = files.filter(F.col("length") > range_bytes).select("file_name")
    return small.unionByName(fold_digests(ranges.join(large, "file_name", "left_semi")))


def verify_ranges(observed: DataFrame, recorded: DataFrame) -> DataFrame:
    """file_name, start, status of every byte range: match, changed, missing or unexpected."""
    named = lambda df: df.select("file_name", "start", F.col("length").alias("byte_size"), "sha256")
    both = [named(df).withColumn("at", F.struct("file_name", "start")) for df in (observed, recorded)]
    return verify_manifest(*both, key="at").select("at.file_name", "at.start", "status")


def verify_manifest(observed: DataFrame, recorded: DataFrame, *, key: str = "file_name") -> DataFrame:
    """key, status: match, changed, missing or unexpected. A snapshot is reused only when all match."""
    a = recorded.select(key, F.col("sha256").alias("_recorded"), F.col("byte_size").alias("_size"))
    b = observed.select(key, "sha256", "byte_size")
    joined = a.join(b, key, "full_outer")
    same = (F.col("sha256") == F.col("_recorded")) & (F.col("byte_size") == F.col("_size"))
    status = (
        F.when(F.col("sha256").isNull(), "missing").when(F.col("_recorded").isNull(), "unexpected")
        .when(same, "match").otherwise("changed")
    )
    return joined.select(key, status.alias("status"))
