"""Helpers shared by the operators: written cuts of the lineage, text batches, the label fold."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from areascreen.session import checkpoint_dir

#: Bytes of text that a task works on at once; its arrays take some fifty times as much. A longer single text is a batch of its own.
BATCH_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` into the shared checkpoint folder and read it back.

    The written table survives lost executors, keeps its columns for pruning, and is removed when the session ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove a table that ``materialise`` wrote, once what was made from it is written itself."""
    spark = df.sparkSession
    for path in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if path.rsplit("/", 1)[-1].startswith("llm-"):
            jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def text_batches(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of each hold at most ``limit`` bytes, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        first, held = 0, 0
        for row, size in enumerate(sizes):
            if row > first and held + size > limit:
                yield batch.slice(first, row - first)
                first, held = row, 0
            held += size
        if len(sizes) > first:
            yield batch.slice(first)


def fold(doc_id: Column | str) -> Column:
    """crc32 of the id as text, modulo 5; rows with 0 are held out. A null id counts as held out."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % 5, F.lit(0))


def held_out(doc_id: Column | str) -> Column:
    return fold(doc_id) == 0


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """At most ``rows`` training rows (text, label): labelled, not held out, in hash order of the id.

    Only here are labels read. Repeated ids keep one row; null ids, texts or labels give none.
    """
    marks = labels.filter(~held_out("doc_id") & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(chosen, "doc_id").dropDuplicates(["doc_id"])
