"""Append-once outcome ledger: the first write of a key wins, in batch and in a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from areascreen.operators.skew import first_by
from areascreen.sources.writers import path_exists

KEYS = ("od_plan_id", "method")


def new_rows(incoming: DataFrame, ledger: DataFrame, *, keys: Sequence[str] = KEYS, order: Sequence[str] = ("attempted_at",)) -> DataFrame:
    """Incoming rows whose key the ledger lacks, the earliest per key."""
    return first_by(incoming, list(keys), list(order)).select(*incoming.columns).join(
        ledger.select(*keys).distinct(), list(keys), "left_anti"
    )


def _stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Ledger rows with the batch folder they lie in; empty when nothing was written yet."""
    tagged = T.StructType([*schema.fields, T.StructField("batch", T.StringType())])
    if not path_exists(spark, path):
        return spark.createDataFrame([], tagged)
    return spark.read.schema(tagged).parquet(path)


def read_ledger(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The ledger at ``path``."""
    return _stored(spark, path, schema).drop("batch")


def insert_if_absent(incoming: DataFrame, path: str, *, batch: str, keys: Sequence[str] = KEYS, order: Sequence[str] = ("attempted_at",)) -> None:
    """Append the new keys of a batch in a folder of their own.

    Repeating a batch after a failure replaces that folder and leaves the result unchanged: the
    folder is pruned from the rows the batch is compared with.
    """
    stored = _stored(incoming.sparkSession, path, incoming.schema)
    others = stored.filter(F.col("batch") != batch).drop("batch")
    fresh = new_rows(incoming, others, keys=keys, order=order)
    fresh.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/batch={batch}")


def stream_into_ledger(source: DataFrame, path: str, checkpoint: str, *, keys: Sequence[str] = KEYS, order: Sequence[str] = ("attempted_at",)) -> StreamingQuery:
    """Stream new outcome files into the ledger; late duplicates are ignored by key.

    No state is kept in the stream: the ledger itself is the memory, so it needs no watermark.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        insert_if_absent(batch, path, batch=f"{epoch:012d}", keys=keys, order=order)

    return (
        source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
