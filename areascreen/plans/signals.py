"""Second commercial signal: key equality of two evidence families, union and qualification."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from areascreen.operators.evidence import qualification, signal_rollup
from areascreen.operators.joins import key_set_difference

EVIDENCE_COLUMNS = ["node_id", "signal_key", "buffer_metres", "measurement_status", "positive_signal", "feature_count"]


def combined_evidence(first: DataFrame, second: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(evidence, key differences): both families in one long table.

    The two must cover the same (node, buffer) keys; the caller fails on any difference.
    """
    evidence = first.select(*EVIDENCE_COLUMNS).unionByName(second.select(*EVIDENCE_COLUMNS))
    return evidence, key_set_difference(first, second, ["node_id", "buffer_metres"])


def qualify(evidence: DataFrame, reviews: DataFrame, *, largest_buffer: int, required: int) -> DataFrame:
    """node_id, positive_signals, missing_signals, open_reviews, qualification_status."""
    rolled = signal_rollup(evidence, largest_buffer=largest_buffer)
    opened = reviews.groupBy("node_id").agg(F.count_if(F.col("status") == "open").alias("open_reviews"))
    joined = rolled.join(opened, "node_id", "left").na.fill(0, ["open_reviews"])
    return joined.withColumn(
        "qualification_status", qualification(F.col("positive_signals"), F.col("open_reviews"), required=required)
    )
