"""The corpus pipeline: stages that each call one text operator on what the stage before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from areascreen.llm.common import read
from areascreen.llm.decontaminate import find_leaks
from areascreen.llm.near_dup import near_duplicates
from areascreen.llm.packing import pack
from areascreen.llm.pii import find, redact, train
from areascreen.llm.quality import score_quality
from areascreen.llm.queries import GOOD, TOKENIZER
from areascreen.session import checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a quality score of at least GOOD; rejected ones go."""
    scored = score_quality(docs, read(spark, sf_dir, "labels"))
    return scored.filter(F.col("quality_score") >= GOOD).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8): one of the smallest doc_id.

    Rows without doc_id stay. Rows of one id are documents of their own where their texts differ: each goes only with
    its own group. Of several texts of the smallest id in one group the one with the least SHA-256 stays, of repeated
    rows the first by their other columns.
    """
    digest = next(n for n in (f"_digest{k}" for k in range(len(docs.columns) + 1)) if n not in docs.columns)
    told = docs.withColumn(digest, F.coalesce(F.unhex(F.sha2("text", 256)), F.lit(b"").cast("binary")))
    groups = near_duplicates(told.select("doc_id", "text", digest), words=5, num=4, den=5, mark=digest).filter("doc_id IS NOT NULL")
    groups = groups.select("doc_id", F.coalesce("component", "mark").alias("label"), "mark", "kept").distinct()
    least = groups.filter("kept").groupBy("doc_id", "label").agg(F.min("mark").alias("least"))
    gone = groups.join(least, ["doc_id", "label"], "left").filter("NOT kept OR mark != least").select("doc_id", F.col("mark").alias(digest))
    # The rows are shuffled once: repeated rows are combined ahead of it, and the join reuses the partitions.
    row = F.struct("text", *[c for c in docs.columns if c not in ("doc_id", "text")])
    rows = told.filter("doc_id IS NOT NULL").groupBy("doc_id", digest).agg(F.min(row).alias("row"))
    left = rows.join(gone, ["doc_id", digest], "left_anti").select("doc_id", "row.*").select(*docs.columns)
    return left.unionByName(docs.filter("doc_id IS NULL"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``."""
    return find_leaks(docs, read(spark, sf_dir, "benchmark")).filter(F.size("leaks") == 0).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every span of personal data replaced by its kind; n_chars counts the new text."""
    clean = redact(find(docs, train(docs)))
    return clean.withColumn("n_chars", F.when(F.size("pii") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length with their token ids."""
    return pack(docs, TOKENIZER)


STAGES = [
    ("quality_classifier", quality), ("minhash_near_dedup", near_dedup), ("benchmark_decontamination", decontamination),
    ("pii", personal_data), ("packing", packing),
]

#: No SQL: the classifier, the near-duplicate search and the tokenizer cannot be stated in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each stage's result is a written table in the shared folder."""
    docs = read(spark, sf_dir, "documents")
    base = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
