from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from areascreen.llm import queries
from areascreen.llm.weighted_hash import _GAMMA, edited_fingerprints, fingerprint, likeness, signatures


def jaccard(a: str, b: str) -> float:
    """Generalised Jaccard similarity of word counts."""
    x, y = Counter(a.lower().split()), Counter(b.lower().split())
    return sum((x & y).values()) / sum((x | y).values()) if x or y else 1.0


def test_gamma_quantiles():
    u = (np.arange(1 << 16) + 0.5) / (1 << 16)
    assert np.abs(1 - (1 + _GAMMA) * np.exp(-_GAMMA) - u).max() < 1e-12 and (np.diff(_GAMMA) > 0).all()


def test_collision_rate_is_the_generalised_jaccard_similarity(spark):
    random.seed(5)
    pairs = []
    for _ in range(400):
        vocabulary = [f"w{random.randrange(10**9)}" for _ in range(random.randrange(2, 60))]
        a = random.choices(vocabulary, k=random.randrange(1, 200))
        b = [*random.sample(a, random.randrange(len(a) + 1)), *random.choices(vocabulary, k=random.randrange(60))] or ["z"]
        random.shuffle(b)
        pairs.append((" ".join(a), " ".join(b)))
    rows = fingerprint(fingerprint(spark.createDataFrame(pairs, "text string, other string")), "other", "second")
    found = rows.withColumn("near", likeness("fingerprint", "second")).collect()
    error = np.array([r["near"] - jaccard(r["text"], r["other"]) for r in found])
    assert abs(error.mean()) < 0.01 and np.sqrt((error**2).mean()) < 0.05  # 128 samples: at most 0.044 for one pair
    by_rank = sorted(zip([jaccard(r["text"], r["other"]) for r in found], error))
    assert all(abs(np.mean([e for _, e in by_rank[k : k + 100]])) < 0.02 for k in range(0, 400, 100))  # for small and large ones alike


def test_weights_count_not_only_terms():
    one, many = signatures(pa.array(["a b", "a b b b b b b b b b"]))
    same = np.mean(np.frombuffer(one, ">u2") == np.frombuffer(many, ">u2"))
    assert 0.08 < same < 0.35  # 2 / 10; without weights it would be 1


def check(rows: list[tuple], found: list) -> None:
    """``rows`` in order of (doc_id, MD5 of the text)."""
    texts = [t or "" for _, t in rows]
    want = Counter()
    for k, text in enumerate(texts):
        after, cut = texts[(k + 1) % len(texts)], len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        want[(rows[k][0], len(text), hashlib.sha256(edited.encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_chars"], bytes(r["edited_sha256"]).hex()) for r in found) == want


def test_odd_rows_in_order(spark, odd, none):
    rows = sorted(((r["doc_id"], r["text"]) for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest()))
    for parts in (1, 7):
        found = edited_fingerprints(odd.repartition(parts)).collect()
        check(rows, found)
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[1]["fingerprint"] == by_id[2]["fingerprint"] == by_id[3]["fingerprint"] == b"" and by_id[1]["near_next"] == 1.0
    assert by_id[6]["near_next"] == 1.0 and by_id[3]["near_next"] == 0.0  # a copy follows 6, words follow no words
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in found)
    assert edited_fingerprints(none).count() == 0
    alone = edited_fingerprints(odd.filter("doc_id = 5")).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0
    renamed = fingerprint(odd.withColumn("row", F.lit(1)).withColumn("made", F.lit(2)).withColumn("fingerprint", F.lit(3)))
    assert renamed.count() == odd.count() and renamed.columns == [*odd.columns, "row", "made", "fingerprint"]


def test_query_over_many_partitions(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rows = sorted(map(tuple, docs.collect()), key=lambda r: r[0])
    found = edited_fingerprints(docs.repartition(3)).collect()
    check(rows, found)
    texts = dict(rows)
    prints: dict = {}
    for r in found:
        assert prints.setdefault(texts[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
    error = []
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        r = next(r for r in found if r["doc_id"] == i)
        cut = len(text) // 4
        error += [r["near_next"] - jaccard(text, after), r["near_edited"] - jaccard(text, text[: len(text) - cut] + after[:cut])]
    assert abs(np.mean(error)) < 0.01 and max(map(abs, error)) < 0.25
    query = queries.op12_document_fingerprints(spark, small).collect()
    assert {(r["doc_id"], r["fingerprint"], r["edited_sha256"]) for r in query} == {(r["doc_id"], r["fingerprint"].hex(), r["edited_sha256"].hex()) for r in found}
