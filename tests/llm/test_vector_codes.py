from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from areascreen.llm import queries
from areascreen.llm.vector_codes import compress, hex_code, with_group_error


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    """Plain Lloyd in Python integers over (id, vector), every part against every entry."""
    whole = [(i, [int((x * scale) // 1) for x in v]) for i, v in rows]
    whole.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = -(-len(whole[0][1]) // parts)
    cut = lambda v, p: v[p * size : (p + 1) * size]
    books = [[cut(v, p) for _, v in whole[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            held: dict[int, list] = {}
            for _, v in whole:
                held.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(held[k]) for c in zip(*held[k])] if k in held else e for k, e in enumerate(books[p])]
    found = [(i, [near(cut(v, p), books[p]) for p in range(parts)]) for i, v in whole]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, [k for _, k in n], min(sum(d for d, _ in n), 2**63 - 1)) for i, n in found), key=str), digest


def got(frame, **options):
    found = compress(frame, **options)
    return sorted(((r["vec_id"], list(r["codes"]), r["error"]) for r in found.codes.collect()), key=str), found


@pytest.mark.parametrize("kind", ["small", "ties", "huge", "repeated"])
def test_active_entries_give_plain_lloyd(spark, kind):
    random.seed(kind)
    value = {
        "small": lambda: random.gauss(0, 0.1), "ties": lambda: random.choice([0.0, 1 / 1024, -1 / 1024, 2 / 1024]),
        "huge": lambda: random.choice([random.gauss(0, 1), 1e8, -1e9, 1e30, 70000.0]), "repeated": lambda: random.gauss(0, 0.1)}[kind]
    rows = [(k if kind != "repeated" else k % 7 or None, [value() for _ in range(8)]) for k in range(300)]
    rows += rows[:20]
    want, digest = brute(rows, entries=12)
    have, found = got(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5), entries=12)
    assert have == want and found.digest() == digest
    assert found.compared[0] == 320 * 4 * 12 and all(n <= found.compared[0] for n in found.compared)


def test_fixed_entries_are_not_compared_again(spark):
    rows = [(k, [float(k % 4), 0.0, 0.0, 0.0]) for k in range(400)]
    found = compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), entries=4)
    assert found.compared[0] == 400 * 4 * 4 and found.compared[1:] == [0, 0, 0, 0]  # the start is the solution, so nothing moves
    assert found.codes.agg(F.sum("error")).first()[0] == 0


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.5, -0.25]), (2, None), (3, [nan, 0.0, 0.0]), (4, [inf, 0.0, 0.0]), (5, [None, 0.0, 0.0]), (6, []), (7, [1.0]), (None, [0.25, 1.0, 1.0]), (1, [0.5, 1.5, -0.25])]
    frame = spark.createDataFrame([(i, v, None if i == 1 else 3, "x", "k") for i, v in rows], "vec_id long, embedding array<double>, codes int, `k.ept` string, near string")
    found = compress(frame.withColumn("vec", F.lit(1)), keep=("vec_id", "vec", "near"), entries=2)
    want, digest = brute([(i, v) for i, v in rows if v and len(v) == 3 and None not in v and nan not in v and inf not in v], entries=2)
    assert sorted(((r["vec_id"], list(r["codes"]), r["error"]) for r in found.codes.collect()), key=str) == want and found.digest() == digest
    assert found.codes.columns == ["vec_id", "vec", "near", "codes", "error"] and all(r["vec"] == 1 and r["near"] == "k" for r in found.codes.collect())
    none = compress(frame.limit(0))
    assert none.codes.count() == 0 and none.digest() == hashlib.sha256(b"").hexdigest()


def test_errors_of_groups_and_codes_as_text(spark):
    rows = spark.createDataFrame([(1, None, 5, [0, 255]), (2, None, 7, [16, 1]), (3, 4, 2**63 - 1, [1]), (4, 4, 3, [])], "vec_id int, label int, error long, codes array<int>")
    found = {r["vec_id"]: (r["total"], r["code"]) for r in with_group_error(rows, "label", "total").withColumn("code", hex_code("codes")).collect()}
    assert found == {1: (12, "00ff"), 2: (12, "1001"), 3: (2**63 - 1, "01"), 4: (2**63 - 1, "")}


def test_query_against_brute_force(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    want, digest = brute([(r["vec_id"], r["embedding"]) for r in rows])
    have = queries.op11_vector_codes(spark, small).collect()
    assert sorted(((r["vec_id"], [int(r["code"][k : k + 2], 16) for k in range(0, 8, 2)], r["error"]) for r in have), key=str) == want
    assert {r["codebooks_sha256"] for r in have} == {digest}
