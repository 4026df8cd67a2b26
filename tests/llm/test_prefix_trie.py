from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from areascreen.llm import prefix_trie as module, queries
from areascreen.llm.prefix_trie import prefix_trie

TURNS = "conv_id long, turn long, role string, text string"


def head_of(c: int) -> int:
    return zlib.crc32(str(c).encode()) % 9


def base_of(c: int) -> int:
    return c - (c % 5 if c >= 0 else -(-c % 5))


def brute(rows: list[tuple]) -> list[tuple]:
    """The trie of rebuilt lists, walked from the leaves up."""
    own: dict = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.sha256(f"0:{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [(r[3], r[4]) for r in sorted(v)] for c, v in own.items()}
    members: dict = {}
    whole = {}
    for c in own:
        h = head_of(c)
        turns = own.get(base_of(c), [])[:h] + own[c][h:]
        whole[c] = tuple(turns)
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children: dict = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[x] for x in below) if below else 1
        saved[node] = sum(saved[x] for x in below) + (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
    return sorted((
        min(m), len(node), min(members[node[:-1]]) if node else -1, len(m), len(children.get(node, [])), leaves[node], saved[node],
        hashlib.sha256(",".join(map(str, sorted(c for c in m if whole[c] == node))).encode()).hexdigest()) for node, m in members.items())


def trie(turns) -> list[tuple]:
    c = F.col("conv_id")
    found = prefix_trie(turns, base=c - c % 5, head=F.crc32(F.encode(c.cast("string"), "UTF-8")) % 9)
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in found.collect())


@pytest.mark.parametrize("block", [3, 4096])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(module, "BLOCK", block)
    random.seed(11)
    rows = []
    for c in range(0, 90):
        if c % 15 == 5:
            continue  # some bases do not exist
        for k in range(random.choice([1, 2, 3, 9, 12, 20])):
            rows.append((c, k if c % 7 else None, random.choice(["user", "assistant", None]), random.choice(["a", "b", "", None, "ü😀", "a" * 50])))
    rows += [(c, k, "user", "same") for c in (100, 101, 102, 103, 107, 113) for k in range(30)]  # copies
    rows += [(200, k, "user", f"t{k % 3}") for k in range(2500)] + [(201, k, "user", f"t{k % 3}") for k in range(2500)]  # long ones
    rows += [(300, 1, "user", "tie"), (300, 1, "assistant", "tie"), (300, 1, "user", "tie"), (300, None, "x", "y"), (-7, 1, "u", "v"), (-5, 1, "u", "v"), (None, 1, "u", "v")]
    rows += [(400, 0, "ab", "c"), (403, 0, "a", "bc"), (404, 0, None, None)]
    frame = spark.createDataFrame(rows, TURNS).withColumns({"token": F.lit(1), "k": F.lit("x"), "part": F.lit(2), "depth": F.lit(None).cast("int")})
    for parts in (1, 9):
        assert trie(frame.repartition(parts)) == brute(rows)


def test_conversations_over_many_partitions(spark):
    rows = [(c, k, "user", f"t{(k * k) % 7}") for c in (10, 12, 13) for k in range(700)] + [(11, k, "user", "z") for k in range(3)]
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", "23")
    session.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    frame = session.createDataFrame(rows, TURNS).repartition(6)
    assert trie(frame) == brute(rows)


def test_a_collision_is_noticed_and_resolved(spark, monkeypatch):
    real = module._bases
    used = []

    def bases(attempt):
        used.append(attempt)
        return [0] * 4 if attempt == 0 else real(attempt)  # at first all sequences look alike

    monkeypatch.setattr(module, "_bases", bases)
    monkeypatch.setattr(module, "pow", lambda b, k, p: pow(b or 1, k, p), raising=False)
    rows = [(c, k, "user", f"t{c}{k}") for c in range(4) for k in range(10)]
    assert trie(spark.createDataFrame(rows, TURNS)) == brute(rows) and used == [0, 1]


def test_empty_and_turnless(spark):
    assert trie(spark.createDataFrame([], TURNS)) == [] and trie(spark.createDataFrame([(None, 1, "a", "b")], TURNS)) == []
    alone = next(c for c in range(1, 99) if c % 5 and head_of(c) > 1)
    rows = [(alone, 1, "user", "dropped")]  # its base does not exist and its own turn is replaced
    assert trie(spark.createDataFrame(rows, TURNS)) == brute(rows) == [(alone, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]


def test_query_equals_sql(spark, small):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW conversations AS SELECT * FROM '{small}/conversations.parquet'")
    result = connection.execute(queries.ORACLES["op13_prefix_trie"])
    names = [c[0] for c in result.description]
    assert sorted(map(str, queries.op13_prefix_trie(spark, small).select(*names).collect())) == sorted(
        str(r) for r in spark.createDataFrame(result.fetchall(), queries.op13_prefix_trie(spark, small).select(*names).schema).collect())
