"""Conversation prefix trie from composable fingerprints.

A turn's fingerprint is a number t (in four lanes, each modulo a prime of its own). A sequence of turns is the monoid
element (length n, u = t1 B + t2 B^2 + ... + tn B^n), and (m, u) followed by (n, v) is (m + n, u + B^m v). B has an
inverse, so a part of a sequence is a quotient of two of its prefixes. A rebuilt conversation, the head of its base and
then its own turns from some place on, therefore has prefixes that are linear in the prefixes of the two original
conversations: no rebuilt text is ever made. Prefixes with equal fingerprints form a node, and the digests of the turns
they refer to are checked to be one per node, and the texts behind a digest to be one per digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from areascreen.llm.common import materialise
from areascreen.operators.skew import salted_join

#: The four largest primes below 2^31: products of two residues fit a long.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
#: Turns of one conversation that a join or a window holds as one key.
BLOCK = 4096
_LANES = range(len(PRIMES))
_NODE = ["depth", "a", "b"]

_PREFIXES = ("kind int, part long, conv_id long, turn long, rid long, k long, token binary, n_bytes long, "
             + ", ".join([f"u{j} long" for j in _LANES] + [f"w{j} long" for j in _LANES]) + ", first_conv long, first_token binary, first_turn long, first_rid long")


def _bases(attempt: int) -> list[int]:
    random = np.random.Generator(np.random.PCG64([20261130, attempt]))
    return [int(random.integers(1 << 20, p - 1)) for p in PRIMES]


class _Powers:
    """B^k modulo p for arrays of k: one table for each 12 bits of k."""

    def __init__(self, base: int, prime: int) -> None:
        self.prime = prime
        self.tables = []
        for _ in range(4):
            table = [1]
            for _ in range(4095):
                table.append(table[-1] * base % prime)
            self.tables.append(np.array(table, np.int64))
            base = table[-1] * base % prime

    def __call__(self, k: np.ndarray) -> np.ndarray:
        found = np.ones(len(k), np.int64)
        for level, table in enumerate(self.tables):
            found = found * table[(k >> (12 * level)) & 4095] % self.prime
        return found


def _token(attempt: int) -> Column:
    """Digest of a turn: role and text are told apart by the role's length."""
    return F.sha2(F.concat(F.lit(f"{attempt}:"), F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)


def _prefixes(rows: DataFrame, bases: list[int]) -> DataFrame:
    """Prefix elements within each sorted partition, and one summary row of each partition (kind 1)."""
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = [_Powers(b, p) for b, p in zip(bases, PRIMES)]
        conv, k0, u0, first, part = None, 0, [0] * len(PRIMES), None, None
        names = [f.split()[0] for f in _PREFIXES.split(", ")]
        kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
        types = [kinds[f.split()[1]] for f in _PREFIXES.split(", ")]

        def batch_of(columns: dict, n: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(names, types)], names)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids = batch.column("conv_id").to_numpy(zero_copy_only=False)
            if first is None:
                first = {f"first_{c}": [batch.column(x)[0].as_py()] for c, x in (("conv", "conv_id"), ("token", "token"), ("turn", "turn"), ("rid", "rid"))}
                part = batch.column("part")[0].as_py()
            starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
            goes_on = ids[0] == conv
            k = np.arange(n) - starts[owner] + 1
            k[: starts[1] if len(starts) > 1 else n] += k0 if goes_on else 0
            columns = {"kind": np.zeros(n, np.int32), "conv_id": ids, "k": k, "n_bytes": batch.column("n_bytes"), "token": batch.column("token"), "part": batch.column("part")}
            last = []
            for j, prime in enumerate(PRIMES):
                term = batch.column(f"t{j}").to_numpy(zero_copy_only=False) % prime * powers[j](k) % prime
                total = np.cumsum(term)
                before = (total - term)[starts]
                if goes_on:
                    before[0] -= u0[j]
                columns[f"u{j}"] = (total - before[owner]) % prime
                columns[f"w{j}"] = (total - term - before[owner]) % prime
                last.append(int(columns[f"u{j}"][-1]))
            conv, k0, u0 = int(ids[-1]), int(k[-1]), last
            yield batch_of(columns, n)
        if first is not None:
            yield batch_of({"kind": [1], "part": [part], "conv_id": [conv], "k": [k0], **{f"u{j}": [u0[j]] for j in _LANES}, **first}, 1)

    return rows.mapInArrow(compute, _PREFIXES)


def _carried(found: DataFrame, bases: list[int]) -> DataFrame:
    """conv_id, k, u, w, token, n_bytes of every original turn: what partitions before it hold of its conversation is put in front.

    Summaries are one row a partition; they are composed here in order.
    """
    names = ["part", "conv_id", "k", *[f"u{j}" for j in _LANES], "first_conv", "first_turn", "first_token", "first_rid"]
    told = sorted(found.filter("kind = 1").select(*names).collect(), key=lambda r: (
        r["first_conv"], r["first_turn"] is not None, r["first_turn"] or 0, bytes(r["first_token"]), r["first_rid"]))
    carry, rows = None, []
    for r in told:
        here = (r["conv_id"], r["k"], [r[f"u{j}"] for j in _LANES])
        if carry and carry[0] == r["first_conv"]:
            moved = [pow(b, carry[1], p) for b, p in zip(bases, PRIMES)]
            rows.append((r["part"], r["first_conv"], carry[1], *carry[2], *moved))
            if here[0] == carry[0]:
                here = (here[0], carry[1] + here[1], [(u + m * v) % p for u, m, v, p in zip(carry[2], moved, here[2], PRIMES)])
        carry = here
    schema = "part long, conv_id long, k0 long, " + ", ".join([f"c{j} long" for j in _LANES] + [f"m{j} long" for j in _LANES])
    carries = F.broadcast(found.sparkSession.createDataFrame(rows, schema))  # at most one row a partition
    joined = found.filter("kind = 0").join(carries, ["part", "conv_id"], "left")

    def lane(name: str, j: int) -> Column:
        return F.coalesce((F.col(f"c{j}") + F.col(f"m{j}") * F.col(f"{name}{j}")) % PRIMES[j], F.col(f"{name}{j}")).alias(f"{name}{j}")

    return joined.select("conv_id", (F.col("k") + F.coalesce("k0", F.lit(0))).alias("k"), "token", "n_bytes",
                         *[lane("u", j) for j in _LANES], *[lane("w", j) for j in _LANES])


def _packed(lanes: list[Column], names: tuple[str, str]) -> list[Column]:
    return [F.shiftleft(lanes[0], 31).bitwiseOR(lanes[1]).alias(names[0]), F.shiftleft(lanes[2], 31).bitwiseOR(lanes[3]).alias(names[1])]


def _members(turns: DataFrame, base: Column, head: Column, most: int, bases: list[int]) -> DataFrame:
    """One row for every prefix of every rebuilt conversation, the empty one included: its node's fingerprint (depth, a,
    b), the parent's (pa, pb), and digest and bytes of its last turn. ``ends`` marks the whole conversation."""
    lanes = [f"{x}{j}" for x in "uw" for j in _LANES]
    heads = materialise(turns.groupBy("conv_id").agg(
        F.max("k").alias("n"), F.sort_array(F.collect_list(F.when(F.col("k") <= most, F.struct("k", *lanes, "token", "n_bytes")))).alias("heads")))
    own = heads.select("conv_id", "n", "heads", base.cast("long").alias("base"), head.cast("long").alias("h"))
    based = own.join(heads.select(F.col("conv_id").alias("base"), F.col("heads").alias("base_heads")), "base", "left")
    based = based.withColumn("base_heads", F.slice(F.coalesce("base_heads", F.array().cast(heads.schema["heads"].dataType)), F.lit(1), F.col("h").cast("int")))
    based = based.withColumn("hb", F.size("base_heads").cast("long"))

    def at(heads: str, k: Column, j: int) -> Column:
        return F.coalesce(F.get(F.col(heads)[f"u{j}"], (k - 1).cast("int")), F.lit(0).cast("long"))

    joins = []
    for j, (b, p) in enumerate(zip(bases, PRIMES)):
        power = F.element_at(F.array(*[F.lit(pow(b, k, p)).cast("long") for k in range(-most, most + 1)]), (F.col("hb") - F.col("h") + most + 1).cast("int"))
        based = based.withColumn(f"alpha{j}", power)
        joins.append(F.pmod(at("base_heads", F.col("hb"), j) - F.col(f"alpha{j}") * at("heads", F.col("h"), j) % p, F.lit(p)).alias(f"delta{j}"))
    based = materialise(based.select("conv_id", "n", "h", "hb", "base_heads", *[f"alpha{j}" for j in _LANES], *joins, (F.col("hb") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("whole")))

    zero = F.lit(0).cast("long")
    root = based.select("conv_id", zero.alias("depth"), zero.alias("a"), zero.alias("b"), F.lit(None).cast("long").alias("pa"), F.lit(None).cast("long").alias("pb"),
                        F.lit(None).cast("binary").alias("token"), zero.alias("n_bytes"), (F.col("whole") == 0).alias("ends"))
    shared = based.select("conv_id", "whole", F.explode("base_heads").alias("t")).select(
        "conv_id", F.col("t.k").alias("depth"), *_packed([F.col(f"t.u{j}") for j in _LANES], ("a", "b")), *_packed([F.col(f"t.w{j}") for j in _LANES], ("pa", "pb")),
        "t.token", "t.n_bytes", (F.col("whole") == F.col("t.k")).alias("ends"))
    # A long conversation is many blocks, so no join key holds more than BLOCK of its turns.
    block = lambda k: F.floor(k / BLOCK)
    blocks = based.filter("n > h").select("*", F.explode(F.sequence(block(F.col("h") + 1), block(F.col("n")))).alias("block")).drop("base_heads", "n")
    after = turns.filter(F.col("k") > head).withColumn("block", block(F.col("k"))).join(blocks, ["conv_id", "block"])
    moved = {x: [(F.col(f"delta{j}") + F.col(f"alpha{j}") * F.col(f"{x}{j}")) % PRIMES[j] for j in _LANES] for x in "uw"}
    depth = F.col("hb") + F.col("k") - F.col("h")
    suffix = after.select("conv_id", depth.alias("depth"), *_packed(moved["u"], ("a", "b")), *_packed(moved["w"], ("pa", "pb")), "token", "n_bytes", (depth == F.col("whole")).alias("ends"))
    return root.unionByName(shared).unionByName(suffix)


def _end_digests(members: DataFrame) -> DataFrame:
    """depth, a, b, ends_sha256: the hash of the ids of the conversations that end in a node, in order.

    Sorted ranges of ids become pieces of text first, one a batch and node, so that the task that hashes a node reads few
    rows and holds one.
    """
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*[batch.column(c).to_pylist() for c in (*_NODE, "conv_id")])
            made = []
            for node, group in groupby(rows, key=lambda r: r[:3]):
                ids = [r[3] for r in group]
                made.append((*node, ids[0], ",".join(map(str, ids))))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 4 else pa.int64()) for k, c in enumerate(zip(*made))] if made else [
                pa.array([], pa.string() if k == 4 else pa.int64()) for k in range(5)], [*_NODE, "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = []
            for *own, ids in zip(*[batch.column(c).to_pylist() for c in (*_NODE, "ids")]):
                if own != node:
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = own, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _ended(done)
        yield _ended([(*node, state.hexdigest())] if node is not None else [])

    def _ended(rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 3 else pa.int64()) for k, c in enumerate(columns)], [*_NODE, "ends_sha256"])

    ended = members.filter("ends").select(*_NODE, "conv_id")
    dealt = ended.repartitionByRange(*_NODE, "conv_id").sortWithinPartitions(*_NODE, "conv_id")
    told = dealt.mapInArrow(pieces, "depth long, a long, b long, first long, ids string")
    return told.repartition(*_NODE).sortWithinPartitions(*_NODE, "first").mapInArrow(digests, "depth long, a long, b long, ends_sha256 string")


def prefix_trie(turns: DataFrame, base: Column, head: Column, most: int = 8) -> DataFrame:
    """One row per node of the trie of all rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    ``turns`` has conv_id, turn, role, text. Every conversation is the first ``head`` turns of the conversation ``base``
    (all if it has fewer, none if there is no such conversation), then its own turns after its first ``head``. ``base``
    and ``head`` (0 to ``most``) are expressions of conv_id. A node is a distinct sequence of first turns (role, text)
    and is named by its smallest member; the root is the empty sequence. ``n_leaves`` and ``saved_tokens`` cover the
    node's subtree, itself included; saved_tokens adds (members - 1) * UTF-8 bytes of the last text of each node.

    Turns are ordered by number (nulls first); equal numbers by digest of role and text, so repeated rows are turns of
    their own in one order. A null role or text is empty. Rows without conv_id belong to no conversation and take no
    part. Other columns are ignored. An empty table gives no rows.

    No key of a join or window holds more than BLOCK turns of a conversation, counts of a node are map-side aggregates.
    Sums over subtrees need no walk: a node counts where its smallest member is named, and that conversation's total
    reaches all nodes it is a member of. Only the hash of the ids that end in one node is one task's work, on ids alone.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text.alias("text"))
    for attempt in count():  # a second attempt, with other digests and bases, follows only on a collision
        bases = _bases(attempt)
        digest = rows.withColumn("digest", _token(attempt))
        token = F.unhex(F.substr("digest", F.lit(1), F.lit(32)))
        lanes = [F.conv(F.substr("digest", F.lit(33 + 8 * j), F.lit(8)), 16, 10).cast("long").alias(f"t{j}") for j in _LANES]
        order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("token"), F.col("rid")]
        dealt = digest.select("conv_id", "turn", token.alias("token"), F.octet_length("text").cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("rid"), *lanes)
        dealt = dealt.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id().cast("long"))
        found = materialise(_prefixes(dealt, bases))
        members = materialise(_members(_carried(found, bases), base, head, most, bases))
        nodes = members.groupBy(*_NODE).agg(
            F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("token").alias("least"), F.max("token").alias("most"),
            F.max("n_bytes").alias("n_bytes"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
        nodes = materialise(nodes)
        content = F.struct("role", "text")
        texts = digest.groupBy("digest").agg(F.min(content).alias("one"), F.max(content).alias("other")).filter("one != other")
        if nodes.filter("least != most").isEmpty() and texts.isEmpty():
            break

    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    block = F.floor(F.col("depth") / BLOCK).alias("block")
    nodes = nodes.join(children, _NODE, "left").select(
        *_NODE, "conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "pa", "pb", ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"), block)
    nodes = materialise(nodes)

    # A conversation names a chain of nodes, from some depth down to its end.
    parts = nodes.groupBy("conv_id", "block").agg(F.sum("saved").alias("held"), F.min("depth").alias("top"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    chain = W.partitionBy("conv_id")
    parts = materialise(parts.select(
        "conv_id", "block", F.sum("held").over(chain).alias("named"), F.max("leaf").over(chain).alias("leaf"), F.min("top").over(chain).alias("top"),
        (F.sum("held").over(chain.orderBy("block")) - F.col("held")).alias("above")))
    first = parts.groupBy("conv_id").agg(F.max("named").alias("named"), F.max("leaf").alias("leaf"), F.max("block").alias("last"))
    reach = first.select("conv_id", "named", "leaf", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("block"))
    sums = members.withColumn("block", block).join(reach, ["conv_id", "block"]).groupBy(*_NODE).agg(F.sum("named").alias("all"), F.sum("leaf").alias("n_leaves"))

    inside = F.sum("saved").over(W.partitionBy("conv_id", "block").orderBy("depth")) - F.col("saved")
    placed = nodes.join(parts.select("conv_id", "block", "top", "above"), ["conv_id", "block"]).withColumn("before", F.col("above") + inside)
    placed = materialise(placed.select(*_NODE, "conv_id", "n_convs", "n_children", "pa", "pb", "top", "before"))
    tops = placed.filter((F.col("depth") == F.col("top")) & (F.col("depth") > 0))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    named = salted_join(tops, above, ["depth", "pa", "pb"], spread=["conv_id"])
    inner = placed.filter((F.col("depth") > F.col("top")) | (F.col("depth") == 0)).withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("conv_id")))
    whole = named.unionByName(inner).join(sums, _NODE).join(_end_digests(members), _NODE, "left")
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("all") - F.col("before")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
