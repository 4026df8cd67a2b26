"""Shards of equal row counts by balanced label propagation, in Spark joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from areascreen.llm.common import materialise

#: Rounds of propagation, and parts into which priorities and numberings are cut (fixed sizes of small tables).
ROUNDS, PARTS = 12, 4096


def _sums(values: list[int]) -> list[int]:
    """Sums before each value, and the total."""
    found = [0]
    for value in values:
        found.append(found[-1] + value)
    return found


def _numbered(rows: DataFrame, keys: list[str], order: Column, name: str) -> DataFrame:
    """Number the rows of each key gapless from 0, roughly by ``order`` (0 to 1), without sorting a key in one task.

    Rows fall into PARTS parts per key; the counts of all parts give the offsets, and each part is numbered by itself.
    """
    parted = rows.withColumn("_part", F.least(F.floor(order * PARTS), F.lit(PARTS - 1)).cast("int"))
    counts = parted.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_held"))
    offsets = counts.withColumn("_before", F.sum("_held").over(W.partitionBy(*keys).orderBy("_part")) - F.col("_held")).drop("_held")
    inside = F.row_number().over(W.partitionBy(*keys, "_part").orderBy("rid")) - 1
    return parted.withColumn("_inside", inside).join(offsets, [*keys, "_part"]).withColumn(
        name, (F.col("_before") + F.col("_inside")).cast("long")).drop("_part", "_inside", "_before")


def _unit(*columns: Column | str) -> Column:
    """A hash as a number from 0 to 1."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / (1 << 30)


def _near(group: str) -> Column:
    """A number from 0 to 1 that is close for rows of one group, yet spreads a huge group over many parts."""
    return F.pmod(_unit(group) + _unit("rid") / 32, F.lit(1.0))


def propagate(linked: DataFrame, shards: int, quota: int, rounds: int = ROUNDS) -> DataFrame:
    """Move linked rows (rid, grp, shard) towards the shard that holds most of their group; no shard exceeds ``quota``
    by moves.

    Each round counts rows per group and shard, picks for every group the fullest shard that has room, and lets rows
    with fewer neighbours where they are ask to move there. A group that fits whole into that room also leaves shards
    without room, however many it has there; if it is in none with room, a hash picks one. Requests are ranked by the
    neighbours gained. A histogram of the ranks, of fixed size, gives each shard the rank up to which all requests fit
    its room; the requests of the first rank that does not fit whole are numbered and fill what is left exactly. So the
    rule is the same for tables of any size.
    """
    def by_shard(values: list) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("to") + 1)

    for turn in range(rounds):
        inside = {r["shard"]: r["n"] for r in linked.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per shard
        room = [max(0, quota - inside.get(s, 0)) for s in range(shards)]
        held = linked.groupBy("grp", "shard").agg(F.count(F.lit(1)).alias("held")).withColumn("weight", F.struct("held", F.xxhash64("grp", "shard").alias("tie")))
        open_ = [s for s in range(shards) if room[s]]
        if not open_:
            break
        split = held.groupBy("grp").agg(F.sum("held").alias("copies"), F.count(F.lit(1)).alias("spots")).filter("spots > 1")
        best = held.filter(F.col("shard").isin(open_)).groupBy("grp").agg(F.max_by("shard", "weight").alias("to"), F.max("weight").alias("most"))
        any_open = F.element_at(F.array(*[F.lit(s) for s in open_]), F.floor(_unit("grp", F.lit(turn)) * len(open_)).cast("int") + 1)
        best = split.join(best, "grp", "left").withColumn("to", F.coalesce("to", any_open)).withColumn("there", F.coalesce(F.col("most.held"), F.lit(0)))
        fits = F.col("copies") - F.col("there") <= by_shard(room)
        leaves = (F.col("weight") < F.col("most")) | (~F.col("shard").isin(open_) & fits)
        wanted = held.join(best, "grp").filter((F.col("shard") != F.col("to")) & leaves).select(
            "grp", "shard", "to", F.greatest(F.col("there") - F.col("held"), F.lit(0)).alias("gain"))
        rank = F.floor(PARTS / (1 + F.col("gain").cast("double")) + _unit("grp", F.lit(turn)) * 64).cast("int")
        asked = materialise(linked.join(wanted, ["grp", "shard"]).select("rid", "grp", "to", rank.alias("rank")))
        ranks = asked.groupBy("to", "rank").agg(F.count(F.lit(1)).alias("n"))
        upto = ranks.withColumn("upto", F.sum("n").over(W.partitionBy("to").orderBy("rank"))).withColumn("room", by_shard(room))
        left = F.col("room") - F.col("upto") + F.col("n")
        cut = upto.filter("upto > room").groupBy("to").agg(F.min_by(F.struct("rank", left.alias("left")), "rank").alias("cut"))
        fits = {r["to"]: r["cut"] for r in cut.collect()}  # at most one row per shard
        limit = by_shard([fits[s]["rank"] if s in fits else 2 * PARTS for s in range(shards)])
        rest = by_shard([fits[s]["left"] if s in fits else 0 for s in range(shards)])
        some = _numbered(asked.filter(F.col("rank") == limit), ["to"], _near("grp"), "place").filter(F.col("place") < rest)
        moves = asked.filter(F.col("rank") < limit).select("rid", F.col("to").alias("moved")).unionByName(some.select("rid", F.col("to").alias("moved")))
        if moves.isEmpty():
            break
        linked = materialise(linked.join(moves, "rid", "left").select("rid", "grp", F.coalesce("moved", "shard").alias("shard")))
    return linked


def shard(docs: DataFrame, shards: int = 24, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row: row counts of shards differ by one at most.

    Rows with equal texts are linked. Linked rows start at a hash of the row, propagate under quotas, and rows without
    links fill the shards up. Linked rows over a shard's count go to shards with room, those of a group near each other.
    A group larger than a shard fills several. Moves need room: where linked rows alone fill the shards, some copies
    stay apart.
    ``size`` is the text's UTF-8 bytes plus 8; ``slot`` numbers a shard's rows gapless from 0.

    A null text equals an empty one. Null ids stay null; repeated rows are rows of their own. Other columns are ignored.
    An empty table gives no rows.
    """
    body = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    rows = materialise(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.length(body) + 8).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"), F.md5(body).alias("grp"), F.monotonically_increasing_id().alias("rid")))
    groups = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1").select("grp")
    total = rows.count()
    counts = [total // shards + (s < total % shards) for s in range(shards)]
    linked = materialise(rows.select("rid", "grp").join(groups, "grp").withColumn("shard", F.floor(_unit("rid") * shards).cast("int")))
    linked = propagate(linked, shards, total // shards, rounds)

    inside = {r["shard"]: r["n"] for r in linked.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per shard
    over = [s for s in range(shards) if inside.get(s, 0) > counts[s]]
    stay = linked
    if over:  # quotas hold for moves, not for where rows start
        most = F.element_at(F.array(*[F.lit(c) for c in counts]), F.col("shard") + 1)
        ranked = _numbered(linked.filter(F.col("shard").isin(over)), ["shard"], _near("grp"), "place")
        stay = materialise(linked.filter(~F.col("shard").isin(over)).unionByName(ranked.filter(F.col("place") < most).select(*linked.columns)))
    placed = rows.join(stay.select("rid", "shard"), "rid", "left")
    gaps = [counts[s] - min(inside.get(s, 0), counts[s]) for s in range(shards)]
    ends = _sums(gaps)[1:]
    free = _numbered(placed.filter("shard IS NULL").withColumn("_all", F.lit(0)), ["_all"], _near("grp"), "place")
    fill = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= F.col("place")))
    filled = placed.filter("shard IS NOT NULL").unionByName(free.withColumn("shard", fill.cast("int")).select(*placed.columns))
    return _numbered(materialise(filled), ["shard"], _unit("rid"), "slot").select("doc_id", "size", "text_crc32", "shard", "slot")
