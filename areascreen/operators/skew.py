"""Joins and groupings that survive one key holding a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

#: A key is hot when it holds more than this share of the rows, so there are at
#: most ``1 / HOT_SHARE`` hot keys whatever the size of the data: the table of hot
#: keys is safe to broadcast.
HOT_SHARE = 1 / 512

#: A key with fewer rows than this is no burden to one task.
HOT_ROWS = 50_000

#: Rows of a task where the number of partitions follows the size of the data.
TASK_ROWS = 1_000_000


def fan_out(df: DataFrame, keys: Sequence[str], rows: int = 0) -> DataFrame:
    """Hash the rows over all shuffle partitions ahead of a step that multiplies them.

    Adaptive coalescing looks at the size of the input and would leave such a step to a few
    tasks; an explicit number of partitions is kept. A join on the same keys reuses it. ``rows`` of the step, where
    known, give a large one more partitions (``TASK_ROWS``).
    """
    return sized(df, keys, rows)


def sized(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """Hash the rows by ``keys`` into partitions of about ``TASK_ROWS`` rows, so that a sort or an aggregate by the keys
    holds a bounded share of the data in a task, however large the data. ``rows`` is the number of rows, or more."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(partitions, -(-rows // TASK_ROWS)), *keys)


def hot_keys(df: DataFrame, keys: Sequence[str], share: float = HOT_SHARE) -> DataFrame:
    """Keys holding more than ``share`` of all rows, with the number of salts each needs."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_t")).scalar()
    limit = F.greatest(F.ceil(total * F.lit(share)), F.lit(HOT_ROWS))
    return counts.filter(F.col("_n") > limit).select(
        *keys, F.ceil(F.col("_n") / limit).cast("int").alias("_salts")
    )


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which nulls are equal; a key column comes once, from ``left``."""
    renamed = right.select(*[F.col(k).alias(f"_right_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    return left.join(renamed, condition, how).drop(*[f"_right_{k}" for k in keys])


def _piece(columns: Sequence[str], pieces: Column) -> Column:
    return F.pmod(F.xxhash64(*columns), pieces).cast("int")


def _pieces(pieces: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), pieces - 1))


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    *,
    spread: Sequence[str],
    how: str = "inner",
    condition: Column | None = None,
    share: float = HOT_SHARE,
    multiplies: bool = False,
    found: DataFrame | None = None,
    rows: int = 0,
) -> DataFrame:
    """Equi-join in which every hot key of ``left`` is split over several tasks.

    ``spread`` names columns of ``left`` whose hash decides the piece a row goes to.
    Only the rows of ``right`` that carry a hot key are copied, once per piece, so
    the result is that of a plain join. Without hot keys it is a plain join. ``multiplies``
    says that a row meets many rows, so that all tasks should share the join. Then ``right`` is shuffled ahead of the
    join too: rows exploded from a small table count as small until they are written, and would be broadcast.

    A key that is hot in ``right`` as well is split in both directions: its rows form a grid of pieces,
    those of either side copied along the other's pieces only. An outer join keeps ``right`` whole, since
    a copied row of ``left`` would meet nothing in some pieces. ``found`` are the hot keys of ``left`` as
    :func:`hot_keys` gives them, where the caller knows them; then ``left`` is not counted here. ``rows`` is how many
    rows the join has, where known: its partitions follow them if it ``multiplies``.
    """
    found = hot_keys(left, keys, share) if found is None else found
    heavy = found.collect()  # at most 1 / share rows
    if not heavy:
        if multiplies:
            left, right = fan_out(left, keys, rows), fan_out(right, keys, rows)
        joined = left.join(right, list(keys), how)
        return joined if condition is None else joined.filter(condition)
    spark = left.sparkSession
    hot = F.broadcast(spark.createDataFrame(heavy, found.schema))
    across = [c for c in right.columns if c not in keys and not _unhashable(right.schema[c].dataType)]
    both = []
    if how == "inner" and across:
        limit = max(HOT_ROWS, 1)
        counts = right.join(hot.select(*keys), list(keys), "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        both = counts.filter(F.col("_n") > limit).select(  # at most 1 / share rows
            *keys, F.least(F.ceil(F.col("_n") / limit), F.lit(int(1 / share))).cast("int").alias("_sides")).collect()
    big = left.join(hot, list(keys), "left").withColumn("_salt", _piece(spread, F.coalesce("_salts", F.lit(1)))).drop("_salts")
    small = right.join(hot, list(keys), "left").withColumn("_salt", _pieces(F.coalesce("_salts", F.lit(1)))).drop("_salts")
    grid = [*keys, "_salt"]
    if both:
        fields = ", ".join(f"`{k}` {right.schema[k].dataType.simpleString()}" for k in keys)
        wide = F.broadcast(spark.createDataFrame(both, f"{fields}, _sides int"))
        sides = F.coalesce("_sides", F.lit(1))
        big = big.join(wide, list(keys), "left").withColumn("_side", _pieces(sides)).drop("_sides")
        small = small.join(wide, list(keys), "left").withColumn("_side", _piece(across, sides)).drop("_sides")
        grid.append("_side")
    if multiplies:
        big, small = fan_out(big, grid, rows), fan_out(small, grid, rows)
    joined = big.join(small, grid, how)
    if condition is not None:
        joined = joined.filter(condition)
    return joined.drop("_salt", "_side")


def _unhashable(kind: T.DataType) -> bool:
    return "map<" in kind.simpleString() or "variant" in kind.simpleString()


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], *, count: str | None = None) -> DataFrame:
    """One row per key, the least by ``order``; a partial aggregate, never a sorted group.

    ``order`` must be a total order within a key.
    """
    rest = [c for c in df.columns if c not in keys]
    ordered = [*order, *[c for c in rest if c not in order]]
    aggregates = [F.min(F.struct(*ordered)).alias("_first")]
    if count:
        aggregates.append(F.count(F.lit(1)).alias(count))
    picked = df.groupBy(*keys).agg(*aggregates)
    return picked.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest], *([count] if count else []))
