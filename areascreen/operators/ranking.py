"""Exact ranks, percentiles, bands and medians over groups of any size.

A ``row_number`` window puts a whole group into one task. That is used only after a check
that the largest group is small. Beyond it, ``row_index`` gives the same numbers from one
range-partitioned sort: rows are numbered inside each sorted partition and the partition
offsets (one row per partition) are added.

``bounded`` of the functions below is the outcome of :func:`is_bounded`; left out, it is
checked. Callers that rank the same groups several times check once.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from areascreen.operators.skew import null_safe_join
from areascreen.session import cut_lineage

#: Largest group that one task may sort.
WINDOW_ROWS = 500_000

_ROW_BITS = 33  # layout of monotonically_increasing_id(): partition id above, row number below


def is_bounded(df: DataFrame, by: Sequence[str] = ()) -> bool:
    """Whether every group has at most ``WINDOW_ROWS`` rows: one count, read as one number."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    largest = counts.agg(F.max("n").alias("n")).first()["n"] or 0
    return largest <= WINDOW_ROWS


def group_size(df: DataFrame, by: Sequence[str] = (), name: str = "group_size", *, bounded: bool = False) -> DataFrame:
    """Add the number of rows of each row's group."""
    if bounded:
        return df.withColumn(name, F.count(F.lit(1)).over(Window.partitionBy(*by)))
    if by:
        return null_safe_join(df, df.groupBy(*by).agg(F.count(F.lit(1)).alias(name)), by)
    return df.withColumn(name, df.agg(F.count(F.lit(1)).alias(name)).scalar())


def row_index(
    df: DataFrame, order: Sequence[Column], *, by: Sequence[str] = (), name: str = "rank", bounded: bool | None = None
) -> DataFrame:
    """Add ``row_number() over (partition by by order by order)``; ``order`` must be total."""
    if is_bounded(df, by) if bounded is None else bounded:
        position = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        return df.withColumn(name, position.cast("bigint"))
    ordered = df.orderBy(*[F.col(c) for c in by], *order)
    numbered = cut_lineage(ordered.withColumn("_pos", F.monotonically_increasing_id()))
    numbered = numbered.withColumn("_part", F.shiftright("_pos", _ROW_BITS))
    sizes = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    # One row per sorted partition, so bounded by spark.sql.shuffle.partitions.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    within = F.col("_pos").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    indexed = numbered.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + within + 1)
    if by:
        starts = indexed.groupBy(*by).agg(F.min(name).alias("_start"))
        indexed = null_safe_join(indexed, starts, by).withColumn(name, F.col(name) - F.col("_start") + 1)
    return indexed.select(*df.columns, F.col(name).cast("bigint").alias(name))


def descending_rank(
    df: DataFrame, value: str, key: str, *, by: Sequence[str] = (), name: str = "rank", bounded: bool | None = None
) -> DataFrame:
    """Rank by value descending, key ascending: 1..n without ties."""
    return row_index(df, [F.col(value).desc(), F.col(key).asc()], by=by, name=name, bounded=bounded)


def ordinal_percentile(rank: Column, size: Column, *, single: float) -> Column:
    """``(n - rank) / (n - 1)``; a group of one gets ``single`` (0.0 or 1.0, by use)."""
    return F.when(size == 1, F.lit(single)).otherwise((size - rank) / (size - F.lit(1)))


def quartile_from_percentile(percentile: Column) -> Column:
    """4 from .75 up, 3 from .50, 2 from .25, else 1."""
    return (
        F.when(percentile >= 0.75, 4).when(percentile >= 0.50, 3).when(percentile >= 0.25, 2).otherwise(1)
    ).cast("bigint")


def band(rank: Column, size: Column, labels: Sequence[str]) -> Column:
    """Ordinal bands, first label on top: ``min(k - 1, (rank - 1) * k // n)``."""
    k = len(labels)
    position = F.least(F.lit(k - 1), F.floor((rank - 1) * F.lit(k) / size))
    return F.element_at(F.array(*[F.lit(label) for label in labels]), (position + 1).cast("int"))


def rank_quartile(rank: Column, size: Column) -> Column:
    """Quartile of an ascending rank: ``min((rank - 1) // (n / 4) + 1, 4)``."""
    return F.least(F.floor((rank - 1) / (size / F.lit(4.0))) + 1, F.lit(4)).cast("bigint")


def _is_close(a: float, b: float, tolerance: float) -> bool:
    return a == b or abs(a - b) <= tolerance * max(abs(a), abs(b))


def _run_firsts(values: Sequence[float], tolerance: float, first: float | None) -> list[float]:
    """First value of the run of each of the descending values; ``first`` is the run that is open before them."""
    found = []
    for value in values:
        if first is None or not _is_close(value, first, tolerance):
            first = value
        found.append(first)
    return found


def close_runs(df: DataFrame, value: str, *, by: Sequence[str] = (), tolerance: float = 1e-9, bounded: bool | None = None, name: str = "run_first") -> DataFrame:
    """by, value, name: every distinct non-null value of a group and the first value of its run.

    Runs go from the largest value down; a value stays in the run while it is within ``tolerance`` (relative to the larger
    of both) of the run's first. Where a run ends thus depends on where it began. Groups too large for one task are
    sorted by ranges: a partition in which two neighbours are not close knows its last run whatever came before; only
    where partitions lie within one chain of close neighbours does the open run pass on, from one to the next.
    """
    values = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias(value)).distinct()
    schema = values.select(*by, value, F.col(value).alias(name)).schema
    if is_bounded(values, by) if bounded is None else bounded:
        def runs(table: pa.Table) -> pa.Table:
            table = table.sort_by([(value, "descending")])
            return table.append_column(name, pa.array(_run_firsts(table.column(value).to_pylist(), tolerance, None), pa.float64()))

        return values.groupBy(*by).applyInArrow(runs, schema)

    order = [*[F.col(c) for c in by], F.col(value).desc()]
    placed = cut_lineage(values.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    key = F.struct(F.lit(0).alias("_"), *by)
    ends = placed.groupBy("_part").agg(
        F.min_by(key, F.struct(*by, -F.col(value))).alias("low_key"), F.max_by(key, F.struct(*by, -F.col(value))).alias("high_key"),
        F.min(F.struct(*by, (-F.col(value)).alias("_v")))["_v"].alias("low"), F.max(F.struct(*by, (-F.col(value)).alias("_v")))["_v"].alias("high"))
    borders = sorted(ends.collect(), key=lambda r: r["_part"])  # one row a partition
    inherits = {b["_part"]: a["_part"] for a, b in zip(borders, borders[1:]) if a["high_key"] == b["low_key"] and _is_close(-a["high"], -b["low"], tolerance)}

    def marked(opened: dict[int, float | None], exits: bool):
        def compute(table: pa.Table) -> pa.Table:
            table = table.take(pc.sort_indices(table, [*[(c, "ascending") for c in by], (value, "descending")], null_placement="at_start"))
            part = table.column("_part")[0].as_py()
            keys = list(zip(*[table.column(c).to_pylist() for c in by])) if by else [()] * table.num_rows
            held, found, before, settled, last = table.column(value).to_pylist(), [], opened.get(part), False, None
            for k, own in enumerate(held):
                if k and (keys[k] != keys[k - 1] or not _is_close(own, held[k - 1], tolerance)):
                    before, settled = None, True
                before = _run_firsts([own], tolerance, before)[0]
                found.append(before)
            if exits:
                return pa.table({"_part": pa.array([part], pa.int32()), "settled": [settled], "first": pa.array([before], pa.float64())})
            return table.drop_columns("_part").append_column(name, pa.array(found, pa.float64()))

        return compute

    opened: dict[int, float | None] = {}
    heirs = set(inherits.values())
    pending = sorted(heirs)
    while pending:
        told = placed.filter(F.col("_part").isin(pending)).groupBy("_part").applyInArrow(marked(opened, True), "_part int, settled boolean, first double")
        known = {r["_part"]: r["first"] for r in told.collect() if r["settled"] or r["_part"] not in inherits or r["_part"] in opened}
        opened |= {b: known[a] for b, a in inherits.items() if a in known}
        pending = sorted(p for p in pending if p not in known)
    return placed.groupBy("_part").applyInArrow(marked(opened, False), schema)


def average_rank(
    df: DataFrame, value: str, key: str, *, by: Sequence[str] = (), descending: bool = True,
    name: str = "average_rank", bounded: bool | None = None, tolerance: float | None = None,
) -> DataFrame:
    """Rank in which rows of equal value share the mean of their positions.

    With ``tolerance`` (descending only) rows of one run of nearly equal values (``close_runs``) share it.
    """
    direction = F.col(value).desc() if descending else F.col(value).asc()
    bounded = is_bounded(df, by) if bounded is None else bounded
    if tolerance is not None:
        if not descending:
            raise ValueError("runs of nearly equal values are formed from the largest value down")
        runs = close_runs(df, value, by=by, tolerance=tolerance, bounded=bounded, name="_first").withColumnRenamed(value, "_value")
        firsts = null_safe_join(df.withColumn("_value", F.col(value).cast("double")), runs, [*by, "_value"], "left")
        return average_rank(firsts, "_first", key, by=by, name=name, bounded=bounded).select(*df.columns, name)
    if bounded:
        first = F.rank().over(Window.partitionBy(*by).orderBy(direction))
        ties = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
        return df.withColumn(name, first + (ties - 1) / 2)
    indexed = row_index(df, [direction, F.col(key).asc()], by=by, name="_index", bounded=False)
    ties = indexed.groupBy(*by, value).agg(((F.min("_index") + F.max("_index")) / 2).alias(name))
    return null_safe_join(indexed, ties, [*by, value]).select(*df.columns, name)


def average_percentile(
    df: DataFrame, value: str, key: str, *, by: Sequence[str] = (), higher_is_better: bool = True,
    name: str = "percentile", bounded: bool | None = None,
) -> DataFrame:
    """``1 - (average rank - 1) / max(n - 1, 1)``, best value first."""
    bounded = is_bounded(df, by) if bounded is None else bounded
    ranked = average_rank(df, value, key, by=by, descending=higher_is_better, name="_average", bounded=bounded)
    sized = group_size(ranked, by, "_size", bounded=bounded)
    share = 1 - (F.col("_average") - 1) / F.greatest(F.col("_size") - 1, F.lit(1))
    return sized.withColumn(name, share).select(*df.columns, name)


def exact_median(
    df: DataFrame, value: str, key: str, *, by: Sequence[str] = (), name: str = "median", bounded: bool | None = None
) -> DataFrame:
    """Interpolated median of the non-null values of each group, as a double."""
    known = df.filter(F.col(value).isNotNull()).select(*by, key, F.col(value).cast("double").alias(value))
    if bounded:
        return known.groupBy(*by).agg(F.median(value).alias(name))
    if bounded is None:
        # Equal values are counted before anything is sorted; few distinct values are a small table whatever the rows.
        counted = cut_lineage(known.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n")))
        if is_bounded(counted, by):
            upto = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
            placed = counted.withColumns({"_upto": F.sum("_n").over(upto), "_size": F.sum("_n").over(Window.partitionBy(*by))})
            low, high = F.floor((F.col("_size") + 1) / 2), F.floor((F.col("_size") + 2) / 2)
            middle = placed.groupBy(*by).agg(F.min(F.when(F.col("_upto") >= low, F.col(value))).alias("_a"), F.min(F.when(F.col("_upto") >= high, F.col(value))).alias("_b"))
            return middle.select(*by, ((F.col("_a") + F.col("_b")) / 2).alias(name))
    indexed = group_size(row_index(known, [F.col(value), F.col(key)], by=by, name="_index", bounded=False), by, "_size")
    middle = F.col("_index").isin(
        F.floor((F.col("_size") + 1) / 2), F.floor((F.col("_size") + 2) / 2)
    )
    return indexed.filter(middle).groupBy(*by).agg(F.avg(value).alias(name))
