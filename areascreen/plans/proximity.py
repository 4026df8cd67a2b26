"""Proximity baseline of each node and coverage of a second point signal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from areascreen.functions.documents import flag_array
from areascreen.operators.geometry import grid, nearest, polygons, reach
from areascreen.operators.ranking import descending_rank, group_size, is_bounded, ordinal_percentile, quartile_from_percentile
from areascreen.session import cut_lineage


def proximity_baseline(
    nodes: DataFrame, exits: DataFrame, zones: DataFrame, points: dict[str, DataFrame], regions: DataFrame,
    *, radii: Sequence[int] = (800, 1200), cell_size: float = 2000.0,
) -> DataFrame:
    """One row per node: population and points near its exits, anchor region, rank and quartile."""
    # Node-level tables are small next to their inputs and are read more than once: written.
    people = cut_lineage(reach.within_reach(exits, zones, radii, key="node_id"))
    result = nodes
    for r in radii:
        here = people.filter(F.col("radius") == r).select("node_id", F.round("population", 3).alias(f"population_{r}m"), F.col("reached").alias(f"zone_count_{r}m"))
        result = result.join(here, "node_id", "left")
    result = result.na.fill(0, [f"population_{r}m" for r in radii] + [f"zone_count_{r}m" for r in radii])
    for name, located in points.items():
        counts = grid.counts_within(exits, located, [float(r) for r in radii], key="node_id", prefix=name)
        result = result.join(counts, "node_id", "left").na.fill(0, [f"{name}_{r}m" for r in radii])
    result = cut_lineage(result)
    names = regions.select("geo_id", F.col("name").alias("anchor_area"), F.col("region").alias("anchor_region")).distinct()
    result = polygons.assign_polygon(
        result, regions, names, policy="unique", cell_size=cell_size, attributes=["anchor_area", "anchor_region"]
    )
    first = radii[0]
    flags = flag_array({
        "anchor_without_region": F.col("anchor_region").isNull(),
        "no_population_nearby": F.col(f"population_{first}m") == 0,
    })
    result = result.withColumn("quality_flags", F.to_json(flags)).drop("match_count")
    return add_demand_ranks(cut_lineage(result), f"population_{first}m")


def add_demand_ranks(nodes: DataFrame, value: str) -> DataFrame:
    """Rank by value (ties by id), percentile (0 for a single node) and quartile."""
    bounded = is_bounded(nodes)
    ranked = group_size(descending_rank(nodes, value, "node_id", bounded=bounded), name="_size", bounded=bounded)
    percentile = ordinal_percentile(F.col("rank"), F.col("_size"), single=0.0)
    return ranked.withColumn("percentile", percentile).withColumn(
        "quartile", quartile_from_percentile(F.col("percentile"))
    ).drop("_size")


def proximity_checks(result: DataFrame, *, radii: Sequence[int], expected_nodes: int, national_population: float) -> DataFrame:
    """check_id, violations: publication gates of the baseline, in one aggregate."""
    low, high = (f"population_{r}m" for r in radii)
    tests = {
        "row_count": F.abs(F.count(F.lit(1)) - expected_nodes),
        "duplicate_nodes": F.count(F.lit(1)) - F.countDistinct("node_id"),
        "negative_population": F.count_if((F.col(low) < 0) | (F.col(high) < 0)),
        "above_national": F.count_if(F.col(high) > national_population + 1e-6),
        "not_monotone": F.count_if(F.col(high) < F.col(low)),
    }
    row = result.agg(*[test.alias(name) for name, test in tests.items()])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("check_id"), F.col(name).alias("violations")) for name in tests
    ])))


def signal_coverage(
    nodes: DataFrame, exits: DataFrame, points: DataFrame, regions: DataFrame, *, radii: Sequence[int],
    cell_size: float, leaf: float,
) -> DataFrame:
    """Per node and buffer: points within the exit union, nearest distance and anchor region."""
    counts = grid.counts_within(exits, points, [float(r) for r in radii], key="node_id", prefix="count")
    distance = nearest.nearest_point(exits, points, key="node_id", leaf=leaf)
    names = regions.select("geo_id", F.col("region").alias("anchor_region")).distinct()
    placed = polygons.assign_polygon(
        nodes.select("node_id", "x", "y"), regions, names, policy="least", cell_size=cell_size, attributes=["anchor_region"]
    )
    wide = placed.join(counts, "node_id").join(distance, "node_id")
    rows = F.inline(F.array(*[
        F.struct(F.lit(r).alias("buffer_metres"), F.col(f"count_{r}m").alias("point_count")) for r in radii
    ]))
    return wide.select("node_id", "anchor_region", F.bround("distance", 3).alias("nearest_distance"), rows).withColumn(
        "positive_signal", F.col("point_count") > 0
    )


def regional_coverage(coverage: DataFrame, primary: int) -> DataFrame:
    """Per region: nodes, positive nodes and coverage rate at the primary buffer."""
    rows = coverage.filter((F.col("buffer_metres") == primary) & F.col("anchor_region").isNotNull())
    return rows.groupBy("anchor_region").agg(
        F.count(F.lit(1)).alias("node_count"), F.count_if("positive_signal").alias("positive_count"),
        (F.count_if("positive_signal") / F.count(F.lit(1))).alias("coverage_rate"),
    )
