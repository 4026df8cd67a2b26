"""Walking catchments: shared requests per building, best route and membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from areascreen.functions import ids
from areascreen.functions.documents import flag_array
from areascreen.functions.numbers import coordinate_key
from areascreen.operators.geometry.grid import distances_within
from areascreen.operators.skew import salted_join
from areascreen.session import cut_lineage

#: Fixed vocabulary of outcome categories.
CATEGORIES = [
    "authorization_error", "http_error", "invalid_response", "missing_route", "network_error", "rate_limited", "success",
]


def walk_requests(branches: DataFrame, exits: DataFrame, members: DataFrame, *, reach_metres: float) -> DataFrame:
    """One request per building coordinate and exit of a mapped station within reach.

    Branches of one building share its requests. A reach beyond the extent of the data gives
    the complete table.
    """
    buildings = branches.filter("x IS NOT NULL AND y IS NOT NULL").select("x", "y").distinct()
    mapped = salted_join(
        exits, members.select("complex_id", "node_id").distinct(), ["complex_id"], spread=["exit_id"]
    ).withColumn("_exit", F.struct("node_id", "complex_id", "exit_id"))
    near = distances_within(mapped.select("_exit", "x", "y"), buildings, reach_metres, key="_exit")
    keyed = near.withColumn("coordinate_key", coordinate_key(F.col("x"), F.col("y"))).select(
        "_exit.*", "coordinate_key", "x", "y", "distance"
    )
    return keyed.withColumn("od_plan_id", ids.walk_request_id("node_id", "exit_id", "coordinate_key"))


def best_routes(outcomes: DataFrame) -> DataFrame:
    """Per node and building: fastest successful exit, its distance, attempts and categories.

    Unresolved stays null: membership is unknown, not false.
    """
    success = F.col("category") == "success"
    best = F.min(F.when(success, F.struct("duration_seconds", "exit_id", "distance_metres")))
    grouped = outcomes.groupBy("node_id", "coordinate_key").agg(
        best.alias("_best"), F.count(F.lit(1)).alias("attempted_exit_count"),
        *[F.bool_or(F.col("category") == c).alias(f"_{c}") for c in CATEGORIES],
    )
    duration = F.col("_best.duration_seconds")
    return grouped.select(
        "node_id", "coordinate_key", "attempted_exit_count",
        F.when(F.col("_best").isNotNull(), "resolved").otherwise("unresolved").alias("route_status"),
        duration.alias("minimum_walk_seconds"), F.col("_best.exit_id").alias("best_exit_id"),
        F.col("_best.distance_metres").alias("walk_distance_metres"),
        (duration <= 600).alias("inside_10_minute_walk"), (duration <= 900).alias("inside_15_minute_walk"),
        flag_array({c: F.col(f"_{c}") for c in CATEGORIES}).alias("observed_route_categories"),
    )


def memberships(branches: DataFrame, routes: DataFrame) -> DataFrame:
    """Routes of each building given to every branch in it."""
    return salted_join(_keyed(branches), routes, ["coordinate_key"], spread=["branch_id"], multiplies=True)


def _keyed(branches: DataFrame) -> DataFrame:
    return branches.select("branch_id", coordinate_key(F.col("x"), F.col("y")).alias("coordinate_key"))


def branch_counts(members: DataFrame) -> DataFrame:
    """Distinct branches inside the 10 and 15 minute walk per node."""
    inside = lambda c: F.countDistinct(F.when(F.col(c), F.col("branch_id")))
    return members.groupBy("node_id").agg(
        inside("inside_10_minute_walk").alias("confirmed_10"), inside("inside_15_minute_walk").alias("confirmed_15"),
        F.count_if(F.col("route_status") == "resolved").alias("resolved_routes"), F.count(F.lit(1)).alias("evaluated"),
    )


def building_counts(branches: DataFrame, routes: DataFrame) -> DataFrame:
    """:func:`branch_counts` of the memberships, counted by building where every branch stands in one building.

    Branches of a building share its routes, so they are counted before the join instead of joined one by one.
    """
    keyed = cut_lineage(_keyed(branches))
    if not keyed.groupBy("branch_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").isEmpty():
        return branch_counts(memberships(branches, routes))
    sized = keyed.groupBy("coordinate_key").agg(F.count(F.lit(1)).alias("_rows"), F.count("branch_id").alias("_n"))
    found = salted_join(routes, sized, ["coordinate_key"], spread=["node_id"])

    def total(test: Column, count: str) -> Column:
        return F.coalesce(F.sum(F.when(test, F.col(count))), F.lit(0))

    return found.groupBy("node_id").agg(
        total(F.col("inside_10_minute_walk"), "_n").alias("confirmed_10"), total(F.col("inside_15_minute_walk"), "_n").alias("confirmed_15"),
        total(F.col("route_status") == "resolved", "_rows").alias("resolved_routes"), F.sum("_rows").alias("evaluated"),
    )
