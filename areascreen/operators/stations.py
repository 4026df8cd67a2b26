"""Grouping of exits into complexes: roll-up, medoid, extent, flags and status precedence."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from areascreen.functions import ids, text
from areascreen.operators.skew import first_by, salted_join
from areascreen.session import cut_lineage

#: Sectors of directions that the search for the farthest pair begins with, parts that each is cut into, and where it ends.
_SECTORS, _FINER, _MOST_SECTORS = 16, 8, 16 * 8**7
#: Pairs left for every possible end at which these are compared instead of cut finer.
_PAIRS_PER_END = 256
_GRID = 12


def apply_overrides(exits: DataFrame, overrides: DataFrame) -> DataFrame:
    """Add complex_name: the normalised name, or the override's target for a listed label.

    ``overrides`` has unique ``source_label`` and ``target_label``.
    """
    listed = overrides.select(
        text.normalize_name(F.col("source_label")).alias("_label"), text.normalize_name(F.col("target_label")).alias("_target")
    )
    named = exits.withColumn("_label", text.normalize_name(F.col("station_name")))
    joined = salted_join(named, listed, ["_label"], spread=["exit_id"], how="left")
    return joined.withColumn("complex_name", F.coalesce("_target", "_label")).withColumn(
        "overridden", F.col("_target").isNotNull()
    ).drop("_label", "_target")


def unused_overrides(exits: DataFrame, overrides: DataFrame) -> DataFrame:
    """Overrides whose source label does not occur."""
    labels = exits.select(text.normalize_name(F.col("station_name")).alias("_label")).distinct()
    return overrides.withColumn("_label", text.normalize_name(F.col("source_label"))).join(labels, "_label", "left_anti").drop("_label")


def rollup(exits: DataFrame) -> DataFrame:
    """Count, centroid, extent, spelling and override facts per complex_name."""
    return exits.groupBy("complex_name").agg(
        F.count(F.lit(1)).alias("exit_count"), F.avg("x").alias("centroid_x"), F.avg("y").alias("centroid_y"),
        F.min("x").alias("lo_x"), F.max("x").alias("hi_x"), F.min("y").alias("lo_y"), F.max("y").alias("hi_y"),
        F.countDistinct("station_name").alias("name_variants"),
        F.countDistinct(F.when(~F.col("overridden"), F.col("station_name"))).alias("unexplained_variants"),
        F.coalesce(F.min(F.when(~F.col("overridden"), F.col("station_name"))), F.min("station_name")).alias("display_name"),
        F.bool_or("overridden").alias("overridden"),
    )


def name_variants(exits: DataFrame) -> DataFrame:
    """complex_name, station_name, exits: the spellings of each complex."""
    return exits.groupBy("complex_name", "station_name").agg(F.count(F.lit(1)).alias("exits"))


def repeated_labels(exits: DataFrame) -> DataFrame:
    """complex_name, label, copies for exit labels used more than once in a complex."""
    return exits.groupBy("complex_name", text.normalize_name(F.col("label")).alias("label")).agg(
        F.count(F.lit(1)).alias("copies")
    ).filter("copies > 1")


def _along(sector: Column, sectors: int) -> Column:
    """Position of (x, y) along the middle direction of a sector; ``sectors`` of them cover half a turn."""
    angle = (sector + 0.5) * (math.pi / sectors)
    return F.col("x") * F.cos(angle) + F.col("y") * F.sin(angle)


def _ends(value: Column, hi: Column, lo: Column, reach: Column, sectors: int) -> tuple[Column, Column]:
    """Whether a point can be the upper, or the lower, end of a pair in the sector that is at least ``reach`` apart.

    Such a pair lies within half a sector of the middle direction, so it covers ``reach * cos(half)`` along it.
    """
    need = reach * math.cos(math.pi / 2 / sectors) - 1e-12 * (F.abs(hi) + F.abs(lo) + 1)
    return value >= lo + need, value <= hi - need


def maximum_distance(exits: DataFrame, *, key: str = "complex_name") -> DataFrame:
    """key, maximum_distance between any two members; 0 for a single one.

    Extreme positions along a few directions are a mergeable aggregate. Their largest extent is a distance that some
    pair reaches; only positions that can end a longer pair stay, each in the sectors of directions where it can.
    Sectors are cut finer until few pairs are left, which are then compared exactly. So points on a circle, all of them
    corners of the hull, meet those opposite only, and no task holds a group.

    Rows without key take no part; a group without positions has the distance 0.
    """
    spots = cut_lineage(exits.select(key, "x", "y").filter(F.col(key).isNotNull()).distinct())
    sectors = _SECTORS
    places = [_along(F.lit(k), sectors) for k in range(sectors)]
    extremes = spots.groupBy(key).agg(
        *[F.max(v).alias(f"_hi{k}") for k, v in enumerate(places)], *[F.min(v).alias(f"_lo{k}") for k, v in enumerate(places)]
    ).withColumn("_reach", F.greatest(*[F.col(f"_hi{k}") - F.col(f"_lo{k}") for k in range(sectors)]))
    extremes = cut_lineage(extremes)
    options = []
    for k, v in enumerate(places):
        upper, lower = _ends(v, F.col(f"_hi{k}"), F.col(f"_lo{k}"), F.col("_reach"), sectors)
        options.append(F.struct(F.lit(k).cast("long").alias("sector"), upper.alias("upper"), lower.alias("lower")))
    able = F.explode(F.filter(F.array(*options), lambda o: o["upper"] | o["lower"])).alias("_o")
    rows = salted_join(spots, extremes, [key], spread=["x", "y"]).select(key, "x", "y", "_reach", able)
    rows = cut_lineage(rows.select(key, "x", "y", "_reach", "_o.sector", "_o.upper", "_o.lower"))
    while sectors < _MOST_SECTORS:
        ends = rows.groupBy(key, "sector").agg(F.count_if("upper").cast("double").alias("u"), F.count_if("lower").cast("double").alias("l"))
        pairs, left = ends.agg(F.coalesce(F.sum(F.col("u") * F.col("l")), F.lit(0.0)), F.coalesce(F.sum(F.col("u") + F.col("l")), F.lit(0.0))).first()
        if pairs <= _PAIRS_PER_END * left:
            break
        sectors *= _FINER
        finer = F.explode(F.array(*[F.col("sector") * _FINER + k for k in range(_FINER)])).alias("sector")
        wide = rows.select(key, "x", "y", "upper", "lower", "_reach", finer).withColumn("_value", _along(F.col("sector"), sectors))
        bounds = wide.groupBy(key, "sector").agg(
            F.max(F.when(F.col("upper"), F.col("_value"))).alias("_hi"), F.min(F.when(F.col("lower"), F.col("_value"))).alias("_lo"), F.max("_reach").alias("_old")
        ).filter("_hi IS NOT NULL AND _lo IS NOT NULL")
        bounds = cut_lineage(bounds)
        reach = bounds.groupBy(key).agg(F.max(F.greatest(F.col("_hi") - F.col("_lo"), F.col("_old"))).alias("_reach"))
        bounds = salted_join(bounds.drop("_old"), reach, [key], spread=["sector"])
        upper, lower = _ends(F.col("_value"), F.col("_hi"), F.col("_lo"), F.col("_reach"), sectors)
        rows = salted_join(wide.drop("_reach"), bounds, [key, "sector"], spread=["x", "y"]).select(
            key, "x", "y", "_reach", "sector", (F.col("upper") & upper).alias("upper"), (F.col("lower") & lower).alias("lower"))
        rows = cut_lineage(rows.filter("upper OR lower"))
    uppers = rows.filter("upper").select(key, "sector", F.col("x").alias("_ux"), F.col("y").alias("_uy"))
    lowers = rows.filter("lower").select(key, "sector", F.col("x").alias("_wx"), F.col("y").alias("_wy"))
    gap = (F.col("_ux") - F.col("_wx")) ** 2 + (F.col("_uy") - F.col("_wy")) ** 2
    farthest = salted_join(uppers, lowers, [key, "sector"], spread=["_ux", "_uy"]).groupBy(key).agg(F.max(gap).alias("_far"))
    return extremes.select(key).join(farthest, key, "left").select(
        key, F.coalesce(F.sqrt("_far"), F.lit(0.0)).alias("maximum_distance"))


def medoid(exits: DataFrame, *, key: str = "complex_name", member: str = "exit_id") -> DataFrame:
    """key, member, total_distance: the member with the least total distance to the others.

    Ties go to the least id. The group is summarised by at most ``_GRID**2`` cells (count,
    centre of mass, spread). The sum over a cell is at least its count times the distance to
    its centre of mass, and at most that plus its spread, so most members are ruled out
    without meeting the rest; only the remaining ones are summed exactly.
    """
    box = exits.groupBy(key).agg(
        F.min("x").alias("_lx"), F.max("x").alias("_hx"), F.min("y").alias("_ly"), F.max("y").alias("_hy")
    )
    def slot(value: str, low: str, high: str) -> Column:
        width = F.greatest(F.col(high) - F.col(low), F.lit(1e-9))
        return F.least(F.lit(_GRID - 1), F.floor((F.col(value) - F.col(low)) / width * _GRID)).cast("int")

    placed = salted_join(exits.select(key, member, "x", "y"), box, [key], spread=[member]).select(
        key, member, "x", "y", slot("x", "_lx", "_hx").alias("_cx"), slot("y", "_ly", "_hy").alias("_cy")
    )
    cells = placed.groupBy(key, "_cx", "_cy").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"),
        F.min("x").alias("lx"), F.max("x").alias("hx"), F.min("y").alias("ly"), F.max("y").alias("hy"),
    )
    spread = F.col("n") * F.sqrt((F.col("hx") - F.col("lx")) ** 2 + (F.col("hy") - F.col("ly")) ** 2)
    summary = cells.groupBy(key).agg(  # at most _GRID ** 2 cells per group
        F.collect_list(F.struct("n", "mx", "my")).alias("cells"), F.sum(spread).alias("slack")
    )
    least = F.aggregate(
        "cells", F.lit(0.0),
        lambda total, c: total + c["n"] * F.sqrt((F.col("x") - c["mx"]) ** 2 + (F.col("y") - c["my"]) ** 2),
    )
    bounded = salted_join(exits.select(key, member, "x", "y"), summary, [key], spread=[member]).select(
        key, member, "x", "y", "slack", least.alias("least")
    )
    best = bounded.groupBy(key).agg(F.min(F.col("least") + F.col("slack")).alias("_best"))
    kept = salted_join(bounded, best, [key], spread=[member]).filter(
        F.col("least") <= F.col("_best") * (1 + 1e-9) + 1e-9
    ).select(key, member, "x", "y")
    # Positions meet candidate positions; copies of a position are counted, not repeated.
    spots = exits.groupBy(key, "x", "y").agg(F.count(F.lit(1)).alias("n"))
    trial = cut_lineage(kept).select(key, F.col("x").alias("tx"), F.col("y").alias("ty")).distinct()
    gap = F.sqrt((F.col("x") - F.col("tx")) ** 2 + (F.col("y") - F.col("ty")) ** 2)
    totals = salted_join(spots, trial, [key], spread=["x", "y"]).groupBy(key, "tx", "ty").agg(
        F.sum(F.col("n") * gap).alias("total_distance")
    )
    scored = kept.withColumnRenamed("x", "tx").withColumnRenamed("y", "ty").join(totals, [key, "tx", "ty"])
    # Sums differ in the last bits by order of addition; ties are decided on micrometres.
    ranked = scored.withColumn("_total", F.round("total_distance", 6))
    return first_by(ranked.select(key, "_total", member), [key], ["_total", member]).select(
        key, member, F.col("_total").alias("total_distance")
    )


def complexes(exits: DataFrame, *, dispersed_metres: float, implausible_metres: float) -> DataFrame:
    """One row per complex with extent, medoid, rail mode and review flags."""
    facts = rollup(exits)
    labels = repeated_labels(exits).groupBy("complex_name").agg(F.count(F.lit(1)).alias("repeated_labels"))
    joined = (
        facts.join(maximum_distance(exits), "complex_name")
        .join(medoid(exits).select("complex_name", F.col("exit_id").alias("representative_exit_id")), "complex_name")
        .join(labels, "complex_name", "left").na.fill(0, ["repeated_labels"])
        .withColumn("rail_mode", text.rail_mode(F.col("complex_name")))
        .withColumn("complex_id", ids.station_complex_id("complex_name"))
    )
    flags = {
        "unusually_dispersed": F.col("maximum_distance") > dispersed_metres,
        "implausible_extent": F.col("maximum_distance") > implausible_metres,
        "repeated_exit_labels": F.col("repeated_labels") > 0,
        "normalized_name_collision": F.col("unexplained_variants") > 1,
        "ambiguous_station_name": F.col("rail_mode").isin("mrt_code_only_unverified", "unknown"),
    }
    from areascreen.functions.documents import flag_array

    return joined.withColumn("flags", flag_array(flags))


def review_items(stations: DataFrame, dispositions: DataFrame) -> DataFrame:
    """One review item per complex and flag, closed where a disposition says so."""
    items = stations.select("complex_id", "complex_name", F.explode("flags").alias("issue_category"))
    joined = items.join(
        dispositions.select("complex_name", "issue_category", F.col("status").alias("_status")), ["complex_name", "issue_category"], "left"
    )
    return joined.select(
        ids.station_review_id("complex_id", "issue_category").alias("review_item_id"), "complex_id", "complex_name",
        "issue_category", F.coalesce("_status", F.lit("open")).alias("status"),
    )


def operational_status(stations: DataFrame, exceptions: DataFrame, roster: DataFrame, overrides: DataFrame) -> DataFrame:
    """Add operational_status and its basis: override, exception, roster, else unresolved.

    ``overrides`` and ``exceptions`` have complex_name and status; ``roster`` has base_name. The
    roster counts only for complexes of a known rail mode.
    """
    named = stations.withColumn("base_name", text.station_base_name(F.col("complex_name")))
    joined = (
        named.join(overrides.select("complex_name", F.col("status").alias("_override")), "complex_name", "left")
        .join(exceptions.select("complex_name", F.col("status").alias("_exception")), "complex_name", "left")
        .join(roster.select("base_name", F.lit(True).alias("_listed")).distinct(), "base_name", "left")
    )
    listed = F.coalesce("_listed", F.lit(False)) & F.col("rail_mode").isin("mrt", "lrt")
    return joined.withColumns({
        "operational_status": F.coalesce("_override", "_exception", F.when(listed, "verified_operational"), F.lit("unresolved")),
        "basis": F.when(F.col("_override").isNotNull(), "override").when(F.col("_exception").isNotNull(), "exception")
        .when(listed, "roster").otherwise("none"),
    }).drop("_override", "_exception", "_listed")


def corroboration(stations: DataFrame, register: DataFrame) -> DataFrame:
    """Rows and distinct codes and lines of an older register per base name; null when unmatched."""
    per_name = register.groupBy("base_name").agg(
        F.count(F.lit(1)).alias("register_rows"), F.countDistinct(F.nullif("code", F.lit(""))).alias("codes"),
        F.countDistinct(F.nullif("line", F.lit(""))).alias("lines"),
        F.min(F.nullif("code", F.lit(""))).alias("first_code"),
    )
    named = stations.withColumn("base_name", text.station_base_name(F.col("complex_name")))
    joined = named.join(per_name, "base_name", "left")
    return joined.withColumn(
        "corroboration_status", F.when(F.col("register_rows").isNotNull(), "exact_base_name_match").otherwise("unmatched_older_source")
    )


def register_values(stations: DataFrame, register: DataFrame, columns: Sequence[str]) -> DataFrame:
    """complex_name, field, value, rows: every distinct non-empty value of an older register for each complex.

    Values are rows, so a name with very many of them is no longer list; order them by field and value where needed.
    """
    listed = F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns]))
    values = register.select("base_name", listed).filter("value IS NOT NULL AND value != ''")
    counted = values.groupBy("base_name", "field", "value").agg(F.count(F.lit(1)).alias("rows"))
    named = stations.select("complex_name", text.station_base_name(F.col("complex_name")).alias("base_name")).distinct()
    return named.join(counted, "base_name").select("complex_name", "field", "value", "rows")


def candidate_nodes(stations: DataFrame) -> DataFrame:
    """Complexes that may become nodes: heavy rail or code-only, not known to be closed."""
    rail = F.col("rail_mode").isin("mrt", "mrt_code_only_unverified")
    closed = F.coalesce(
        F.col("operational_status").isin("verified_opening_within_decision_horizon", "not_operational"), F.lit(False)
    )
    return stations.filter(rail & ~closed)
