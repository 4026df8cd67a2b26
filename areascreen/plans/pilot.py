"""Pilot areas: per region the largest, and the one closest to the region's median."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from areascreen.operators.ranking import exact_median, group_size, rank_quartile, row_index


def pilot_areas(areas: DataFrame, *, mandated: str) -> DataFrame:
    """area, region, population, national_quartile, reason.

    In the region of the mandated area, that area replaces the pick nearest the median.
    """
    ordered = row_index(areas, [F.col("population"), F.col("area")], name="_low")
    sized = group_size(ordered, name="_n").withColumn("national_quartile", rank_quartile(F.col("_low"), F.col("_n")))
    forced = F.col("area") == mandated
    medians = exact_median(areas, "population", "area", by=["region"], name="_median")
    mandates = areas.filter(forced).select("region", F.lit(True).alias("_mandated"))
    ready = sized.join(medians, "region").join(mandates, "region", "left").withColumn(
        "_mandated", F.coalesce("_mandated", F.lit(False))
    )
    # row_number() = 1 per region keeps one row per map task.
    top = F.row_number().over(Window.partitionBy("region").orderBy(F.col("population").desc(), "area"))
    highest = ready.filter(~forced).withColumn("_top", top).filter("_top = 1").drop("_top")
    others = ready.join(highest.select("area"), "area", "left_anti").filter(~F.col("_mandated"))
    near = F.row_number().over(Window.partitionBy("region").orderBy(F.abs(F.col("population") - F.col("_median")), "area"))
    closest = others.withColumn("_near", near).filter("_near = 1").drop("_near")
    columns = ["area", "region", "population", "national_quartile"]
    return (
        highest.select(*columns, F.lit("highest_population").alias("reason"))
        .unionByName(closest.select(*columns, F.lit("closest_to_region_median").alias("reason")))
        .unionByName(ready.filter(forced).select(*columns, F.lit("mandated").alias("reason")))
    )
