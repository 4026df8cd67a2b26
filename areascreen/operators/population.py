"""Population table cleaning: levels, target ages, completeness and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from areascreen.functions.numbers import parse_count

#: Fixed value: the published sexes.
SEXES = ["Total", "Males", "Females"]


def parsed_rows(raw: DataFrame) -> DataFrame:
    """Drop note rows, trim, parse the count and name the publication level of each row.

    ``raw`` has planning_area, subzone, age, sex and count_raw, all text.
    """
    text = {c: F.trim(c) for c in ("planning_area", "subzone", "age", "sex")}
    rows = raw.withColumns(text).filter(~((F.col("subzone") == "") & (F.col("age") == "") & (F.col("sex") == "")))
    level = (
        F.when((F.col("planning_area") == "Total") & (F.col("subzone") == "Total"), "national")
        .when((F.col("planning_area") != "Total") & (F.col("subzone") == "Total"), "planning_area")
        .when(F.col("planning_area") == "Total", "other").otherwise("subzone")
    )
    return rows.withColumn("_c", parse_count(F.col("count_raw"))).select(
        "planning_area", "subzone", "age", F.col("age").try_cast("int").alias("age_years"), "sex",
        F.col("_c.count").alias("count"), F.col("_c.marker").alias("marker"), level.alias("level"),
    )


def target_slice(rows: DataFrame, low: int, high: int) -> DataFrame:
    return rows.filter(F.col("age_years").between(low, high))


def population_proxy(rows: DataFrame, *, low: int, high: int, rounding: int = 10) -> DataFrame:
    """Per subzone: sum over the target ages, or a completeness note instead of a sum.

    A subzone with a missing age or an unreadable count gets no population.
    """
    detail = target_slice(rows, low, high).filter((F.col("level") == "subzone") & (F.col("sex") == "Total"))
    grouped = detail.groupBy("planning_area", "subzone").agg(
        F.sum("count").alias("_sum"), F.countDistinct("age_years").alias("observed_ages"), F.count(F.lit(1)).alias("component_count"),
        F.count_if(F.col("count").isNull()).alias("null_count"), F.count_if(F.col("marker") == "nil_or_negligible").alias("nil_count"),
    )
    complete = (F.col("observed_ages") == high - low + 1) & (F.col("null_count") == 0)
    return grouped.withColumn("complete", complete).withColumn("population", F.when(complete, F.col("_sum"))).withColumn(
        "maximum_rounding_error", F.col("component_count") * F.lit(rounding) / 2
    ).drop("_sum")


def sex_reconciliation(rows: DataFrame, *, low: int, high: int) -> DataFrame:
    """Total minus males minus females per subzone and age; null when a part is missing."""
    detail = target_slice(rows, low, high).filter(F.col("level") == "subzone")

    def of(sex: str) -> Column:
        return F.max(F.when(F.col("sex") == sex, F.col("count")))

    grouped = detail.groupBy("planning_area", "subzone", "age_years").agg(*[of(s).alias(s) for s in SEXES])
    return grouped.select(
        "planning_area", "subzone", "age_years", (F.col("Total") - F.col("Males") - F.col("Females")).alias("difference")
    )


def published_reconciliation(rows: DataFrame, *, low: int, high: int) -> DataFrame:
    """Published totals against detail sums, per planning area and age and for the nation."""
    total = target_slice(rows, low, high).filter(F.col("sex") == "Total")
    detail, area = F.col("level") == "subzone", F.col("level") == "planning_area"
    by_area = total.filter(detail | area).groupBy("planning_area", "age_years").agg(
        F.max(F.when(area, F.col("count"))).alias("published"), F.coalesce(F.sum(F.when(detail, F.col("count"))), F.lit(0)).alias("detail")
    ).filter("published IS NOT NULL")
    national = total.agg(
        F.lit("Total").alias("planning_area"), F.lit(None).cast("int").alias("age_years"),
        F.coalesce(F.sum(F.when(F.col("level") == "national", F.col("count"))), F.lit(0)).alias("published"),
        F.coalesce(F.sum(F.when(detail, F.col("count"))), F.lit(0)).alias("detail"),
    )
    return by_area.unionByName(national).withColumn("difference", F.col("detail") - F.col("published"))
