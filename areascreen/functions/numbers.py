"""Typed parsing, dates, distances and rounding as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

DAYS_PER_MONTH = 30.4375


def parse_count(raw: Column) -> Column:
    """struct(count, marker): ``-`` is a nil count of 0, blank is missing, the rest must be whole."""
    text = F.trim(raw)
    number = text.try_cast("double")
    whole = number == F.floor(number)
    marker = (
        F.when(text == "-", "nil_or_negligible").when(text == "", "missing")
        .when(number.isNull(), F.concat(F.lit("unknown:"), text))
        .when(~whole, F.concat(F.lit("non_integer:"), text))
    )
    count = F.when(text == "-", F.lit(0)).when(whole, number).cast("bigint")
    return F.struct(count.alias("count"), marker.alias("marker"))


def optional_text(raw: Column) -> Column:
    return F.nullif(F.trim(raw), F.lit(""))


def optional_double(raw: Column) -> Column:
    return optional_text(raw).try_cast("double")


def optional_int(raw: Column) -> Column:
    return optional_text(raw).try_cast("bigint")


def optional_bool(raw: Column) -> Column:
    """Null for blank, true for the text ``true`` in any case, else false."""
    return F.lower(optional_text(raw)) == "true"


def is_fresh(observed: Column, cutoff: Column, days: int) -> Column:
    """Observed within ``days`` up to the cutoff; dates that do not parse are not fresh."""
    age = F.datediff(cutoff.try_cast("date"), observed.try_cast("date"))
    return F.coalesce(age.between(0, days), F.lit(False))


def age_in_months(updated: Column, snapshot: Column) -> Column:
    return F.greatest(F.lit(0.0), F.datediff(snapshot.cast("date"), updated.cast("date")) / F.lit(DAYS_PER_MONTH))


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x1 - x2, y1 - y2
    return F.sqrt(dx * dx + dy * dy)


def coordinate_key(longitude: Column, latitude: Column) -> Column:
    return F.format_string("%.7f,%.7f", longitude, latitude)


def in_bounds(longitude: Column, latitude: Column, bounds: dict[str, float]) -> Column:
    """Whether the point lies in the box; a null coordinate does not."""
    inside = longitude.between(bounds["minimum_longitude"], bounds["maximum_longitude"]) & latitude.between(
        bounds["minimum_latitude"], bounds["maximum_latitude"]
    )
    return F.coalesce(inside, F.lit(False))


def all_finite(df: DataFrame) -> Column:
    """Aggregate: every floating value of the table is finite or null."""
    tests = [F.lit(True)]
    for field in df.schema.fields:
        if field.dataType.typeName() in ("double", "float"):
            value = F.col(field.name)
            odd = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
            tests.append(F.count_if(odd) == 0)
    verdict = tests[0]
    for test in tests[1:]:
        verdict = verdict & test
    return verdict
