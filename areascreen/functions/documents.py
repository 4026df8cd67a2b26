"""JSON cells for flat files and checks over nested schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Fixed value: field names that must not be published.
FORBIDDEN_FIELDS = {"address", "postal_code", "operator_url", "email", "password", "authorization"}


def flag_array(flags: dict[str, Column]) -> Column:
    """Names of the conditions that hold, in the given order."""
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in flags.items()]))


def json_array(values: Column) -> Column:
    """Sorted array as a JSON text cell."""
    return F.to_json(F.sort_array(values))


def feature_json(identifier: Column, longitude: Column, latitude: Column, properties: Column) -> Column:
    """GeoJSON point feature as one line of text."""
    return F.to_json(F.struct(
        F.lit("Feature").alias("type"), identifier.alias("id"),
        F.struct(F.lit("Point").alias("type"), F.array(longitude, latitude).alias("coordinates")).alias("geometry"),
        properties.alias("properties"),
    ))


def field_names(schema: T.DataType) -> set[str]:
    """Every field name at any depth of a schema."""
    if isinstance(schema, T.StructType):
        names = {field.name for field in schema.fields}
        return names.union(*[field_names(field.dataType) for field in schema.fields])
    if isinstance(schema, T.ArrayType):
        return field_names(schema.elementType)
    if isinstance(schema, T.MapType):
        return field_names(schema.valueType)
    return set()


def forbidden_fields(df: DataFrame) -> list[str]:
    return sorted(field_names(df.schema) & FORBIDDEN_FIELDS)
