"""Declared schemas of the domain tables; readers never infer."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(),
    "boolean": T.BooleanType(), "timestamp": T.TimestampType(),
}


def _struct(text: str) -> T.StructType:
    pairs = [column.split() for column in text.split(", ")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


POPULATION = _struct("planning_area string, subzone string, age string, sex string, count_raw string")
SUBZONES = _struct(
    "geo_id string, subzone_name string, planning_area_name string, region_name string, area double, centroid_x double, centroid_y double"
)
EDGES = _struct("geo_id string, part int, ring int, seq int, x1 double, y1 double, x2 double, y2 double")
EXITS = _struct("exit_id string, complex_id string, station_name string, label string, longitude double, latitude double, x double, y double")
ROUTING_PLAN = _struct(
    "od_plan_id string, origin_id string, node_id string, exit_id string, scenario_id string, population double, nearest_distance double"
)
OUTCOMES = _struct(
    "od_plan_id string, method string, category string, http_status int, duration_seconds double, distance_metres double, attempted_at timestamp"
)
NODE_METRICS = _struct(
    "node_id string, scenario_id string, threshold_case_id string, is_primary boolean, accessible_population double, "
    "centroid_population double, national_population double"
)
CANDIDATES = _struct(
    "candidate_id string, seq bigint, brand_name string, address_raw string, postal_code string, unit string, "
    "canonical_address string, canonical_postal_code string, canonical_unit string, identity_conflict boolean"
)
OBSERVATIONS = _struct(
    "evidence_id string, branch_id string, observation_type string, evidence_scope string, polarity string, observed_at string"
)
REVIEWS = _struct(
    "review_item_id string, entity_type string, entity_reference string, issue_category string, status string"
)
