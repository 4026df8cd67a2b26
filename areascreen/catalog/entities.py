"""Entity resolution, evidence classes, geocode decisions and response parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from areascreen.catalog.registry import query
from areascreen.catalog.views import COVERED, MEET, origins, region_edges, table, with_views
from areascreen.functions import text

from areascreen.operators import entity, evidence, od
from areascreen.operators.geometry import polygons

CANDIDATES_SQL = r"""cand AS (SELECT o_orderkey AS candidate_id, o_orderkey AS seq, b,
    CASE o_orderkey%3 WHEN 0 THEN 'Brand ' WHEN 1 THEN ' brand  ' ELSE 'BRAND ' END || (b%20)::VARCHAR AS brand_name,
    CASE o_orderkey%2 WHEN 0 THEN 'Blk ' || b::VARCHAR || ' Lor 5' ELSE b::VARCHAR || ' lorong  5' END AS address_raw,
    CASE WHEN b%5 = 4 OR o_orderkey%9 = 0 THEN NULL ELSE (100000 + b)::VARCHAR END AS postal_code,
    CASE WHEN b%3 = 2 THEN '#02-02' WHEN o_orderkey%4 = 0 THEN NULL WHEN b%3 = 1 AND o_orderkey%4 = 1 THEN '#01-01' WHEN b%3 = 1 THEN '#01-02' ELSE '#01-01' END AS unit,
    CASE WHEN o_orderkey%7 = 0 AND b%2 = 0 THEN b::VARCHAR || ' Lorong 5' END AS canonical_address,
    CASE WHEN o_orderkey%7 = 0 AND b%2 = 0 THEN (100000 + b)::VARCHAR END AS canonical_postal_code,
    CASE WHEN o_orderkey%7 = 0 AND b%2 = 0 THEN '#01-01' END AS canonical_unit,
    b%10 = 0 AND o_orderkey%5 = 0 AS identity_conflict
    FROM (SELECT *, o_custkey%300 AS b FROM orders)),
  norm AS (SELECT *, upper(trim(regexp_replace(brand_name, '\s+', ' ', 'g'))) AS brand0, coalesce(canonical_address, address_raw) AS address,
    coalesce(canonical_postal_code, postal_code) AS postal0, coalesce(canonical_unit, unit) AS unit0 FROM cand),
  rec AS (SELECT *, CASE WHEN brand0 = 'BRAND 19' THEN 'BRAND 0' ELSE brand0 END AS brand, upper(trim(regexp_replace(address, '\s+', ' ', 'g'))) AS na FROM norm),
  rec2 AS (SELECT *, regexp_replace(regexp_replace(na, '^BLK\s+', ''), '\bLOR\b', 'LORONG', 'g') AS building,
    CASE WHEN canonical_address IS NOT NULL THEN concat(upper(canonical_address), '~', canonical_postal_code, '~', canonical_unit) END AS ident FROM rec),
  ver AS (SELECT brand, building, count(*) FILTER (unit0 IS NULL) AS missing_units, count(DISTINCT ident) AS idents, min(ident) AS ident, count(DISTINCT unit0) AS units,
    count(DISTINCT postal0) AS postals, min(postal0) AS p0, bool_or(identity_conflict) AS conflict, arg_min(candidate_id, seq) FILTER (ident IS NOT NULL) AS supporter FROM rec2 GROUP BY 1, 2),
  ver2 AS (SELECT *, idents = 1 AND units = 1 AND NOT conflict AND (postals = 0 OR (postals = 1 AND p0 = split_part(ident, '~', 2))) AS resolved,
    CASE WHEN conflict OR postals > 1 THEN 'conflicting_identity_evidence' ELSE 'ambiguous_missing_unit_identity' END AS issue FROM ver WHERE missing_units > 0 AND idents > 0),
  fil AS (SELECT r.candidate_id, r.seq, r.brand, r.brand_name, CASE WHEN f THEN split_part(v.ident, '~', 1) ELSE address END AS address, CASE WHEN f THEN split_part(v.ident, '~', 1) ELSE na END AS na,
    CASE WHEN f THEN split_part(v.ident, '~', 2) ELSE postal0 END AS postal, CASE WHEN f THEN split_part(v.ident, '~', 3) ELSE unit0 END AS unit
    FROM (SELECT r.*, v.ident AS vident, coalesce(r.unit0 IS NULL AND v.resolved, false) AS f FROM rec2 r LEFT JOIN ver2 v ON r.brand = v.brand AND r.building = v.building AND v.resolved) r
    LEFT JOIN ver2 v ON r.brand = v.brand AND r.building = v.building AND v.resolved),
  keyed AS (SELECT *, coalesce(postal, '') AS pk, CASE WHEN postal IS NULL THEN na ELSE '' END AS ak, coalesce(unit, '') AS uk FROM fil),
  grp AS (SELECT brand, pk, ak, uk, count(*) AS source_candidate_count, min(seq) AS s0, arg_min(brand_name, seq) AS brand_name, arg_min(address, seq) AS address_raw, arg_min(na, seq) AS normalized_address FROM keyed GROUP BY ALL),
  br AS (SELECT *, 'BRANCH_' || upper(substr(sha256(concat_ws(chr(31), brand, normalized_address, uk)), 1, 16)) AS branch_id FROM grp)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, b = F.col("o_orderkey"), F.col("b")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 300).alias("b"))
    brand = F.when(key % 3 == 0, "Brand ").when(key % 3 == 1, " brand  ").otherwise("BRAND ")
    validated = (key % 7 == 0) & (b % 2 == 0)
    unit = (
        F.when(b % 3 == 2, "#02-02").when(key % 4 == 0, None).when((b % 3 == 1) & (key % 4 == 1), "#01-01")
        .when(b % 3 == 1, "#01-02").otherwise("#01-01")
    )
    return rows.select(
        key.alias("candidate_id"), key.alias("seq"), F.concat(brand, b % 20).alias("brand_name"),
        F.when(key % 2 == 0, F.concat(F.lit("Blk "), b, F.lit(" Lor 5"))).otherwise(F.concat(b, F.lit(" lorong  5"))).alias("address_raw"),
        F.when((b % 5 == 4) | (key % 9 == 0), None).otherwise((b + 100000).cast("string")).alias("postal_code"), unit.alias("unit"),
        F.when(validated, F.concat(b, F.lit(" Lorong 5"))).alias("canonical_address"),
        F.when(validated, (b + 100000).cast("string")).alias("canonical_postal_code"),
        F.when(validated, "#01-01").alias("canonical_unit"), ((b % 10 == 0) & (key % 5 == 0)).alias("identity_conflict"),
    )


def resolved(spark: SparkSession, sf_dir: str) -> entity.Resolution:
    aliases = spark.createDataFrame([("BRAND 19", "BRAND 0")], "alias string, canonical_brand string")
    return entity.deduplicate(candidates(spark, sf_dir), aliases)


@query("E1_E3_branches", f"""WITH {CANDIDATES_SQL}
  SELECT branch_id, brand_name, brand AS normalized_brand_name, address_raw, normalized_address, coalesce(pk, '') AS postal_code, coalesce(uk, '') AS unit, source_candidate_count FROM br""")
def branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved(spark, sf_dir).branches.withColumns({c: F.coalesce(c, F.lit("")) for c in ("postal_code", "unit")})


@query("E3_W11_memberships", f"""WITH {CANDIDATES_SQL} SELECT branch_id, candidate_id FROM keyed JOIN br USING (brand, pk, ak, uk)""")
def branch_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved(spark, sf_dir).memberships


@query("E2_unit_resolutions", f"""WITH {CANDIDATES_SQL}
  SELECT brand, building, split_part(ident, '~', 2) AS canonical_postal_code, split_part(ident, '~', 3) AS canonical_unit, supporter AS supporting_candidate_id, missing_units FROM ver2 WHERE resolved""")
def unit_resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved(spark, sf_dir).resolutions.select(
        "brand", "building", F.col("identity.postal").alias("canonical_postal_code"), F.col("identity.unit").alias("canonical_unit"),
        "supporting_candidate_id", "missing_units",
    )


@query("E3_reviews", f"""WITH {CANDIDATES_SQL},
  items AS (SELECT 'branch_group' AS entity_type, brand || '|' || building AS entity_reference, brand || '|' || building AS ek, issue AS issue_category FROM ver2 WHERE NOT resolved
    UNION ALL SELECT 'branch_group', brand || '|' || pk, brand || '|' || pk, 'ambiguous_unit_within_postal' FROM br WHERE pk <> '' GROUP BY brand, pk HAVING bool_or(uk = '') AND bool_or(uk <> '')
    UNION ALL SELECT 'branch_candidate', s0::VARCHAR, brand || '|' || ak || '|' || uk, 'missing_or_invalid_postal_code' FROM br WHERE pk = '')
  SELECT 'CREV_' || upper(substr(sha256(concat_ws(chr(31), entity_type, ek, issue_category)), 1, 16)) AS review_item_id, entity_type, entity_reference, issue_category, 'open' AS status FROM items""")
def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved(spark, sf_dir).reviews


@query("E9_brands", f"""WITH {CANDIDATES_SQL} SELECT DISTINCT 'BRAND_' || upper(substr(sha256(brand), 1, 16)) AS brand_id, brand AS normalized_brand_name FROM br""")
def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity.brands_of(resolved(spark, sf_dir).branches)


@query("A29_shared_addresses", """SELECT upper(p_name) AS normalized_address, count(DISTINCT p_brand) AS brand_count FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1""")
def shared_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return entity.shared_addresses(parts.select(
        text.normalize_address(F.col("p_name")).alias("normalized_address"), F.col("p_brand").alias("normalized_brand_name")
    ))


OBSERVATIONS_SQL = """obs AS (SELECT event_id, event_id//8 AS branch_id, CASE event_type WHEN 'click' THEN 'branch_address_or_existence' WHEN 'view' THEN 'mathematics_subject' WHEN 'purchase' THEN 'level_overlap'
     WHEN 'error' THEN CASE WHEN event_id%3 = 0 THEN 'branch_closed' ELSE 'other' END ELSE 'listing_seen' END AS observation_type,
   CASE event_id%5 WHEN 0 THEN 'search_snippet' WHEN 4 THEN 'directory' ELSE 'operator_controlled' END AS evidence_scope,
   CASE event_id%11 WHEN 0 THEN 'contradicts' WHEN 1 THEN NULL ELSE 'supports' END AS polarity, strftime(ts, '%Y-%m-%d') AS observed_at FROM events)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, kind = F.col("event_id"), F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id", F.floor(key / 8).alias("branch_id"),
        F.when(kind == "click", "branch_address_or_existence").when(kind == "view", "mathematics_subject").when(kind == "purchase", "level_overlap")
        .when((kind == "error") & (key % 3 == 0), "branch_closed").when(kind == "error", "other").otherwise("listing_seen").alias("observation_type"),
        F.when(key % 5 == 0, "search_snippet").when(key % 5 == 4, "directory").otherwise("operator_controlled").alias("evidence_scope"),
        F.when(key % 11 == 0, "contradicts").when(key % 11 == 1, None).otherwise("supports").alias("polarity"),
        F.date_format("ts", "yyyy-MM-dd").alias("observed_at"),
    )


@query("E5_evidence_classes", f"""WITH {OBSERVATIONS_SQL},
  f AS (SELECT branch_id, bool_or(observation_type = 'branch_closed' AND evidence_scope <> 'search_snippet') AS excl,
    bool_or(observation_type = 'branch_address_or_existence' AND s) AS a, bool_or(observation_type = 'mathematics_subject' AND s) AS m, bool_or(observation_type = 'level_overlap' AND s) AS l,
    bool_or(observation_type = 'branch_address_or_existence' AND s AND fo) AS fa, bool_or(observation_type = 'mathematics_subject' AND s AND fo) AS fm, bool_or(observation_type = 'level_overlap' AND s AND fo) AS fl
    FROM (SELECT *, coalesce(polarity, 'supports') = 'supports' AS s, evidence_scope = 'operator_controlled' AND date_diff('day', observed_at::DATE, DATE '2024-01-20') BETWEEN 0 AND 30 AS fo FROM obs) GROUP BY 1)
  SELECT branch_id, CASE WHEN excl AND (a OR m OR l) THEN 'unresolved' WHEN excl THEN 'excluded' WHEN fa AND fm AND fl THEN 'confirmed' WHEN a OR m OR l THEN 'possible' ELSE 'unresolved' END AS status,
    CASE WHEN excl THEN '' ELSE concat_ws(',', CASE WHEN NOT fa THEN 'branch_address_or_existence' END, CASE WHEN NOT fm THEN 'mathematics_subject' END, CASE WHEN NOT fl THEN 'level_overlap' END) END AS missing_elements FROM f""")
def evidence_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = evidence.classify(observations(spark, sf_dir), cutoff="2024-01-20")
    return classes.withColumn("missing_elements", F.array_join("missing_elements", ","))


@query("E6_validation_status", """
  WITH v AS (SELECT event_id, CASE event_id%4 WHEN 0 THEN 'confirmed_operator_page' WHEN 1 THEN 'attempted_blocked' WHEN 2 THEN 'not_attempted' END AS a,
    CASE event_id%3 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'confirmed_by_page' ELSE 'unknown' END AS s, CASE event_id%5 WHEN 0 THEN 'confirmed_not_mapped' WHEN 1 THEN 'possible' ELSE 'confirmed' END AS l, event_type = 'view' AS listed FROM events),
  r AS (SELECT *, CASE WHEN a IS NULL THEN 'unresolved' WHEN a = 'confirmed_operator_page' AND contains(s, 'confirmed') AND contains(l, 'confirmed') AND NOT contains(l, 'not_mapped') THEN 'confirmed'
    WHEN starts_with(a, 'attempted_') OR contains(a, 'possible') OR contains(l, 'possible') THEN 'possible' ELSE 'unresolved' END AS status FROM v)
  SELECT event_id, status, CASE WHEN status = 'unresolved' AND listed THEN 'possible' ELSE status END AS with_directory FROM r""")
def validation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    address = F.when(key % 4 == 0, "confirmed_operator_page").when(key % 4 == 1, "attempted_blocked").when(key % 4 == 2, "not_attempted")
    subject = F.when(key % 3 == 0, "confirmed").when(key % 3 == 1, "confirmed_by_page").otherwise("unknown")
    level = F.when(key % 5 == 0, "confirmed_not_mapped").when(key % 5 == 1, "possible").otherwise("confirmed")
    rows = table(spark, sf_dir, "events").select(
        "event_id", "event_type",
        evidence.status_from_validation(address, subject, level, confirmed_address="confirmed_operator_page").alias("status"),
    )
    return rows.select(
        "event_id", "status", evidence.directory_floor(F.col("status"), F.col("event_type") == "view").alias("with_directory")
    )


SELECTED_AREAS = [f"NATION_{i}" for i in range(12)]


@query("E7_geography_policy", with_views("origins region_edges", f"""
  WITH p AS (SELECT DISTINCT x AS px, y AS py FROM origins WHERE origin_id%9 <> 0),
  m AS (SELECT px, py, geo_id FROM p, region_edges WHERE {MEET} GROUP BY ALL HAVING {COVERED}),
  n AS (SELECT px, py, min(name) AS planning_area FROM m JOIN (SELECT DISTINCT geo_id, name FROM region_edges) USING (geo_id) GROUP BY 1, 2),
  b AS (SELECT origin_id, area, planning_area, planning_area IN ('NATION_0','NATION_1','NATION_2','NATION_3','NATION_4','NATION_5','NATION_6','NATION_7','NATION_8','NATION_9','NATION_10','NATION_11') AS inside
    FROM origins LEFT JOIN n ON x = px AND y = py AND origin_id%9 <> 0)
  SELECT origin_id, CASE WHEN planning_area IS NULL THEN 'unresolved_no_coordinate' ELSE 'coordinate_derived' END AS planning_area_source, CASE WHEN planning_area IS NOT NULL AND NOT inside THEN 'excluded' ELSE 'retained' END AS outcome,
    coalesce(CASE WHEN planning_area IS NULL THEN 'planning_area_unresolved' WHEN NOT inside THEN 'coordinate_derived_outside_pilot_geography' WHEN planning_area <> area THEN 'planning_area_searched_derived_mismatch' END, '') AS issue_category FROM b"""))
def geography_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.col("origin_id") % 9 != 0
    rows = origins(spark, sf_dir).select(
        "origin_id", F.col("area").alias("planning_area_searched"), F.when(known, F.col("x")).alias("x"), F.when(known, F.col("y")).alias("y")
    )
    edges = region_edges(spark, sf_dir)
    names = edges.select("geo_id", F.col("name").alias("planning_area")).distinct()
    placed = polygons.assign_polygon(rows, edges, names, policy="least", cell_size=2000.0, attributes=["planning_area"])
    return entity.geography_policy(placed, SELECTED_AREAS).select(
        "origin_id", "planning_area_source", "outcome", F.coalesce("issue_category", F.lit("")).alias("issue_category")
    )


@query("E8_offerings", """
  WITH b AS (SELECT c_name AS branch_id, unnest(CASE c_custkey%3 WHEN 0 THEN ['P1 ', 's4'] ELSE ['unspecified'] END) AS level FROM customer WHERE c_custkey%4 IN (0, 1))
  SELECT branch_id, 'Mathematics' AS subject, level, 'OFFER_' || upper(substr(sha256(concat_ws(chr(31), branch_id, 'MATHEMATICS', upper(trim(level)))), 1, 16)) AS offering_id FROM b""")
def offerings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("branch_id"),
        F.element_at(F.array(*[F.lit(s) for s in ("confirmed", "possible", "excluded", "unresolved")]), (key % 4 + 1).cast("int")).alias("evidence_status"),
        F.when(key % 3 == 0, F.array(F.lit("P1 "), F.lit("s4"))).when(key % 3 == 1, F.array().cast("array<string>")).alias("levels"),
    )
    return entity.offerings(rows, subject="Mathematics")


@query("E4_A30_relocations", """
  WITH b AS (SELECT c_custkey AS branch_id, c_nationkey AS brand_id, CASE WHEN c_custkey%5 = 0 THEN 'closed' ELSE 'current' END AS status FROM customer),
  r AS (SELECT c_custkey AS prev, c_custkey + 1 AS new FROM customer WHERE c_mktsegment = 'BUILDING')
  SELECT count(*) FILTER (CASE WHEN o.prev IS NOT NULL THEN 'relocated' WHEN n.new IS NOT NULL THEN 'current' ELSE status END = 'current') AS current_branches,
    count(DISTINCT brand_id) AS distinct_brands, (SELECT count(*) FROM r) AS history_rows FROM b LEFT JOIN r o ON b.branch_id = o.prev LEFT JOIN r n ON b.branch_id = n.new""")
def relocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    customers = table(spark, sf_dir, "customer")
    rows = customers.select(key.alias("branch_id"), F.col("c_nationkey").alias("brand_id"), F.when(key % 5 == 0, "closed").otherwise("current").alias("status"))
    moves = customers.filter("c_mktsegment = 'BUILDING'").select(
        key.alias("previous_branch_id"), (key + 1).alias("new_branch_id"), F.lit(True).alias("effective_date_known"), F.lit("S1").alias("source_ref")
    )
    linked, history = entity.relocate(rows, moves)
    return entity.status_counts(linked).withColumn("history_rows", history.agg(F.count(F.lit(1)).alias("n")).scalar())


GEO_BOUNDS = {"minimum_longitude": 103.6, "maximum_longitude": 104.1, "minimum_latitude": 1.15, "maximum_latitude": 1.48}


@query("E10_geocode_decisions", """
  WITH e AS (SELECT c_custkey AS entity_id, CASE WHEN c_custkey%8 = 0 THEN NULL ELSE (100000 + c_custkey)::VARCHAR END AS postal,
     CASE c_custkey%13 WHEN 0 THEN 429 WHEN 1 THEN 500 WHEN 2 THEN 0 ELSE 200 END AS st, c_custkey%5 AS v FROM customer),
  h AS (SELECT entity_id, unnest([{'p': CASE WHEN v = 0 THEN 'x' ELSE ' ' || (100000 + entity_id)::VARCHAR END, 'lon': (103.55 + (entity_id%60)/100.0)::DOUBLE, 'lat': (1.2 + (entity_id%30)/100.0)::DOUBLE},
     {'p': (100000 + entity_id)::VARCHAR, 'lon': (103.55 + (entity_id%60)/100.0 + CASE WHEN v = 1 THEN 0.01 ELSE 0.000000001 END)::DOUBLE, 'lat': (1.2 + (entity_id%30)/100.0)::DOUBLE}]) AS r FROM e WHERE v <> 0 OR entity_id%2 = 0),
  g AS (SELECT e.entity_id, count(*) FILTER (trim(r.p) = postal AND st = 200) AS exact_count, count(DISTINCT CASE WHEN trim(r.p) = postal AND st = 200 THEN concat(round_even(r.lon, 7), ',', round_even(r.lat, 7)) END) AS coordinate_count,
     min(CASE WHEN trim(r.p) = postal AND st = 200 THEN round_even(r.lon, 7)::DOUBLE END) AS lon, min(CASE WHEN trim(r.p) = postal AND st = 200 THEN round_even(r.lat, 7)::DOUBLE END) AS lat FROM e LEFT JOIN h USING (entity_id) GROUP BY 1),
  d AS (SELECT entity_id, postal, exact_count, coordinate_count, lon, lat, CASE WHEN postal IS NULL THEN 'missing_postal_code' WHEN coordinate_count = 1 AND lon BETWEEN 103.6 AND 104.1 AND lat BETWEEN 1.15 AND 1.48 THEN 'resolved_exact_postal_unique_coordinate'
     WHEN coordinate_count = 1 THEN 'out_of_bounds' WHEN coordinate_count > 1 THEN 'ambiguous_exact_postal_coordinates' WHEN st = 429 THEN 'rate_limited' WHEN st = 200 THEN 'no_exact_postal_coordinate' WHEN st > 0 THEN 'http_error' ELSE 'network_error' END AS status
     FROM e JOIN g USING (entity_id))
  SELECT entity_id, status, coalesce(CASE WHEN postal IS NOT NULL THEN exact_count END, -1) AS exact_count, coalesce(CASE WHEN postal IS NOT NULL THEN coordinate_count END, -1) AS coordinate_count,
     CASE WHEN status LIKE 'resolved%' THEN lon END AS longitude, CASE WHEN status LIKE 'resolved%' THEN lat END AS latitude FROM d""")
def geocode_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    customers = table(spark, sf_dir, "customer")
    entities = customers.select(key.alias("entity_id"), F.when(key % 8 != 0, (key + 100000).cast("string")).alias("postal_code"))
    longitude = F.lit(103.55) + (key % 60) / 100
    latitude = F.lit(1.2) + (key % 30) / 100
    shift = F.when(key % 5 == 1, 0.01).otherwise(0.000000001)
    own = (key + 100000).cast("string")
    results = F.array(
        F.struct(F.when(key % 5 == 0, "x").otherwise(F.concat(F.lit(" "), own)).alias("postal"), longitude.alias("longitude"), latitude.alias("latitude")),
        F.struct(own.alias("postal"), (longitude + shift).alias("longitude"), latitude.alias("latitude")),
    )
    status = F.when(key % 13 == 0, 429).when(key % 13 == 1, 500).when(key % 13 == 2, 0).otherwise(200)
    responses = customers.select(
        key.alias("entity_id"), status.alias("http_status"), F.when((key % 5 != 0) | (key % 2 == 0), results).alias("results")
    )
    decided = entity.geocode_decision(entities, responses, GEO_BOUNDS)
    return decided.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("exact_count", "coordinate_count")})


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    seconds, metres = (key % 4000).cast("string"), (key % 700).cast("string")
    pt = F.concat(
        F.lit('{"plan": {"itineraries": [{"duration": '), seconds, F.lit(', "legs": [{"distance": '), metres, F.lit('.5}, {"mode": "walk"}, {"distance": 20}]}, {"duration": 1}]}}')
    )
    walk = F.concat(F.lit('{"route_summary": {"total_time": '), seconds, F.lit(', "total_distance": '), metres, F.lit("}}"))
    body = F.when(key % 7 == 0, '{"plan": {"itineraries": []}}').when(key % 7 == 1, '{"error": "none"}').when(key % 2 == 0, pt).otherwise(walk)
    status = F.when(key % 10 == 0, 404).when(key % 10 == 1, 429).when(key % 10 == 2, 403).when(key % 50 == 3, 0).when(key % 50 == 4, 500).otherwise(200)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(key % 2 == 0, "pt").otherwise("walk").alias("mode"), status.alias("http_status"),
        F.when(key % 33 == 5, "not_json").otherwise("ok").alias("outcome"), body.alias("body"),
    )


BODIES_SQL = """bodies AS (SELECT o_orderkey, CASE WHEN o_orderkey%2 = 0 THEN 'pt' ELSE 'walk' END AS mode,
    CASE WHEN o_orderkey%10 = 0 THEN 404 WHEN o_orderkey%10 = 1 THEN 429 WHEN o_orderkey%10 = 2 THEN 403 WHEN o_orderkey%50 = 3 THEN 0 WHEN o_orderkey%50 = 4 THEN 500 ELSE 200 END AS st,
    CASE WHEN o_orderkey%33 = 5 THEN 'not_json' ELSE 'ok' END AS outcome,
    CASE WHEN o_orderkey%7 < 2 THEN NULL ELSE (o_orderkey%4000)::DOUBLE END AS secs, CASE WHEN o_orderkey%7 < 2 THEN NULL WHEN o_orderkey%2 = 0 THEN o_orderkey%700 + 20.5::DOUBLE ELSE (o_orderkey%700)::DOUBLE END AS mets FROM orders),
  parsed AS (SELECT *, CASE WHEN st = 404 THEN 'missing_route' WHEN st = 429 THEN 'rate_limited' WHEN st IN (401, 403) THEN 'authorization_error' WHEN st = 0 THEN 'network_error' WHEN st <> 200 THEN 'http_error'
    WHEN outcome <> 'ok' OR secs IS NULL THEN 'invalid_response' ELSE 'success' END AS category FROM bodies)"""


@query("E11_route_outcomes", f"""WITH {BODIES_SQL} SELECT o_orderkey, mode, category, coalesce(CASE WHEN category = 'success' THEN secs END, -1) AS duration_seconds, coalesce(CASE WHEN category = 'success' THEN mets END, -1) AS distance_metres FROM parsed""")
def route_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return od.route_outcome(_bodies(spark, sf_dir)).select("o_orderkey", "mode", "category", *[
        F.coalesce(c, F.lit(-1.0)).alias(c) for c in ("duration_seconds", "distance_metres")
    ])


@query("A27_route_modes", f"""WITH {BODIES_SQL} SELECT count(*) FILTER (mode='walk' AND category='success') AS walk_success, count(*) FILTER (mode='pt' AND category='success') AS pt_success,
  count(*) FILTER (mode='pt' AND category='missing_route') AS pt_missing, count(*) FILTER (category='rate_limited') AS rate_limited, count(*) AS routes FROM parsed""")
def route_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return od.route_mode_summary(od.route_outcome(_bodies(spark, sf_dir)))
