"""Scalar functions and row predicates, run over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from areascreen.catalog.registry import query
from areascreen.catalog.views import origins, table, trip_plan, with_views
from areascreen.functions import documents, finance, ids, numbers, projection, text
from areascreen.operators import ranking

#: Postal addresses written in several spellings, one per customer.
ADDRESS_SQL = """addresses AS (SELECT c_custkey AS id, c_mktsegment,
  concat(CASE c_custkey%3 WHEN 0 THEN 'Blk ' WHEN 1 THEN ' blk  ' ELSE '' END, c_custkey%900 + 1, '  Lor ', c_nationkey,
         CASE c_custkey%4 WHEN 0 THEN ' St' WHEN 1 THEN ' Ave' WHEN 2 THEN ' Rd ' ELSE ' dr,' END, ' ', c_custkey%7,
         CASE c_custkey%5 WHEN 0 THEN '' WHEN 1 THEN ' #0' || (c_custkey%9)::VARCHAR || ' - 1' ELSE ' # 12 -0' || (c_custkey%9)::VARCHAR END,
         CASE WHEN c_custkey%6 = 0 THEN ' (' || c_mktsegment || ')' ELSE '' END) AS address,
  CASE c_custkey%7 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN concat('S(', 100000 + c_custkey, ')')
       WHEN 3 THEN (10000 + c_custkey%90000)::VARCHAR WHEN 4 THEN '12' ELSE (500000 + c_custkey%400000)::VARCHAR END AS postal
  FROM customer)"""


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    block = F.when(key % 3 == 0, "Blk ").when(key % 3 == 1, " blk  ").otherwise("")
    road = F.when(key % 4 == 0, " St").when(key % 4 == 1, " Ave").when(key % 4 == 2, " Rd ").otherwise(" dr,")
    unit = (
        F.when(key % 5 == 0, "").when(key % 5 == 1, F.concat(F.lit(" #0"), key % 9, F.lit(" - 1")))
        .otherwise(F.concat(F.lit(" # 12 -0"), key % 9))
    )
    label = F.when(key % 6 == 0, F.concat(F.lit(" ("), "c_mktsegment", F.lit(")"))).otherwise("")
    postal = (
        F.when(key % 7 == 0, F.lit(None).cast("string")).when(key % 7 == 1, " ")
        .when(key % 7 == 2, F.concat(F.lit("S("), key + 100000, F.lit(")")))
        .when(key % 7 == 3, (key % 90000 + 10000).cast("string")).when(key % 7 == 4, "12")
        .otherwise((key % 400000 + 500000).cast("string"))
    )
    return table(spark, sf_dir, "customer").select(
        key.alias("id"), "c_mktsegment",
        F.concat(block, key % 900 + 1, F.lit("  Lor "), F.col("c_nationkey"), road, F.lit(" "), key % 7, unit, label).alias("address"),
        postal.alias("postal"),
    )


_SPACE = r"[\s\x0b\x1c-\x1f\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_NAME = "replace(upper(trim(regexp_replace(text, '" + _SPACE + "', ' ', 'g'))), 'ẞ', 'SS')"


@query("F1_normalize_name", f"""SELECT doc_id, sha256(n) AS digest, length(n) AS characters
  FROM (SELECT doc_id, {_NAME} AS n FROM documents)""")
def normalize_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = text.normalize_name(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("n")).select(
        "doc_id", F.sha2("n", 256).alias("digest"), F.length("n").cast("bigint").alias("characters")
    )


ADDRESS_KEYS_SQL = ADDRESS_SQL + r""",
keyed AS (SELECT *, regexp_replace(upper(trim(regexp_replace(address, '\s+', ' ', 'g'))), '#\s*(\d+)\s*-\s*(\w+)', '#\1-\2', 'g') AS normalized FROM addresses),
plain AS (SELECT *, replace(regexp_replace(regexp_replace(regexp_replace(normalized, '\s*\([^)]*\)', '', 'g'),
    '\s*#\s*[A-Z0-9]+\s*-\s*[A-Z0-9/]+.*$', ''), '^BLK\s+', ''), ',', ' ') AS p FROM keyed),
building AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(p,
    '\bLOR\b', 'LORONG', 'g'), '\bST\b', 'STREET', 'g'), '\bAVE\b', 'AVENUE', 'g'), '\bRD\b', 'ROAD', 'g'), '\bDR\b', 'DRIVE', 'g'), '\s+', ' ', 'g')) AS building,
    regexp_replace(postal, '\D', '', 'g') AS digits FROM plain)"""


@query("F2_F3_F4_addresses", f"""WITH {ADDRESS_KEYS_SQL}
  SELECT id, normalized, building, CASE WHEN length(digits) = 6 THEN digits WHEN length(digits) = 5 THEN lpad(digits, 6, '0') END AS postal_code
  FROM building""")
def address_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addresses(spark, sf_dir).select(
        "id", text.normalize_address(F.col("address")).alias("normalized"),
        text.normalize_building_address(F.col("address")).alias("building"),
        text.normalize_postal_code(F.col("postal")).alias("postal_code"),
    )


@query("F5_station_names", r"""
  WITH s AS (SELECT s_suppkey AS id, CASE s_suppkey%4 WHEN 0 THEN replace(s_name, '#', ' ') || '  MRT Station' WHEN 1 THEN s_name || ' LRT station '
     WHEN 2 THEN 'ne' || (s_suppkey%20)::VARCHAR ELSE s_name END AS name FROM supplier),
  n AS (SELECT id, upper(trim(regexp_replace(name, '\s+', ' ', 'g'))) AS n FROM s)
  SELECT id, regexp_replace(n, '\s+(?:MRT|LRT)\s+STATION$', '') AS base_name,
         CASE WHEN n LIKE '% LRT STATION' THEN 'lrt' WHEN n LIKE '% MRT STATION' THEN 'mrt'
              WHEN regexp_matches(n, '^[A-Z]{2}\d+[A-Z]?$') THEN 'mrt_code_only_unverified' ELSE 'unknown' END AS mode,
         regexp_replace(regexp_replace(n, ' MRT STATION$', ''), ' LRT STATION$', '') AS display_name FROM n""")
def station_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    name = (
        F.when(key % 4 == 0, F.concat(F.replace("s_name", F.lit("#"), F.lit(" ")), F.lit("  MRT Station")))
        .when(key % 4 == 1, F.concat("s_name", F.lit(" LRT station ")))
        .when(key % 4 == 2, F.concat(F.lit("ne"), key % 20)).otherwise(F.col("s_name"))
    )
    normalized = text.normalize_name(name)
    return table(spark, sf_dir, "supplier").select(
        key.alias("id"), text.station_base_name(name).alias("base_name"),
        text.rail_mode(normalized).alias("mode"), text.display_name(normalized).alias("display_name"),
    )


_RAW_COUNT = """CASE l_linenumber%7 WHEN 0 THEN '-' WHEN 1 THEN '  ' WHEN 2 THEN 'n.a.' WHEN 3 THEN (l_quantity + 0.5)::VARCHAR
   WHEN 4 THEN ' ' || (l_quantity::BIGINT)::VARCHAR || ' ' ELSE (l_quantity::BIGINT * 10)::VARCHAR END"""


@query("F6_count_markers", f"""
  WITH t AS (SELECT l_suppkey, trim({_RAW_COUNT}) AS t FROM lineitem),
  n AS (SELECT *, try_cast(t AS DOUBLE) AS v FROM t)
  SELECT l_suppkey, coalesce(CASE WHEN t = '-' THEN 'nil_or_negligible' WHEN t = '' THEN 'missing' WHEN v IS NULL THEN 'unknown:' || t
      WHEN v <> floor(v) THEN 'non_integer:' || t END, 'numeric') AS marker,
    count(*) AS rows, sum(CASE WHEN t = '-' THEN 0 WHEN v = floor(v) THEN v END)::BIGINT AS total FROM n GROUP BY 1, 2""")
def count_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    quantity, number = F.col("l_quantity"), F.col("l_linenumber") % 7
    whole = quantity.cast("bigint")
    raw = (
        F.when(number == 0, "-").when(number == 1, "  ").when(number == 2, "n.a.")
        .when(number == 3, (quantity + 0.5).cast("string"))
        .when(number == 4, F.concat(F.lit(" "), whole, F.lit(" "))).otherwise((whole * 10).cast("string"))
    )
    parsed = table(spark, sf_dir, "lineitem").select("l_suppkey", numbers.parse_count(raw).alias("p"))
    return parsed.groupBy("l_suppkey", F.coalesce("p.marker", F.lit("numeric")).alias("marker")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("p.count").alias("total")
    )


def _hash_sql(prefix: str, separator: str, *parts: str) -> str:
    return f"'{prefix}' || upper(substr(sha256(concat_ws({separator}, {', '.join(parts)})), 1, 16))"


@query("F7_hash_ids", f"""SELECT c_custkey,
  {_hash_sql('BRAND_', 'chr(31)', 'c_mktsegment')} AS brand_id,
  {_hash_sql('BRANCH_', 'chr(31)', 'c_mktsegment', 'c_name', "''")} AS branch_id,
  {_hash_sql('OFFER_', 'chr(31)', 'c_name', "'MATH'", 'c_nationkey::VARCHAR')} AS offering_id,
  {_hash_sql('EVID_', 'chr(31)', 'c_name', "'S1'", "'2024-01-30'", 'c_mktsegment')} AS evidence_id,
  {_hash_sql('QRY_', 'chr(31)', 'c_nationkey::VARCHAR', "'web'", 'c_name')} AS query_id,
  {_hash_sql('CREV_', 'chr(31)', "'branch'", 'c_name', "'open'")} AS review_id,
  {_hash_sql('STC_', 'chr(31)', 'c_name')} AS complex_id,
  {_hash_sql('NODE_', 'chr(31)', 'c_name')} AS node_id,
  {_hash_sql('CW_', "'|'", 'c_name', 'c_custkey::VARCHAR', "'1,2'", "'walk'")} AS request_id FROM customer""")
def hash_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, segment, nation = F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", ids.brand_id(segment).alias("brand_id"),
        ids.branch_id(segment, name, F.lit(None)).alias("branch_id"),
        ids.offering_id(name, F.lit("MATH"), nation).alias("offering_id"),
        ids.evidence_id(name, F.lit("S1"), F.lit("2024-01-30"), segment).alias("evidence_id"),
        ids.query_id(nation, F.lit("web"), name).alias("query_id"),
        ids.review_id(F.lit("branch"), name, F.lit("open")).alias("review_id"),
        ids.station_complex_id(name).alias("complex_id"), ids.node_id(name).alias("node_id"),
        ids.walk_request_id(name, F.col("c_custkey"), F.lit("1,2")).alias("request_id"),
    )


def _projection_sql(tm: projection.TransverseMercator) -> str:
    a, b, d = tm.alpha(), tm.beta(), tm.delta()
    k = repr(tm.scale * tm.rectifying_radius)
    north0 = repr(tm.origin_northing())
    inverse = " ".join(f"- ({b[j - 1]!r}) * sin({2 * j}*xi0) * cosh({2 * j}*eta0)" for j in (1, 2, 3))
    inverse_eta = " ".join(f"- ({b[j - 1]!r}) * cos({2 * j}*xi0) * sinh({2 * j}*eta0)" for j in (1, 2, 3))
    latitude = " ".join(f"+ ({d[j - 1]!r}) * sin({2 * j}*chi)" for j in (1, 2, 3))
    north = " ".join(f"+ ({a[j - 1]!r}) * sin({2 * j}*xi) * cosh({2 * j}*eta)" for j in (1, 2, 3))
    east = " ".join(f"+ ({a[j - 1]!r}) * cos({2 * j}*xi) * sinh({2 * j}*eta)" for j in (1, 2, 3))
    e = repr(tm.eccentricity)
    return f"""s1 AS (SELECT *, (y - {tm.false_northing} + {north0}) / {k} AS xi0, (x - {tm.false_easting}) / {k} AS eta0 FROM origins),
    s2 AS (SELECT *, xi0 {inverse} AS xi9, eta0 {inverse_eta} AS eta9 FROM s1),
    s3 AS (SELECT *, asin(sin(xi9) / cosh(eta9)) AS chi FROM s2),
    s4 AS (SELECT *, {tm.origin_longitude!r} + degrees(atan2(sinh(eta9), cos(xi9))) AS longitude, degrees(chi {latitude}) AS latitude FROM s3),
    s5 AS (SELECT *, radians(longitude - {tm.origin_longitude!r}) AS lam, sin(radians(latitude)) AS sp FROM s4),
    s6 AS (SELECT *, sinh(atanh(sp) - {e} * atanh({e} * sp)) AS t FROM s5),
    s7 AS (SELECT *, atan2(t, cos(lam)) AS xi, asinh(sin(lam) / sqrt(t*t + cos(lam)*cos(lam))) AS eta FROM s6)
    SELECT origin_id, round(longitude, 9) AS longitude, round(latitude, 9) AS latitude,
      round({tm.false_easting} + {k} * (eta {east}), 3) AS easting,
      round({tm.false_northing} - {north0} + {k} * (xi {north}), 3) AS northing FROM s7"""


@query("F8_projection", with_views("origins", "WITH " + _projection_sql(projection.TransverseMercator())))
def project(spark: SparkSession, sf_dir: str) -> DataFrame:
    degrees = origins(spark, sf_dir).select("origin_id", projection.to_degrees(F.col("x"), F.col("y")).alias("d"))
    metres = degrees.select("origin_id", "d.*").withColumn("m", projection.to_metres(F.col("longitude"), F.col("latitude")))
    return metres.select(
        "origin_id", F.round("longitude", 9).alias("longitude"), F.round("latitude", 9).alias("latitude"),
        F.round("m.easting", 3).alias("easting"), F.round("m.northing", 3).alias("northing"),
    )


@query("F10_distance_and_rounding", with_views("origins", """
  SELECT origin_id, round_even(sqrt((x-20000)*(x-20000) + (y-12000)*(y-12000)), 3)::DOUBLE AS distance,
         printf('%.7f,%.7f', x/400000 + 103.5, y/240000 + 1.2) AS coordinate_key FROM origins"""))
def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    return origins(spark, sf_dir).select(
        "origin_id", F.bround(numbers.distance(x, y, F.lit(20000.0), F.lit(12000.0)), 3).alias("distance"),
        numbers.coordinate_key(x / 400000 + 103.5, y / 240000 + 1.2).alias("coordinate_key"),
    )


@query("F11_age_in_months", """SELECT o_orderkey, round(greatest(0, date_diff('day', o_orderdate::DATE, DATE '1998-06-01') / 30.4375::DOUBLE), 9) AS months FROM orders""")
def ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = numbers.age_in_months(F.col("o_orderdate"), F.lit("1998-06-01"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(months, 9).alias("months"))


@query("F12_F13_F14_finance", """
  WITH s AS (SELECT c_custkey, 280 + c_custkey%80 AS fee, 25 + c_custkey%300 AS variable_cost, 12000 + c_custkey%6000 AS fixed_cost,
     6000 + c_custkey%5000 AS occupancy_cost, greatest(0, floor(c_acctbal))::BIGINT AS population, c_custkey%4 AS confirmed FROM customer),
  c AS (SELECT *, fee - variable_cost AS contribution FROM s),
  b AS (SELECT *, CASE WHEN contribution > 0 THEN ceil((fixed_cost + occupancy_cost) / contribution)::BIGINT END AS break_even,
     greatest(0, 120 * contribution - fixed_cost) AS affordable_occupancy FROM c)
  SELECT c_custkey, contribution, break_even, round(break_even / 180, 9) AS break_even_utilisation,
     coalesce(break_even <= 180, false) AS capacity_feasible, affordable_occupancy,
     affordable_occupancy - occupancy_cost AS surplus_after_occupancy,
     CASE WHEN population > 0 THEN round(break_even / population, 9) END AS capture_share,
     confirmed::DOUBLE AS observed, greatest(1, confirmed)::DOUBLE AS cautious FROM b""")
def finance_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    scenarios = table(spark, sf_dir, "customer").select(
        key, (key % 80 + 280).alias("fee"), (key % 300 + 25).alias("variable_cost"),
        (key % 6000 + 12000).alias("fixed_cost"), (key % 5000 + 6000).alias("occupancy_cost"),
        F.greatest(F.lit(0), F.floor("c_acctbal")).alias("population"), (key % 4).alias("confirmed"),
    )
    return finance.financial_outputs(scenarios, capacity=180, target=120).select(
        "c_custkey", "contribution", "break_even", F.round("break_even_utilisation", 9).alias("break_even_utilisation"),
        "capacity_feasible", "affordable_occupancy", "surplus_after_occupancy",
        F.round(finance.required_capture_share(F.col("break_even"), F.col("population")), 9).alias("capture_share"),
        finance.competition_value(F.col("confirmed"), zero_caution=False).alias("observed"),
        finance.competition_value(F.col("confirmed"), zero_caution=True).alias("cautious"),
    )


@query("F15_P10_urls", r"""SELECT page_id, regexp_replace(url, '(?s)[?#].*$', '') AS clean, url IS NULL OR regexp_matches(url, '^https?://\S+$') AS valid,
  regexp_matches(url || ' x', '^https?://\S+$') AS valid_with_blank FROM pages""")
def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", text.sanitize_url(url).alias("clean"), text.is_url_or_null(url).alias("valid"),
        text.is_url_or_null(F.concat(url, F.lit(" x"))).alias("valid_with_blank"),
    )


@query("F18_json_cells", """SELECT l_suppkey, to_json(list_filter(['large', 'discounted', 'returned'],
    lambda f: (f = 'large' AND q > 45) OR (f = 'discounted' AND d > 0.05) OR (f = 'returned' AND r))) AS flags_json, count(*) AS rows
  FROM (SELECT l_suppkey, l_quantity AS q, l_discount AS d, l_returnflag = 'R' AS r FROM lineitem) GROUP BY 1, 2""")
def json_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = documents.flag_array({
        "large": F.col("l_quantity") > 45, "discounted": F.col("l_discount") > 0.05, "returned": F.col("l_returnflag") == "R",
    })
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.to_json(flags).alias("flags_json")).agg(
        F.count(F.lit(1)).alias("rows")
    )


@query("F19_finite_and_forbidden", """
  SELECT 'lineitem' AS table_name, count(*) FILTER (NOT isfinite(l_quantity) OR NOT isfinite(l_extendedprice) OR NOT isfinite(l_discount) OR NOT isfinite(l_tax)) = 0 AS numbers_finite, '[]' AS forbidden FROM lineitem
  UNION ALL SELECT 'customer', count(*) FILTER (NOT isfinite(c_acctbal)) = 0, '["address"]' FROM customer""")
def finite_and_forbidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    customers = table(spark, sf_dir, "customer").withColumn("contact", F.struct(F.col("c_name").alias("address")))

    def verdict(name: str, df: DataFrame) -> DataFrame:
        found = F.lit(str(documents.forbidden_fields(df)).replace("'", '"'))
        return df.agg(numbers.all_finite(df).alias("numbers_finite")).select(
            F.lit(name).alias("table_name"), "numbers_finite", found.alias("forbidden")
        )

    return verdict("lineitem", lines).unionByName(verdict("customer", customers))


BOUNDS = {"minimum_longitude": 103.6, "maximum_longitude": 104.1, "minimum_latitude": 1.15, "maximum_latitude": 1.48}


@query("P1_bounding_box", with_views("origins", """
  SELECT region, count(*) AS points, count(*) FILTER (x/40000*0.6 + 103.55 BETWEEN 103.6 AND 104.1 AND y/24000*0.4 + 1.1 BETWEEN 1.15 AND 1.48) AS inside
  FROM origins GROUP BY 1"""))
def bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    longitude, latitude = F.col("x") / 40000 * 0.6 + 103.55, F.col("y") / 24000 * 0.4 + 1.1
    return origins(spark, sf_dir).groupBy("region").agg(
        F.count(F.lit(1)).alias("points"), F.count_if(numbers.in_bounds(longitude, latitude, BOUNDS)).alias("inside")
    )


@query("P8_vague_leads", """SELECT conv_id, turn, role FROM conversations WHERE contains(lower(text), 'the') OR contains(lower(text), 'que ')""")
def vague_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").filter(
        text.is_vague_lead(F.col("text"), ["the", "que "])
    ).select("conv_id", "turn", "role")


@query("P11_freshness", """
  SELECT o_orderkey, coalesce(date_diff('day', try_cast(observed AS DATE), DATE '1997-06-30') BETWEEN 0 AND 90, false) AS fresh
  FROM (SELECT o_orderkey, CASE o_orderkey%5 WHEN 0 THEN 'unknown' WHEN 1 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS observed FROM orders)""")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    observed = F.when(key % 5 == 0, "unknown").when(key % 5 == 1, None).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf_dir, "orders").select(key, numbers.is_fresh(observed, F.lit("1997-06-30"), 90).alias("fresh"))


@query("P12_optional_casts", """
  SELECT o_orderkey, try_cast(nullif(trim(raw), '') AS DOUBLE) AS as_double, try_cast(nullif(trim(whole), '') AS BIGINT) AS as_int,
         lower(nullif(trim(flag), '')) = 'true' AS as_bool
  FROM (SELECT o_orderkey, CASE o_orderkey%4 WHEN 0 THEN '' WHEN 1 THEN ' ' ELSE ' ' || (o_orderkey / 4)::VARCHAR END AS raw,
               CASE o_orderkey%3 WHEN 0 THEN '' WHEN 1 THEN 'x' ELSE o_orderkey::VARCHAR END AS whole,
               CASE o_orderkey%4 WHEN 0 THEN 'True' WHEN 1 THEN 'false' WHEN 2 THEN ' ' ELSE 'TRUE ' END AS flag FROM orders)""")
def optional_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    raw = F.when(key % 4 == 0, "").when(key % 4 == 1, " ").otherwise(F.concat(F.lit(" "), (key / 4).cast("string")))
    whole = F.when(key % 3 == 0, "").when(key % 3 == 1, "x").otherwise(key.cast("string"))
    flag = F.when(key % 4 == 0, "True").when(key % 4 == 1, "false").when(key % 4 == 2, " ").otherwise("TRUE ")
    return table(spark, sf_dir, "orders").select(
        key, numbers.optional_double(raw).alias("as_double"), numbers.optional_int(whole).alias("as_int"),
        numbers.optional_bool(flag).alias("as_bool"),
    )


@query("P13_explorer", with_views("nodes", """
  WITH r AS (SELECT *, row_number() OVER (ORDER BY y DESC, node_id) AS rank FROM nodes)
  SELECT node_id, node_name, region, rank, rank <= 10 AS leader FROM r
  WHERE region = 'ASIA' AND (contains(lower(node_name), '0') OR contains(lower(area), '0'))"""))
def explorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    from areascreen.catalog.views import nodes

    ranked = ranking.descending_rank(nodes(spark, sf_dir), "y", "node_id")
    matches = text.contains_text(F.col("node_name"), "0") | text.contains_text(F.col("area"), "0")
    return ranked.filter((F.col("region") == "ASIA") & matches).select(
        "node_id", "node_name", "region", "rank", (F.col("rank") <= 10).alias("leader")
    )
