"""Population cleaning, exact joins, set operations, run reconciliation and quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from areascreen.catalog.decide import SCREEN_SQL, measures, screened
from areascreen.catalog.registry import query
from areascreen.catalog.views import nodes, origins, table, trip_plan, trip_rows, with_views
from areascreen.operators import joins, population, quality, selection, stats
from areascreen.plans import competition, decision, sensitivity, signals
from areascreen.plans.proximity import proximity_checks
from areascreen.sources import manifest

RAW_SQL = r"""raw AS (SELECT planning_area, subzone, age, sex, CASE WHEN n%17 = 0 THEN '-' WHEN n%101 = 0 THEN 'n.a.' ELSE n::VARCHAR END AS count_raw FROM (
   SELECT ' AREA ' || (c_nationkey)::VARCHAR AS planning_area, 'ZONE ' || (c_custkey%400)::VARCHAR || ' ' AS subzone, (c_custkey//400 % 5 + 7)::VARCHAR AS age, s.sex, (floor(abs(c_acctbal)/10)::BIGINT * 10 + c_custkey%3) // s.d AS n
   FROM (SELECT c_custkey, (c_custkey%400)%25 AS c_nationkey, c_acctbal FROM customer), (VALUES ('Total', 1), ('Males', 2), ('Females', 3)) s(sex, d)
   UNION ALL SELECT 'AREA ' || n_nationkey::VARCHAR, 'Total', a::VARCHAR, 'Total', n_nationkey*1000 + a FROM nation, range(7, 12) t(a)
   UNION ALL SELECT 'Total', 'Total', a::VARCHAR, 'Total', 500000 + a FROM (SELECT DISTINCT c_custkey%5 + 7 AS a FROM customer))
   UNION ALL SELECT 'Note about ' || r_name, ' ', '', '', '' FROM region),
 par AS (SELECT trim(planning_area) AS planning_area, trim(subzone) AS subzone, trim(age) AS age, try_cast(trim(age) AS INT) AS age_years, trim(sex) AS sex,
   CASE WHEN trim(count_raw) = '-' THEN 0 ELSE try_cast(trim(count_raw) AS BIGINT) END AS count, CASE WHEN trim(count_raw) = '-' THEN 'nil_or_negligible' WHEN trim(count_raw) = '' THEN 'missing' WHEN try_cast(trim(count_raw) AS DOUBLE) IS NULL THEN 'unknown:' || trim(count_raw) END AS marker,
   CASE WHEN trim(planning_area) = 'Total' AND trim(subzone) = 'Total' THEN 'national' WHEN trim(planning_area) <> 'Total' AND trim(subzone) = 'Total' THEN 'planning_area' WHEN trim(planning_area) = 'Total' THEN 'other' ELSE 'subzone' END AS level
   FROM raw WHERE NOT (trim(subzone) = '' AND trim(age) = '' AND trim(sex) = ''))"""


def raw_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    sexes = F.explode(F.array(*[F.struct(F.lit(s).alias("sex"), F.lit(d).alias("d")) for s, d in (("Total", 1), ("Males", 2), ("Females", 3))]))
    customers = table(spark, sf_dir, "customer")
    detail = customers.select("c_custkey", "c_acctbal", sexes.alias("s")).select(
        F.concat(F.lit(" AREA "), (key % 400) % 25).alias("planning_area"), F.concat(F.lit("ZONE "), key % 400, F.lit(" ")).alias("subzone"),
        (F.floor(key / 400) % 5 + 7).cast("string").alias("age"), F.col("s.sex").alias("sex"),
        F.floor((F.floor(F.abs("c_acctbal") / 10) * 10 + key % 3) / F.col("s.d")).alias("n"),
    )
    areas = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(7), F.lit(11))).alias("a")).select(
        F.concat(F.lit("AREA "), F.col("n_nationkey")).alias("planning_area"), F.lit("Total").alias("subzone"), F.col("a").cast("string").alias("age"),
        F.lit("Total").alias("sex"), (F.col("n_nationkey") * 1000 + F.col("a")).cast("bigint").alias("n"),
    )
    national = customers.select((key % 5 + 7).alias("a")).distinct().select(
        F.lit("Total").alias("planning_area"), F.lit("Total").alias("subzone"), F.col("a").cast("string").alias("age"), F.lit("Total").alias("sex"), (F.col("a") + 500000).alias("n")
    )
    counted = detail.unionByName(areas).unionByName(national)
    marker = F.when(F.col("n") % 17 == 0, "-").when(F.col("n") % 101 == 0, "n.a.").otherwise(F.col("n").cast("string"))
    notes = table(spark, sf_dir, "region").select(
        F.concat(F.lit("Note about "), "r_name").alias("planning_area"), F.lit(" ").alias("subzone"), F.lit("").alias("age"), F.lit("").alias("sex"), F.lit("").alias("count_raw")
    )
    return counted.withColumn("count_raw", marker).drop("n").unionByName(notes)


@query("P4_P5_population_levels", with_views("origins", f"WITH {RAW_SQL} SELECT level, sex, coalesce(marker, 'numeric') AS marker, count(*) AS rows, coalesce(sum(count), -1)::BIGINT AS total FROM par WHERE age_years BETWEEN 7 AND 10 GROUP BY 1, 2, 3"))
def population_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = population.target_slice(population.parsed_rows(raw_population(spark, sf_dir)), 7, 10)
    return rows.groupBy("level", "sex", F.coalesce("marker", F.lit("numeric")).alias("marker")).agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("count"), F.lit(-1)).alias("total")
    )


@query("A1_population_proxy", f"""WITH {RAW_SQL},
  g AS (SELECT planning_area, subzone, sum(count)::BIGINT AS s, count(DISTINCT age_years) AS observed_ages, count(*) AS component_count, count(*) FILTER (count IS NULL) AS null_count, count(*) FILTER (marker = 'nil_or_negligible') AS nil_count
    FROM par WHERE level = 'subzone' AND sex = 'Total' AND age_years BETWEEN 7 AND 9 GROUP BY 1, 2)
  SELECT planning_area, subzone, observed_ages, component_count, null_count, nil_count, observed_ages = 3 AND null_count = 0 AS complete, coalesce(CASE WHEN observed_ages = 3 AND null_count = 0 THEN s END, -1) AS population, component_count * 10 / 2 AS maximum_rounding_error FROM g""")
def population_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    proxy = population.population_proxy(population.parsed_rows(raw_population(spark, sf_dir)), low=7, high=9)
    return proxy.withColumn("population", F.coalesce("population", F.lit(-1)))


@query("A2_sex_reconciliation", f"""WITH {RAW_SQL},
  g AS (SELECT planning_area, subzone, age_years, max(count) FILTER (sex = 'Total') - max(count) FILTER (sex = 'Males') - max(count) FILTER (sex = 'Females') AS difference FROM par WHERE level = 'subzone' AND age_years BETWEEN 7 AND 16 GROUP BY 1, 2, 3)
  SELECT planning_area, subzone, age_years, coalesce(difference, -999999) AS difference FROM g""")
def sex_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = population.sex_reconciliation(population.parsed_rows(raw_population(spark, sf_dir)), low=7, high=16)
    return result.withColumn("difference", F.coalesce("difference", F.lit(-999999)))


@query("A3_published_reconciliation", f"""WITH {RAW_SQL}, t AS (SELECT * FROM par WHERE sex = 'Total' AND age_years BETWEEN 7 AND 16),
  a AS (SELECT planning_area, age_years, max(count) FILTER (level = 'planning_area') AS published, coalesce(sum(count) FILTER (level = 'subzone'), 0)::BIGINT AS detail FROM t WHERE level IN ('subzone', 'planning_area') GROUP BY 1, 2),
  n AS (SELECT 'Total' AS planning_area, -1 AS age_years, coalesce(sum(count) FILTER (level = 'national'), 0)::BIGINT AS published, coalesce(sum(count) FILTER (level = 'subzone'), 0)::BIGINT AS detail FROM t)
  SELECT *, detail - published AS difference FROM (SELECT * FROM a WHERE published IS NOT NULL UNION ALL SELECT * FROM n)""")
def published_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = population.published_reconciliation(population.parsed_rows(raw_population(spark, sf_dir)), low=7, high=16)
    return result.withColumn("age_years", F.coalesce("age_years", F.lit(-1)))


CROSSWALK_SQL = """l AS (SELECT DISTINCT ' ' || lower(p_name) || ' ' AS name, p_type AS kind FROM part),
  r AS (SELECT p_partkey AS geo_id, CASE WHEN p_size > 43 THEN p_name ELSE p_name || ' ' || p_partkey::VARCHAR END AS area_name, p_type AS area_kind FROM part),
  t AS (SELECT upper(trim(area_name)) AS k0, upper(trim(area_kind)) AS k1, count(*) AS n, min(geo_id) AS geo_id FROM r GROUP BY 1, 2),
  x AS (SELECT l.*, CASE WHEN n IS NULL THEN 'unmatched' WHEN n = 1 THEN 'matched' ELSE 'ambiguous' END AS match_status, CASE WHEN n = 1 THEN geo_id END AS geo_id FROM l LEFT JOIN t ON upper(trim(name)) = k0 AND upper(trim(kind)) = k1)"""


def crosswalk_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    parts = table(spark, sf_dir, "part")
    left = parts.select(F.concat(F.lit(" "), F.lower("p_name"), F.lit(" ")).alias("name"), F.col("p_type").alias("kind")).distinct()
    own_name = F.when(F.col("p_size") > 43, F.col("p_name")).otherwise(F.concat_ws(" ", "p_name", "p_partkey"))
    right = parts.select(
        F.col("p_partkey").alias("geo_id"), own_name.alias("area_name"),
        F.col("p_type").alias("area_kind"),
    )
    return left, right


@query("J1_exact_crosswalk", f"WITH {CROSSWALK_SQL} SELECT name, kind, match_status, coalesce(geo_id, -1) AS geo_id FROM x")
def exact_crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = crosswalk_sides(spark, sf_dir)
    matched = joins.exact_crosswalk(left, right, names=[("name", "area_name"), ("kind", "area_kind")], identifier="geo_id")
    return matched.withColumn("geo_id", F.coalesce("geo_id", F.lit(-1)))


@query("J1_never_matched", f"WITH {CROSSWALK_SQL} SELECT geo_id FROM r WHERE geo_id NOT IN (SELECT geo_id FROM x WHERE geo_id IS NOT NULL)")
def never_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = crosswalk_sides(spark, sf_dir)
    matched = joins.exact_crosswalk(left, right, names=[("name", "area_name"), ("kind", "area_kind")], identifier="geo_id")
    return joins.never_matched(right, matched, "geo_id").select("geo_id")


@query("J2_must_match", """SELECT count(*) FILTER (s_suppkey IS NULL) AS unmatched_rows, count(*) AS rows FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_acctbal > 0""")
def must_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    suppliers = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return joins.must_match(lines, suppliers, ["l_suppkey"])[1]


@query("J13_A7_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("A8_frequencies", "SELECT event_type, CASE WHEN value > 10 THEN 'high' ELSE 'low' END AS level, count(*) AS rows FROM events GROUP BY 1, 2")
def frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("level", F.when(F.col("value") > 10, "high").otherwise("low"))
    return joins.frequencies(rows, ["event_type", "level"])


@query("A25_functional_dependency", """
  SELECT 'c_nationkey_to_c_mktsegment' AS direction, c_nationkey::VARCHAR AS value, count(DISTINCT c_mktsegment) AS partners FROM customer GROUP BY c_nationkey HAVING count(DISTINCT c_mktsegment) > 1
  UNION ALL SELECT 'c_mktsegment_to_c_nationkey', c_mktsegment, count(DISTINCT c_nationkey) FROM customer GROUP BY c_mktsegment HAVING count(DISTINCT c_nationkey) > 1""")
def functional_dependency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.functional_dependency(table(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment")


@query("A24_channel_overlap", """
  WITH p AS (SELECT user_id, bool_or(event_type IN ('click', 'view')) AS a, bool_or(event_type = 'purchase' AND value > 30) AS b FROM events GROUP BY 1),
  c AS (SELECT count(*) FILTER (a) AS a_count, count(*) FILTER (b) AS b_count, count(*) FILTER (a AND b) AS overlap_count, count(*) FILTER (a AND NOT b) AS unique_to_a, count(*) FILTER (b AND NOT a) AS unique_to_b, count(*) FILTER (a OR b) AS union_count FROM p)
  SELECT *, round(overlap_count / union_count, 9) AS jaccard FROM c""")
def channel_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    result = stats.channel_overlap(
        table(spark, sf_dir, "events"), "user_id", kind.isin("click", "view"), (kind == "purchase") & (F.col("value") > 30)
    )
    return result.withColumn("jaccard", F.round("jaccard", 9))


@query("A28_area_yield", with_views("origins", """
  SELECT area, coalesce(searched, 0) AS searched, coalesce(located, 0) AS located FROM (SELECT area, count(*) AS searched FROM origins GROUP BY 1)
  FULL JOIN (SELECT 'NATION_' || (floor(x/8000)::BIGINT + 5*floor(y/4800)::BIGINT)::VARCHAR AS area, count(*) AS located FROM origins GROUP BY 1) USING (area)"""))
def area_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = origins(spark, sf_dir)
    located = F.concat(F.lit("NATION_"), F.floor(F.col("x") / 8000) + 5 * F.floor(F.col("y") / 4800))
    a = joins.frequencies(rows, ["area"], count="searched")
    b = joins.frequencies(rows.select(located.alias("area")), ["area"], count="located")
    return a.join(b, "area", "full_outer").na.fill(0, ["searched", "located"])


EVIDENCE_SQL = """fam AS (SELECT l_suppkey AS node_id, b.buffer AS buffer_metres, count(*) FILTER (l_linenumber <= b.n AND l_quantity >= 48) AS zoning, count(*) FILTER (l_linenumber <= b.n AND l_quantity >= 49 AND l_discount > 0.05) AS retail FROM lineitem, (VALUES (400, 1), (800, 2)) b(buffer, n) GROUP BY 1, 2),
  ev AS (SELECT node_id, 'zoning' AS signal_key, buffer_metres, 'observed' AS measurement_status, zoning > 8 AS positive_signal, zoning AS feature_count FROM fam
    UNION ALL SELECT node_id, 'retail', buffer_metres, CASE WHEN node_id%11 = 0 THEN 'missing' ELSE 'observed' END, CASE WHEN node_id%11 = 0 THEN NULL ELSE retail > 2 END, CASE WHEN node_id%11 <> 0 THEN retail END FROM fam)"""


def evidence_families(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    buffers = F.explode(F.array(*[F.struct(F.lit(b).cast("bigint").alias("buffer_metres"), F.lit(n).alias("n")) for b, n in ((400, 1), (800, 2))]))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("node_id"), "l_linenumber", "l_quantity", "l_discount", buffers.alias("b"))
    inside = F.col("l_linenumber") <= F.col("b.n")
    fam = rows.groupBy("node_id", F.col("b.buffer_metres").alias("buffer_metres")).agg(
        F.count_if(inside & (F.col("l_quantity") >= 48)).alias("zoning"),
        F.count_if(inside & (F.col("l_quantity") >= 49) & (F.col("l_discount") > 0.05)).alias("retail"),
    )
    absent = F.col("node_id") % 11 == 0
    first = fam.select(
        "node_id", F.lit("zoning").alias("signal_key"), "buffer_metres", F.lit("observed").alias("measurement_status"),
        (F.col("zoning") > 8).alias("positive_signal"), F.col("zoning").alias("feature_count"),
    )
    second = fam.select(
        "node_id", F.lit("retail").alias("signal_key"), "buffer_metres", F.when(absent, "missing").otherwise("observed").alias("measurement_status"),
        F.when(~absent, F.col("retail") > 2).alias("positive_signal"), F.when(~absent, F.col("retail")).alias("feature_count"),
    )
    return first, second


@query("U1_combined_evidence", f"WITH {EVIDENCE_SQL} SELECT node_id, signal_key, buffer_metres, measurement_status, coalesce(positive_signal::VARCHAR, 'unknown') AS positive_signal, coalesce(feature_count, -1) AS feature_count FROM ev")
def combined_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence, _ = signals.combined_evidence(*evidence_families(spark, sf_dir))
    return evidence.withColumn("positive_signal", F.coalesce(F.col("positive_signal").cast("string"), F.lit("unknown"))).withColumn(
        "feature_count", F.coalesce("feature_count", F.lit(-1))
    )


@query("J14_U7_key_sets", f"""WITH {EVIDENCE_SQL}, a AS (SELECT DISTINCT node_id, buffer_metres FROM ev WHERE signal_key = 'zoning' AND feature_count > 8), b AS (SELECT DISTINCT node_id, buffer_metres FROM ev WHERE signal_key = 'retail' AND positive_signal)
  SELECT node_id, buffer_metres, 'missing' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT node_id, buffer_metres, 'unexpected' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = evidence_families(spark, sf_dir)
    return joins.key_set_difference(first.filter("feature_count > 8"), second.filter("positive_signal"), ["node_id", "buffer_metres"])


@query("A12_E14_qualification", f"""WITH {EVIDENCE_SQL},
  r AS (SELECT node_id, count(DISTINCT signal_key) FILTER (measurement_status = 'observed' AND positive_signal) AS positive_signals, count(DISTINCT signal_key) FILTER (measurement_status = 'missing') AS missing_signals FROM ev WHERE buffer_metres = 800 GROUP BY 1),
  o AS (SELECT s_suppkey AS node_id, (s_suppkey%9 = 0)::BIGINT AS open_reviews FROM supplier)
  SELECT r.*, coalesce(open_reviews, 0) AS open_reviews, CASE WHEN open_reviews > 0 THEN 'needs_manual_review' WHEN positive_signals >= 2 THEN 'qualified' WHEN positive_signals > 0 THEN 'provisional' ELSE 'needs_manual_review' END AS qualification_status FROM r LEFT JOIN o USING (node_id)""")
def qualification(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence, _ = signals.combined_evidence(*evidence_families(spark, sf_dir))
    reviews = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("node_id"), F.when(F.col("s_suppkey") % 9 == 0, "open").otherwise("closed").alias("status")
    )
    return signals.qualify(evidence, reviews, largest_buffer=800, required=2)


@query("P6_accepted_categories", """
  SELECT category, count(n) AS rows, count(n) = 0 AS never_observed FROM (VALUES ('BUILDING'), ('MACHINERY'), ('WHITE SITE')) v(category) LEFT JOIN (SELECT upper(trim(c_mktsegment)) AS n FROM customer) ON n = category GROUP BY 1""")
def accepted_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    from areascreen.sources.readers import accepted_category_counts

    return accepted_category_counts(table(spark, sf_dir, "customer"), "c_mktsegment", ["BUILDING", "MACHINERY", "WHITE SITE"])


ATTEMPT_SQL = """att AS (SELECT event_id AS attempt_id, CASE WHEN event_id%20 = 0 THEN 'AGGREGATE_ALL_ADDRESSES' ELSE 'a' END AS address_key, [event_id, (event_id + 1 + event_id%3)] AS obs FROM events),
  lnk AS (SELECT attempt_id, unnest(obs) AS observation_id FROM att WHERE address_key <> 'AGGREGATE_ALL_ADDRESSES')"""


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        key.alias("attempt_id"), F.when(key % 20 == 0, "AGGREGATE_ALL_ADDRESSES").otherwise("a").alias("address_key"),
        F.array(key, key + 1 + key % 3).alias("source_observation_ids"),
    )


@query("J18_observation_links", f"WITH {ATTEMPT_SQL} SELECT observation_id, count(*) AS attempts FROM lnk GROUP BY 1 HAVING count(*) > 1")
def observation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.link_observations(attempts(spark, sf_dir), aggregate_marker="AGGREGATE_ALL_ADDRESSES")[1]


@query("J19_branch_validations", f"WITH {ATTEMPT_SQL} SELECT DISTINCT event_id//4 AS branch_id, attempt_id FROM events JOIN lnk ON event_id = observation_id")
def branch_validations(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, _ = joins.link_observations(attempts(spark, sf_dir), aggregate_marker="AGGREGATE_ALL_ADDRESSES")
    members = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 4).alias("branch_id"), F.col("event_id").alias("candidate_id"))
    return joins.branch_validations(members, links)


TEMPLATES = [("directory", "T1", "{area} mathematics lessons"), ("directory", "T2", "{area} lesson centre"), ("web", "T1", "primary maths {area}")]
PROTOCOL_SQL = """proto AS (SELECT c_custkey AS area_code, c_mktsegment || ' ' || c_custkey::VARCHAR AS area_name, channel, template, replace(pattern, '{area}', upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' ' || c_custkey::VARCHAR) AS query_text,
   'QRY_' || upper(substr(sha256(concat_ws(chr(31), c_custkey::VARCHAR, channel, template)), 1, 16)) AS query_id
   FROM customer, (VALUES ('directory', 'T1', '{area} mathematics lessons'), ('directory', 'T2', '{area} lesson centre'), ('web', 'T1', 'primary maths {area}')) t(channel, template, pattern))"""


def protocol(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("area_code"), F.concat("c_mktsegment", F.lit(" "), F.col("c_custkey").cast("string")).alias("area_name")
    )
    return joins.expected_protocol(areas, TEMPLATES)


@query("J21_protocol", f"WITH {PROTOCOL_SQL} SELECT * FROM proto")
def protocol_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return protocol(spark, sf_dir)


ROLE_SQL = """roles AS (SELECT l_suppkey AS node_id, 'Node ' || l_suppkey::VARCHAR || CASE WHEN l_suppkey%19 = 0 AND l_linenumber = 7 THEN '!' ELSE '' END AS node_name, CASE WHEN l_suppkey%3 = 0 AND l_linenumber <= 2 THEN 'candidate' WHEN l_suppkey%2 = 0 AND l_linenumber <= 5 THEN 'outside_audit' ELSE 'benchmark' END AS role
    FROM lineitem),
  merged AS (SELECT node_id, min(node_name) AS node_name, count(DISTINCT node_name) AS names, min(CASE role WHEN 'candidate' THEN 1 WHEN 'outside_audit' THEN 2 ELSE 3 END) AS p, count(DISTINCT role) AS role_count FROM roles GROUP BY 1)"""


def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    node, line = F.col("l_suppkey"), F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        node.alias("node_id"), F.concat(F.lit("Node "), node, F.when((node % 19 == 0) & (line == 7), "!").otherwise("")).alias("node_name"),
        F.when((node % 3 == 0) & (line <= 2), "candidate").when((node % 2 == 0) & (line <= 5), "outside_audit").otherwise("benchmark").alias("role"),
    )


@query("J22_schedule", f"WITH {ROLE_SQL} SELECT node_id, node_name, (['candidate', 'outside_audit', 'benchmark'])[p] AS role, role_count, template FROM merged, (VALUES ('T1'), ('T2')) t(template)")
def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.target_schedule(roles(spark, sf_dir), ["T1", "T2"], ["candidate", "outside_audit", "benchmark"])[0]


@query("J22_conflicts", f"WITH {ROLE_SQL} SELECT node_id, names FROM merged WHERE names > 1")
def schedule_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.target_schedule(roles(spark, sf_dir), ["T1", "T2"], ["candidate", "outside_audit", "benchmark"])[1]


@query("J23_log_reconciliation", f"""WITH {PROTOCOL_SQL},
  log AS (SELECT CASE WHEN area_code%40 = 1 THEN 'EXTRA_' || query_id ELSE query_id END AS query_id, channel, CASE WHEN area_code%30 = 2 THEN 'T9' ELSE template END AS template, area_code%4 AS reported_count, area_code%4 = 0 AS zero_result FROM proto WHERE NOT contains(area_name, '33')),
  ob AS (SELECT query_id, 'Brand ' || (area_code%3)::VARCHAR AS brand_name, 'Addr ' || (i // 2)::VARCHAR AS address_raw FROM proto, range(0, 3) r(i) WHERE i < area_code%4),
  ln AS (SELECT query_id, sum(n)::BIGINT AS linked_count, sum(n-1)::BIGINT AS duplicate_signatures FROM (SELECT query_id, upper(brand_name), upper(address_raw), count(*) AS n FROM ob GROUP BY 1, 2, 3) GROUP BY 1)
  SELECT query_id, CASE WHEN l.channel IS NULL THEN 'missing' WHEN p.channel IS NULL THEN 'unexpected' ELSE 'present' END AS presence, coalesce(l.channel = p.channel AND l.template = p.template, false) AS fields_match,
    coalesce(linked_count, 0) AS linked_count, coalesce(duplicate_signatures, 0) AS duplicate_signatures, coalesce(reported_count = coalesce(linked_count, 0), false) AS count_reconciled, coalesce(zero_result = (coalesce(linked_count, 0) = 0), false) AS zero_consistent
  FROM proto p FULL JOIN log l USING (query_id) LEFT JOIN ln USING (query_id)""")
def log_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = protocol(spark, sf_dir)
    code = F.col("area_code")
    log = expected.filter(~F.contains("area_name", F.lit("33"))).select(
        F.when(code % 40 == 1, F.concat(F.lit("EXTRA_"), "query_id")).otherwise(F.col("query_id")).alias("query_id"), "channel",
        F.when(code % 30 == 2, "T9").otherwise(F.col("template")).alias("template"), (code % 4).alias("reported_count"), (code % 4 == 0).alias("zero_result"),
    )
    numbered = F.explode(F.when(code % 4 > 0, F.sequence(F.lit(0), (code % 4 - 1).cast("int"))))
    observed = expected.withColumn("i", numbered).select(
        "query_id", F.concat(F.lit("Brand "), code % 3).alias("brand_name"), F.concat(F.lit("Addr "), F.floor(F.col("i") / 2)).alias("address_raw")
    )
    return joins.reconcile_log(expected, log, observed, ["channel", "template"])


@query("J24_J25_integrity", """
  WITH b AS (SELECT o_orderkey AS branch_id, o_custkey AS brand_id FROM orders), br AS (SELECT c_custkey AS brand_id FROM customer WHERE c_acctbal > 0), e AS (SELECT l_orderkey AS branch_id FROM lineitem), o AS (SELECT event_id * 2 AS branch_id FROM events),
  c AS (SELECT count(DISTINCT branch_id) AS branch_count, (SELECT count(*) FROM b WHERE brand_id NOT IN (SELECT brand_id FROM br)) AS branches_without_brand, (SELECT count(*) FROM e WHERE branch_id NOT IN (SELECT branch_id FROM b)) AS evidence_without_branch,
    (SELECT count(*) FROM o WHERE branch_id NOT IN (SELECT branch_id FROM b)) AS offerings_without_branch, (SELECT count(*) FROM br WHERE brand_id NOT IN (SELECT brand_id FROM b)) AS brands_without_branch FROM b)
  SELECT *, branches_without_brand + evidence_without_branch + offerings_without_branch + brands_without_branch = 0 AS valid FROM c""")
def integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("branch_id"), F.col("o_custkey").alias("brand_id"))
    brands = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("brand_id"))
    evidence = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("branch_id"))
    offerings = table(spark, sf_dir, "events").select((F.col("event_id") * 2).alias("branch_id"))
    return joins.referential_integrity(orders, brands, evidence, offerings)


@query("J25_retained_only", """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)""")
def retained_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    retained = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("l_suppkey"))
    kept, _ = joins.retained_only(table(spark, sf_dir, "lineitem"), retained, "l_suppkey")
    return kept.select("l_orderkey", "l_linenumber", "l_quantity")


@query("J28_explorer_rows", with_views("nodes", f"WITH {SCREEN_SQL} SELECT n.node_id, n.region, coalesce(transit_accessibility, 0) AS transit_accessibility, x, y FROM nodes n LEFT JOIN (SELECT * FROM measures WHERE transit_accessibility > 5000) USING (node_id)"))
def explorer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_nodes = nodes(spark, sf_dir)
    access = measures(spark, sf_dir).filter("transit_accessibility > 5000").select("node_id", "transit_accessibility")
    return joins.explorer_rows(all_nodes.select("node_id", "region"), access, all_nodes.select("node_id", "x", "y"))


@query("U2_review_union", """
  WITH a AS (SELECT user_id AS entity, event_type AS issue, event_id AS seq, 'station' AS origin FROM events WHERE value > 20), b AS (SELECT user_id, event_type, event_id, 'node' FROM events)
  SELECT entity, issue, seq, origin FROM (SELECT *, row_number() OVER (PARTITION BY entity, issue ORDER BY part, seq) AS r FROM (SELECT *, 0 AS part FROM a UNION ALL SELECT *, 1 FROM b)) WHERE r = 1""")
def review_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("entity"), F.col("event_type").alias("issue"), F.col("event_id").alias("seq"), "value")
    parts = [events.filter("value > 20").drop("value").withColumn("origin", F.lit("station")), events.drop("value").withColumn("origin", F.lit("node"))]
    return joins.union_first(parts, ["entity", "issue"], ["seq"])


@query("U5_selection_change", """
  WITH a AS (SELECT DISTINCT l_suppkey AS node_id FROM lineitem WHERE (l_suppkey * 7 + l_linenumber) % 97 < 40 AND l_suppkey % 3 <> 0), b AS (SELECT DISTINCT l_suppkey AS node_id FROM lineitem WHERE NOT ((l_suppkey * 7 + l_linenumber) % 97 < 40 AND l_suppkey % 3 <> 0))
  SELECT node_id, CASE WHEN a.node_id IS NULL THEN 'entrant' WHEN b.node_id IS NULL THEN 'exit' ELSE 'kept' END AS change FROM a FULL JOIN b USING (node_id)""")
def selection_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("node_id"), "l_linenumber")
    side = (F.pmod(F.col("node_id") * 7 + F.col("l_linenumber"), F.lit(97)) < 40) & (F.col("node_id") % 3 != 0)  # every row is on one side
    return selection.selection_change(lines.filter(side), lines.filter(~side), "node_id")


@query("U6_partition", """
  WITH e AS (SELECT o_orderkey AS id FROM orders), r AS (SELECT l_orderkey AS id FROM lineitem WHERE l_linenumber % 2 = 1), x AS (SELECT l_orderkey + 1 AS id FROM lineitem WHERE l_linenumber % 2 = 0),
  s AS (SELECT id, count(*) AS n FROM (SELECT * FROM r UNION ALL SELECT * FROM x) GROUP BY 1), j AS (SELECT e.id IS NOT NULL AS wanted, coalesce(n, 0) AS n FROM e FULL JOIN s USING (id)),
  c AS (SELECT count(*) FILTER (wanted) AS expected, count(*) FILTER (wanted AND n = 1) AS exactly_once, count(*) FILTER (wanted AND n = 0) AS missing, count(*) FILTER (n > 1) AS duplicated, count(*) FILTER (NOT wanted) AS unexpected FROM j)
  SELECT *, missing = 0 AND duplicated = 0 AND unexpected = 0 AS valid FROM c""")
def partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return joins.partition_report(
        table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), lines.filter("l_linenumber % 2 = 1").select(F.col("l_orderkey").alias("id")),
        lines.filter("l_linenumber % 2 = 0").select((F.col("l_orderkey") + 1).alias("id")), "id",
    )


BATCH_SQL = """bat AS (SELECT c_nationkey AS batch, 'complete' AS status, count(*) AS queries, sum(c_custkey%5)::BIGINT AS routes_planned, sum(c_custkey%5)::BIGINT AS routes_completed FROM customer GROUP BY 1)"""


@query("X9_A15_ledger_totals", f"""WITH {BATCH_SQL}
  SELECT count(*) AS batches, count(*) FILTER (status <> 'complete') AS incomplete_batches, sum(queries)::BIGINT AS queries, sum(routes_planned)::BIGINT AS routes_planned, sum(routes_completed)::BIGINT AS routes_completed,
   (SELECT count(*) FROM (SELECT DISTINCT lower(trim(p_name)), lower(trim(p_brand)), p_size::VARCHAR FROM part JOIN lineitem ON p_partkey = l_partkey WHERE l_quantity > 25)) AS distinct_branches, sum(routes_planned) = sum(routes_completed) AS routes_reconcile FROM bat""")
def ledger_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    routes = F.sum(F.col("c_custkey") % 5)
    batches = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("batch")).agg(
        F.lit("complete").alias("status"), F.count(F.lit(1)).alias("queries"), routes.alias("routes_planned"), routes.alias("routes_completed")
    )
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_quantity")
    leads = lines.join(table(spark, sf_dir, "part"), "p_partkey").select(
        F.col("p_name").alias("operator_name"), F.concat(F.lit(" "), F.upper("p_brand")).alias("branch_label"), F.col("p_size").alias("postal_code"), (F.col("l_quantity") > 25).alias("eligible")
    )
    return competition.ledger_totals(batches, leads)


@query("X9_target_sets", with_views("nodes", f"WITH {SCREEN_SQL} SELECT node_id, confirmed_10, confirmed_15, CASE WHEN s_acctbal > 5000 THEN 'candidate' WHEN s_acctbal > 0 THEN 'outside_audit' ELSE 'benchmark' END AS target_set FROM measures JOIN supplier ON node_id = s_suppkey"))
def target_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = measures(spark, sf_dir).select("node_id", "confirmed_10", "confirmed_15")
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node_id"), "s_acctbal")
    return competition.target_sets(counts, suppliers.filter("s_acctbal > 5000"), suppliers.filter("s_acctbal > 0"))


@query("Q1_Q2_check_suite", """
  WITH c AS (SELECT 'keys_unique' AS check_id, CASE WHEN n > 0 THEN 'warning' ELSE 'pass' END AS status, n AS observed FROM (SELECT count(*) - count(DISTINCT l_orderkey * 100 + l_linenumber) AS n FROM lineitem)
    UNION ALL SELECT 'quantity_positive', CASE WHEN n > 0 THEN 'fail' ELSE 'pass' END, n FROM (SELECT count(*) FILTER (l_quantity <= 0) AS n FROM lineitem)
    UNION ALL SELECT 'discount_in_range', CASE WHEN n > 0 THEN 'fail' ELSE 'pass' END, n FROM (SELECT count(*) FILTER (l_discount NOT BETWEEN 0 AND 0.1) AS n FROM lineitem))
  SELECT check_id, 'lineitem' AS table_name, status, observed, (SELECT CASE WHEN bool_or(status = 'fail') THEN 'failed' WHEN bool_or(status = 'warning') THEN 'passed_with_warnings' ELSE 'passed' END FROM c) AS overall_status FROM c""")
def check_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.checks(table(spark, sf_dir, "lineitem"), {
        "keys_unique": (F.count(F.lit(1)) - F.countDistinct("l_orderkey", "l_linenumber"), "warning"),
        "quantity_positive": (F.count_if(F.col("l_quantity") <= 0), "fail"),
        "discount_in_range": (F.count_if(~F.col("l_discount").between(0, 0.1)), "fail"),
    }, table="lineitem")
    return rows.withColumn("overall_status", quality.overall_status(rows).select("overall_status").scalar())


GATES = [("feature_count", ">=", 100), ("region_count", ">=", 5), ("minimum_region_count", ">=", 10), ("positive_rate", ">=", 0.95), ("negative_rate", "<=", 0.05), ("missing_count", "<=", 0)]


@query("Q3_threshold_gates", with_views("origins", """
  WITH m AS (SELECT count(*)::DOUBLE AS feature_count, count(DISTINCT region)::DOUBLE AS region_count, (SELECT min(n) FROM (SELECT count(*) AS n FROM origins GROUP BY region))::DOUBLE AS minimum_region_count, count(*) FILTER (population > 0) / count(*) AS positive_rate,
    count(*) FILTER (population <= 0) / count(*) AS negative_rate, count(*) FILTER (population IS NULL)::DOUBLE AS missing_count FROM origins),
  g AS (SELECT 'feature_count' AS gate, feature_count AS observed, '>=100' AS required, feature_count >= 100 AS ok FROM m UNION ALL SELECT 'region_count', region_count, '>=5', region_count >= 5 FROM m UNION ALL SELECT 'minimum_region_count', minimum_region_count, '>=10', minimum_region_count >= 10 FROM m
    UNION ALL SELECT 'positive_rate', positive_rate, '>=0.95', positive_rate >= 0.95 FROM m UNION ALL SELECT 'negative_rate', negative_rate, '<=0.05', negative_rate <= 0.05 FROM m UNION ALL SELECT 'missing_count', missing_count, '<=0', missing_count <= 0 FROM m)
  SELECT gate, round(observed, 9) AS observed, required, CASE WHEN ok THEN 'pass' ELSE 'fail' END AS status, (SELECT bool_and(ok) FROM g) AS accepted FROM g"""))
def threshold_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = origins(spark, sf_dir)
    smallest = rows.groupBy("region").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("n")).scalar()
    people = F.col("population")
    metrics = rows.agg(
        F.count(F.lit(1)).alias("feature_count"), F.countDistinct("region").alias("region_count"),
        (F.count_if(people > 0) / F.count(F.lit(1))).alias("positive_rate"), (F.count_if(people <= 0) / F.count(F.lit(1))).alias("negative_rate"),
        F.count_if(people.isNull()).alias("missing_count"),
    ).withColumn("minimum_region_count", smallest)
    gates = quality.threshold_gates(metrics, GATES)
    return gates.withColumn("observed", F.round("observed", 9)).withColumn("accepted", quality.all_gates_met(gates).select("accepted").scalar())


def branches_and_reviews(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    key = F.col("o_orderkey")
    labels = F.array(F.lit("confirmed"), F.lit("possible"), F.lit("unresolved"))
    branches = table(spark, sf_dir, "orders").select(
        key.alias("branch_id"), F.when(key % 200 == 0, "ftp://x").when(key % 3 == 0, None).otherwise("https://a/b").alias("url"),
        F.when(key % 5 != 0, "p").alias("postal_code"), F.when(key % 2 != 0, "u").alias("unit"), (key % 30 != 0).alias("exact_address"),
        F.when(key % 4 != 0, F.concat(F.lit("NATION_"), F.col("o_custkey") % 25)).alias("planning_area"),
        F.when(key % 4 == 0, "unresolved_no_coordinate").when(key % 97 == 1, "searched").otherwise("coordinate_derived").alias("planning_area_source"),
        F.element_at(labels, (key % 3 + 1).cast("int")).alias("evidence_status"), (key % 7 != 0).alias("fresh_operator_evidence"),
        F.when(F.col("o_orderstatus") == "O", "current").otherwise("closed").alias("status"), ((key % 3 == 0) | (key % 100 == 1)).alias("counts_as_primary"), "o_orderpriority",
    )
    reviews = branches.filter("o_orderpriority <> '5-LOW'").select(
        F.col("branch_id").cast("string").alias("entity_reference"), F.concat(F.lit("evidence_status_"), "evidence_status").alias("issue_category")
    )
    return branches, reviews


_BRANCH_GATES_SQL = """
  WITH b AS (SELECT o_orderkey AS branch_id, CASE WHEN o_orderkey%200 = 0 THEN 'ftp://x' WHEN o_orderkey%3 = 0 THEN NULL ELSE 'https://a/b' END AS url, CASE WHEN o_orderkey%5 = 0 THEN NULL ELSE 'p' END AS postal_code, CASE WHEN o_orderkey%2 = 0 THEN NULL ELSE 'u' END AS unit,
    o_orderkey%30 <> 0 AS exact_address, CASE WHEN o_orderkey%4 = 0 THEN NULL ELSE 'NATION_' || (o_custkey%25)::VARCHAR END AS planning_area, CASE WHEN o_orderkey%4 = 0 THEN 'unresolved_no_coordinate' WHEN o_orderkey%97 = 1 THEN 'searched' ELSE 'coordinate_derived' END AS src,
    (['confirmed', 'possible', 'unresolved'])[1 + o_orderkey%3] AS es, o_orderkey%7 <> 0 AS fresh, CASE WHEN o_orderstatus = 'O' THEN 'current' ELSE 'closed' END AS status, o_orderkey%3 = 0 OR o_orderkey%100 = 1 AS prim, o_orderpriority AS pr FROM orders),
  rv AS (SELECT branch_id, 'evidence_status_' || es AS issue FROM b WHERE pr <> '5-LOW')
  SELECT 'urls_valid' AS gate, count(*) FILTER (url IS NOT NULL AND NOT regexp_matches(url, '^https?://')) AS violations FROM b UNION ALL SELECT 'no_placeholder_branches', count(*) FILTER (postal_code IS NULL AND unit IS NULL AND NOT exact_address) FROM b
  UNION ALL SELECT 'planning_areas_derived_or_unresolved', count(*) FILTER (planning_area IS NOT NULL AND src <> 'coordinate_derived') FROM b UNION ALL SELECT 'confirmed_have_fresh_evidence', count(*) FILTER (es = 'confirmed' AND NOT fresh) FROM b
  UNION ALL SELECT 'primary_is_confirmed_current', count(*) FILTER ((prim AND es <> 'confirmed') OR (status = 'current' AND es = 'unresolved')) FROM b UNION ALL SELECT 'possible_not_primary', count(*) FILTER (es = 'possible' AND prim) FROM b
  UNION ALL SELECT 'resolved_within_selected_areas', count(*) FILTER (src = 'coordinate_derived' AND planning_area NOT IN ('NATION_1', 'NATION_2', 'NATION_3')) FROM b
  UNION ALL SELECT 'review_items_enumerated', count(*) FROM b WHERE es <> 'confirmed' AND (branch_id, 'evidence_status_' || es) NOT IN (SELECT branch_id, issue FROM rv)"""


@query("Q4_branch_gates", _BRANCH_GATES_SQL)
def branch_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    branches, reviews = branches_and_reviews(spark, sf_dir)
    return quality.branch_gates(branches, reviews, ["NATION_1", "NATION_2", "NATION_3"])


@query("Q4_acceptance_gates", f"""WITH g AS ({_BRANCH_GATES_SQL}),
  silent AS (SELECT count(*) AS n FROM orders WHERE o_orderkey % 3 = 1 AND o_orderpriority = '5-LOW'),
  m AS (SELECT gate, violations + CASE WHEN gate = 'possible_not_primary' THEN (SELECT n FROM silent) ELSE 0 END AS violations FROM g
    UNION ALL SELECT 'all_queries_logged', count(*) FROM orders WHERE o_orderkey % 50 = 0
    UNION ALL SELECT 'query_integrity_reconciled', count(*) FROM orders WHERE o_orderkey % 50 <> 0 AND o_totalprice < 2000
    UNION ALL SELECT 'validation_attempts_complete', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
    UNION ALL SELECT 'csv_parquet_parity', 0
    UNION ALL SELECT 'checksums_verify', count(*) FROM supplier WHERE s_suppkey % 9 = 0
    UNION ALL SELECT 'secret_scan_pass', CASE WHEN count(*) > 0 THEN 1 ELSE 0 END FROM part WHERE contains(p_name, 'password=')
    UNION ALL SELECT 'geocoding_executed_or_validated_cache', 0
    UNION ALL SELECT 'exact_observation_provenance_partition_complete', CASE WHEN count(*) > 0 THEN 1 ELSE 0 END FROM customer WHERE c_custkey % 11 = 0
    UNION ALL SELECT 'retained_relational_integrity', CASE WHEN (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) > 0 THEN 1 ELSE 0 END)
  SELECT gate, CAST(violations AS BIGINT) AS violations, violations = 0 AS met FROM m""")
def acceptance_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    branches, reviews = branches_and_reviews(spark, sf_dir)
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    expected = orders.select(F.col("o_orderkey").alias("query_id"), "o_totalprice")
    log = expected.filter("query_id % 50 != 0")
    people = customers.select(F.col("c_custkey").alias("candidate_id"))
    kept, left = people.filter("candidate_id % 11 != 0"), people.filter("candidate_id % 22 = 0").unionByName(people.filter("candidate_id % 22 = 0"))
    recorded = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file_name"), F.col("s_name").alias("sha256"), F.lit(1).alias("byte_size"))
    observed = recorded.withColumn("sha256", F.when(F.col("file_name") % 9 == 0, "changed").otherwise(F.col("sha256")))
    owned = orders.select(F.col("o_orderkey").alias("branch_id"), F.col("o_custkey").alias("brand_id"))
    parts = table(spark, sf_dir, "part")
    return quality.acceptance_gates(
        branches, reviews, ["NATION_1", "NATION_2", "NATION_3"], expected=expected, log=log, log_errors=log.filter("o_totalprice < 2000"), candidates=people,
        attempts=orders.select(F.col("o_custkey").alias("candidate_id")), partition=joins.partition_report(people, kept, left, "candidate_id"),
        integrity=joins.referential_integrity(owned, people.withColumnRenamed("candidate_id", "brand_id"), owned, owned),
        copies=quality.parity(parts, parts.repartition("p_size")), manifest=manifest.verify_manifest(observed, recorded),
        secrets=quality.secret_scan(parts, path="p_partkey", content="p_name")[1], geocoding_source="cache")


@query("Q9_release_checks", """
  WITH c AS (SELECT s_suppkey AS node_id, s_acctbal FROM supplier WHERE s_suppkey % 3 <> 0), p AS (SELECT node_id, CASE WHEN node_id % 50 = 1 THEN NULL ELSE s_acctbal END AS score FROM c WHERE node_id % 20 <> 4 UNION ALL SELECT node_id, s_acctbal FROM c WHERE node_id % 31 = 1),
  t AS (SELECT count(*) AS n FROM (SELECT node_id FROM c LEFT JOIN (SELECT node_id, count(*) AS k FROM p GROUP BY 1) USING (node_id) WHERE k IS NULL OR k <> 1)),
  w AS (SELECT 'candidates_represented' AS check_id, n AS observed FROM t UNION ALL SELECT 'totals_reconcile', CASE WHEN (SELECT count(*) FROM lineitem) = 60000 THEN 0 ELSE 1 END UNION ALL SELECT 'numbers_finite', 0 UNION ALL SELECT 'no_private_fields', 1 UNION ALL SELECT 'association_not_causal', 0
    UNION ALL SELECT 'recommendations_hold_both_ways', count(*) FROM (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'A') AS o, count(*) FILTER (l_returnflag = 'R' AND l_quantity > 48) AS k FROM lineitem GROUP BY 1) WHERE NOT (o > 0 AND k > 0)),
  r AS (SELECT check_id, CASE WHEN observed > 0 THEN 'blocker' ELSE 'pass' END AS status, CAST(observed AS BIGINT) AS observed FROM w UNION ALL SELECT unnest(['possible_leads_not_retained', 'finance_is_illustrative']), 'warning', 0)
  SELECT *, (SELECT CASE WHEN bool_or(status = 'blocker') THEN 'blocker' ELSE 'pass_with_accepted_limitations' END FROM r) AS release_status FROM r""")
def release_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = table(spark, sf_dir, "supplier").filter("s_suppkey % 3 != 0").select(F.col("s_suppkey").alias("node_id"), F.col("s_acctbal").cast("double").alias("score"), F.col("s_name").alias("email"))
    shown = candidates.filter("node_id % 20 != 4").withColumn("score", F.when(F.col("node_id") % 50 != 1, F.col("score")))
    published = shown.unionByName(candidates.filter("node_id % 31 = 1")).select("node_id", "score", F.struct("email").alias("contact"))
    lines = table(spark, sf_dir, "lineitem")
    totals = quality.reconcile_totals(lines.agg(F.count(F.lit(1)).alias("lines")), {"lines": 60000})
    held = lines.groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "A").alias("observed_count"), F.count_if((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 48)).alias("caution_count"))
    rows = quality.release_checks(
        candidates, published, totals, held, expected_candidates=candidates.count(),
        association_label="inconclusive", accepted=["possible_leads_not_retained", "finance_is_illustrative"])
    return rows.withColumn("release_status", quality.release_status(rows).select("release_status").scalar())


@query("Q5_publication_gates", with_views("trip_plan trip_outcomes cases origins nodes", """
  WITH t AS (SELECT count(*) AS n, count(*) - count(DISTINCT od_plan_id) AS dup, count(*) FILTER (NOT coalesce(population >= 0, false)) AS neg, count(*) FILTER (NOT coalesce(distance >= 0, false)) AS negd FROM trip_plan),
  p AS (SELECT n_name, sum(c_acctbal) AS low, sum(c_acctbal) * (1 + (n_nationkey % 3 - 1) * 0.5::DOUBLE) AS high FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, n_nationkey)
  SELECT 'routing' AS stage, 'row_count' AS check_id, abs(n - (SELECT count(DISTINCT c_custkey) FROM customer) * (SELECT count(*) FROM supplier) * 2) AS violations FROM t UNION ALL SELECT 'routing', 'duplicate_trips', dup FROM t UNION ALL SELECT 'routing', 'negative_population', neg FROM t UNION ALL SELECT 'routing', 'negative_distance', negd FROM t
  UNION ALL SELECT 'proximity', 'row_count', abs(count(*) - 25) FROM p UNION ALL SELECT 'proximity', 'duplicate_nodes', 0 UNION ALL SELECT 'proximity', 'negative_population', count(*) FILTER (low < 0 OR high < 0) FROM p
  UNION ALL SELECT 'proximity', 'above_national', count(*) FILTER (high > 300000.0::DOUBLE + 1e-6) FROM p UNION ALL SELECT 'proximity', 'not_monotone', count(*) FILTER (high < low) FROM p
  UNION ALL SELECT 'accessibility', 'row_count', abs(count(*) - 25 * 3 * 5) FROM (SELECT DISTINCT o_custkey % 25 AS n, o_orderstatus, o_orderpriority FROM orders)
  UNION ALL SELECT 'accessibility', 'duplicate_metrics', 0
  UNION ALL SELECT 'accessibility', 'incomplete_routes', count(*) FROM (SELECT bool_and(o_totalprice > 1000) AS ok FROM orders GROUP BY o_custkey % 25, o_orderstatus, o_orderpriority) WHERE NOT ok"""))
def publication_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates of the routing plan, the proximity baseline and the accessibility metrics before each is published."""
    people = origins(spark, sf_dir).select("origin_id")
    routing = quality.routing_plan_checks(trip_plan(spark, sf_dir), origins=people, nodes=nodes(spark, sf_dir).select("node_id"), scenarios=2, rows=trip_rows(spark, sf_dir))
    nation = table(spark, sf_dir, "nation")
    customers = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    low = F.sum(F.col("c_acctbal").cast("double"))
    baseline = customers.groupBy(F.col("n_name").alias("node_id"), "n_nationkey").agg(low.alias("population_800m")).withColumn(
        "population_1200m", F.col("population_800m") * (1 + (F.col("n_nationkey") % 3 - 1) * 0.5))
    near = proximity_checks(baseline, radii=(800, 1200), expected_nodes=25, national_population=300000.0)
    reached = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 25).alias("node_id"), F.col("o_orderstatus").alias("scenario_id"), F.col("o_orderpriority").alias("threshold_case_id")).agg(
        F.bool_and(F.col("o_totalprice") > 1000).alias("route_coverage_complete"))
    access = quality.accessibility_checks(reached, nodes=25, scenarios=3, cases=5)
    parts = [rows.select(F.lit(stage).alias("stage"), "check_id", F.col("violations").cast("long").alias("violations")) for stage, rows in (("routing", routing), ("proximity", near), ("accessibility", access))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_PATTERNS = [p.replace("'", "''") for p in quality.SECRET_PATTERNS]


@query("Q6_secret_scan", f"""SELECT doc_id, regexp_matches(text, '{_PATTERNS[0]}') OR regexp_matches(text, '{_PATTERNS[1]}') AS generic_pattern, contains(text, 'example.com') AS exact_value FROM documents
  WHERE regexp_matches(text, '{_PATTERNS[0]}') OR regexp_matches(text, '{_PATTERNS[1]}') OR contains(text, 'example.com')""")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.secret_scan(table(spark, sf_dir, "documents"), path="doc_id", content="text", credentials=["example.com"])[0]


@query("Q6_secret_summary", f"""WITH s AS (SELECT regexp_matches(text, '{_PATTERNS[0]}') OR regexp_matches(text, '{_PATTERNS[1]}') AS p FROM conversations)
  SELECT count(*) AS scanned, count(*) FILTER (p) AS pattern_findings, 0::BIGINT AS exact_findings, count(*) FILTER (p) AS findings, CASE WHEN count(*) FILTER (p) > 0 THEN 'fail' ELSE 'warning' END AS status, 'limited' AS assurance FROM s""")
def secret_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumn("path", F.concat_ws("/", "conv_id", "turn"))
    return quality.secret_scan(turns, path="path", content="text")[1]


@query("Q7_parity", "SELECT count(*) AS left_rows, count(*) AS right_rows, true AS equal FROM orders")
def parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return quality.parity(orders, orders.repartition("o_custkey"))


@query("Q8_reproduction", """
  WITH a AS (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY 1), b AS (SELECT o_custkey, count(*) AS orders FROM orders WHERE o_orderpriority <> '1-URGENT' OR o_totalprice < 400000 GROUP BY 1)
  SELECT o_custkey, coalesce(a.orders, -1) AS published_orders, coalesce(b.orders, -1) AS recomputed_orders FROM a FULL JOIN b USING (o_custkey) WHERE a.orders IS DISTINCT FROM b.orders""")
def reproduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    published = joins.frequencies(orders, ["o_custkey"], count="orders")
    kept = orders.filter((F.col("o_orderpriority") != "1-URGENT") | (F.col("o_totalprice") < 400000))
    differing = quality.reproduce(published, joins.frequencies(kept, ["o_custkey"], count="orders"), "o_custkey", ["orders"])
    return differing.na.fill(-1)


@query("Q10_reconciled_totals", with_views("trip_plan", """
  WITH t AS (SELECT count(*) AS trips, count(DISTINCT scenario_id) AS scenarios, count(*) - count(DISTINCT od_plan_id) AS duplicate_trips, count(*) FILTER (population < 0) AS negative_population FROM trip_plan)
  SELECT total, observed, expected, CASE WHEN observed = expected THEN 'pass' ELSE 'fail' END AS status FROM (SELECT 'scenarios' AS total, scenarios AS observed, 2::BIGINT AS expected FROM t UNION ALL SELECT 'duplicate_trips', duplicate_trips, 0 FROM t
    UNION ALL SELECT 'negative_population', negative_population, 0 FROM t UNION ALL SELECT 'trips', trips, 96944 FROM t)"""))
def reconciled_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = trip_plan(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("trips"), F.countDistinct("scenario_id").alias("scenarios"),
        (F.count(F.lit(1)) - F.countDistinct("od_plan_id")).alias("duplicate_trips"), F.count_if(F.col("population") < 0).alias("negative_population"),
    )
    return quality.reconcile_totals(totals, {"scenarios": 2, "duplicate_trips": 0, "negative_population": 0, "trips": 96944})


def threshold_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = F.explode(F.array(*[F.struct(F.lit(name).alias("threshold"), F.lit(q).alias("q")) for name, q in (("low", 30), ("reference", 20), ("high", 10))]))
    access = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("node_id"), "l_quantity", limits.alias("t")).groupBy(
        "node_id", F.col("t.threshold").alias("threshold")
    ).agg(F.coalesce(F.sum(F.when(F.col("l_quantity") > F.col("t.q"), F.col("l_quantity"))), F.lit(0)).cast("bigint").alias("transit_accessibility"))
    base = screened(spark, sf_dir).filter("exclusion_reason IS NULL").select("node_id", "region", "population_proximity")
    return base.join(access, "node_id")


def threshold_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = sensitivity.threshold_selections(threshold_screen(spark, sf_dir), merit_slots=24, coverage_slots=9, maximum=36)
    return chosen.filter("selection_stage IS NOT NULL")


THRESHOLD_SQL = SCREEN_SQL + """,
  acc AS (SELECT l_suppkey AS node_id, threshold, coalesce(sum(l_quantity) FILTER (l_quantity > q), 0)::BIGINT AS access FROM lineitem, (VALUES ('low', 30), ('reference', 20), ('high', 10)) t(threshold, q) GROUP BY 1, 2),
  tr AS (SELECT e.node_id, region, threshold, population_proximity, access, row_number() OVER (PARTITION BY threshold ORDER BY population_proximity DESC, e.node_id) AS pr, row_number() OVER (PARTITION BY threshold ORDER BY access DESC, e.node_id) AS ar, count(*) OVER (PARTITION BY threshold) AS n FROM eligible e JOIN acc USING (node_id)),
  ts AS (SELECT *, 0.5::DOUBLE*((n-pr)::DOUBLE/(n-1)) + 0.5::DOUBLE*((n-ar)::DOUBLE/(n-1)) AS score FROM tr),
  tq AS (SELECT *, row_number() OVER (PARTITION BY threshold ORDER BY score DESC, node_id) AS rk FROM ts),
  tp AS (SELECT threshold, region, count(*) AS c FROM tq WHERE rk <= 24 GROUP BY 1, 2),
  tt AS (SELECT tq.*, coalesce(c, 0) + row_number() OVER (PARTITION BY tq.threshold, tq.region ORDER BY rk) - 1 AS turn FROM tq LEFT JOIN tp ON tq.threshold = tp.threshold AND tq.region = tp.region WHERE rk > 24),
  tc AS (SELECT *, row_number() OVER (PARTITION BY threshold ORDER BY turn, region) AS cv FROM tt),
  tf AS (SELECT *, row_number() OVER (PARTITION BY threshold ORDER BY rk) AS f FROM tc WHERE cv > 9),
  tsel AS (SELECT threshold, node_id, population_proximity, access FROM tq WHERE rk <= 24 UNION ALL SELECT threshold, node_id, population_proximity, access FROM tc WHERE cv <= 9 UNION ALL SELECT threshold, node_id, population_proximity, access FROM tf WHERE f <= 3)"""


@query("X10_selection_changes", with_views("nodes", f"""WITH {THRESHOLD_SQL}, x AS (SELECT t.threshold, r.node_id FROM (SELECT DISTINCT threshold FROM tsel) t, (SELECT node_id FROM tsel WHERE threshold = 'reference') r)
  SELECT threshold, node_id, CASE WHEN x.k IS NULL THEN 'entrant' WHEN s.k IS NULL THEN 'exit' ELSE 'kept' END AS change FROM (SELECT *, 1 AS k FROM tsel) s FULL JOIN (SELECT *, 1 AS k FROM x) x USING (threshold, node_id)"""))
def selection_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensitivity.selection_changes(threshold_selected(spark, sf_dir), "reference")


RERANK_SQL = """{threshold},
  cp AS (SELECT node_id, confirmed_10, confirmed_15 FROM measures WHERE {known}),
  days AS (SELECT s.threshold, d.day, s.node_id, population_proximity AS demand, CASE WHEN d.day = 'weekday' THEN access ELSE population_proximity - access END AS accessible, confirmed_10, confirmed_15 FROM tsel s CROSS JOIN (VALUES ('weekday'), ('weekend')) d(day) LEFT JOIN cp USING (node_id)),
  stat AS (SELECT threshold, day, count(*) FILTER (confirmed_10 IS NULL) AS missing_nodes FROM days GROUP BY 1, 2)"""


def rerank(spark: SparkSession, sf_dir: str, known: str) -> tuple[DataFrame, DataFrame]:
    day = F.explode(F.array(F.lit("weekday"), F.lit("weekend")))
    cells = threshold_selected(spark, sf_dir).withColumn("day", day).select(
        "threshold", "day", "node_id", F.col("population_proximity").alias("demand"),
        F.when(F.col("day") == "weekday", F.col("transit_accessibility")).otherwise(F.col("population_proximity") - F.col("transit_accessibility")).alias("accessible"),
    )
    counts = measures(spark, sf_dir).filter(known).select("node_id", "confirmed_10", "confirmed_15")
    return sensitivity.rerank(cells, counts, by=["threshold", "day"])


@query("X10_ranking_status", with_views("nodes", f"WITH {RERANK_SQL.format(threshold=THRESHOLD_SQL, known='confirmed_15 > 0')} SELECT threshold, day, missing_nodes, CASE WHEN missing_nodes > 0 THEN 'unavailable_missing_competition' ELSE 'complete' END AS status FROM stat"))
def ranking_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank(spark, sf_dir, "confirmed_15 > 0")[1]


@query("X10_both_sets_ranked", with_views("nodes", f"""WITH {THRESHOLD_SQL},
  acs AS (SELECT e.node_id, threshold, population_proximity, access FROM eligible e JOIN acc USING (node_id)),
  sets AS (SELECT 'fixed' AS node_set, a.* FROM acs a WHERE node_id IN (SELECT node_id FROM tsel WHERE threshold = 'reference') UNION ALL SELECT 'alternative', a.* FROM acs a JOIN tsel s ON s.threshold = a.threshold AND s.node_id = a.node_id),
  cells AS (SELECT node_set, s.threshold, d.day, s.node_id, population_proximity AS demand, CASE WHEN d.day = 'weekday' THEN access ELSE population_proximity - access END AS accessible, confirmed_10, confirmed_15 FROM sets s CROSS JOIN (VALUES ('weekday'), ('weekend')) d(day) LEFT JOIN (SELECT node_id, confirmed_10, confirmed_15 FROM measures WHERE confirmed_15 >= 0) USING (node_id)),
  bad AS (SELECT DISTINCT node_set, threshold, day FROM cells WHERE confirmed_10 IS NULL),
  base AS (SELECT * FROM cells c WHERE NOT EXISTS (FROM bad b WHERE b.node_set = c.node_set AND b.threshold = c.threshold AND b.day = c.day)),
  cc AS (SELECT *, greatest(CASE WHEN caution THEN 1 ELSE 0 END, CASE WHEN minutes = 10 THEN confirmed_10 ELSE confirmed_15 END)::DOUBLE AS competition FROM base, (VALUES ('confirmed_10_min', 10, false), ('confirmed_15_min', 15, false), ('zero_confirmed_caution_10_min', 10, true), ('zero_confirmed_caution_15_min', 15, true)) v(cs, minutes, caution)),
  avgs AS (SELECT *, rank() OVER (g ORDER BY demand DESC) + (count(*) OVER (PARTITION BY node_set, threshold, day, cs, demand) - 1) / 2.0::DOUBLE AS rd, rank() OVER (g ORDER BY accessible DESC) + (count(*) OVER (PARTITION BY node_set, threshold, day, cs, accessible) - 1) / 2.0::DOUBLE AS ra,
    rank() OVER (g ORDER BY competition) + (count(*) OVER (PARTITION BY node_set, threshold, day, cs, competition) - 1) / 2.0::DOUBLE AS rc, greatest(count(*) OVER g - 1, 1) AS d FROM cc WINDOW g AS (PARTITION BY node_set, threshold, day, cs)),
  sc AS (SELECT *, 1 - (rd-1)/d AS ds, 1 - (ra-1)/d AS sa, 1 - (rc-1)/d AS ks, NOT EXISTS (SELECT 1 FROM cc o WHERE o.node_set = a.node_set AND o.threshold = a.threshold AND o.day = a.day AND o.cs = a.cs AND o.demand >= a.demand AND o.accessible >= a.accessible AND o.competition <= a.competition AND (o.demand > a.demand OR o.accessible > a.accessible OR o.competition < a.competition)) AS onf FROM avgs a),
  rn AS (SELECT node_set, threshold, day, cs, profile, node_id, onf, row_number() OVER (PARTITION BY node_set, threshold, day, cs, profile, onf ORDER BY w0*ds + w1*sa + w2*ks + w3*0.5::DOUBLE DESC, node_id) AS fr FROM sc, (SELECT profile, w0::DOUBLE AS w0, w1::DOUBLE AS w1, w2::DOUBLE AS w2, w3::DOUBLE AS w3 FROM (VALUES ('balanced', 0.25, 0.25, 0.25, 0.25), ('demand_led', 0.4, 0.2, 0.2, 0.2), ('accessibility_led', 0.2, 0.4, 0.2, 0.2), ('competition_led', 0.2, 0.2, 0.4, 0.2), ('finance_led', 0.2, 0.2, 0.2, 0.4)) p(profile, w0, w1, w2, w3)))
  SELECT node_set, threshold, day, node_id, count(*) FILTER (onf AND fr <= 3) AS selection_count FROM rn GROUP BY ALL"""))
def both_sets_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference set and each threshold's own set, ranked under every threshold and day."""
    screen = threshold_screen(spark, sf_dir)
    cells = sensitivity.both_sets(screen, threshold_selected(spark, sf_dir), "reference").withColumn("day", F.explode(F.array(F.lit("weekday"), F.lit("weekend")))).select(
        "node_set", "threshold", "day", "node_id", F.col("population_proximity").alias("demand"),
        F.when(F.col("day") == "weekday", F.col("transit_accessibility")).otherwise(F.col("population_proximity") - F.col("transit_accessibility")).alias("accessible"))
    counts = measures(spark, sf_dir).filter("confirmed_15 >= 0").select("node_id", "confirmed_10", "confirmed_15")
    ranked, _ = sensitivity.rerank(cells, counts, by=["node_set", "threshold", "day"])
    return ranked.select("node_set", "threshold", "day", "node_id", "selection_count")


@query("J27_combined_days", with_views("nodes", f"""WITH {RERANK_SQL.format(threshold=THRESHOLD_SQL, known='confirmed_15 >= 0')},
  base AS (SELECT d.* FROM days d JOIN stat s ON d.threshold = s.threshold AND d.day = s.day AND missing_nodes = 0),
  cc AS (SELECT *, greatest(CASE WHEN caution THEN 1 ELSE 0 END, CASE WHEN minutes = 10 THEN confirmed_10 ELSE confirmed_15 END)::DOUBLE AS competition FROM base, (VALUES ('confirmed_10_min', 10, false), ('confirmed_15_min', 15, false), ('zero_confirmed_caution_10_min', 10, true), ('zero_confirmed_caution_15_min', 15, true)) v(cs, minutes, caution)),
  avgs AS (SELECT *, rank() OVER (g ORDER BY demand DESC) + (count(*) OVER (PARTITION BY threshold, day, cs, demand) - 1) / 2.0::DOUBLE AS rd, rank() OVER (g ORDER BY accessible DESC) + (count(*) OVER (PARTITION BY threshold, day, cs, accessible) - 1) / 2.0::DOUBLE AS ra,
    rank() OVER (g ORDER BY competition) + (count(*) OVER (PARTITION BY threshold, day, cs, competition) - 1) / 2.0::DOUBLE AS rc, greatest(count(*) OVER g - 1, 1) AS d FROM cc WINDOW g AS (PARTITION BY threshold, day, cs)),
  sc AS (SELECT *, 1 - (rd-1)/d AS ds, 1 - (ra-1)/d AS sa, 1 - (rc-1)/d AS ks, NOT EXISTS (SELECT 1 FROM cc o WHERE o.threshold = a.threshold AND o.day = a.day AND o.cs = a.cs AND o.demand >= a.demand AND o.accessible >= a.accessible AND o.competition <= a.competition AND (o.demand > a.demand OR o.accessible > a.accessible OR o.competition < a.competition)) AS onf FROM avgs a),
  rn AS (SELECT threshold, day, cs, profile, node_id, onf, row_number() OVER (PARTITION BY threshold, day, cs, profile, onf ORDER BY w0*ds + w1*sa + w2*ks + w3*0.5::DOUBLE DESC, node_id) AS fr FROM sc, (SELECT profile, w0::DOUBLE AS w0, w1::DOUBLE AS w1, w2::DOUBLE AS w2, w3::DOUBLE AS w3 FROM (VALUES ('balanced', 0.25, 0.25, 0.25, 0.25), ('demand_led', 0.4, 0.2, 0.2, 0.2), ('accessibility_led', 0.2, 0.4, 0.2, 0.2), ('competition_led', 0.2, 0.2, 0.4, 0.2), ('finance_led', 0.2, 0.2, 0.2, 0.4)) p(profile, w0, w1, w2, w3)))
  SELECT threshold, node_id, count(*) FILTER (onf AND fr <= 3) AS selection_count, count(*) FILTER (onf AND fr <= 3 AND cs LIKE 'confirmed%') AS observed_count, count(*) FILTER (onf AND fr <= 3 AND cs LIKE 'zero%') AS caution_count, 'combined' AS status FROM rn GROUP BY 1, 2"""))
def combined_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision.combine_days(rerank(spark, sf_dir, "confirmed_15 >= 0")[0], by=["threshold"], day="day", days=["weekday", "weekend"])
