"""Screening, selection, sampling and the robust decision."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from areascreen.catalog.registry import query
from areascreen.catalog.views import nodes, origins, table, with_views
from areascreen.operators import pareto, ranking, selection, stats
from areascreen.plans import decision
from areascreen.session import cut_lineage

SCREEN_SQL = """measures AS (SELECT l_suppkey AS node_id, sum(l_quantity)::BIGINT AS population_proximity,
    coalesce(sum(l_quantity) FILTER (l_returnflag = 'N'), 0)::BIGINT AS transit_accessibility,
    count(*) FILTER (l_quantity = 50 AND l_discount >= 0.1) AS confirmed_10,
    count(*) FILTER (l_quantity >= 49 AND l_discount >= 0.09) AS confirmed_15 FROM lineitem GROUP BY 1),
  screen AS (SELECT n.node_id, node_name, CASE WHEN n.node_id%13 = 0 THEN NULL ELSE region END AS region,
    CASE WHEN n.node_id%10 = 0 THEN 'provisional' ELSE 'qualified' END AS qualification_status,
    population_proximity, transit_accessibility, n.node_id%17 <> 0 AS route_coverage_complete,
    CASE WHEN n.node_id%10 = 0 THEN 'not_qualified' WHEN m.node_id IS NULL THEN 'missing_screen_input'
         WHEN n.node_id%13 = 0 THEN 'missing_region' WHEN n.node_id%17 = 0 THEN 'incomplete_route_coverage' END AS exclusion_reason
    FROM nodes n LEFT JOIN measures m USING (node_id)),
  eligible AS (SELECT * FROM screen WHERE exclusion_reason IS NULL),
  ranked AS (SELECT *, row_number() OVER (ORDER BY population_proximity DESC, node_id) AS population_rank,
    row_number() OVER (ORDER BY transit_accessibility DESC, node_id) AS accessibility_rank, count(*) OVER () AS n FROM eligible),
  pct AS (SELECT *, CASE WHEN n = 1 THEN 1.0::DOUBLE ELSE (n-population_rank)::DOUBLE/(n-1) END AS population_percentile,
    CASE WHEN n = 1 THEN 1.0::DOUBLE ELSE (n-accessibility_rank)::DOUBLE/(n-1) END AS accessibility_percentile FROM ranked),
  scored AS (SELECT *, 0.5::DOUBLE*population_percentile + 0.5::DOUBLE*accessibility_percentile AS screen_score,
    NOT EXISTS (SELECT 1 FROM pct o WHERE o.population_proximity >= p.population_proximity AND o.transit_accessibility >= p.transit_accessibility
       AND (o.population_proximity > p.population_proximity OR o.transit_accessibility > p.transit_accessibility)) AS nondominated FROM pct p)"""


def _select_sql(merit: int, cover: int, maximum: int) -> str:
    return f"""so AS (SELECT *, row_number() OVER (ORDER BY screen_score DESC, node_id) AS rk FROM scored),
  lim AS (SELECT least({merit}, count(*)) AS m, least({maximum}, count(*)) AS t FROM so),
  picked AS (SELECT region, count(*) AS c FROM so, lim WHERE rk <= m GROUP BY 1),
  turn AS (SELECT so.*, coalesce(c, 0) + row_number() OVER (PARTITION BY so.region ORDER BY rk) - 1 AS turn FROM so CROSS JOIN lim LEFT JOIN picked ON so.region = picked.region WHERE rk > m),
  cov AS (SELECT *, row_number() OVER (ORDER BY turn, region) AS cv FROM turn),
  fil AS (SELECT *, row_number() OVER (ORDER BY rk) AS f FROM cov, lim WHERE cv > greatest(0, least({cover}, t - m))),
  selected AS (SELECT node_id, region, 'merit' AS selection_stage, rk AS selection_slot FROM so, lim WHERE rk <= m
    UNION ALL SELECT node_id, region, 'regional_coverage', m + cv FROM cov, lim WHERE cv <= greatest(0, least({cover}, t - m))
    UNION ALL SELECT node_id, region, 'global_shortfall_fill', m + greatest(0, least({cover}, t - m)) + f FROM fil WHERE m + greatest(0, least({cover}, t - m)) + f <= t)"""


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_suppkey").alias("node_id")).agg(
        F.sum("l_quantity").cast("bigint").alias("population_proximity"),
        F.coalesce(F.sum(F.when(F.col("l_returnflag") == "N", F.col("l_quantity"))), F.lit(0)).cast("bigint").alias("transit_accessibility"),
        F.count_if((F.col("l_quantity") == 50) & (F.col("l_discount") >= 0.1)).alias("confirmed_10"),
        F.count_if((F.col("l_quantity") >= 49) & (F.col("l_discount") >= 0.09)).alias("confirmed_15"),
    )


def screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_nodes, key, measured = nodes(spark, sf_dir), F.col("node_id"), measures(spark, sf_dir)
    listed = all_nodes.select("node_id", "node_name", F.when(key % 10 == 0, "provisional").otherwise("qualified").alias("qualification_status"))
    proximity = measured.select("node_id", "population_proximity").join(
        all_nodes.select("node_id", F.when(key % 13 != 0, F.col("region")).alias("region")), "node_id"
    )
    access = measured.select("node_id", "transit_accessibility", (key % 17 != 0).alias("route_coverage_complete"))
    return selection.eligible_screen(listed, proximity, access)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.screen_score(screened(spark, sf_dir).filter("exclusion_reason IS NULL"))


def selected(rows: DataFrame) -> DataFrame:
    chosen = selection.balanced_selection(rows, merit_slots=24, coverage_slots=9, maximum=36)
    return cut_lineage(chosen.filter("selection_stage IS NOT NULL"))


def sampled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates, sample, strata) as tables of their own."""
    rows = cut_lineage(scored(spark, sf_dir))
    candidates = selected(rows)
    sample, strata_rows = selection.outside_sample(
        rows, candidates, labels=["high", "middle", "low"], sample_size=25, minimum=1, seed="20260918"
    )
    return candidates, sample, strata_rows


@query("P3_eligibility", with_views("nodes", f"WITH {SCREEN_SQL} SELECT node_id, coalesce(exclusion_reason, 'eligible') AS reason FROM screen"))
def eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screened(spark, sf_dir).select("node_id", F.coalesce("exclusion_reason", F.lit("eligible")).alias("reason"))


@query("W1_W2_screen_scores", with_views("nodes", f"""WITH {SCREEN_SQL}
  SELECT node_id, population_rank, accessibility_rank, round(population_percentile, 9) AS population_percentile,
    round(accessibility_percentile, 9) AS accessibility_percentile, round(screen_score, 9) AS screen_score, nondominated FROM scored"""))
def screen_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir)
    return rows.select("node_id", "population_rank", "accessibility_rank", "nondominated", *[
        F.round(c, 9).alias(c) for c in ("population_percentile", "accessibility_percentile", "screen_score")
    ])


@query("W3_quartiles", """
  WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank, count(*) OVER () AS n FROM customer)
  SELECT c_custkey, rank, CASE WHEN p >= 0.75 THEN 4 WHEN p >= 0.5 THEN 3 WHEN p >= 0.25 THEN 2 ELSE 1 END AS quartile
  FROM (SELECT *, CASE WHEN n = 1 THEN 0 ELSE (n - rank) / (n - 1) END AS p FROM r)""")
def quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = ranking.group_size(
        ranking.descending_rank(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey"), name="n"
    )
    percentile = ranking.ordinal_percentile(F.col("rank"), F.col("n"), single=0.0)
    return ranked.select("c_custkey", "rank", ranking.quartile_from_percentile(percentile).alias("quartile"))


@query("W5_average_percentile", """
  WITH c AS (SELECT c_custkey, c_nationkey, floor(c_acctbal / 500)::BIGINT AS v FROM customer),
  r AS (SELECT *, rank() OVER (PARTITION BY c_nationkey ORDER BY v) + (count(*) OVER (PARTITION BY c_nationkey, v) - 1) / 2.0 AS avg_rank, count(*) OVER (PARTITION BY c_nationkey) AS n FROM c)
  SELECT c_custkey, round(1 - (avg_rank - 1) / greatest(n - 1, 1), 9)::DOUBLE AS percentile FROM r""")
def average_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.floor(F.col("c_acctbal") / 500).alias("v"))
    scored_rows = ranking.average_percentile(rows, "v", "c_custkey", by=["c_nationkey"], higher_is_better=False)
    return scored_rows.select("c_custkey", F.round("percentile", 9).alias("percentile"))


@query("W6_W7_bands", """
  WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS hi, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS lo, count(*) OVER () AS n FROM customer)
  SELECT c_custkey, (['top', 'upper', 'middle', 'lower', 'low', 'bottom', 'tail'])[1 + least(6, (hi-1)*7//n)] AS band,
    least(floor((lo-1) / (n/4.0))::BIGINT + 1, 4) AS quartile FROM r""")
def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    hi = ranking.descending_rank(rows, "c_acctbal", "c_custkey", name="hi")
    both = ranking.row_index(hi, [F.col("c_acctbal"), F.col("c_custkey")], name="lo")
    sized = ranking.group_size(both, name="n")
    labels = ["top", "upper", "middle", "lower", "low", "bottom", "tail"]
    return sized.select(
        "c_custkey", ranking.band(F.col("hi"), F.col("n"), labels).alias("band"),
        ranking.rank_quartile(F.col("lo"), F.col("n")).alias("quartile"),
    )


@query("X3_pareto_frontier", """
  WITH p AS (SELECT l_suppkey, l_partkey, sum(l_quantity)::BIGINT AS quantity, sum(round(l_discount*100))::BIGINT AS discount, count(*) AS lines FROM lineitem GROUP BY 1, 2),
  d AS (SELECT DISTINCT l_suppkey, quantity, discount, lines FROM p)
  SELECT l_suppkey, quantity, discount, lines FROM d a WHERE NOT EXISTS (SELECT 1 FROM d b WHERE a.l_suppkey = b.l_suppkey AND b.quantity >= a.quantity AND b.discount >= a.discount AND b.lines >= a.lines
     AND (b.quantity > a.quantity OR b.discount > a.discount OR b.lines > a.lines))""")
def pareto_by_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(
        F.sum("l_quantity").cast("bigint").alias("quantity"), F.sum(F.round(F.col("l_discount") * 100)).cast("bigint").alias("discount"),
        F.count(F.lit(1)).alias("lines"),
    )
    frontier = pareto.pareto_frontier(points, ["quantity", "discount", "lines"], by=["l_suppkey"])
    return frontier.select("l_suppkey", *[F.col(c).cast("bigint").alias(c) for c in ("quantity", "discount", "lines")])


@query("X4_T5_balanced_selection", with_views("nodes", f"WITH {SCREEN_SQL}, {_select_sql(24, 9, 36)} SELECT * FROM selected"))
def balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selected(scored(spark, sf_dir)).select("node_id", "region", "selection_stage", "selection_slot")


SAMPLE_SQL = f"""{SCREEN_SQL}, {_select_sql(24, 9, 36)},
  banded AS (SELECT *, (['high', 'middle', 'low'])[1 + least(2, (rk-1)*3//n)] AS screen_band FROM so),
  universe AS (SELECT * FROM banded WHERE node_id NOT IN (SELECT node_id FROM selected)),
  sizes AS (SELECT region, screen_band, count(*) AS population_count FROM universe GROUP BY 1, 2),
  tot AS (SELECT sum(population_count)::DOUBLE AS u, count(*) AS s FROM sizes),
  slots AS (SELECT region, screen_band, population_count, unnest(range(1, least(population_count, 25)::BIGINT)) AS j FROM sizes),
  won AS (SELECT region, screen_band FROM slots, tot ORDER BY population_count/u - j/25.0::DOUBLE DESC, region, screen_band, j LIMIT (SELECT 25 - s FROM tot)),
  strata AS (SELECT z.*, 1 + (SELECT count(*) FROM won w WHERE w.region = z.region AND w.screen_band = z.screen_band) AS sample_count FROM sizes z)"""


@query("X5_strata", with_views("nodes", f"""WITH {SAMPLE_SQL}
  SELECT region || '|' || screen_band AS stratum_id, population_count, sample_count, round(sample_count / population_count, 9) AS inclusion_probability,
    round(1.0 / (sample_count / population_count), 9)::DOUBLE AS design_weight FROM strata"""))
def strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, rows = sampled(spark, sf_dir)
    return rows.select(
        "stratum_id", "population_count", "sample_count", F.round("inclusion_probability", 9).alias("inclusion_probability"),
        F.round("design_weight", 9).alias("design_weight"),
    )


@query("X5_U3_U4_outside_sample", with_views("nodes", f"""WITH {SAMPLE_SQL}
  SELECT node_id, region, screen_band, round(population_count / sample_count, 9)::DOUBLE AS design_weight, false AS is_candidate FROM (
    SELECT u.*, population_count, sample_count, row_number() OVER (PARTITION BY u.region, u.screen_band ORDER BY sha256('20260918|' || node_id::VARCHAR), node_id) AS place
    FROM universe u JOIN strata s ON u.region = s.region AND u.screen_band = s.screen_band) WHERE place <= sample_count"""))
def outside_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates, sample, _ = sampled(spark, sf_dir)
    marked = sample.join(candidates.select("node_id", F.lit(True).alias("_candidate")), "node_id", "left")
    return marked.select(
        "node_id", "region", "screen_band", F.round("design_weight", 9).alias("design_weight"), F.coalesce("_candidate", F.lit(False)).alias("is_candidate")
    )


@query("X6_W12_pilot_areas", with_views("origins", """
  WITH a AS (SELECT area, min(region) AS region, sum(population)::BIGINT AS population FROM origins GROUP BY 1),
  m AS (SELECT *, median(population) OVER (PARTITION BY region) AS med, row_number() OVER (PARTITION BY region ORDER BY (area = 'NATION_7')::INT, population DESC, area) AS hi,
     bool_or(area = 'NATION_7') OVER (PARTITION BY region) AS mandated, row_number() OVER (ORDER BY population, area) AS lo, count(*) OVER () AS n FROM a),
  s AS (SELECT *, row_number() OVER (PARTITION BY region, hi = 1 ORDER BY abs(population - med), area) AS near FROM m)
  SELECT area, region, population, least(floor((lo-1) / (n/4.0))::BIGINT + 1, 4) AS national_quartile,
    CASE WHEN hi = 1 THEN 'highest_population' WHEN mandated THEN 'mandated' ELSE 'closest_to_region_median' END AS reason
  FROM s WHERE hi = 1 OR (mandated AND area = 'NATION_7') OR (NOT mandated AND near = 1)"""))
def pilot_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    from areascreen.plans.pilot import pilot_areas as choose

    areas = origins(spark, sf_dir).groupBy("area").agg(F.min("region").alias("region"), F.sum("population").alias("population"))
    return choose(areas, mandated="NATION_7")


@query("A26_population_by_area", with_views("origins", "SELECT area, sum(population)::BIGINT AS population FROM origins GROUP BY 1"))
def population_by_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return origins(spark, sf_dir).groupBy("area").agg(F.sum("population").alias("population"))


GRID_SQL = """cells AS (SELECT l_suppkey AS node_id, l_returnflag || l_linestatus AS access_case, sum(l_quantity)::BIGINT AS accessible FROM lineitem GROUP BY 1, 2),
  base AS (SELECT access_case, node_id, population_proximity AS demand, accessible, confirmed_10, confirmed_15 FROM measures JOIN cells USING (node_id)),
  cc AS (SELECT *, greatest(CASE WHEN caution THEN 1 ELSE 0 END, CASE WHEN minutes = 10 THEN confirmed_10 ELSE confirmed_15 END)::DOUBLE AS competition
    FROM base, (VALUES ('confirmed_10_min', 10, false), ('confirmed_15_min', 15, false), ('zero_confirmed_caution_10_min', 10, true), ('zero_confirmed_caution_15_min', 15, true)) v(competition_case, minutes, caution)),
  avgs AS (SELECT *, rank() OVER (g ORDER BY demand DESC) + (count(*) OVER (PARTITION BY access_case, competition_case, demand) - 1) / 2.0::DOUBLE AS rd,
    rank() OVER (g ORDER BY accessible DESC) + (count(*) OVER (PARTITION BY access_case, competition_case, accessible) - 1) / 2.0::DOUBLE AS ra,
    rank() OVER (g ORDER BY competition) + (count(*) OVER (PARTITION BY access_case, competition_case, competition) - 1) / 2.0::DOUBLE AS rc,
    greatest(count(*) OVER g - 1, 1) AS d FROM cc WINDOW g AS (PARTITION BY access_case, competition_case)),
  sc AS (SELECT *, 1 - (rd-1)/d AS ds, 1 - (ra-1)/d AS sa, 1 - (rc-1)/d AS cs, NOT EXISTS (SELECT 1 FROM cc o WHERE o.access_case = a.access_case AND o.competition_case = a.competition_case
      AND o.demand >= a.demand AND o.accessible >= a.accessible AND o.competition <= a.competition AND (o.demand > a.demand OR o.accessible > a.accessible OR o.competition < a.competition)) AS on_frontier FROM avgs a),
  runs0 AS (SELECT access_case, competition_case, profile, node_id, on_frontier, w0*ds + w1*sa + w2*cs + w3*0.5::DOUBLE AS score
    FROM sc, (SELECT profile, w0::DOUBLE AS w0, w1::DOUBLE AS w1, w2::DOUBLE AS w2, w3::DOUBLE AS w3 FROM (VALUES ('balanced', 0.25, 0.25, 0.25, 0.25), ('demand_led', 0.4, 0.2, 0.2, 0.2), ('accessibility_led', 0.2, 0.4, 0.2, 0.2),
      ('competition_led', 0.2, 0.2, 0.4, 0.2), ('finance_led', 0.2, 0.2, 0.2, 0.4)) p(profile, w0, w1, w2, w3))),
  runs1 AS (SELECT *, row_number() OVER (PARTITION BY access_case, competition_case, profile ORDER BY score DESC, node_id) AS rank,
    row_number() OVER (PARTITION BY access_case, competition_case, profile, on_frontier ORDER BY score DESC, node_id) AS fr FROM runs0),
  runs AS (SELECT *, on_frontier AND fr <= 3 AS selected FROM runs1),
  res AS (SELECT node_id, count(*) AS evaluations, count(*) FILTER (selected) AS selection_count, count(*) FILTER (selected AND competition_case LIKE 'confirmed%') AS observed_count,
    count(*) FILTER (selected AND competition_case LIKE 'zero%') AS caution_count, count(*) FILTER (on_frontier AND profile = 'balanced') AS pareto_count,
    median(rank)::DOUBLE AS median_rank, min(rank) AS best_rank, max(rank) AS worst_rank FROM runs GROUP BY 1)"""


def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_suppkey").alias("node_id"), F.concat("l_returnflag", "l_linestatus").alias("access_case")
    ).agg(F.sum("l_quantity").cast("bigint").alias("accessible"))
    base = measures(spark, sf_dir).select("node_id", F.col("population_proximity").alias("demand"), "confirmed_10", "confirmed_15")
    return cells.join(base, "node_id")


def grid_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision.evaluate(grid_cells(spark, sf_dir), by=["access_case"])


@query("W9_W10_evaluation_ranks", with_views("nodes", f"WITH {SCREEN_SQL}, {GRID_SQL} SELECT access_case, competition_case, profile, node_id, on_frontier, rank, selected, round(score, 9) AS score FROM runs"))
def evaluation_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_runs(spark, sf_dir).withColumn("score", F.round("score", 9))


@query("X7_T2_T3_T4_robust_decision", with_views("nodes", f"""WITH {SCREEN_SQL}, {GRID_SQL},
  o AS (SELECT *, row_number() OVER (ORDER BY selection_count DESC, median_rank, worst_rank, node_id) AS position,
     CASE WHEN observed_count > 0 AND caution_count > 0 THEN 'recommended' WHEN selection_count > 0 THEN 'recheck' END AS ln FROM res),
  l AS (SELECT *, row_number() OVER (PARTITION BY ln ORDER BY position) AS lr FROM o)
  SELECT * EXCLUDE (ln, lr), round(selection_count/evaluations, 9) AS top_three_frequency, round(observed_count/(evaluations/2), 9) AS observed_frequency,
    round(caution_count/(evaluations/2), 9) AS caution_frequency, round(pareto_count*5/evaluations, 9) AS pareto_frequency,
    coalesce(CASE WHEN (ln = 'recommended' AND lr <= 3) OR (ln = 'recheck' AND lr <= 2) THEN ln END, '') AS list_name,
    coalesce(CASE WHEN (ln = 'recommended' AND lr <= 3) OR (ln = 'recheck' AND lr <= 2) THEN lr END, 0) AS list_rank FROM l"""))
def robust_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = decision.recommend(decision.robustness(grid_runs(spark, sf_dir)))
    rounded = {c: F.round(c, 9) for c in ("top_three_frequency", "observed_frequency", "caution_frequency", "pareto_frequency")}
    return results.withColumns(rounded).withColumn("list_name", F.coalesce("list_name", F.lit(""))).withColumn(
        "list_rank", F.coalesce("list_rank", F.lit(0)).cast("bigint")
    )


@query("A20_unique_orderings", with_views("nodes", f"""WITH {SCREEN_SQL}, {GRID_SQL}
  SELECT count(*) AS evaluations, count(DISTINCT o) AS unique_orderings FROM (SELECT string_agg(node_id::VARCHAR, ',' ORDER BY rank) AS o FROM runs GROUP BY access_case, competition_case, profile)"""))
def orderings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision.unique_orderings(grid_runs(spark, sf_dir), by=["access_case"])


@query("A19_robustness", with_views("nodes", f"WITH {SCREEN_SQL}, {GRID_SQL} SELECT node_id, selection_count, pareto_count, median_rank, best_rank, worst_rank FROM res"))
def robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision.robustness(grid_runs(spark, sf_dir)).select(
        "node_id", "selection_count", "pareto_count", "median_rank", "best_rank", "worst_rank"
    )


@query("W13_rank_movement", """
  WITH m AS (SELECT l_suppkey AS node_id, sum(l_quantity) FILTER (l_returnflag = 'N')::BIGINT AS a, sum(l_quantity) FILTER (l_returnflag = 'R')::BIGINT AS b FROM lineitem GROUP BY 1),
  r AS (SELECT node_id, row_number() OVER (ORDER BY a DESC, node_id) AS left_rank, row_number() OVER (ORDER BY b DESC, node_id) AS right_rank FROM m)
  SELECT *, left_rank - right_rank AS movement, CASE WHEN left_rank > right_rank THEN 'up' WHEN left_rank < right_rank THEN 'down' ELSE 'same' END AS direction FROM r""")
def movement(spark: SparkSession, sf_dir: str) -> DataFrame:
    def ranked(flag: str) -> DataFrame:
        sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("node_id")).agg(
            F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_quantity"))).cast("bigint").alias("value")
        )
        return ranking.descending_rank(sums, "value", "node_id")

    return decision.rank_movement(ranked("N"), ranked("R"))


@query("A16_X8_weighted_association", with_views("nodes", f"""WITH {SAMPLE_SQL},
  sampled AS (SELECT u.node_id, population_count / sample_count AS weight, row_number() OVER (PARTITION BY u.region, u.screen_band ORDER BY sha256('20260918|' || node_id::VARCHAR), node_id) AS place, sample_count
    FROM universe u JOIN strata s ON u.region = s.region AND u.screen_band = s.screen_band),
  material AS (SELECT node_id, 1.0::DOUBLE AS w FROM selected UNION ALL SELECT node_id, weight FROM sampled WHERE place <= sample_count),
  xy AS (SELECT 'design_weighted' AS variant, transit_accessibility::DOUBLE AS x, confirmed_10::DOUBLE AS y, w FROM material JOIN measures USING (node_id)
    UNION ALL SELECT 'candidates_only', transit_accessibility, confirmed_10, 1.0 FROM selected JOIN measures USING (node_id)),
  mean AS (SELECT variant, sum(w*x)/sum(w) AS mx, sum(w*y)/sum(w) AS my FROM xy GROUP BY 1),
  mom AS (SELECT variant, sum(w) AS sw, sum(w*w) AS sww, sum(w*(x-mx)*(y-my))/sum(w) AS cov, sum(w*(x-mx)*(x-mx))/sum(w) AS vx, sum(w*(y-my)*(y-my))/sum(w) AS vy FROM xy JOIN mean USING (variant) GROUP BY 1)
  SELECT variant, round(CASE WHEN vx <> 0 AND vy <> 0 THEN cov/sqrt(vx*vy) ELSE 0 END, 9) AS weighted_correlation,
    round(CASE WHEN vx <> 0 THEN cov/vx ELSE 0 END * 10000, 6) AS weighted_slope, round(sw*sw/sww, 6) AS effective_sample_size FROM mom"""))
def association(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates, sample, _ = sampled(spark, sf_dir)
    weighted = candidates.select("node_id", F.lit(1.0).alias("w"))
    material = weighted.unionByName(cut_lineage(sample.select("node_id", F.col("design_weight").alias("w"))))
    measured = cut_lineage(measures(spark, sf_dir))

    def result(name: str, rows: DataFrame) -> DataFrame:
        return stats.weighted_association(
            rows.join(measured, "node_id"), "transit_accessibility", "confirmed_10", "w"
        ).withColumn("variant", F.lit(name))

    both = result("design_weighted", material).unionByName(result("candidates_only", weighted))
    return both.select(
        "variant", F.round("weighted_correlation", 9).alias("weighted_correlation"),
        F.round("weighted_slope", 6).alias("weighted_slope"), F.round("effective_sample_size", 6).alias("effective_sample_size"),
    )


@query("T1_top_by_rank", """SELECT p_partkey, p_retailprice, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20""")
def top_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = ranking.descending_rank(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice", "p_partkey")
    return ranked.orderBy("rank").limit(20)


@query("X12_capture_share", with_views("nodes", f"""WITH {SCREEN_SQL},
  f AS (SELECT *, ceil((fixed + occupancy) / (fee - variable))::BIGINT AS break_even FROM (VALUES ('cautious', 280, 35, 18000, 12000), ('base', 320, 30, 15000, 9000), ('upside', 360, 25, 12000, 6000)) v(scenario, fee, variable, fixed, occupancy))
  SELECT node_id, scenario, break_even, CASE WHEN transit_accessibility > 0 THEN round(break_even / transit_accessibility, 9) END AS capture_share FROM measures, f"""))
def capture_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    from areascreen.functions import finance

    # The three operator scenarios.
    scenarios = F.inline(F.array(*[
        F.struct(F.lit(n).alias("scenario"), F.lit(f).alias("fee"), F.lit(v).alias("variable_cost"), F.lit(x).alias("fixed_cost"), F.lit(o).alias("occupancy_cost"))
        for n, f, v, x, o in (("cautious", 280, 35, 18000, 12000), ("base", 320, 30, 15000, 9000), ("upside", 360, 25, 12000, 6000))
    ]))
    rows = finance.financial_outputs(
        measures(spark, sf_dir).select("node_id", "transit_accessibility", scenarios), capacity=180, target=120
    )
    share = finance.required_capture_share(F.col("break_even"), F.col("transit_accessibility"))
    return rows.select("node_id", "scenario", "break_even", F.round(share, 9).alias("capture_share"))
