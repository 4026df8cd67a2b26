"""Spatial joins, overlap areas and the composites built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from areascreen.catalog import slabs
from areascreen.catalog.registry import query
from areascreen.catalog.views import COVERED, CROSS, MEET, exits, nodes, origins, places, region_edges, with_views, zone_edges
from areascreen.operators.geometry import areas, grid, nearest, polygons, reach, validity
from areascreen.plans import proximity

RADII = (800, 1200)


@query("F9_polygon_measures", with_views("zone_edges", """
  WITH b AS (SELECT geo_id, min(least(x1,x2)) AS bx, min(least(y1,y2)) AS b_y FROM zone_edges GROUP BY 1),
  r AS (SELECT geo_id, bx, b_y, x1-bx AS x1, y1-b_y AS y1, x2-bx AS x2, y2-b_y AS y2 FROM zone_edges JOIN b USING (geo_id)),
  s AS (SELECT geo_id, any_value(bx) AS bx, any_value(b_y) AS b_y, sum(x1*y2-x2*y1) AS a, sum((x1+x2)*(x1*y2-x2*y1)) AS mx, sum((y1+y2)*(x1*y2-x2*y1)) AS my, count(*) AS edge_count,
     count(*) FILTER (x1=x2 AND y1=y2) AS degenerate_edge_count, abs(sum(x2-x1)) + abs(sum(y2-y1)) < 1e-6 AS closed FROM r GROUP BY 1)
  SELECT geo_id, round(abs(a/2), 3) AS area, round(bx + mx/(a*3), 3) AS centroid_x, round(b_y + my/(a*3), 3) AS centroid_y, edge_count, degenerate_edge_count, closed FROM s"""))
def polygon_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = polygons.measures(zone_edges(spark, sf_dir))
    return measured.withColumns({c: F.round(c, 3) for c in ("area", "centroid_x", "centroid_y")})


_BENT_SQL = """bent AS (SELECT geo_id, seq, x1, y1, x2, y2 FROM (SELECT geo_id, seq, geo_id % 10 AS kind,
      CASE WHEN geo_id % 10 = 3 AND seq = 1 THEN ax + w*4/12 ELSE x1 END AS x1, CASE WHEN geo_id % 10 = 3 AND seq = 1 THEN ay + h*8/12 WHEN geo_id % 10 = 4 AND seq = 5 THEN ay ELSE y1 END AS y1,
      CASE WHEN geo_id % 10 = 3 AND seq = 0 THEN ax + w*4/12 ELSE x2 END AS x2, CASE WHEN geo_id % 10 = 3 AND seq = 0 THEN ay + h*8/12 WHEN geo_id % 10 = 4 AND seq = 4 THEN ay ELSE y2 END AS y2
    FROM zone_edges JOIN (SELECT geo_id, min(x1) AS ax, min(y1) AS ay, max(x1)-min(x1) AS w, max(y1)-min(y1) AS h FROM zone_edges GROUP BY 1) USING (geo_id)) WHERE NOT (kind = 5 AND seq = 2))"""


def bent_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zones, some of them spoiled: crossing edges (id ending in 3), a corner on an edge (4), an edge missing (5)."""
    edges = zone_edges(spark, sf_dir)
    box = edges.groupBy("geo_id").agg(F.min("x1").alias("ax"), F.min("y1").alias("ay"), (F.max("x1") - F.min("x1")).alias("w"), (F.max("y1") - F.min("y1")).alias("h"))
    kind, seq = F.col("geo_id") % 10, F.col("seq")
    joined = edges.join(box, "geo_id").filter(~((kind == 5) & (seq == 2)))
    mid_x, mid_y = F.col("ax") + F.col("w") * 4 / 12, F.col("ay") + F.col("h") * 8 / 12
    return joined.select(
        "geo_id", "seq", F.when((kind == 3) & (seq == 1), mid_x).otherwise(F.col("x1")).alias("x1"),
        F.when((kind == 3) & (seq == 1), mid_y).when((kind == 4) & (seq == 5), F.col("ay")).otherwise(F.col("y1")).alias("y1"),
        F.when((kind == 3) & (seq == 0), mid_x).otherwise(F.col("x2")).alias("x2"),
        F.when((kind == 3) & (seq == 0), mid_y).when((kind == 4) & (seq == 4), F.col("ay")).otherwise(F.col("y2")).alias("y2"))


@query("E16_validity_report", with_views("zone_edges", f"""WITH {_BENT_SQL},
  c AS (SELECT geo_id, x, y, sum(o) AS over, count(*) FILTER (o = 1) AS starts FROM (SELECT geo_id, x1 AS x, y1 AS y, 1 AS o FROM bent UNION ALL SELECT geo_id, x2, y2, -1 FROM bent) GROUP BY 1, 2, 3),
  s AS (SELECT a.geo_id, a.x1, a.y1, a.x2, a.y2, b.x1 AS u1, b.y1 AS v1, b.x2 AS u2, b.y2 AS v2, (a.x2-a.x1)*(b.y1-a.y1)-(a.y2-a.y1)*(b.x1-a.x1) AS s1, (a.x2-a.x1)*(b.y2-a.y1)-(a.y2-a.y1)*(b.x2-a.x1) AS s2,
      (b.x2-b.x1)*(a.y1-b.y1)-(b.y2-b.y1)*(a.x1-b.x1) AS t1, (b.x2-b.x1)*(a.y2-b.y1)-(b.y2-b.y1)*(a.x2-b.x1) AS t2 FROM bent a JOIN bent b ON a.geo_id = b.geo_id AND a.seq <> b.seq),
  p AS (SELECT geo_id, 'unclosed_ring' AS reason, x, y FROM c WHERE over <> 0 UNION SELECT geo_id, 'repeated_corner', x, y FROM c WHERE starts > 1
    UNION SELECT geo_id, 'crossing_edges', round(u1 + s1/(s1-s2)*(u2-u1), 3), round(v1 + s1/(s1-s2)*(v2-v1), 3) FROM s WHERE sign(s1)*sign(s2) < 0 AND sign(t1)*sign(t2) < 0
    UNION SELECT geo_id, 'overlapping_edges', lo[1], lo[2] FROM (SELECT geo_id, list_max([list_min([row(x1, y1), row(x2, y2)]), list_min([row(u1, v1), row(u2, v2)])]) AS lo,
        list_min([list_max([row(x1, y1), row(x2, y2)]), list_max([row(u1, v1), row(u2, v2)])]) AS hi FROM s WHERE s1 = 0 AND s2 = 0) WHERE lo < hi
    UNION SELECT geo_id, 'touching_edge', u1, v1 FROM s WHERE s1 = 0 AND s2 <> 0 AND u1 BETWEEN least(x1,x2) AND greatest(x1,x2) AND v1 BETWEEN least(y1,y2) AND greatest(y1,y2) AND (u1,v1) <> (x1,y1) AND (u1,v1) <> (x2,y2)
    UNION SELECT geo_id, 'touching_edge', u2, v2 FROM s WHERE s2 = 0 AND s1 <> 0 AND u2 BETWEEN least(x1,x2) AND greatest(x1,x2) AND v2 BETWEEN least(y1,y2) AND greatest(y1,y2) AND (u2,v2) <> (x1,y1) AND (u2,v2) <> (x2,y2)),
  f AS (SELECT geo_id, min((reason, x, y)) AS first, count(*) AS n FROM p GROUP BY 1)
  SELECT geo_id, n IS NULL AS valid, first[1] AS reason, round(first[2], 3) AS x, round(first[3], 3) AS y, coalesce(n, 0) AS problem_count FROM (SELECT DISTINCT geo_id FROM bent) LEFT JOIN f USING (geo_id)"""))
def validity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = validity.validity(bent_edges(spark, sf_dir), cell_size=250.0)
    return found.withColumns({c: F.round(c, 3) for c in ("x", "y")})


@query("J5_point_in_polygon", with_views("origins region_edges zone_edges", f"""
  WITH p AS (SELECT DISTINCT x AS px, y AS py FROM origins),
  m AS (SELECT px, py, geo_id FROM p, region_edges WHERE {MEET} GROUP BY ALL HAVING {COVERED}),
  n AS (SELECT px, py, min(name) AS anchor_area, count(*) AS match_count FROM m JOIN (SELECT DISTINCT geo_id, name FROM region_edges) USING (geo_id) GROUP BY 1, 2)
  SELECT origin_id, anchor_area, coalesce(match_count, 0) AS match_count FROM origins LEFT JOIN n ON x = px AND y = py"""))
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = region_edges(spark, sf_dir)
    names = edges.select("geo_id", F.col("name").alias("anchor_area")).distinct()
    assigned = polygons.assign_polygon(
        origins(spark, sf_dir), edges, names, policy="least", cell_size=2000.0, attributes=["anchor_area"]
    )
    return assigned.select("origin_id", "anchor_area", "match_count")


@query("J5_unique_zone", with_views("places zone_edges", f"""
  WITH p AS (SELECT DISTINCT x AS px, y AS py FROM places),
  m AS (SELECT px, py, geo_id FROM p JOIN zone_edges ON {MEET} GROUP BY ALL HAVING {COVERED}),
  n AS (SELECT px, py, min(geo_id) AS zone, count(*) AS match_count FROM m GROUP BY 1, 2)
  SELECT place_id, CASE WHEN match_count = 1 THEN zone END AS zone, coalesce(match_count, 0) AS match_count
  FROM places LEFT JOIN n ON x = px AND y = py"""))
def unique_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = zone_edges(spark, sf_dir)
    names = edges.select("geo_id", F.col("geo_id").alias("zone")).distinct()
    assigned = polygons.assign_polygon(
        places(spark, sf_dir), edges, names, policy="unique", cell_size=500.0, attributes=["zone"]
    )
    return assigned.select("place_id", "zone", "match_count")


@query("J5_border_points", with_views("region_edges", f"""
  WITH p AS (SELECT geo_id AS own, seq, along, x1 + along*(x2-x1) AS px, y1 + along*(y2-y1) AS py FROM region_edges, (VALUES (0.0::DOUBLE), (0.5), (0.625)) v(along)),
  m AS (SELECT px, py, geo_id, name FROM (SELECT DISTINCT px, py FROM p), region_edges WHERE {MEET} GROUP BY ALL HAVING {COVERED}),
  n AS (SELECT px, py, min(name) AS name, count(*) AS match_count FROM m GROUP BY 1, 2)
  SELECT own, seq, along, CASE WHEN match_count = 1 THEN name END AS only_area, name AS first_area, match_count FROM p LEFT JOIN n USING (px, py)"""))
def border_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners and points on the borders of all regions, under the policies of one and of the least match."""
    edges = region_edges(spark, sf_dir)
    names = edges.select("geo_id", "name").distinct()
    along = F.explode(F.array(*[F.lit(t) for t in (0.0, 0.5, 0.625)])).alias("along")
    points = edges.select(F.col("geo_id").alias("own"), "seq", "x1", "y1", "x2", "y2", along)
    points = points.select("own", "seq", "along", (F.col("x1") + F.col("along") * (F.col("x2") - F.col("x1"))).alias("x"), (F.col("y1") + F.col("along") * (F.col("y2") - F.col("y1"))).alias("y"))
    only = polygons.assign_polygon(points, edges, names, policy="unique", cell_size=2000.0, attributes=["name"]).withColumnRenamed("name", "only_area")
    both = polygons.assign_polygon(only.drop("match_count"), edges, names, policy="least", cell_size=2000.0, attributes=["name"])
    return both.select("own", "seq", "along", "only_area", F.col("name").alias("first_area"), "match_count")


@query("J6_points_within_union", with_views("exits places", """
  WITH n AS (SELECT node_id, place_id, min((e.x-p.x)*(e.x-p.x) + (e.y-p.y)*(e.y-p.y)) AS d2 FROM (SELECT DISTINCT node_id, x, y FROM exits) e
     JOIN places p ON p.x BETWEEN e.x-1200 AND e.x+1200 AND p.y BETWEEN e.y-1200 AND e.y+1200 GROUP BY 1, 2)
  SELECT node_id, coalesce(count(*) FILTER (d2 <= 640000), 0) AS places_800m, coalesce(count(*) FILTER (d2 <= 1440000), 0) AS places_1200m
  FROM (SELECT DISTINCT node_id FROM exits) LEFT JOIN n USING (node_id) GROUP BY 1"""))
def points_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.counts_within(exits(spark, sf_dir), places(spark, sf_dir), [800.0, 1200.0], key="node_id", prefix="places")


@query("J7_area_weighted_population", with_views("exits zone_edges", f"""WITH {slabs.POPULATION}
  SELECT node_id, radius::BIGINT AS radius, round(population, 3) AS population, zone_count FROM pop"""))
def weighted_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = areas.area_weighted_population(exits(spark, sf_dir), zone_edges(spark, sf_dir), RADII, key="node_id")
    return people.select("node_id", F.col("radius").cast("bigint").alias("radius"), F.round("population", 3).alias("population"), "zone_count")


@query("J7_zones_reached", with_views("exits zone_edges", f"""
  WITH e AS (SELECT DISTINCT node_id, x AS px, y AS py FROM exits),
  near AS (SELECT DISTINCT node_id, geo_id FROM (SELECT *, greatest(0, least(1, coalesce(((px-x1)*(x2-x1)+(py-y1)*(y2-y1)) / nullif((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1), 0), 0))) AS t
      FROM e JOIN zone_edges ON px BETWEEN least(x1,x2)-800 AND greatest(x1,x2)+800 AND py BETWEEN least(y1,y2)-800 AND greatest(y1,y2)+800)
      WHERE sqrt((px-(x1+t*(x2-x1)))*(px-(x1+t*(x2-x1))) + (py-(y1+t*(y2-y1)))*(py-(y1+t*(y2-y1)))) < 800),
  inside AS (SELECT DISTINCT node_id, geo_id FROM (SELECT node_id, px, py, geo_id FROM e JOIN zone_edges ON {CROSS} GROUP BY ALL HAVING count(*)%2 = 1))
  SELECT node_id, count(*) AS zone_count FROM (SELECT * FROM near UNION SELECT * FROM inside) GROUP BY 1"""))
def zones_reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reach.within_reach(exits(spark, sf_dir), zone_edges(spark, sf_dir), [800], key="node_id", areas=False)
    return found.select("node_id", F.col("reached").alias("zone_count"))


@query("J8_category_overlap", with_views("exits zone_edges", f"""WITH {slabs.CATEGORIES}
  SELECT category, node_id, radius::BIGINT AS radius, round(area, 2) AS area, round(buffer_area, 2) AS buffer_area, round(area/buffer_area, 6) AS area_share
  FROM cov JOIN buf USING (node_id, radius) WHERE area > 1e-6"""))
def category_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = areas.category_overlap(exits(spark, sf_dir), zone_edges(spark, sf_dir), RADII, key="node_id")
    return found.select(
        F.coalesce("category", F.lit("all")).alias("category"), "node_id", F.col("radius").cast("bigint").alias("radius"),
        F.round("area", 2).alias("area"), F.round("buffer_area", 2).alias("buffer_area"), F.round("area_share", 6).alias("area_share"),
    )


@query("J10_nearest_polygon", with_views("exits zone_edges", f"""
  WITH e AS (SELECT DISTINCT node_id, x AS px, y AS py FROM exits),
  d AS (SELECT node_id, px, py, x1, y1, x2, y2, greatest(0, least(1, coalesce(((px-x1)*(x2-x1)+(py-y1)*(y2-y1)) / nullif((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1), 0), 0))) AS t FROM e, zone_edges),
  near AS (SELECT node_id, min(sqrt((px-(x1+t*(x2-x1)))*(px-(x1+t*(x2-x1))) + (py-(y1+t*(y2-y1)))*(py-(y1+t*(y2-y1))))) AS distance FROM d GROUP BY 1),
  inside AS (SELECT DISTINCT node_id FROM (SELECT node_id, px, py, geo_id FROM e JOIN zone_edges ON {CROSS} GROUP BY ALL HAVING count(*)%2 = 1))
  SELECT node_id, round(CASE WHEN node_id IN (SELECT node_id FROM inside) THEN 0 ELSE distance END, 3) AS distance FROM near"""))
def nearest_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest.nearest_polygon(exits(spark, sf_dir), zone_edges(spark, sf_dir), key="node_id", leaf=250.0)
    return found.select("node_id", F.round("distance", 3).alias("distance"))


@query("J9_J11_nearest_point", with_views("exits places", """
  SELECT node_id, round(sqrt(min((e.x-p.x)*(e.x-p.x) + (e.y-p.y)*(e.y-p.y))), 3) AS distance
  FROM (SELECT DISTINCT node_id, x, y FROM exits) e, (SELECT DISTINCT x, y FROM places) p GROUP BY 1"""))
def nearest_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest.nearest_point(exits(spark, sf_dir), places(spark, sf_dir), key="node_id", leaf=250.0)
    return found.select("node_id", F.round("distance", 3).alias("distance"))


ANCHOR_SQL = f"""ap AS (SELECT DISTINCT x AS px, y AS py FROM nodes),
  am AS (SELECT px, py, geo_id FROM ap, region_edges WHERE {MEET} GROUP BY ALL HAVING {COVERED}),
  an AS (SELECT px, py, min(name) AS anchor_area, min(r.region) AS anchor_region, count(*) AS match_count FROM am JOIN (SELECT DISTINCT geo_id, name, region FROM region_edges) r USING (geo_id) GROUP BY 1, 2)"""


@query("X1_proximity_baseline", with_views("nodes exits places zone_edges region_edges", f"""WITH {slabs.POPULATION}, {ANCHOR_SQL},
  ee AS (SELECT DISTINCT node_id, x AS px, y AS py FROM exits),
  nd AS (SELECT node_id, geo_id, sqrt((px-(x1+t*(x2-x1)))*(px-(x1+t*(x2-x1))) + (py-(y1+t*(y2-y1)))*(py-(y1+t*(y2-y1)))) AS d FROM (
      SELECT *, greatest(0, least(1, coalesce(((px-x1)*(x2-x1)+(py-y1)*(y2-y1)) / nullif((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1), 0), 0))) AS t
      FROM ee JOIN zone_edges ON px BETWEEN least(x1,x2)-1200 AND greatest(x1,x2)+1200 AND py BETWEEN least(y1,y2)-1200 AND greatest(y1,y2)+1200)
      UNION ALL SELECT node_id, geo_id, -1.0 FROM (SELECT node_id, px, py, geo_id FROM ee JOIN zone_edges ON {CROSS} GROUP BY ALL HAVING count(*)%2 = 1)),
  zc AS (SELECT node_id, count(DISTINCT geo_id) FILTER (d < 800) AS zone_count_800m, count(DISTINCT geo_id) FILTER (d < 1200) AS zone_count_1200m FROM nd GROUP BY 1),
  pw AS (SELECT node_id, count(*) FILTER (d2 <= 640000) AS places_800m, count(*) FILTER (d2 <= 1440000) AS places_1200m FROM (
     SELECT node_id, place_id, min((e.x-p.x)*(e.x-p.x) + (e.y-p.y)*(e.y-p.y)) AS d2 FROM (SELECT DISTINCT node_id, x, y FROM exits) e
     JOIN places p ON p.x BETWEEN e.x-1200 AND e.x+1200 AND p.y BETWEEN e.y-1200 AND e.y+1200 GROUP BY 1, 2) GROUP BY 1),
  j AS (SELECT n.node_id, n.node_name, n.area, n.region, n.x, n.y,
      coalesce(round((SELECT population FROM pop WHERE pop.node_id = n.node_id AND radius = 800), 3), 0) AS population_800m, coalesce(zone_count_800m, 0) AS zone_count_800m,
      coalesce(round((SELECT population FROM pop WHERE pop.node_id = n.node_id AND radius = 1200), 3), 0) AS population_1200m, coalesce(zone_count_1200m, 0) AS zone_count_1200m,
      coalesce(places_800m, 0) AS places_800m, coalesce(places_1200m, 0) AS places_1200m,
      CASE WHEN match_count = 1 THEN anchor_area END AS anchor_area, CASE WHEN match_count = 1 THEN anchor_region END AS anchor_region
    FROM nodes n LEFT JOIN zc USING (node_id) LEFT JOIN pw USING (node_id) LEFT JOIN an ON n.x = px AND n.y = py),
  k AS (SELECT *, row_number() OVER (ORDER BY population_800m DESC, node_id) AS rank, count(*) OVER () AS cnt FROM j),
  l AS (SELECT *, CASE WHEN cnt = 1 THEN 0.0 ELSE (cnt - rank) / (cnt - 1) END AS percentile FROM k)
  SELECT * EXCLUDE (cnt), CASE WHEN percentile >= 0.75 THEN 4 WHEN percentile >= 0.5 THEN 3 WHEN percentile >= 0.25 THEN 2 ELSE 1 END AS quartile,
    to_json(list_filter(['anchor_without_region', 'no_population_nearby'], lambda f: (f = 'anchor_without_region' AND anchor_region IS NULL) OR (f = 'no_population_nearby' AND population_800m = 0))) AS quality_flags FROM l"""))
def proximity_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proximity.proximity_baseline(
        nodes(spark, sf_dir), exits(spark, sf_dir), zone_edges(spark, sf_dir), {"places": places(spark, sf_dir)},
        region_edges(spark, sf_dir), radii=RADII,
    )


SIGNAL_SQL = f"""{ANCHOR_SQL},
  pairs AS (SELECT node_id, place_id, min((e.x-p.x)*(e.x-p.x) + (e.y-p.y)*(e.y-p.y)) AS d2 FROM (SELECT DISTINCT node_id, x, y FROM exits) e, places p GROUP BY 1, 2),
  agg AS (SELECT node_id, count(*) FILTER (d2 <= 160000) AS c400, count(*) FILTER (d2 <= 640000) AS c800, sqrt(min(d2)) AS d FROM pairs GROUP BY 1),
  cov AS (SELECT n.node_id, anchor_region, round_even(d, 3)::DOUBLE AS nearest_distance, b.buffer_metres::BIGINT AS buffer_metres,
      CASE WHEN b.buffer_metres = 400 THEN c400 ELSE c800 END AS point_count, CASE WHEN b.buffer_metres = 400 THEN c400 ELSE c800 END > 0 AS positive_signal
    FROM nodes n JOIN agg USING (node_id) LEFT JOIN an ON x = px AND y = py, (VALUES (400), (800)) b(buffer_metres))"""


def signal_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proximity.signal_coverage(
        nodes(spark, sf_dir), exits(spark, sf_dir), places(spark, sf_dir), region_edges(spark, sf_dir),
        radii=(400, 800), cell_size=2000.0, leaf=250.0,
    ).withColumn("buffer_metres", F.col("buffer_metres").cast("bigint"))


@query("X11_signal_coverage", with_views("nodes exits places region_edges", f"WITH {SIGNAL_SQL} SELECT * FROM cov"))
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal_coverage(spark, sf_dir)


@query("A23_regional_coverage", with_views("nodes exits places region_edges", f"""WITH {SIGNAL_SQL}
  SELECT anchor_region, count(*) AS node_count, count(*) FILTER (positive_signal) AS positive_count,
         round(count(*) FILTER (positive_signal) / count(*), 6) AS coverage_rate
  FROM cov WHERE buffer_metres = 800 AND anchor_region IS NOT NULL GROUP BY 1"""))
def regional(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = proximity.regional_coverage(signal_coverage(spark, sf_dir), 800)
    return rates.withColumn("coverage_rate", F.round("coverage_rate", 6))
