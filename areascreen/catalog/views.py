"""Domain views derived from the given tables, each as a DataFrame and as SQL text.

Nodes are suppliers, origins are customers, exits are parts attached to a node, places
are orders, zones are concave polygons around customers, regions are the cells of a
five by five grid (one per nation) and the trip plan holds every customer-supplier pair
that occurs in the order lines. Only integer arithmetic is used to place things, so
that two engines agree on every coordinate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from areascreen.functions.ids import prefixed_id
from areascreen.operators.skew import sized

#: Fixed values of the standard comparison.
SCENARIOS = ["primary_weekday_after_school", "weekend_comparison"]
THRESHOLD_CASES = [
    ("pt20_walk10_primary", 20, 10, True),
    ("pt15_walk10", 15, 10, False),
    ("pt25_walk10", 25, 10, False),
    ("pt20_walk5", 20, 5, False),
    ("pt20_walk15", 20, 15, False),
]


#: The ray rule over edge rows, as SQL.
CROSS = "(y1 <= py) <> (y2 <= py) AND px < x1 + (py-y1)*(x2-x1)/(y2-y1)"
#: A polygon covers its border: edges that a point crosses or lies on, and the groups of them that say it is covered.
ON = "(px BETWEEN least(x1,x2) AND greatest(x1,x2) AND py BETWEEN least(y1,y2) AND greatest(y1,y2) AND (x2-x1)*(py-y1) = (y2-y1)*(px-x1))"
MEET, COVERED = f"(({CROSS}) OR {ON})", f"count(*) FILTER ({CROSS}) % 2 = 1 OR bool_or({ON})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _position(key: Column, x_factor: int, y_factor: int) -> list[Column]:
    return [
        ((key * x_factor) % 40000).cast("double").alias("x"),
        ((key * y_factor) % 24000).cast("double").alias("y"),
    ]


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, node_name, area, region, x, y."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    places = nation.join(region, nation.n_regionkey == region.r_regionkey)
    supplier = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    return supplier.join(places, supplier.s_nationkey == places.n_nationkey).select(
        key.alias("node_id"), F.col("s_name").alias("node_name"), F.col("n_name").alias("area"),
        F.col("r_name").alias("region"), *_position(key, 7919, 104729),
    )


def origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """origin_id, area, region, category, population, x, y."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    places = nation.join(region, nation.n_regionkey == region.r_regionkey)
    customer = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    return customer.join(places, customer.c_nationkey == places.n_nationkey).select(
        key.alias("origin_id"), F.col("n_name").alias("area"), F.col("r_name").alias("region"),
        F.col("c_mktsegment").alias("category"),
        F.greatest(F.lit(0), F.floor("c_acctbal")).cast("bigint").alias("population"),
        *_position(key, 6007, 15485863),
    )


def exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exit_id, node_id, label, x, y."""
    count = table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n")).scalar()
    part = table(spark, sf_dir, "part").withColumn("node_id", F.col("p_partkey") % count)
    return part.select(
        F.col("p_partkey").alias("exit_id"), "node_id", F.col("p_brand").alias("label"),
        ((F.col("node_id") * 7919) % 40000 + (F.col("p_size") * 13) % 400 - 200).cast("double").alias("x"),
        ((F.col("node_id") * 104729) % 24000 + (F.col("p_partkey") % 97) * 4 - 194).cast("double").alias("y"),
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """place_id, kind, x, y."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("place_id"), F.col("o_orderpriority").alias("kind"), *_position(key, 4001, 32452843)
    )


#: Corners of a zone relative to its anchor, in shares of its width and height.
ZONE_CORNERS = [(0, 0), (12, 0), (12, 12), (8, 12), (6, 4), (4, 12)]


def zone_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """geo_id, category, population, seq, x1, y1, x2, y2: a concave polygon per customer."""
    base = origins(spark, sf_dir).withColumn("w", (F.col("origin_id") % 7) * 60 + 240).withColumn(
        "h", (F.col("origin_id") % 5) * 60 + 180
    )

    def corner(shares: tuple[int, int]) -> tuple[Column, Column]:
        return (
            F.col("x") + (F.col("w") * shares[0] / 12).cast("double"),
            F.col("y") + (F.col("h") * shares[1] / 12).cast("double"),
        )

    edges = []
    for seq, start in enumerate(ZONE_CORNERS):
        end = ZONE_CORNERS[(seq + 1) % len(ZONE_CORNERS)]
        (x1, y1), (x2, y2) = corner(start), corner(end)
        edges.append(F.struct(
            F.lit(seq).cast("bigint").alias("seq"), x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")
        ))
    return base.select(
        F.col("origin_id").alias("geo_id"), "category", "population", F.inline(F.array(*edges))
    )


def region_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """geo_id, name, region, seq, x1, y1, x2, y2: one rectangle per nation."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    x0 = ((F.col("n_nationkey") % 5) * 8000).cast("double")
    y0 = (F.floor(F.col("n_nationkey") / 5) * 4800).cast("double")
    x9, y9 = x0 + 8000, y0 + 4800
    corners = [(x0, y0), (x9, y0), (x9, y9), (x0, y9)]
    edges = [
        F.struct(
            F.lit(seq).cast("bigint").alias("seq"), start[0].alias("x1"), start[1].alias("y1"),
            corners[(seq + 1) % 4][0].alias("x2"), corners[(seq + 1) % 4][1].alias("y2"),
        )
        for seq, start in enumerate(corners)
    ]
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").cast("bigint").alias("geo_id"), F.col("n_name").alias("name"),
        F.col("r_name").alias("region"), F.inline(F.array(*edges)),
    )


def trip_rows(spark: SparkSession, sf_dir: str) -> int:
    """A bound on the rows of the trip table, from the file footers."""
    return table(spark, sf_dir, "lineitem").count() * len(SCENARIOS)


def trip_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """origin_id, node_id, population, x, y, distance: the pairs of an origin (at x, y) and a node that trips are planned for.

    The number of partitions follows the rows, so that what a task sorts or holds does not grow with the data; both sides
    of a step are dealt alike, and the pairs are told apart where the join with the origins needs them.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rows = lines.count()
    joined = sized(lines, ["l_orderkey"], rows).join(sized(orders, ["o_orderkey"], rows), F.col("l_orderkey") == F.col("o_orderkey"))
    pairs = sized(joined.select(F.col("o_custkey").alias("origin_id"), F.col("l_suppkey").alias("node_id")), ["origin_id"], rows).distinct()
    origin = sized(origins(spark, sf_dir).select("origin_id", "population", "x", "y"), ["origin_id"], rows)
    node_x = ((F.col("node_id") * 7919) % 40000).cast("double")
    node_y = ((F.col("node_id") * 104729) % 24000).cast("double")
    dx, dy = F.col("x") - node_x, F.col("y") - node_y
    return pairs.join(origin, "origin_id").withColumn("distance", F.sqrt(dx * dx + dy * dy))


def plan_of(pairs: DataFrame) -> DataFrame:
    """od_plan_id, origin_id, node_id, scenario_id, population, distance: every pair in every scenario."""
    return pairs.withColumn("scenario_id", F.explode(F.array(*[F.lit(s) for s in SCENARIOS]))).select(
        prefixed_id("OD_", "|", "origin_id", "node_id", "scenario_id").alias("od_plan_id"),
        "origin_id", "node_id", "scenario_id", "population", "distance",
    )


def trip_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """od_plan_id, origin_id, node_id, scenario_id, population, distance: the trip table."""
    return plan_of(trip_pairs(spark, sf_dir))


def trip_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes_of(trip_plan(spark, sf_dir))


def outcomes_of(plan: DataFrame) -> DataFrame:
    """od_plan_id, method, category, duration_seconds: what was recorded for each trip.

    Every trip has a public-transport row; trips whose category is not ``success``
    also have a walking row.
    """
    h = F.col("origin_id") * 31 + F.col("node_id") * 17 + F.when(F.col("scenario_id") == SCENARIOS[0], 0).otherwise(7)
    pt = F.when(h % 10 == 0, "missing_route").when(h % 10 == 1, "invalid_response").otherwise("success")
    walk = F.when(F.floor(h / 10) % 4 == 0, "missing_route").otherwise("success")
    rows = F.array_compact(F.array(
        F.struct(
            F.lit("pt").alias("method"), pt.alias("category"),
            F.when(pt == "success", ((h * 37) % 2400 + 60).cast("double")).alias("duration_seconds"),
        ),
        F.when(pt != "success", F.struct(
            F.lit("walk").alias("method"), walk.alias("category"),
            F.when(walk == "success", ((h * 53) % 1800).cast("double")).alias("duration_seconds"),
        )),
    ))
    return plan.select("od_plan_id", F.inline(rows))


_CASES_SQL = ", ".join(f"('{c}', {p}, {w}, {str(b).lower()})" for c, p, w, b in THRESHOLD_CASES)
_EDGES_SQL = ", ".join(
    "{{'seq': {s}, 'x1': x + (w*{a[0]}/12)::DOUBLE, 'y1': y + (h*{a[1]}/12)::DOUBLE, "
    "'x2': x + (w*{b[0]}/12)::DOUBLE, 'y2': y + (h*{b[1]}/12)::DOUBLE}}".format(
        s=i, a=ZONE_CORNERS[i], b=ZONE_CORNERS[(i + 1) % len(ZONE_CORNERS)]
    )
    for i in range(len(ZONE_CORNERS))
)

#: The same views as SQL, in dependency order.
SQL_VIEWS: dict[str, str] = {
    "nodes": """SELECT s_suppkey AS node_id, s_name AS node_name, n_name AS area, r_name AS region,
        ((s_suppkey*7919)%40000)::DOUBLE AS x, ((s_suppkey*104729)%24000)::DOUBLE AS y
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "origins": """SELECT c_custkey AS origin_id, n_name AS area, r_name AS region, c_mktsegment AS category,
        greatest(0, floor(c_acctbal))::BIGINT AS population,
        ((c_custkey*6007)%40000)::DOUBLE AS x, ((c_custkey*15485863)%24000)::DOUBLE AS y
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "exits": """SELECT p_partkey AS exit_id, node_id, p_brand AS label,
        ((node_id*7919)%40000 + (p_size*13)%400 - 200)::DOUBLE AS x,
        ((node_id*104729)%24000 + (p_partkey%97)*4 - 194)::DOUBLE AS y
        FROM (SELECT *, p_partkey % (SELECT count(*) FROM supplier) AS node_id FROM part)""",
    "places": """SELECT o_orderkey AS place_id, o_orderpriority AS kind,
        ((o_orderkey*4001)%40000)::DOUBLE AS x, ((o_orderkey*32452843)%24000)::DOUBLE AS y FROM orders""",
    "zone_edges": f"""SELECT geo_id, category, population, e.seq::BIGINT AS seq, e.x1 AS x1, e.y1 AS y1, e.x2 AS x2, e.y2 AS y2
        FROM (SELECT origin_id AS geo_id, category, population, unnest([{_EDGES_SQL}]) AS e
              FROM (SELECT *, (origin_id%7)*60+240 AS w, (origin_id%5)*60+180 AS h FROM origins))""",
    "region_edges": """SELECT n_nationkey::BIGINT AS geo_id, n_name AS name, r_name AS region, e.seq::BIGINT AS seq,
        e.x1 AS x1, e.y1 AS y1, e.x2 AS x2, e.y2 AS y2
        FROM (SELECT n_nationkey, n_name, r_name, unnest([
          {'seq': 0, 'x1': x0, 'y1': y0, 'x2': x0+8000, 'y2': y0},
          {'seq': 1, 'x1': x0+8000, 'y1': y0, 'x2': x0+8000, 'y2': y0+4800},
          {'seq': 2, 'x1': x0+8000, 'y1': y0+4800, 'x2': x0, 'y2': y0+4800},
          {'seq': 3, 'x1': x0, 'y1': y0+4800, 'x2': x0, 'y2': y0}]) AS e
          FROM (SELECT *, ((n_nationkey%5)*8000)::DOUBLE AS x0, ((n_nationkey//5)*4800)::DOUBLE AS y0 FROM nation)
          JOIN region ON n_regionkey = r_regionkey)""",
    "trip_plan": f"""SELECT 'OD_' || upper(substr(sha256(concat_ws('|', origin_id, node_id, scenario_id)), 1, 16)) AS od_plan_id,
        origin_id, node_id, scenario_id, population,
        sqrt((x-nx)*(x-nx) + (y-ny)*(y-ny)) AS distance
        FROM (SELECT p.*, o.population, o.x, o.y, ((p.node_id*7919)%40000)::DOUBLE AS nx,
                     ((p.node_id*104729)%24000)::DOUBLE AS ny, unnest(['{SCENARIOS[0]}', '{SCENARIOS[1]}']) AS scenario_id
              FROM (SELECT DISTINCT o_custkey AS origin_id, l_suppkey AS node_id
                    FROM lineitem JOIN orders ON l_orderkey = o_orderkey) p JOIN origins o USING (origin_id))""",
    "trip_outcomes": f"""SELECT od_plan_id, method, category, duration_seconds FROM (
        SELECT od_plan_id, 'pt' AS method, pt AS category,
               CASE WHEN pt = 'success' THEN ((h*37)%2400 + 60)::DOUBLE END AS duration_seconds FROM trip_h
        UNION ALL
        SELECT od_plan_id, 'walk', walk, CASE WHEN walk = 'success' THEN ((h*53)%1800)::DOUBLE END FROM trip_h
        WHERE pt <> 'success')""",
    "cases": f"SELECT * FROM (VALUES {_CASES_SQL}) t(threshold_case_id, pt_minutes, walk_minutes, is_primary)",
}
_TRIP_H = f"""SELECT *, CASE WHEN h%10 = 0 THEN 'missing_route' WHEN h%10 = 1 THEN 'invalid_response' ELSE 'success' END AS pt,
    CASE WHEN (h//10)%4 = 0 THEN 'missing_route' ELSE 'success' END AS walk
    FROM (SELECT *, origin_id*31 + node_id*17 + CASE WHEN scenario_id = '{SCENARIOS[0]}' THEN 0 ELSE 7 END AS h FROM trip_plan)"""
_NEEDS = {
    "zone_edges": ["origins"],
    "trip_plan": ["origins"],
    "trip_h": ["trip_plan"],
    "trip_outcomes": ["trip_h"],
}
SQL_VIEWS["trip_h"] = _TRIP_H


def with_views(names: str, body: str) -> str:
    """Prefix ``body`` with the named views (and those they need) as common table expressions."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in _NEEDS.get(name, []):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    views = ",\n".join(f"{name} AS ({SQL_VIEWS[name]})" for name in ordered)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {views},\n{body[5:]}"
    return f"WITH {views}\n{body}"
