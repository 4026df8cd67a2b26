"""SQL that works out overlap areas by horizontal slabs, a method apart from the boundary sums of the library.

Between two neighbouring heights at which anything happens (a corner, the top or bottom of a disc, a crossing of two
boundaries) the order of all boundaries from left to right stays the same. The order is read at the slab's middle, and
the areas between neighbouring boundaries are integrals of lines and of circles in closed form.
"""

from __future__ import annotations

#: Discs of the exits, zones in their reach, and the heights at which the boundary of the discs' union bends.
REACH = """ex AS (SELECT DISTINCT node_id, radius, x, y FROM exits, (VALUES (800::DOUBLE), (1200::DOUBLE)) v(radius)),
  nb AS (SELECT node_id, radius, min(x)-radius AS ax, max(x)+radius AS bx, min(y)-radius AS a_y, max(y)+radius AS b_y FROM ex GROUP BY 1, 2),
  zb AS (SELECT geo_id, min(least(x1,x2)) AS ax, max(greatest(x1,x2)) AS bx, min(least(y1,y2)) AS a_y, max(greatest(y1,y2)) AS b_y FROM zone_edges GROUP BY 1),
  reach AS (SELECT node_id, radius, geo_id, zb.a_y, zb.b_y FROM nb JOIN zb ON nb.ax < zb.bx AND zb.ax < nb.bx AND nb.a_y < zb.b_y AND zb.a_y < nb.b_y),
  top AS (SELECT node_id, radius, x AS px, unnest([y-radius, y+radius]) AS py FROM ex
    UNION ALL
    SELECT node_id, radius, mx + s*h*(y2-y1)/d, my - s*h*(x2-x1)/d FROM (
      SELECT a.node_id, a.radius, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, (a.x+b.x)/2 AS mx, (a.y+b.y)/2 AS my,
        sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS d, sqrt(greatest(0, a.radius*a.radius - ((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))/4)) AS h
      FROM ex a JOIN ex b ON a.node_id = b.node_id AND a.radius = b.radius AND (a.x, a.y) < (b.x, b.y) AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) < 4*a.radius*a.radius), (VALUES (-1), (1)) v(s)),
  ec AS (SELECT node_id, radius, geo_id, x1 + t*(x2-x1) AS px, y1 + t*(y2-y1) AS py FROM (
      SELECT node_id, radius, geo_id, x1, y1, x2, y2, unnest([(-b-sqrt(b*b-a*c))/a, (-b+sqrt(b*b-a*c))/a]) AS t FROM (
        SELECT e.*, z.x1, z.y1, z.x2, z.y2, (x2-x1)*(x2-x1)+(y2-y1)*(y2-y1) AS a, (x1-x)*(x2-x1)+(y1-y)*(y2-y1) AS b, (x1-x)*(x1-x)+(y1-y)*(y1-y)-radius*radius AS c, geo_id
        FROM reach JOIN ex e USING (node_id, radius) JOIN zone_edges z USING (geo_id)) WHERE a > 0 AND b*b-a*c > 0) WHERE t BETWEEN 0 AND 1),
  bends AS (SELECT * FROM top t WHERE NOT EXISTS (FROM ex e WHERE e.node_id = t.node_id AND e.radius = t.radius AND (px-x)*(px-x)+(py-y)*(py-y) < e.radius*e.radius - 1e-3)),
  cuts AS (SELECT * FROM ec t WHERE NOT EXISTS (FROM ex e WHERE e.node_id = t.node_id AND e.radius = t.radius AND (px-x)*(px-x)+(py-y)*(py-y) < e.radius*e.radius - 1e-3))"""

#: Integral of sqrt(r^2 - u^2), and of an island's disc boundary over a slab (side -1 or 1).
ROUND = "(({u})*sqrt(greatest(0, r*r-({u})*({u}))) + r*r*asin(greatest(-1, least(1, ({u})/r))))/2"


def islands(keys: str) -> str:
    """Union of the discs at each slab's middle as (x0, x1) with the integrals i0, i1 of its two ends."""
    low, high = ROUND.format(u="ya-y"), ROUND.format(u="yb-y")
    return f"""dc AS (SELECT {keys}, ya, yb, x-h AS x0, x+h AS x1, x*(yb-ya) - (({high})-({low})) AS i0, x*(yb-ya) + (({high})-({low})) AS i1 FROM (
      SELECT s.*, e.x, e.y, e.radius AS r, sqrt(e.radius*e.radius-((ya+yb)/2-e.y)*((ya+yb)/2-e.y)) AS h FROM slab s JOIN ex e ON e.node_id = s.node_id AND e.radius = s.radius AND abs((ya+yb)/2-e.y) < e.radius)),
  dn AS (SELECT *, CASE WHEN x0 <= max(x1) OVER (PARTITION BY {keys}, ya ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM dc),
  di AS (SELECT *, sum(fresh) OVER (PARTITION BY {keys}, ya ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS island FROM dn),
  disc AS (SELECT {keys}, ya, yb, min(x0) AS x0, max(x1) AS x1, arg_min(i0, x0) AS i0, arg_max(i1, x1) AS i1 FROM di GROUP BY {keys}, ya, yb, island)"""


#: Integral over the overlap of two spans that both carry their ends' integrals.
SHARED = "sum(CASE WHEN z.x1 < d.x1 THEN z.i1 ELSE d.i1 END - CASE WHEN z.x0 > d.x0 THEN z.i0 ELSE d.i0 END)"
_AT = "({y}-y1)*(x2-x1)/(y2-y1) + x1"
_ZONE_SPANS = """zx AS (SELECT {keys}, geo_id, ya, yb, {mid} AS x, ({low} + {high})/2*(yb-ya) AS i
      FROM slab JOIN zone_edges USING (geo_id) WHERE y1 <> y2 AND (y1 <= (ya+yb)/2) <> (y2 <= (ya+yb)/2)),
  zp AS (SELECT *, (row_number() OVER (PARTITION BY {keys}, geo_id, ya ORDER BY x) - 1)//2 AS p FROM zx),
  zspan AS (SELECT {keys}, geo_id, ya, yb, min(x) AS x0, max(x) AS x1, arg_min(i, x) AS i0, arg_max(i, x) AS i1 FROM zp GROUP BY {keys}, geo_id, ya, yb, p)""".replace(
    "{mid}", _AT.format(y="(ya+yb)/2")).replace("{low}", _AT.format(y="ya")).replace("{high}", _AT.format(y="yb"))

#: node_id, radius, population, zone_count.
POPULATION = f"""{REACH},
  ev AS (SELECT node_id, radius, geo_id, y1 AS y FROM reach JOIN zone_edges USING (geo_id)
    UNION SELECT node_id, radius, geo_id, py FROM reach JOIN bends USING (node_id, radius) WHERE py BETWEEN a_y AND b_y
    UNION SELECT node_id, radius, geo_id, py FROM cuts),
  sl AS (SELECT node_id, radius, geo_id, y AS ya, lead(y) OVER (PARTITION BY node_id, radius, geo_id ORDER BY y) AS yb FROM ev),
  slab AS (SELECT * FROM sl WHERE yb > ya),
  {_ZONE_SPANS.replace("{keys}", "node_id, radius")},
  {islands("node_id, radius, geo_id")},
  ov AS (SELECT geo_id, node_id, radius, {SHARED} AS overlap FROM zspan z JOIN disc d USING (node_id, radius, geo_id, ya) WHERE z.x0 < d.x1 AND d.x0 < z.x1 GROUP BY 1, 2, 3),
  za AS (SELECT geo_id, any_value(population) AS population, abs(sum((x1-ax)*(y2-a_y)-(x2-ax)*(y1-a_y)))/2 AS area FROM zone_edges JOIN zb USING (geo_id) GROUP BY 1),
  pop AS (SELECT node_id, radius::INT AS radius, sum(population * least(1, greatest(0, overlap/area))) AS population, count(*) AS zone_count
    FROM ov JOIN za USING (geo_id) WHERE overlap > 1e-6 AND area > 0 GROUP BY 1, 2)"""

#: category, node_id, radius, area of the union of a category's zones (and of all), and buffer_area of the discs' union.
CATEGORIES = f"""{REACH},
  near AS (SELECT node_id, radius, geo_id, category, x1, y1, x2, y2 FROM reach JOIN zone_edges USING (geo_id)),
  ee AS (SELECT node_id, radius, py FROM (
      SELECT e.node_id, e.radius, e.y1 + ((f.x1-e.x1)*(f.y2-f.y1)-(f.y1-e.y1)*(f.x2-f.x1))/((e.x2-e.x1)*(f.y2-f.y1)-(e.y2-e.y1)*(f.x2-f.x1))*(e.y2-e.y1) AS py,
        ((f.x1-e.x1)*(f.y2-f.y1)-(f.y1-e.y1)*(f.x2-f.x1))/((e.x2-e.x1)*(f.y2-f.y1)-(e.y2-e.y1)*(f.x2-f.x1)) AS t, ((f.x1-e.x1)*(e.y2-e.y1)-(f.y1-e.y1)*(e.x2-e.x1))/((e.x2-e.x1)*(f.y2-f.y1)-(e.y2-e.y1)*(f.x2-f.x1)) AS u
      FROM near e JOIN near f ON e.node_id = f.node_id AND e.radius = f.radius AND e.geo_id < f.geo_id AND (e.x2-e.x1)*(f.y2-f.y1) <> (e.y2-e.y1)*(f.x2-f.x1)
        AND least(e.x1,e.x2) <= greatest(f.x1,f.x2) AND least(f.x1,f.x2) <= greatest(e.x1,e.x2) AND least(e.y1,e.y2) <= greatest(f.y1,f.y2) AND least(f.y1,f.y2) <= greatest(e.y1,e.y2))
    WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1),
  ev AS (SELECT node_id, radius, y1 AS y FROM near UNION SELECT node_id, radius, py FROM bends UNION SELECT node_id, radius, py FROM cuts UNION SELECT node_id, radius, py FROM ee),
  sl AS (SELECT node_id, radius, y AS ya, lead(y) OVER (PARTITION BY node_id, radius ORDER BY y) AS yb FROM ev),
  slab AS (SELECT * FROM sl WHERE yb > ya),
  zx AS (SELECT node_id, radius, geo_id, category, ya, yb, {_AT.format(y="(ya+yb)/2")} AS x, ({_AT.format(y="ya")} + {_AT.format(y="yb")})/2*(yb-ya) AS i
      FROM slab JOIN near USING (node_id, radius) WHERE y1 <> y2 AND (y1 <= (ya+yb)/2) <> (y2 <= (ya+yb)/2)),
  zp AS (SELECT *, (row_number() OVER (PARTITION BY node_id, radius, geo_id, ya ORDER BY x) - 1)//2 AS p FROM zx),
  zone AS (SELECT node_id, radius, unnest([category, 'all']) AS category, ya, yb, x0, x1, i0, i1 FROM (
      SELECT node_id, radius, any_value(category) AS category, ya, yb, min(x) AS x0, max(x) AS x1, arg_min(i, x) AS i0, arg_max(i, x) AS i1 FROM zp GROUP BY node_id, radius, geo_id, ya, yb, p)),
  zn AS (SELECT *, CASE WHEN x0 <= max(x1) OVER (PARTITION BY category, node_id, radius, ya ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM zone),
  zi AS (SELECT *, sum(fresh) OVER (PARTITION BY category, node_id, radius, ya ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS island FROM zn),
  zspan AS (SELECT category, node_id, radius, ya, min(x0) AS x0, max(x1) AS x1, arg_min(i0, x0) AS i0, arg_max(i1, x1) AS i1 FROM zi GROUP BY category, node_id, radius, ya, island),
  {islands("node_id, radius")},
  buf AS (SELECT node_id, radius, sum(i1 - i0) AS buffer_area FROM disc GROUP BY 1, 2),
  cov AS (SELECT category, node_id, radius, {SHARED} AS area FROM zspan z JOIN disc d USING (node_id, radius, ya) WHERE z.x0 < d.x1 AND d.x0 < z.x1 GROUP BY 1, 2, 3)"""
