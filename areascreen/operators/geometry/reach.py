"""People and polygons within reach of the discs around a key's centres, without a row per edge, disc or pair.

The discs of a key and the edges of a polygon are one row each. Both are dealt to the grid cells their boxes touch, and a
pair is worked out in the cell that holds the lower corner of what both boxes share. A cell's rows are cut into a grid
of pieces of bounded size, and a piece leaves one row of sums per key and radius. Most polygons lie inside one disc or outside
all; the others are summed along their boundaries as in ``areas``. Equal polygons are one shape.

Keys of more than ``CENTRES`` centres and polygons of more than ``EDGES`` edges are left to the joins of ``areas`` and
``polygons``, which hold neither whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from areascreen.operators.geometry.areas import LEAST_AREA, START, overlap_areas, union_arcs, union_area
from areascreen.operators.geometry.grid import box_cells
from areascreen.operators.geometry.polygons import measures, polygon_distances
from areascreen.operators.geometry.unions import oriented
from areascreen.operators.skew import sized
from areascreen.session import cut_lineage

#: Centres of a key and edges of a polygon that are held in one row.
CENTRES, EDGES = 256, 512
#: Rows of discs and of shapes in one piece of a cell, and edge-disc pairs worked out at once.
KEY_ROWS, SHAPE_ROWS, STEP = 1024, 8192, 1 << 18
_TURN = 2 * math.pi
#: Where on an arc its base lies: a place where no corner of a plan does. Factors for what is surely nearer or farther.
_ALONG, _LESS, _MORE = 0.3819660112501051, 1 - 1e-12, 1 + 1e-12
#: Share of an edge within which two places count as one.
_NEAR = 1e-6
#: Sectors around a key's middle, and the directions of their middles.
SECTORS = 8
_MIDDLES = (np.arange(SECTORS) + 0.5) * _TURN / SECTORS - math.pi


def free_arcs(x: np.ndarray, y: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(circle, start, end) of the arcs that bound the union of the discs of radius r; angles are counted from START."""
    dx, dy = x[None, :] - x[:, None], y[None, :] - y[:, None]
    gap = np.sqrt(dx * dx + dy * dy)
    near = (gap > 0) & (gap < 2 * r)
    half = np.where(near, np.arccos(np.minimum(1.0, gap / (2 * r))), 0.0)
    start = np.where(near, np.mod(np.mod(np.arctan2(dy, dx) - START, _TURN) - half, _TURN), 0.0)
    end = start + 2 * half
    edge = np.zeros((len(x), 1))
    low = np.concatenate([edge, start, np.zeros_like(start), edge + _TURN], axis=1)
    high = np.concatenate([edge, np.minimum(end, _TURN), np.maximum(end - _TURN, 0.0), edge + _TURN], axis=1)
    order = np.argsort(low, axis=1)
    low, high = np.take_along_axis(low, order, 1), np.take_along_axis(high, order, 1)
    before = np.maximum.accumulate(high, axis=1)[:, :-1]
    circle, place = np.nonzero(low[:, 1:] > before)
    return circle, before[circle, place], low[circle, place + 1]


def _within(x: np.ndarray, y: np.ndarray, r: float, start: np.ndarray, end: np.ndarray) -> float:
    """Area inside the arcs of circles around (x, y)."""
    x, y = x - x[0], y - y[0]
    start, end = start + START, end + START
    return float((r * r * (end - start) + r * (x * (np.sin(end) - np.sin(start)) - y * (np.cos(end) - np.cos(start)))).sum() / 2)


def _facing(x, y, r, circle, start, end, middle) -> list[np.ndarray]:
    """The discs with a free arc in each sector around the middle and half a sector to either side; all discs last.

    A disc that holds the middle holds the way from there to each of its points. So ground of a sector lies in the union only
    if it lies in a disc that has a free arc there.
    """
    mx, my, wide = middle
    whole = np.arange(len(x))
    if len(x) < 4 or wide > 0.9 * r:
        return [whole]
    first, last = (np.arctan2(y[circle] + r * np.sin(a + START) - my, x[circle] + r * np.cos(a + START) - mx) for a in (start, end))
    turn = np.where(end - start > math.pi, _TURN, np.mod(last - first, _TURN))
    ahead = np.mod(first - (_MIDDLES[:, None] - _TURN / SECTORS), _TURN)
    seen = (ahead <= 2 * _TURN / SECTORS + _NEAR) | (ahead + turn >= _TURN - _NEAR)
    return [np.unique(circle[row]) for row in seen] + [whole]


def _by_sector(rows, facing, hx, hy, gx, gy) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(discs, rows) for the edges from h to g, seen from the middle: by the sector they face, if they keep to it and its sides."""
    if len(facing) == 1:
        yield facing[0], rows
        return
    hx, hy, gx, gy = hx[rows], hy[rows], gx[rows], gy[rows]
    sector = np.minimum(SECTORS - 1, ((np.arctan2(hy + gy, hx + gx) + math.pi) * (SECTORS / _TURN)).astype(np.int8))
    cx, cy, least = np.cos(_MIDDLES)[sector], np.sin(_MIDDLES)[sector], math.cos(_TURN / SECTORS)
    keeps = (hx * cx + hy * cy >= least * np.sqrt(hx * hx + hy * hy)) & (gx * cx + gy * cy >= least * np.sqrt(gx * gx + gy * gy))
    sector[~keeps] = SECTORS
    order = np.argsort(sector, kind="stable")
    bounds = np.searchsorted(sector[order], np.arange(SECTORS + 2))
    for k, discs in enumerate(facing):
        if bounds[k] < bounds[k + 1] and len(discs):
            yield discs, rows[order[bounds[k]:bounds[k + 1]]]


def _discs(centres: DataFrame, radii: Sequence[float], key: str) -> DataFrame:
    """A row per key and radius: the discs that make up the union, the arcs that bound it, and its area.

    Where the centres lie closer together than the radius the union has no hole, and discs without a free arc add nothing.
    """
    gathered = centres.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("spots"))
    kind = centres.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, radius double, buffer_area double, x array<double>, y array<double>, circle array<int>, start array<double>, end array<double>, ox double, oy double, lo_x double, hi_x double, lo_y double, hi_y double"

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spots, names = batch.column("spots"), batch.column(key)
            rows, taken = [], []
            for i, listed in enumerate(spots):
                held = listed.values
                x, y = held.field("x").to_numpy(zero_copy_only=False), held.field("y").to_numpy(zero_copy_only=False)
                box = (x.min(), x.max(), y.min(), y.max())
                for r in radii:
                    circle, start, end = free_arcs(x, y, r)
                    kept = np.unique(circle) if math.hypot(box[1] - box[0], box[3] - box[2]) <= 0.99 * r else np.arange(len(x))
                    taken.append(i)
                    rows.append((r, _within(x[circle], y[circle], r, start, end), x[kept], y[kept], np.searchsorted(kept, circle).astype("int32"), start, end, box[0], box[2], box[0] - r, box[1] + r, box[2] - r, box[3] + r))
            columns = [pa.array(c) for c in zip(*rows)] if rows else [[] for _ in range(13)]
            made = [names.take(pa.array(taken, pa.int32()))] + list(columns)
            yield pa.RecordBatch.from_arrays(made, names=[key, "radius", "buffer_area", "x", "y", "circle", "start", "end", "ox", "oy", "lo_x", "hi_x", "lo_y", "hi_y"])

    return gathered.mapInArrow(compute, schema)


def _shapes(edges: DataFrame, polygon: str, rows: int) -> DataFrame:
    """A row per set of equal polygons: edges with the inside on their left, box, people (sum) and copies."""
    people = F.coalesce(F.max("population"), F.lit(0)).cast("double")
    drawn = oriented(edges, polygon).groupBy(polygon).agg(F.array_sort(F.collect_list(F.struct("x1", "y1", "x2", "y2"))).alias("edges"), people.alias("population"))
    shapes = sized(drawn, ["edges"], rows).groupBy("edges").agg(F.sum("population").alias("population"), F.count(F.lit(1)).alias("copies"))
    ends = lambda a, b: F.concat(F.col(f"edges.{a}"), F.col(f"edges.{b}"))
    return shapes.withColumns({"lo_x": F.array_min(ends("x1", "x2")), "hi_x": F.array_max(ends("x1", "x2")), "lo_y": F.array_min(ends("y1", "y2")), "hi_y": F.array_max(ends("y1", "y2"))})


class _Piece:
    """The shapes of one piece of a cell as flat arrays."""

    def __init__(self, table: pa.Table, least: float = LEAST_AREA, by: str | None = None):
        self.least, self.label = least, None
        if by:
            coded = table.column(by).combine_chunks().dictionary_encode()
            self.label, self.names = coded.indices.to_numpy(), coded.dictionary
        listed = table.column("edges").combine_chunks()
        flat = listed.flatten()
        self.x1, self.y1, self.x2, self.y2 = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("x1", "y1", "x2", "y2"))
        self.lo_x, self.hi_x, self.lo_y, self.hi_y, self.population, self.copies = (
            table.column(c).to_numpy() for c in ("lo_x", "hi_x", "lo_y", "hi_y", "population", "copies"))
        self.owner = np.repeat(np.arange(len(listed)), np.diff(listed.offsets.to_numpy()))
        ox, oy = self.lo_x[self.owner], self.lo_y[self.owner]
        cross = (self.x1 - ox) * (self.y2 - oy) - (self.x2 - ox) * (self.y1 - oy)
        self.area = np.bincount(self.owner, cross / 2, len(self.lo_x))

    def _people(self, shapes: np.ndarray, people: np.ndarray) -> float | np.ndarray:
        """The sum, or one for each label."""
        return float(people.sum()) if self.label is None else np.bincount(self.label[shapes], people, len(self.names)).astype(float)

    def sums(self, x, y, r, circle, start, end, ox, oy, box, here, areas: bool, distances: bool) -> tuple[float | np.ndarray, int, int]:
        """(population, polygons that share ground with the discs, polygons closer than r to a centre)."""
        near = np.nonzero((self.lo_x <= box[1]) & (self.hi_x >= box[0]) & (self.lo_y <= box[3]) & (self.hi_y >= box[2]) & here(np.maximum(self.lo_x, box[0]), np.maximum(self.lo_y, box[2])))[0]
        # Ground closer than r - wide to the middle lies in every disc, ground farther than r + wide in none.
        mx, my, r2 = (x.min() + x.max()) / 2, (y.min() + y.max()) / 2, r * r
        wide = float(np.hypot(x - mx, y - my).max())
        left, right, below, above = self.lo_x[near] - mx, self.hi_x[near] - mx, self.lo_y[near] - my, self.hi_y[near] - my
        inside = np.hypot(np.maximum(np.abs(left), np.abs(right)), np.maximum(np.abs(below), np.abs(above))) < (r - wide) * _LESS
        away = np.hypot(np.maximum(np.maximum(left, -right), 0.0), np.maximum(np.maximum(below, -above), 0.0)) > (r + wide) * _MORE
        full, near = [near[inside]], near[~inside & ~away]
        left, right, below, above = (c[near] - p[:, None] for c, p in ((self.lo_x, x), (self.hi_x, x), (self.lo_y, y), (self.hi_y, y)))
        far_x, far_y = np.maximum(np.abs(left), np.abs(right)), np.maximum(np.abs(below), np.abs(above))
        inside = (far_x * far_x + far_y * far_y < r2 * _LESS).any(axis=0)
        full.append(near[inside])
        chosen, full = near[~inside], np.concatenate(full)
        reached = int(self.copies[full].sum())
        full = full[self.area[full] > self.least]
        people, count = self._people(full, self.population[full]), int(self.copies[full].sum())
        if len(chosen):
            shared, close = self._along(chosen, x, y, r, circle, start, end, ox, oy, (mx, my, wide), areas, distances)
            if areas:
                area = self.area[chosen]
                hit = (shared > self.least) & (area > 0)
                share = np.minimum(1.0, np.maximum(0.0, shared[hit] / area[hit]))
                people += self._people(chosen[hit], self.population[chosen][hit] * share)
                count += int(self.copies[chosen][hit].sum())
            reached += int(self.copies[chosen][close].sum())
        return people, count, reached

    def _along(self, chosen, x, y, r, circle, start, end, ox, oy, middle, areas, distances):
        """Areas shared with the union, and whether a centre is closer than r, of the chosen shapes.

        An edge with both ends in one disc lies inside; only the other edges near the discs are cut by them. An arc is
        followed from a point on it, forth and back.
        """
        m, r2, (mx, my, wide) = len(chosen), r * r, middle
        place = np.full(len(self.lo_x), -1)
        place[chosen] = np.arange(m)
        of = np.nonzero(place[self.owner] >= 0)[0]
        total, close = np.zeros(m), np.zeros(m, dtype=bool)
        cx, cy = x[circle], y[circle]
        turned = lambda angle, px, py: (r2 * angle + r * ((px - ox) * (np.sin(angle + START) - math.sin(START)) - (py - oy) * (np.cos(angle + START) - math.cos(START)))) / 2
        begun, ended, base = turned(start, cx, cy), turned(end, cx, cy), start + _ALONG * (end - start)
        arcs = [np.nonzero(circle == k)[0] for k in range(len(x))]
        nth = np.full((len(x), max(1, max(map(len, arcs)))), -1)  # the arcs of each circle
        for k, own in enumerate(arcs):
            nth[k, :len(own)] = own
        facing = _facing(x, y, r, circle, start, end, middle)
        for low in range(0, len(of), STEP):
            e = of[low:low + STEP]
            z, x1, y1, x2, y2 = place[self.owner[e]], self.x1[e], self.y1[e], self.x2[e], self.y2[e]
            dx, dy, hx, hy = x2 - x1, y2 - y1, x1 - mx, y1 - my
            a = dx * dx + dy * dy
            t = np.minimum(1.0, np.maximum(0.0, np.divide(-(hx * dx + hy * dy), a, out=np.zeros_like(a), where=a > 0)))
            gx, gy, tx, ty = x2 - mx, y2 - my, hx + t * dx, hy + t * dy
            held = np.maximum(hx * hx + hy * hy, gx * gx + gy * gy) < max(0.0, r - wide) ** 2 * _LESS
            cross = ((x1 - ox) * dy - (y1 - oy) * dx) / 2
            total += np.bincount(z[held], cross[held], m)
            close[z[held]] = True
            rest = np.nonzero(~held & (tx * tx + ty * ty <= (r + wide) ** 2 * _MORE))[0]
            for discs, group in _by_sector(rest, facing, hx, hy, gx, gy):
                px, py = x[discs], y[discs]
                step = max(1, STEP // len(discs))
                for at in range(0, len(group), step):
                    part = group[at:at + step]
                    lines = [c[part] for c in (z, x1, y1, x2, y2, cross)]
                    fx, fy, ux, uy = lines[1] - px[:, None], lines[2] - py[:, None], lines[3] - px[:, None], lines[4] - py[:, None]
                    f2, g2 = fx * fx + fy * fy, ux * ux + uy * uy
                    if distances:
                        close[lines[0][(f2 < r2 * _LESS).any(axis=0)]] = True
                    if areas:
                        in1, in2 = f2 <= r2, g2 <= r2
                        whole = (in1 & in2).any(axis=0)
                        total += np.bincount(lines[0][whole], lines[5][whole], m)
                        cut = np.nonzero(~whole)[0]
                        total += self._cut([c[cut] for c in lines], in1[:, cut], in2[:, cut], fx[:, cut], fy[:, cut], f2[:, cut], px, py, r, nth[discs], start, end, base, begun, ended, turned, m)
                    if distances:
                        i = part[~close[z[part]]]
                        u1, v1, du, dv, qx, qy = x1[i], y1[i], dx[i], dy[i], px[:, None], py[:, None]
                        a2 = du * du + dv * dv
                        t = np.maximum(0.0, np.minimum(1.0, np.divide((qx - u1) * du + (qy - v1) * dv, a2, out=np.zeros((len(px), len(i))), where=a2 != 0)))
                        sx, sy = qx - (u1 + t * du), qy - (v1 + t * dv)
                        close[z[i[(np.sqrt(sx * sx + sy * sy) < r).any(axis=0)]]] = True
        if areas:
            sx, sy = cx + r * np.cos(base + START), cy + r * np.sin(base + START)
            total += self._holding(chosen, sx, sy) @ (ended - begun)
        if distances:
            close |= self._holding(chosen, x, y).any(axis=1)
        return total, close

    @staticmethod
    def _cut(lines, in1, in2, fx, fy, f2, x, y, r, nth, start, end, base, begun, ended, turned, m) -> np.ndarray:
        """What edges that no disc holds whole add: their lengths inside the union, and the parts of arcs they open or close."""
        z, x1, y1, x2, y2, cross = lines
        dx, dy = x2 - x1, y2 - y1
        a = dx * dx + dy * dy
        b = fx * dx + fy * dy
        inner = b * b - a * (f2 - r * r)
        k, rows = np.nonzero(in1 | in2 | ((inner > 0) & (b < 0) & (b + a > 0)))
        if not len(rows):
            return np.zeros(m)
        root, slope, bend = np.sqrt(np.maximum(0.0, inner[k, rows])), a[rows], b[k, rows]
        first = np.clip(np.divide(-bend - root, slope, out=np.zeros_like(root), where=slope > 0), 0.0, 1.0)
        last = np.clip(np.divide(root - bend, slope, out=np.zeros_like(root), where=slope > 0), 0.0, 1.0)
        is1, is2 = in1[k, rows], in2[k, rows]
        t0, t1 = np.where(is1, 0.0, first), np.where(is2, 1.0, last)
        # The union of an edge's spans, in order of their start: moved by two an edge, they never reach into the next one.
        order = np.argsort(2 * rows + t0, kind="stable")
        group, low, high = rows[order], t0[order], t1[order]
        moved = 2 * group + high
        top = np.maximum.accumulate(moved)
        leader = np.maximum.accumulate(np.where(moved >= top, np.arange(len(moved)), 0))
        before = np.concatenate([[0.0], high[leader][:-1]])
        before[np.concatenate([[True], group[1:] != group[:-1]])] = 0.0
        within = np.minimum(1.0, np.bincount(group, np.maximum(0.0, high - np.maximum(low, before)), len(z)))
        total = np.bincount(z, cross * within, m)
        # Where another span of the edge goes on, its disc holds the place and no free arc runs there.
        fresh = np.nonzero(low > before - _NEAR)[0]
        last = np.maximum.reduceat(moved, fresh)
        ends, starts = np.zeros(len(rows), dtype=bool), np.zeros(len(rows), dtype=bool)
        starts[order[fresh]] = True
        ends[order] = moved >= np.repeat(last, np.diff(np.append(fresh, len(moved)))) - _NEAR
        for real, t, sign in ((~is2 & ends, t1, 1.0), (~is1 & starts, t0, -1.0)):
            row, disc, t = rows[real], k[real], t[real]
            angle = np.mod(np.arctan2(y1[row] + t * dy[row] - y[disc], x1[row] + t * dx[row] - x[disc]) - START, _TURN)
            for own in nth.T:
                arc = own[disc]
                on = np.nonzero((arc >= 0) & (angle > start[arc]) & (angle < end[arc]))[0]
                arc = arc[on]
                here = turned(angle[on], x[disc[on]], y[disc[on]])
                total += np.bincount(z[row[on]], sign * np.where(angle[on] > base[arc], ended[arc] - here, begun[arc] - here), m)
        return total

    def _holding(self, chosen, px, py) -> np.ndarray:
        """Which of the chosen shapes hold which points."""
        found = np.zeros((len(chosen), len(px)), dtype=bool)
        at_x, at_y = px[:, None], py[:, None]
        in_box = (self.lo_x[chosen] <= at_x) & (self.hi_x[chosen] >= at_x) & (self.lo_y[chosen] <= at_y) & (self.hi_y[chosen] >= at_y)
        some = np.nonzero(in_box.any(axis=0))[0]
        place = np.full(len(self.lo_x), -1)
        place[chosen[some]] = np.arange(len(some))
        of = np.nonzero(place[self.owner] >= 0)[0]
        crossed = np.zeros(len(some) * len(px), dtype=np.int64)
        for low in range(0, len(of), max(1, STEP // len(px))):
            e = of[low:low + max(1, STEP // len(px))]
            crossed += self._crossed(self.x1[e], self.y1[e], self.x2[e], self.y2[e], place[self.owner[e]], px, py, len(some))
        found[some] = (crossed % 2 == 1).reshape(len(some), len(px))
        return found

    @staticmethod
    def _crossed(x1, y1, x2, y2, z, px, py, m) -> np.ndarray:
        """How many edges of each shape a ray from each point towards +x crosses (half-open in y)."""
        k, row = np.nonzero((y1 <= py[:, None]) != (y2 <= py[:, None]))
        x1, y1, x2, y2 = x1[row], y1[row], x2[row], y2[row]
        hit = px[k] < x1 + (py[k] - y1) * (x2 - x1) / (y2 - y1)
        return np.bincount(z[row[hit]] * len(px) + k[hit], minlength=m * len(px))


def _pieces_of(discs: DataFrame, shapes: DataFrame, size: float, key: str, areas: bool, distances: bool, by: str | None = None, least: float = LEAST_AREA) -> DataFrame:
    """Sums per key, radius and ``by`` (of the shapes), a row from each piece that the key's discs are in."""
    cells = ["cx", "cy"]
    circles, polygons = box_cells(discs, size), box_cells(shapes, size)
    counted = circles.groupBy(*cells).agg(F.count(F.lit(1)).alias("_a")).join(polygons.groupBy(*cells).agg(F.count(F.lit(1)).alias("_b")), cells)
    grid = cut_lineage(counted.select(*cells, F.ceil(F.col("_a") / KEY_ROWS).cast("int").alias("_i"), F.ceil(F.col("_b") / SHAPE_ROWS).cast("int").alias("_j")))
    pieces = grid.agg(F.coalesce(F.sum(F.col("_i").cast("long") * F.col("_j")), F.lit(0))).first()[0]
    keys = [*cells, "i", "j"]
    partitions = max(int(discs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(pieces, 4096))

    def deal(rows: DataFrame, own: str, other: str, mine: str, copied: str, told: list[str]) -> DataFrame:
        dealt = rows.join(F.broadcast(grid) if pieces <= 100_000 else grid, cells).withColumn(mine, F.pmod(F.xxhash64(*told), F.col(own)).cast("int"))
        dealt = dealt.withColumn(copied, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("_i", "_j")
        return dealt.repartition(partitions, *keys).groupBy(*keys)

    kind = discs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, radius double, population double, zone_count bigint, reached bigint" + (f", {by} {shapes.schema[by].dataType.simpleString()}" if by else "")

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        made = []
        if a.num_rows and b.num_rows:
            piece, cx, cy = _Piece(b, least, by), a.column("cx")[0].as_py(), a.column("cy")[0].as_py()
            here = lambda x, y: (np.floor(x / size) == cx) & (np.floor(y / size) == cy)
            for row in a.drop_columns([key]).to_pylist():
                x, y, circle, start, end = (np.array(row[c]) for c in ("x", "y", "circle", "start", "end"))
                box = row["lo_x"], row["hi_x"], row["lo_y"], row["hi_y"]
                made.append(piece.sums(x, y, row["radius"], circle.astype(np.int64), start, end, row["ox"], row["oy"], box, here, areas, distances))
        people, count, reached = zip(*made) if made else ((), (), ())
        told = [key, "radius"]
        if by:
            sums = np.array(people).reshape(len(made), -1)
            row, label = np.nonzero(sums > 0)
            none = pa.array(np.zeros(len(row), dtype=np.int64))
            names = piece.names.take(pa.array(label)) if made else b.column(by).slice(0, 0)
            return pa.table([*[a.column(c).take(pa.array(row)) for c in told], pa.array(sums[row, label]), none, none, names], names=[*told, "population", "zone_count", "reached", by])
        return pa.table([*[a.column(c).slice(0, len(made)) for c in told], pa.array(people, pa.float64()), pa.array(count, pa.int64()), pa.array(reached, pa.int64())], names=[*told, "population", "zone_count", "reached"])

    left = deal(circles, "_i", "_j", "i", "j", [key, "radius"])
    return left.cogroup(deal(polygons, "_j", "_i", "j", "i", ["edges"])).applyInArrow(meet, schema)


def within_reach(centres: DataFrame, zones: DataFrame, radii: Sequence[float], *, key: str, polygon: str = "geo_id", areas: bool = True, distances: bool = True) -> DataFrame:
    """key, radius, population, zone_count, reached for every key that reaches a polygon.

    ``population`` is the sum of the polygons' population, each by the share of its area inside the union of the discs (null counts
    as 0), ``zone_count`` the number of polygons that share more than LEAST_AREA with it, ``reached`` the number of polygons
    closer than the radius to a centre, those around a centre included. Without ``areas`` the first two, without ``distances`` the last
    say nothing. Rows without coordinates or key take no part.
    """
    radii = [float(r) for r in radii]
    if "population" not in zones.columns:
        zones = zones.withColumn("population", F.lit(0.0))
    rings = [c for c in ("part", "ring") if c in zones.columns]
    corners = ["x1", "y1", "x2", "y2"]
    zones = zones.dropna(subset=[polygon, *corners]).select(polygon, *rings, "population", *[F.col(c).cast("double").alias(c) for c in corners])
    rows = zones.count()
    edges = cut_lineage(sized(zones, [polygon], rows))
    spots = cut_lineage(centres.select(key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna().distinct())
    large = cut_lineage(edges.groupBy(polygon).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > EDGES).select(polygon))
    wide = cut_lineage(spots.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > CENTRES).select(key))
    has_large, has_wide = not large.isEmpty(), not wide.isEmpty()
    small = edges.join(large, polygon, "left_anti") if has_large else edges
    few = spots.join(wide, key, "left_anti") if has_wide else spots
    found = _pieces_of(cut_lineage(_discs(few, radii, key)), cut_lineage(_shapes(small, polygon, rows)), 2 * max(radii), key, areas, distances)
    if has_wide:
        found = found.unionByName(_by_joins(spots.join(wide, key, "left_semi"), edges, radii, key, polygon, areas, distances))
    if has_large:
        found = found.unionByName(_by_joins(few, edges.join(large, polygon, "left_semi"), radii, key, polygon, areas, distances))
    sums = found.groupBy(key, "radius").agg(*[F.sum(c).alias(c) for c in ("population", "zone_count", "reached")])
    return sums.filter((F.col("zone_count") > 0) | (F.col("reached") > 0))


def union_overlap(centres: DataFrame, tiles: DataFrame, radii: Sequence[float], *, key: str) -> DataFrame:
    """key, radius, _by, area, buffer_area: area of each union of polygons inside the union of the discs around a key's centres,
    and of the latter. ``tiles`` are written rows of ``tiles.union_tiles``. Pairs that share at most LEAST_AREA have no row."""
    radii = [float(r) for r in radii]
    spots = cut_lineage(centres.select(key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna().distinct())
    wide = cut_lineage(spots.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > CENTRES).select(key))
    has_wide = not wide.isEmpty()
    discs = cut_lineage(_discs(spots.join(wide, key, "left_anti") if has_wide else spots, radii, key))
    shapes = tiles.withColumnRenamed("area", "population").withColumn("copies", F.lit(1).cast("bigint"))
    met = _pieces_of(discs.drop("buffer_area"), shapes, 4 * max(radii), key, True, False, by="_by", least=0.0)
    found, buffers = met.select(key, "radius", "_by", F.col("population").alias("area")), discs.select(key, "radius", "buffer_area")
    if has_wide:
        many = spots.join(wide, key, "left_semi")
        arcs = cut_lineage(union_arcs(many, radii, key=key))
        named = cut_lineage(tiles.withColumn("_tile", F.monotonically_increasing_id()))
        shared = overlap_areas(many, named.select("_tile", F.inline("edges")), radii, key=key, polygon="_tile", arcs=arcs)
        found = found.unionByName(shared.join(named.select("_tile", "_by"), "_tile").select(key, "radius", "_by", F.col("overlap_area").alias("area")))
        buffers = buffers.unionByName(union_area(arcs, key, "buffer_area"))
    sums = found.groupBy(key, "radius", "_by").agg(F.sum("area").alias("area")).filter(F.col("area") > LEAST_AREA)
    return sums.join(buffers, [key, "radius"])


def _by_joins(centres: DataFrame, edges: DataFrame, radii: Sequence[float], key: str, polygon: str, areas: bool, distances: bool) -> DataFrame:
    """The same sums by joins of edges and centres, for keys and polygons too large for one row."""
    none, parts = F.lit(0).cast("bigint"), []
    if areas:
        sized = measures(edges, polygon).select(polygon, "area").filter("area > 0")
        people = edges.groupBy(polygon).agg(F.coalesce(F.max("population"), F.lit(0)).cast("double").alias("population"))
        share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("overlap_area") / F.col("area")))
        shared = overlap_areas(centres, edges, radii, key=key, polygon=polygon).join(sized, polygon).join(people, polygon)
        parts.append(shared.select(key, "radius", (F.col("population") * share).alias("population"), F.lit(1).cast("bigint").alias("zone_count"), none.alias("reached")))
    if distances:
        near = polygon_distances(centres, edges, max(radii), key=key, polygon=polygon).withColumn("radius", F.explode(F.array(*[F.lit(r) for r in radii])))
        parts.append(near.filter("distance < radius").select(key, "radius", F.lit(0.0).alias("population"), none.alias("zone_count"), F.lit(1).cast("bigint").alias("reached")))
    return parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0]
