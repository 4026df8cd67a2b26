"""Exact top-k inner products through M-trees: paged nodes in tables, searched best first."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from areascreen.llm.common import materialise

#: Entries of a page, vectors of a tree, queries that a task searches at once, and trees whose roots a task holds. Trees,
#: blocks of queries and parts of the routing level grow in number with the tables; none grows in size.
PAGE, TREE_ROWS, QUERY_ROWS, ROOTS = 128, 8192, 4096, 1024

_PAGES = (
    "tree int, page int, leaf boolean, ids array<long>, vectors array<long>, children array<int>, radius array<double>, "
    "above array<double>, pivot array<long>, cover double"
)
_FOUND = "ask long, query_id long, vec_id long, score long, tree int, opened int, computed long"
_SLACK = 1e-6
_LEAST, _MOST = -(2**63), 2**63 - 1
_EXACT = 2.0**52  # sums of products of whole numbers stay exact doubles while both sums of squares are below this


def usable(column: str) -> Column:
    """Whether a vector is there and holds finite numbers only."""
    return F.col(column).isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))


def _lift(vectors: np.ndarray, largest: float) -> np.ndarray:
    """Vectors in units of the longest, with one more component that makes all of them one unit long: the order of
    Euclidean distances to a query (whose last component is 0) is then the order of its inner products."""
    points = vectors.astype(np.float64) / (largest**0.5 or 1.0)
    return np.column_stack([points, np.sqrt(np.maximum(0.0, 1.0 - (points**2).sum(axis=1)))])


def _apart(targets: np.ndarray, squares: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distance of every target to every lifted point."""
    return np.sqrt(np.maximum(0.0, squares[:, None] + 1.0 - 2.0 * (targets @ points[:, :-1].T)))


def _reach(scores: np.ndarray, squares: np.ndarray, largest: float) -> np.ndarray:
    """Distance within which every vector of at least the given score lies. A score at the least long may stand for lower ones."""
    bound = np.sqrt(np.maximum(0.0, squares + 1.0 - 2.0 * scores.astype(np.float64) / (largest or 1.0)))
    return np.where(scores <= _LEAST, np.inf, bound + _SLACK * (np.sqrt(squares) + 1.0))


def _split(points: np.ndarray, members: np.ndarray, parts: int) -> list[np.ndarray]:
    """Divide points into at most ``parts`` sets around pivots that lie far from each other."""
    pivots, nearest, owner = [int(members[0])], np.full(len(members), np.inf), np.zeros(len(members), np.int64)
    while True:
        far = ((points[members] - points[pivots[-1]]) ** 2).sum(axis=1)
        owner[far < nearest] = len(pivots) - 1
        nearest = np.minimum(nearest, far)
        if len(pivots) == parts or nearest.max() <= 0:
            return [members[owner == k] for k in range(len(pivots)) if (owner == k).any()]
        pivots.append(int(members[nearest.argmax()]))


def _middle(points: np.ndarray, members: np.ndarray) -> int:
    return int(members[((points[members] - points[members].mean(axis=0)) ** 2).sum(axis=1).argmin()])


def build(tree: int, ids: np.ndarray, vectors: np.ndarray, largest: float, page: int = PAGE) -> list[dict]:
    """Pages of one M-tree. A routing entry has a pivot, a covering radius and the distance to its parent's pivot; a
    leaf entry has a vector and that distance. The root is page 0 and names the tree's own pivot and radius."""
    points = _lift(vectors, largest)
    pages: list[dict] = []

    def add(members: np.ndarray, parent: int) -> int:
        number = len(pages)
        pages.append({})
        leaf = len(members) <= page
        groups = [] if leaf else _split(points, members, min(page, 2 * -(-len(members) // page)))
        if len(groups) == 1:  # equal vectors: cut by number
            groups = np.array_split(members, min(page, -(-len(members) // page)))
        pivots = members if leaf else np.array([_middle(points, g) for g in groups])
        away = lambda rows, pivot: np.sqrt(((points[rows] - points[pivot]) ** 2).sum(axis=1))
        pages[number] = {
            "tree": tree, "page": number, "leaf": leaf, "ids": ids[pivots].tolist(), "vectors": vectors[pivots].ravel().tolist(),
            "children": [add(g, int(p)) for g, p in zip(groups, pivots)], "radius": [0.0] * len(pivots) if leaf else [float(away(g, p).max()) for g, p in zip(groups, pivots)],
            "above": away(pivots, parent).tolist(), "pivot": None, "cover": None}
        return number

    everyone = np.arange(len(ids))
    root = _middle(points, everyone)
    add(everyone, root)
    pages[0].update(pivot=vectors[root].tolist(), cover=float(np.sqrt(((points - points[root]) ** 2).sum(axis=1)).max()))
    return pages


class Tree:
    """Pages of one tree in memory, for the searches of one task."""

    def __init__(self, pages: pd.DataFrame, largest: float) -> None:
        self.pages, self.largest = {}, largest
        for row in pages.itertuples(index=False):
            ids = np.asarray(row.ids, np.int64)
            vectors = np.asarray(row.vectors, np.int64).reshape(len(ids), -1)
            self.pages[row.page] = (row.leaf, ids, vectors, _lift(vectors, largest), np.asarray(row.children, np.int64), np.asarray(row.radius, float), np.asarray(row.above, float))

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, floors: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For a block of queries the k best of this tree: row of the query, id and score, and per query the distances computed.

        ``floors`` are scores below which a query needs nothing (the least long: none known), ``apart`` the distances to
        the root's pivot. Each query opens its own pages by their least possible distance; queries that open the same page
        in a round share one matrix product. An entry is left out where the stored distance to its parent's pivot,
        against the query's distance to that pivot, shows for every query of the page that it lies beyond the k-th best.
        """
        count = len(queries)
        targets = queries.astype(np.float64) / (self.largest**0.5 or 1.0)
        squares = (targets**2).sum(axis=1)
        exact = max(self.largest, float(squares.max()) * (self.largest or 1.0)) < _EXACT
        values = queries.astype(np.float64 if exact else object)
        least = np.full((count, max(self.pages) + 1), np.inf)
        parent = np.zeros_like(least)
        least[:, 0], parent[:, 0] = 0.0, apart
        worst = floors.astype(np.int64)
        bound = _reach(worst, squares, self.largest)
        computed = np.zeros(count, np.int64)
        rows, names, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        while True:
            number = least.argmin(axis=1)
            next_least = least[np.arange(count), number]
            going = np.flatnonzero(np.isfinite(next_least) & (next_least <= bound))
            if not len(going):
                return rows, names, scores, computed
            going = going[np.argsort(number[going], kind="stable")]
            least[going, number[going]] = np.inf
            new = []
            for asking in np.split(going, np.flatnonzero(np.diff(number[going])) + 1):
                page = int(number[asking[0]])
                leaf, ids, vectors, points, children, radius, above = self.pages[page]
                needed = np.abs(parent[asking, page][:, None] - above) - radius <= bound[asking][:, None]
                entries = np.flatnonzero(needed.any(axis=0))
                computed[asking] += len(entries)
                if not len(entries):
                    continue
                if leaf:
                    met = values[asking] @ vectors[entries].astype(values.dtype).T
                    met = (met if exact else np.minimum(np.maximum(met, _LEAST), _MOST)).astype(np.int64)
                    good = (met >= worst[asking][:, None]) & (ids[entries] != own[asking][:, None])
                    query, entry = np.nonzero(good)
                    new.append((asking[query], ids[entries][entry], met[query, entry]))
                else:
                    gap = _apart(targets[asking], squares[asking], points[entries])
                    at = np.ix_(asking, children[entries])
                    least[at] = np.where(needed[:, entries], np.maximum(0.0, gap - radius[entries]), np.inf)
                    parent[at] = gap
            if new and sum(len(r) for r, _, _ in new):
                fresh = [np.concatenate(part) for part in zip(*new)]
                touched = np.zeros(count, bool)
                touched[fresh[0]] = True
                old = touched[rows]
                merged = [np.concatenate([part[old], more]) for part, more in zip((rows, names, scores), fresh)]
                order = np.lexsort((merged[1], -1 - merged[2], merged[0]))  # -1 - x turns the order of longs without overflow
                r, n, s = (part[order] for part in merged)
                first = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
                place = np.arange(len(r)) - np.repeat(first, np.diff(np.append(first, len(r))))
                full = place == k - 1
                worst[r[full]] = s[full]
                bound[r[full]] = np.minimum(bound[r[full]], _reach(s[full], squares[r[full]], self.largest))
                kept = place < k
                rows, names, scores = (np.concatenate([part[~old], more[kept]]) for part, more in zip((rows, names, scores), (r, n, s)))


def _meet(left: DataFrame, right: DataFrame, keys: list[str], step: Callable, schema: str) -> DataFrame:
    """Groups of two tables with equal keys, given to ``step`` where both have rows."""
    empty = [field.split()[0] for field in schema.split(", ")]
    both = lambda a, b: step(a, b) if len(a) and len(b) else pd.DataFrame(columns=empty)
    apart = right.toDF(*right.columns)  # columns of its own, where both sides stem from one table
    return left.groupBy(*keys).cogroup(apart.groupBy(*keys)).applyInPandas(both, schema)


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(row, np.int64) for row in rows])


def top_k(items: DataFrame, queries: DataFrame, k: int = 20, tree_rows: int = TREE_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score, trees, distances: every query's k largest inner products over integer vectors, exactly.

    ``items`` and ``queries`` have vec_id and vector (array of long). Ties go to the smaller vec_id, and an item with the
    query's own id is left out. Fewer items give fewer rows. ``trees`` and ``distances`` count what the query opened and
    computed. Scores beyond a long count as the largest or smallest long.

    Items go to the nearest of at most ``ROOTS`` pivots, drawn by hash, and those of one pivot to trees of about
    ``tree_rows``. A routing level of all roots sends each query first to the tree of the nearest root; its k-th best
    score then leaves out every tree whose covering radius cannot reach it. A task holds one tree and one block of queries.

    Null ids, null vectors and vectors of another length than the longest table's first take no part; repeated item
    rows are items of their own, repeated query rows are queries of their own. Other columns are ignored. Empty tables give no rows.
    """
    spark = items.sparkSession
    items = items.select(F.col("vec_id").cast("long"), "vector").filter("vec_id IS NOT NULL AND vector IS NOT NULL")
    queries = queries.select(F.col("vec_id").cast("long").alias("query_id"), F.col("vector").alias("query")).filter("query_id IS NOT NULL AND query IS NOT NULL")
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    size, count, largest = items.agg(F.max(F.size("vector")), F.count(F.lit(1)), F.max(square)).first()
    right = items.filter(F.size("vector") == size).withColumn("deal", F.monotonically_increasing_id())
    asks = queries.filter(F.size("query") == F.lit(size)).withColumn("ask", F.monotonically_increasing_id())
    asked = asks.count() if count else 0
    if not asked or not size:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long, trees long, distances long")
    blocks = max(1, -(-asked // query_rows))
    asks = materialise(asks.withColumn("block", F.pmod(F.xxhash64("ask"), F.lit(blocks)).cast("int")))

    drawn = right.orderBy(F.xxhash64("vec_id", "deal"), "deal").limit(min(ROOTS, -(-count // tree_rows)))
    pivots = _matrix(drawn.toPandas()["vector"]).astype(np.float64)  # at most ROOTS vectors

    def place(batches):
        for batch in batches:
            if len(batch):
                vectors = _matrix(batch["vector"]).astype(np.float64)
                yield batch.assign(cell=((pivots**2).sum(axis=1) - 2.0 * vectors @ pivots.T).argmin(axis=1).astype(np.int32))

    placed = materialise(right.mapInPandas(place, "vec_id long, vector array<long>, deal long, cell int"))
    held = placed.groupBy("cell").count().orderBy("cell").toPandas()  # at most ROOTS rows
    needed = -(-held["count"] // tree_rows)
    first = dict(zip(held["cell"].tolist(), (needed.cumsum() - needed).tolist()))
    number = F.create_map(*[F.lit(x) for pair in first.items() for x in pair])[F.col("cell")]
    several = F.create_map(*[F.lit(x) for pair in zip(held["cell"].tolist(), needed.tolist()) for x in pair])[F.col("cell")]

    page = PAGE

    def make(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id", kind="stable")
        return pd.DataFrame(build(int(group["tree"].iloc[0]), group["vec_id"].to_numpy(), _matrix(group["vector"]), largest, page))

    dealt = placed.select("vec_id", "vector", (number + F.pmod(F.xxhash64("deal"), several)).cast("int").alias("tree"))
    pages = materialise(dealt.groupBy("tree").applyInPandas(make, _PAGES))
    parts = max(1, -(-int(needed.sum()) // ROOTS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    roots = pages.filter("page = 0").select("tree", "pivot", "cover", F.pmod("tree", F.lit(parts)).alias("part"), every(blocks).alias("block"))

    def gaps(left: pd.DataFrame, right: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        targets = _matrix(left["query"]).astype(np.float64) / (largest**0.5 or 1.0)
        squares = (targets**2).sum(axis=1)
        return _apart(targets, squares, _lift(_matrix(right["pivot"]), largest)), squares

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        apart, _ = gaps(left, right)
        at = apart.argmin(axis=1)
        return pd.DataFrame({"ask": left["ask"], "gap": apart.min(axis=1), "tree": right["tree"].to_numpy()[at]})

    def admitted(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        apart, squares = gaps(left, right)
        trees = right["tree"].to_numpy()
        reach = _reach(left["least"].to_numpy(np.int64), squares, largest)
        row, root = np.nonzero((apart - right["cover"].to_numpy() <= reach[:, None]) & (trees != left["tree"].to_numpy()[:, None]))
        return pd.DataFrame({"ask": left["ask"].to_numpy()[row], "gap": apart[row, root], "tree": trees[root]})

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        asks, ids = left["ask"].to_numpy(np.int64), left["query_id"].to_numpy(np.int64)
        rows, names, scores, computed = Tree(right, largest).search(_matrix(left["query"]), ids, k, left["least"].to_numpy(np.int64), left["gap"].to_numpy(float))
        found = pd.DataFrame({"ask": asks[rows], "query_id": ids[rows], "vec_id": names, "score": scores, "opened": 0, "computed": 0}).astype("Int64")
        note = pd.DataFrame({"ask": asks, "query_id": ids, "vec_id": pd.NA, "score": pd.NA, "opened": 1, "computed": computed}).astype("Int64")
        return pd.concat([found, note]).assign(tree=int(right["tree"].iloc[0]))[[f.split()[0] for f in _FOUND.split(", ")]]

    def open_trees(pairs: DataFrame) -> DataFrame:
        nodes = pages.join(pairs.select("block", "tree").distinct(), "tree")
        return materialise(_meet(pairs, nodes, ["block", "tree"], search, _FOUND))

    routed = _meet(asks.withColumn("part", every(parts)), roots, ["block", "part"], nearest, "ask long, gap double, tree int")
    home = routed.groupBy("ask").agg(F.min(F.struct("gap", "tree")).alias("home")).select("ask", "home.*")
    near = open_trees(materialise(asks.join(home, "ask").withColumn("least", F.lit(_LEAST))))
    known = near.groupBy("ask").agg(
        F.when(F.count("vec_id") == k, F.min("score")).otherwise(F.lit(_LEAST)).alias("least"), F.max("tree").alias("tree"))
    known = materialise(asks.join(known, "ask"))
    others = _meet(known.withColumn("part", every(parts)), roots, ["block", "part"], admitted, "ask long, gap double, tree int")
    far = open_trees(materialise(others.join(known.drop("tree"), "ask")))
    one = W.partitionBy("ask")
    ranked = near.unionByName(far).select(
        "*", F.row_number().over(one.orderBy(F.col("vec_id").isNull(), F.desc("score"), "vec_id")).alias("rank"),
        F.sum("opened").over(one).alias("trees"), F.sum("computed").over(one).alias("distances"))
    return ranked.filter((F.col("rank") <= k) & F.col("vec_id").isNotNull()).select("query_id", F.col("rank").cast("int"), "vec_id", "score", "trees", "distances")
