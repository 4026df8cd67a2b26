"""Near-duplicate documents by min-max hashing.

Each document is the set of its word shingles. Under every permutation both the smallest and the largest hash are kept,
so a signature of 2p values costs p hash evaluations per shingle. Bands of signature values propose pairs; the Jaccard
similarity of the full sets confirms them; linked documents form components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from areascreen.llm.bytetext import distinct_sets, mix, shingle_hashes
from areascreen.llm.common import materialise, text_batches
from areascreen.llm.components import components

#: Permutations, and signature values per band. Two values come from each permutation: 40 bands of 6 values. A pair of
#: similarity 0.85 misses all bands with probability 6e-9, one of 0.8 with 5e-6.
PERMUTATIONS, ROWS = 120, 6
#: Shingles of a block's open members, and of the members that these are compared with.
X_CELLS, Y_CELLS = 60_000, 200_000
_RANDOM = np.random.Generator(np.random.PCG64(31337))
_FACTOR = _RANDOM.integers(0, 2**64, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)
_SHIFT = _RANDOM.integers(0, 2**64, PERMUTATIONS, dtype=np.uint64)
_ORDER = _RANDOM.integers(0, 2**64, ROWS, dtype=np.uint64) | np.uint64(1)

_FEATURES = "doc_id long, n_shingles long, class binary, bands array<long>"
_SETS = "doc_id long, class binary, n long, shingles array<long>"


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Min-max signature of every non-empty set: the minima of all permutations, then the maxima."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    found = np.empty((len(starts), 2 * PERMUTATIONS), np.uint64)
    for k in range(PERMUTATIONS if len(starts) else 0):
        permuted = values * _FACTOR[k] + _SHIFT[k]
        found[:, k] = np.minimum.reduceat(permuted, starts)
        found[:, PERMUTATIONS + k] = np.maximum.reduceat(permuted, starts)
    return found


def band_keys(found: np.ndarray) -> np.ndarray:
    """One key per band; keys of different bands differ."""
    bands = found.reshape(len(found), -1, ROWS)
    keys = np.zeros(bands.shape[:2], np.uint64)
    for k in range(ROWS):
        keys = mix(keys + bands[:, :, k] * _ORDER[k])
    return mix(keys + np.arange(bands.shape[1], dtype=np.uint64))


def _class(own: np.ndarray) -> bytes:
    """128-bit fingerprint of a set."""
    return int(mix(own.copy()).sum(dtype=np.uint64)).to_bytes(8, "big") + int(mix(own ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)).to_bytes(8, "big")


def _features(docs: DataFrame, words: int, mark: str | None) -> DataFrame:
    marked = [] if mark is None else ["mark"]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            values, bounds = shingle_hashes(batch.column("text"), words)
            sets = distinct_sets(values, bounds)
            keys = iter(band_keys(signatures(values, bounds)).view(np.int64))
            sizes = [len(own) for own in sets]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array([_class(own) if len(own) else None for own in sets], pa.binary()),
                pa.array([next(keys) if n else None for n in sizes], pa.list_(pa.int64())),
                *[batch.column(name) for name in marked],
            ], ["doc_id", "n_shingles", "class", "bands", *marked])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *[F.col(mark).cast("binary").alias(name) for name in marked])
    return rows.mapInArrow(compute, _FEATURES + ", mark binary" * len(marked))


def _sets(docs: DataFrame, words: int) -> DataFrame:
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            sets = distinct_sets(*shingle_hashes(batch.column("text"), words))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([_class(own) for own in sets], pa.binary()),
                pa.array([len(own) for own in sets], pa.int64()), pa.array([own.view(np.int64) for own in sets], pa.list_(pa.int64())),
            ], ["doc_id", "class", "n", "shingles"])

    return docs.mapInArrow(compute, _SETS)


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5, mark: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, component for every row of ``docs`` (doc_id, text).

    Documents are linked if the intersection of their shingle sets is at least num/den of the union. component_id is the
    smallest doc_id reachable over links, the row's own included; ``kept`` is doc_id = component_id. Where ids repeat with
    different texts, components may share a component_id; ``component`` (binary) tells them apart. It is null without
    shingles. ``mark`` names a binary column of ``docs`` that comes back as ``mark`` and so tells rows of one id apart.

    Documents with the same set are one class, so copies are never expanded into pairs. Classes that share buckets of
    equal band keys form groups, and ``_links`` resolves these exactly without comparing all their pairs.

    Null or empty texts have no shingles and link with nothing. A row without doc_id links with nothing: its
    component_id is null and it is kept. Repeated rows get the same result each. Other columns are ignored. An empty
    table gives no rows.
    """
    features = materialise(_features(docs, words, mark))
    linked = F.col("class").isNotNull() & F.col("doc_id").isNotNull()
    classes = materialise(features.filter(linked).groupBy("class").agg(
        F.min("doc_id").alias("smallest"), F.max("n_shingles").alias("n"), F.first("bands").alias("bands")))
    keyed = classes.select("class", "n", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("held")).filter("held > 1").select("key")
    members = materialise(keyed.join(shared, "key"))
    named = members.select("class").distinct().join(classes.select("class", F.col("smallest").alias("doc_id")), "class")
    wanted = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(named.select("doc_id").distinct(), "doc_id", "left_semi")
    found = _sets(wanted, words).join(named.select("class"), "class", "left_semi")
    sets = materialise(found.groupBy("class").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles")))

    # A class is named by the least head of its buckets; heads that share a class are linked. So components are looked
    # for among heads alone, and a large near group has few of those, however many rows it has.
    heads = members.groupBy("key").agg(F.min("class").alias("head"))
    named = materialise(members.join(heads, "key").groupBy("class").agg(F.min("head").alias("node"), F.collect_set("head").alias("heads")))
    between = named.select("node", F.explode("heads").alias("head")).filter("node != head").distinct()
    near = named.select("class", "node").join(components(between, "node", "head"), "node", "left").select("class", F.coalesce("label", "node").alias("grp"))
    groups = near.join(sets.select("class", "n"), "class").select("grp", "class", "n")
    labels = components(_links(groups, sets, num, den))
    smallest = classes.select("class", "smallest").join(labels.withColumnRenamed("node", "class"), "class", "left")
    smallest = smallest.select("class", "smallest", F.coalesce("label", "class").alias("label"))
    roots = smallest.groupBy("label").agg(F.min("smallest").alias("root"))
    known = materialise(smallest.join(roots, "label").select("class", "label", "root"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return features.join(known, "class", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"),
        F.when(F.col("doc_id").isNotNull(), F.col("label")).alias("component"), *([] if mark is None else ["mark"]))


def _links(groups: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """a, b: links that connect all classes of a group (grp, class, n) which links of any kind connect.

    Every group compares its members with one leader, its smallest set. Members linked to it need no comparison with
    each other. The open ones meet all members of their group in blocks of bounded size, by group and block number, so
    no task holds a group; a block returns a spanning forest of its links, never its pairs, and takes all members that
    are linked to the leader as connected.
    """
    leaders = groups.groupBy("grp").agg(F.min(F.struct("n", "class")).alias("lead"))
    pairs = groups.join(leaders, "grp").filter("class != lead.class").select("grp", "class", F.col("lead.class").alias("lead"))
    member = sets.select("class", F.col("n"), F.col("shingles").alias("own"))
    leader = sets.select(F.col("class").alias("lead"), F.col("n").alias("m"), F.col("shingles").alias("base"))
    both = F.size(F.array_intersect("own", "base")).cast("long")
    met = pairs.join(member, "class").join(leader, "lead").select("grp", "class", "lead", "n", (den * both >= num * (F.col("n") + F.col("m") - both)).alias("linked"))
    met = materialise(met)
    links = met.filter("linked").select(F.col("lead").alias("a"), F.col("class").alias("b"))

    sizes = met.groupBy("grp").agg(F.sum("n").alias("all"), F.sum(F.when(~F.col("linked"), F.col("n"))).alias("open"), F.count_if(~F.col("linked")).alias("left"))
    sizes = sizes.filter("left > 0 AND NOT (left = 1 AND all = open)").select(
        "grp", F.ceil(F.col("open") / X_CELLS).cast("int").alias("xs"), F.ceil(F.col("all") / Y_CELLS).cast("int").alias("ys"))
    placed = materialise(met.join(sizes, "grp").join(sets.select("class", "shingles"), "class").withColumns({
        "x": F.pmod(F.xxhash64("class"), "xs").cast("int"), "y": F.pmod(F.xxhash64("class"), "ys").cast("int")}))
    rows = placed.select("grp", "x", F.explode(F.sequence(F.lit(0), F.col("ys") - 1)).alias("y"), "linked", "class", "shingles").filter("NOT linked").withColumn("open", F.lit(True))
    rows = rows.unionByName(placed.select(
        "grp", F.explode(F.sequence(F.lit(0), F.col("xs") - 1)).alias("x"), "y", "linked", "class", "shingles").withColumn("open", F.lit(False)))

    def compare(table: pa.Table) -> pa.Table:
        found = _block_links(table, num, den)
        return pa.table({"a": pa.array([p[0] for p in found], pa.binary()), "b": pa.array([p[1] for p in found], pa.binary())})

    more = rows.select("grp", "x", "y", "open", "linked", "class", "shingles").groupBy("grp", "x", "y").applyInArrow(compare, "a binary, b binary")
    return links.unionByName(more)


def _block_links(table: pa.Table, num: int, den: int) -> list[tuple[bytes, bytes]]:
    """Spanning forest of the links between the open rows of a block and its other rows."""
    open_ = np.array(table.column("open").to_pylist(), bool)
    names = table.column("class").to_pylist()
    lists = table.column("shingles").combine_chunks()
    values, bounds = np.asarray(lists.flatten()), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
    sets = [values[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    sizes = np.diff(bounds)
    told = [name for name, linked in zip(names, table.column("linked").to_pylist()) if linked]  # connected through the leader
    parent: dict[bytes, bytes] = {name: min(told) for name in told}

    def root(name: bytes) -> bytes:
        while parent.get(name, name) != name:
            name = parent[name]
        return name

    found = []
    xs = np.flatnonzero(open_)
    ys = np.flatnonzero(~open_)
    for begin in range(0, len(xs), 128):
        part = xs[begin : begin + 128]
        for cut in np.array_split(part, max(1, int(sizes[part].sum() * len(part) // 32_000_000))):  # bounds the matrix below
            known = np.unique(np.concatenate([sets[k] for k in cut]))
            has = np.zeros((len(known), len(cut)), np.uint8)
            for column, k in enumerate(cut):
                has[np.searchsorted(known, sets[k]), column] = 1
            for y in ys:
                near = np.searchsorted(known, sets[y])
                near[near == len(known)] = 0
                both = has[near[known[near] == sets[y]]].sum(axis=0, dtype=np.int64)
                for k in cut[den * both >= num * (sizes[cut] + sizes[y] - both)]:
                    a, b = root(names[k]), root(names[y])
                    if a != b:
                        parent[max(a, b)] = min(a, b)
                        found.append((names[k], names[y]))
    return found
