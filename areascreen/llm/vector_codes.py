"""Vector code compression: one codebook for each part of the vectors, learned by Lloyd rounds over active entries.

Every round keeps, beside each vector, the entry of each of its parts and the exact squared distance to it. When the
entries have been replaced, a part whose entry did not change needs only the changed ("active") entries: all others are
as far as before, and none of them was nearer. A part whose entry changed is compared with the whole codebook.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from areascreen.llm.common import discard, materialise
from areascreen.operators.skew import salted_join

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Vectors that a task compares at once.
BLOCK = 2048
#: Distances from here on are not stored; their parts are always compared with the whole codebook.
_LARGEST = 1 << 62
_LONG = (1 << 63) - 1
#: Sums travel as digits of this base, so that sums of any size can be added in longs.
_DIGIT = 40
#: Groups of a kept column up to which their sums are broadcast.
_SMALL = 10_000

_SUMS = "array<struct<part:int,entry:int,place:int,digit:int,value:bigint>>"
_SUMS_TYPE = pa.list_(pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("place", pa.int32()), ("digit", pa.int32()), ("value", pa.int64())]))


@dataclass
class Codebook:
    """Entries of one part, with the indexes of the entries that the last update changed."""

    entries: list[list[int]]
    moved: np.ndarray


def integers(vector: Column | str, scale: int) -> Column:
    """floor(scale * x) of every component, as doubles, which hold these integers exactly."""
    return F.transform(vector, lambda x: _floor(x.cast("double") * scale))


def _floor(x: Column) -> Column:
    """floor as a double: ``floor`` itself returns a long and fails beyond it. Doubles of 2^53 or more are integers."""
    return F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)


def usable(vector: Column | str, scale: int) -> Column:
    """Not null, and every component not null, finite, and finite when scaled."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double") * scale) < float("inf"), F.lit(False)))
    return F.coalesce(finite, F.lit(False))


def nearest(rows: np.ndarray, entries: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (ties to the lower one) and the squared distance of every row.

    Rows are doubles that hold integers; distances are exact, as Python integers where longs might not hold them.
    """
    limit = plain_limit(rows.shape[1])
    book = np.array([[float(x) for x in e] for e in entries], float).reshape(len(entries), rows.shape[1])
    plain = np.flatnonzero(np.abs(book).max(axis=1, initial=0) <= limit)
    plain_rows = np.abs(rows).max(axis=1, initial=0) <= limit if len(plain) else np.zeros(len(rows), bool)
    # Among plain values no distance exceeds 4 * width * limit^2: entries further out than that never win there.
    odd = [e for e in range(len(entries)) if limit < max(map(abs, entries[e]), default=0) <= limit * (2 + 2 * math.isqrt(rows.shape[1]))]
    index, distance = np.zeros(len(rows), np.int64), np.zeros(len(rows), object)
    own = np.flatnonzero(plain_rows)
    if len(own):
        found = _plain_distances(rows[own], book[plain])
        best = found.argmin(axis=1)
        index[own], distance[own] = plain[best], found[np.arange(len(own)), best].astype(np.int64)
    for k in np.arange(len(rows)) if odd else np.flatnonzero(~plain_rows):
        row = [int(x) for x in rows[k]]
        others = odd if plain_rows[k] else range(len(entries))
        known = [(int(distance[k]), int(index[k]))] if plain_rows[k] else []
        distance[k], index[k] = min(known + [(sum((a - b) ** 2 for a, b in zip(row, entries[e])), e) for e in others])
    return index, distance


def plain_limit(width: int) -> int:
    """Components up to this size have squared distances that doubles hold exactly, sums on the way included."""
    return math.isqrt((1 << 51) // max(width, 1))


def _plain_distances(rows: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances by one product; every step is an integer below 2^53."""
    return (rows * rows).sum(axis=1)[:, None] - 2 * (rows @ book.T) + (book * book).sum(axis=1)[None]


def reassign(rows: np.ndarray, index: np.ndarray, stored: np.ndarray, book: Codebook) -> tuple[np.ndarray, np.ndarray, int]:
    """Assign rows anew from their entries and stored distances; also returns the number of distances computed.

    A stored distance of -1 is unknown. Ties go to the lower index, as in a comparison with all entries.
    """
    again = np.isin(index, book.moved) | (stored < 0)
    index, distance = index.copy(), stored.astype(object)
    rescanned = np.flatnonzero(again)
    if len(rescanned):
        index[rescanned], distance[rescanned] = nearest(rows[rescanned], book.entries)
    rest = np.flatnonzero(~again)
    if len(rest) and len(book.moved):
        own, near = nearest(rows[rest], [book.entries[e] for e in book.moved])
        own = book.moved[own]
        better = (near < distance[rest]) | ((near == distance[rest]) & (own < index[rest]))
        index[rest[better]], distance[rest[better]] = own[better], near[better]
    return index, distance, len(rescanned) * len(book.entries) + len(rest) * len(book.moved)


def _digits(value: int) -> list[tuple[int, int]]:
    """(digit number, digit) of a signed integer; digits carry its sign."""
    sign, value = (-1, -value) if value < 0 else (1, value)
    found = []
    while value:
        found.append((len(found), sign * (value & ((1 << _DIGIT) - 1))))
        value >>= _DIGIT
    return [(k, d) for k, d in found if d]


def _ddl(kept: StructType) -> str:
    """The type as DDL; names are quoted, so any column name will do."""
    return "struct<" + ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in kept.fields) + ">"


def _cuts(width: int, parts: int) -> list[slice]:
    size = -(-width // parts)
    return [slice(min(p * size, width), min((p + 1) * size, width)) for p in range(parts)]


def _assign_round(table: DataFrame, books: list[Codebook], width: int, schema: str) -> DataFrame:
    """One pass: new entries and distances of every vector; each task adds one row with the sums of what it assigned."""
    cuts = _cuts(width, len(books))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list[int]] = {}  # one per part and entry
        compared, kept_type = 0, None
        for whole in batches:
            kept_type = whole.schema.field("kept").type
            for start in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(start, BLOCK)
                rows = np.asarray(batch.column("vec").flatten(), float).reshape(batch.num_rows, width)
                codes = np.zeros((batch.num_rows, len(books)), np.int32)
                near = np.zeros((batch.num_rows, len(books)), object)
                old = batch.column("codes")
                fresh = old.null_count == batch.num_rows
                if not fresh:
                    before = np.asarray(old.flatten()).reshape(-1, len(books))
                    stored = np.asarray(batch.column("near").flatten()).reshape(-1, len(books))
                for p, book in enumerate(books):
                    part = rows[:, cuts[p]]
                    if fresh:
                        codes[:, p], near[:, p] = nearest(part, book.entries)
                        compared += len(part) * len(book.entries)
                    else:
                        codes[:, p], near[:, p], n = reassign(part, before[:, p], stored[:, p], book)
                        compared += n
                    _add(sums, p, part, codes[:, p])
                error = near.sum(axis=1) if len(books) else np.zeros(len(rows), object)
                yield pa.RecordBatch.from_arrays([
                    batch.column("kept"), batch.column("vec"), pa.array(list(codes), pa.list_(pa.int32())),
                    pa.array([[int(d) if d < _LARGEST else -1 for d in row] for row in near], pa.list_(pa.int64())),
                    pa.array([min(int(e), _LONG) for e in error], pa.int64()), pa.nulls(len(rows), _SUMS_TYPE), pa.nulls(len(rows), pa.int64()),
                ], ["kept", "vec", "codes", "near", "error", "sums", "compared"])
        if sums:
            told = [{"part": p, "entry": e, "place": place, "digit": k, "value": d}
                    for (p, e), values in sums.items() for place, value in enumerate(values) for k, d in _digits(value)]
            yield pa.RecordBatch.from_arrays([
                pa.nulls(1, kept_type), pa.nulls(1, pa.list_(pa.float64())), pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.list_(pa.int64())),
                pa.nulls(1, pa.int64()), pa.array([told], _SUMS_TYPE), pa.array([compared], pa.int64()),
            ], ["kept", "vec", "codes", "near", "error", "sums", "compared"])

    return table.select("kept", "vec", "codes", "near").mapInArrow(compute, schema)


def _add(sums: dict, part: int, rows: np.ndarray, codes: np.ndarray) -> None:
    """Add rows to the sums of their entries; place 0 counts them."""
    plain = np.abs(rows).max(axis=1, initial=0) <= plain_limit(rows.shape[1])
    for own, whole in ((plain, True), (~plain, False)):
        if not own.any():
            continue
        values, entry = rows[own], codes[own]
        for e in np.unique(entry):
            chosen = values[entry == e]
            added = [int(x) for x in chosen.sum(axis=0)] if whole else [sum(int(x) for x in column) for column in chosen.T]
            before = sums.get((part, int(e)), [0] * (1 + len(added)))
            sums[(part, int(e))] = [a + b for a, b in zip(before, [len(chosen), *added])]


def _updated(table: DataFrame, books: list[Codebook]) -> list[Codebook]:
    """Every entry replaced by the floor of its parts' mean. What comes to the driver is as large as the codebooks."""
    told = table.filter(F.col("sums").isNotNull()).select(F.explode("sums").alias("s")).select("s.*")
    total: dict[tuple[int, int], dict[int, int]] = {}
    for r in told.groupBy("part", "entry", "place", "digit").agg(F.sum("value").alias("value")).collect():
        places = total.setdefault((r["part"], r["entry"]), {})
        places[r["place"]] = places.get(r["place"], 0) + (r["value"] << (_DIGIT * r["digit"]))
    found = []
    for p, book in enumerate(books):
        entries = [
            [total[p, e].get(k + 1, 0) // total[p, e][0] for k in range(len(entry))] if (p, e) in total else entry
            for e, entry in enumerate(book.entries)]
        found.append(Codebook(entries, np.array([e for e, (a, b) in enumerate(zip(entries, book.entries)) if a != b], np.int64)))
    return found


@dataclass
class Compressed:
    """``codes`` (kept columns, codes, error), the final codebooks, and per assignment the number of distances computed."""

    codes: DataFrame
    books: list[Codebook]
    compared: list[int]

    def digest(self) -> str:
        """SHA-256 of all entries' decimal components by part, entry and place."""
        return hashlib.sha256(",".join(str(x) for b in self.books for e in b.entries for x in e).encode()).hexdigest()


def compress(
    vectors: DataFrame, vector: str = "embedding", order: str = "vec_id", keep: Sequence[str] = ("vec_id",), *,
    scale: int = 1024, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> Compressed:
    """Codes of all vectors: the nearest entry of each of ``parts`` equal consecutive parts, and the squared error.

    Components become floor(scale * x). A part's codebook starts as that part of the ``entries`` smallest ``order``
    values. Each round assigns all parts to their nearest entries (squared distance, ties to the lower index), then
    replaces each used entry by the componentwise floor of its parts' mean; after the last round parts are assigned again.

    ``codes`` holds the columns ``keep``, ``codes`` (array of int) and ``error`` (long; the largest long where it would
    not fit). Vectors that are null, empty, hold null or non-finite components, or components that overflow a double when
    scaled take no part; nor do vectors of another length than the first one by ``order`` (then by value). Null ``order``
    values come last. A length that ``parts`` does not divide makes the last part shorter. Repeated rows are rows of
    their own. Kept columns may have any names. No usable vectors give no rows and empty codebooks.

    Every assignment is one written table; the one before it is removed. The driver holds codebooks only.
    """
    named = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(None).cast("int").alias("none"))
    rows = vectors.filter(usable(vector, scale)).select(
        named.alias("kept"), integers(vector, scale).alias("vec"), F.col(order).alias("by")).filter(F.size("vec") > 0)
    first = rows.orderBy(F.col("by").asc_nulls_last(), "vec").select("vec").limit(1).collect()
    width = len(first[0]["vec"]) if first else 0
    rows = rows.filter(F.size("vec") == width)
    start = rows.orderBy(F.col("by").asc_nulls_last(), "vec").select("vec").limit(entries).collect()  # bounded by ``entries``
    books = [Codebook([[int(x) for x in r["vec"][cut]] for r in start], np.arange(len(start))) for cut in _cuts(width, parts)]
    schema = f"kept {_ddl(rows.schema['kept'].dataType)}, vec array<double>, codes array<int>, near array<bigint>, error bigint, sums {_SUMS}, compared bigint"
    table = rows.select("kept", "vec", F.lit(None).cast("array<int>").alias("codes"), F.lit(None).cast("array<bigint>").alias("near"), F.lit(None).alias("sums"))
    compared = []
    for turn in range(rounds + 1):
        held = materialise(_assign_round(table.filter(F.col("sums").isNull()), books, width, schema))
        if turn:
            discard(table)
        compared.append(held.agg(F.sum("compared")).first()[0] or 0)
        if turn < rounds:
            books = _updated(held, books)
        table = held
    out = table.filter(F.col("sums").isNull())
    return Compressed(out.select(*[F.col("kept")[c].alias(c) for c in keep], "codes", "error"), books, compared)


def with_group_error(rows: DataFrame, group: str, name: str) -> DataFrame:
    """Add the sum of ``error`` over equal ``group`` values, nulls together; the largest long where it would not fit."""
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONG).cast("decimal(38,0)")).cast("long")
    keyed = rows.withColumns({"_known": F.col(group).isNotNull(), "_group": F.coalesce(F.col(group).cast("string"), F.lit(""))})
    sums = materialise(keyed.groupBy("_known", "_group").agg(total.alias(name)))
    if sums.limit(_SMALL + 1).count() <= _SMALL:
        joined = keyed.join(F.broadcast(sums), ["_known", "_group"])
    else:
        joined = salted_join(keyed, sums, ["_known", "_group"], spread=["codes", "error"])
    return joined.drop("_known", "_group")


def hex_code(codes: Column | str) -> Column:
    """Two lowercase hex digits for each index, in part order."""
    return F.lower(F.array_join(F.transform(codes, lambda c: F.lpad(F.hex(c), 2, "0")), ""))
