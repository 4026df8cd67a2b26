"""Document fingerprints by consistent weighted sampling.

A document is a set of terms, each weighted by how often it occurs. For every sample and term two gamma variables r, c
and a uniform b follow from a hash, so they are the same in all documents. With t = floor(ln(weight) / r + b) the term
bids c * exp(-r * (t - b + 1)); the sample is the pair (term, t) of the least bid. Two documents share a sample with a
probability equal to their generalised Jaccard similarity: the sum of the smaller weights over the sum of the larger.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from areascreen.llm.bytetext import mix, shingle_hashes
from areascreen.llm.common import materialise, text_batches

#: Samples of a fingerprint; each is kept as 16 bits, so unlike samples look alike once in 65,536.
SAMPLES = 128
#: Steps into which the gamma distribution is cut; a sample draws one by 16 bits of its hash.
_STEPS = 1 << 16
_RANDOM = np.random.Generator(np.random.PCG64(777))
_FACTOR = _RANDOM.integers(0, 2**64, 4 * SAMPLES, dtype=np.uint64) | np.uint64(1)
_SHIFT = _RANDOM.integers(0, 2**64, 4 * SAMPLES, dtype=np.uint64)
_LOW = np.uint64(0xFFFF)


def _gamma_quantiles() -> np.ndarray:
    """Middle quantiles of the gamma distribution of shape 2: the x with 1 - (1 + x) exp(-x) = u, by Newton steps."""
    u = (np.arange(_STEPS) + 0.5) / _STEPS
    x = np.where(u < 0.3, np.sqrt(2 * u), -np.log1p(-u) + np.log1p(-np.log1p(-u)))
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - u) / (x * np.exp(-x)), x / 4)
    return x


_GAMMA = _gamma_quantiles()
_LN_GAMMA = np.log(_GAMMA)


def _bids(terms: np.ndarray, weights: np.ndarray, sample: int) -> np.ndarray:
    """For every (term, weight) a key that sorts by the bid; its last 16 bits tell the pair (term, t)."""
    drawn = mix(terms * _FACTOR[sample] + _SHIFT[sample])
    r = _GAMMA[(drawn >> np.uint64(48)).astype(np.int64)]
    c = _LN_GAMMA[((drawn >> np.uint64(32)) & _LOW).astype(np.int64)]
    b = ((drawn & np.uint64(0xFFFFFFFF)).astype(np.float64) + 0.5) / 2.0**32
    t = np.floor(np.log(weights) / r + b)
    bid = c - r * (t - b + 1)
    bits = bid.view(np.uint64)
    bits = np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))  # ordered like the doubles
    told = mix(drawn + t.astype(np.int64).view(np.uint64) * _FACTOR[SAMPLES]) & _LOW
    return (bits & ~_LOW) | told


def signatures(texts: pa.Array, words: int = 1, samples: int = SAMPLES) -> list[bytes]:
    """Fingerprint of each text: ``samples`` numbers of 16 bits (big-endian); a text without words has an empty one."""
    values, bounds = shingle_hashes(texts, words)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])])) if len(values) else np.zeros(0, np.int64)
    weight = np.diff(np.append(first, len(values)))
    terms, owner = values[first], owner[first]
    # Bids depend on (term, weight) alone and are worked out once for all texts of the batch.
    pairs = np.lexsort((weight, terms))
    fresh = np.concatenate([[True], (terms[pairs][1:] != terms[pairs][:-1]) | (weight[pairs][1:] != weight[pairs][:-1])]) if len(pairs) else np.zeros(0, bool)
    inverse = np.empty(len(pairs), np.int64)
    inverse[pairs] = np.cumsum(fresh) - 1
    own_terms, own_weights = terms[pairs][fresh], weight[pairs][fresh].astype(np.float64)
    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
    found = np.zeros((len(bounds) - 1, samples), ">u2")
    for k in range(samples if len(starts) else 0):
        found[owner[starts], k] = (np.minimum.reduceat(_bids(own_terms, own_weights, k)[inverse], starts) & _LOW).astype(np.uint16)
    return [row.tobytes() if n else b"" for row, n in zip(found, np.diff(bounds))]


def _alike(a: bytes, b: bytes) -> float:
    if not a or not b:
        return float(a == b)
    return float((np.frombuffer(a, ">u2") == np.frombuffer(b, ">u2")).mean())


def likeness(a: Column | str, b: Column | str, samples: int = SAMPLES) -> Column:
    """Share of equal samples of two fingerprints (binary): estimates the generalised Jaccard similarity, from 0 to 1.

    Two empty fingerprints are alike, an empty one and another are not; null gives null.
    """
    a, b = (F.hex(F.col(x) if isinstance(x, str) else x) for x in (a, b))
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(samples - 1)), lambda k: F.substr(a, 4 * k + 1, F.lit(4)) == F.substr(b, 4 * k + 1, F.lit(4))))
    return F.when((a == "") | (b == ""), (a == b).cast("double")).when(a.isNotNull() & b.isNotNull(), same / F.lit(float(samples)))


def fingerprint(docs: DataFrame, column: str = "text", name: str = "fingerprint", words: int = 1, samples: int = SAMPLES) -> DataFrame:
    """All columns of ``docs`` and the binary fingerprint of ``column`` (a column called ``name`` is replaced).

    Terms are runs of ``words`` words, A-Z in lower case. Null, empty and blank texts have an empty fingerprint. Equal
    texts have equal fingerprints in every run. No shuffle; a task holds one batch of texts.
    """
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "text"):
            texts = batch.column("text")
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(signatures(texts, words, samples), pa.binary())], ["row", "made"])

    rest = [c for c in docs.columns if c != name]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col(f"`{column}`").cast("string").alias("text"))
    fields = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in docs.select(*[F.col(f"`{c}`") for c in rest]).schema)
    made = rows.mapInArrow(compute, f"row struct<{fields}>, made binary")
    return made.select(*[F.col("row")[c].alias(c) for c in rest], F.col("made").alias(name))


_NEXT = "kind int, doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, text string, part long, tie string, rid long"
_CLOSED, _TAIL, _HEAD = 0, 1, 2


def _edited(text: str, after: str) -> str:
    """The last quarter of the code points replaced by as many of the next text."""
    cut = len(text) // 4
    return text[: len(text) - cut] + after[:cut]


def _compared(ids: list, texts: list[str], prints: list[bytes], after: list[tuple[str, bytes]]) -> pa.RecordBatch:
    """Result rows of documents whose next document (text, fingerprint) is known."""
    edited = [_edited(text, follows) for text, (follows, _) in zip(texts, after)]
    made = signatures(pa.array(edited, pa.string()))
    rows = [{
        "kind": _CLOSED, "doc_id": i, "n_chars": len(text), "edited_sha256": hashlib.sha256(e.encode()).digest(), "fingerprint": own,
        "edited_fingerprint": new, "near_edited": _alike(own, new), "near_next": _alike(own, follows),
    } for i, text, own, e, new, (_, follows) in zip(ids, texts, prints, edited, made, after)]
    return _batch(rows)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "string": pa.string()}
    fields = [field.split() for field in _NEXT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(name) for r in rows], types[kind]) for name, kind in fields], [name for name, _ in fields])


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition: each but the last is compared with the one behind it.

    The last row comes out as a tail and the first also as a head, with their texts, for the neighbouring partition.
    """
    before: tuple | None = None  # id, text, fingerprint of the row whose next one is not known yet
    part = None
    for batch in text_batches(batches):
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        prints = signatures(batch.column("text"))
        if before is None:
            part = batch.column("part")[0].as_py()
            yield _batch([{"kind": _HEAD, "doc_id": ids[0], "fingerprint": prints[0], "text": texts[0], "part": part,
                           "tie": batch.column("tie")[0].as_py(), "rid": batch.column("rid")[0].as_py()}])
        else:
            ids, texts, prints = [before[0], *ids], [before[1], *texts], [before[2], *prints]
        if len(ids) > 1:
            yield _compared(ids[:-1], texts[:-1], prints[:-1], list(zip(texts[1:], prints[1:])))
        before = ids[-1], texts[-1], prints[-1]
    if before is not None:
        yield _batch([{"kind": _TAIL, "doc_id": before[0], "text": before[1], "fingerprint": before[2], "part": part}])


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of ``docs``.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or all) of the next
    document by doc_id; after the last document comes the first. Nulls come first, rows of one id follow the MD5 of
    their texts, so repeated ids and repeated rows have one order. A null text is empty. A single row follows itself.
    Other columns are ignored. An empty table gives no rows.

    Texts are dealt once by ranges of (doc_id, MD5, row), so a huge id is split as well; a task works through its sorted
    range and holds one batch of texts. First and last rows of the ranges are joined afterwards: two rows a partition.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(
        "doc_id", "text", F.md5(F.encode("text", "UTF-8")).alias("tie"), F.monotonically_increasing_id().alias("rid"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("rid")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id().cast("long"))
    found = materialise(dealt.mapInArrow(_in_order, _NEXT))

    heads = found.filter(F.col("kind") == _HEAD)
    ring = W.orderBy(*order)  # one row a partition
    first = F.first("part").over(ring.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    follows = heads.select("part", F.coalesce(F.lead("part").over(ring), first).alias("following"))
    after = heads.select(F.col("part").alias("following"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    tails = found.filter(F.col("kind") == _TAIL).select("doc_id", "text", "fingerprint", "part").join(follows, "part").join(after, "following")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            after = list(zip(batch.column("next_text").to_pylist(), batch.column("next_print").to_pylist()))
            yield _compared(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("fingerprint").to_pylist(), after)

    closed = tails.select("doc_id", "text", "fingerprint", "next_text", "next_print").mapInArrow(close, _NEXT)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return found.filter(F.col("kind") == _CLOSED).select(*names).unionByName(closed.select(*names))
