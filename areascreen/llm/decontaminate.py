"""Benchmark decontamination: every passage of every document queries a BM25 index of the test items with block-max WAND."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from areascreen.llm.bytetext import LOWER, mix, span_hashes, utf8, word_spans
from areascreen.llm.common import materialise, text_batches

#: Words of an indexed part of an item, and of the steps between passages. A passage is two steps long, so every part of
#: a copied item lies whole in one passage.
PART = 64
#: Constants of BM25, share of its own best score at which an item is retrieved, and share of the trigrams, or of the words
#: in order, of its question and of its answer that verifies it.
K1, B, RETRIEVED, VERIFIED = 1.2, 0.75, 0.5, 0.6
#: Words of the longest answer of which half is enough, so that no one or two edits empty it.
SHORT = 4
#: Parts per posting block, and postings of one index. More postings make more indexes, which are searched one by one.
BLOCK, INDEX_POSTINGS = 4, 200_000

_MARKS = np.array([c if (48 <= c < 58 or 97 <= c < 123 or c >= 128) else 32 for c in LOWER], np.uint8)
_LEAKS = "array<struct<item_id:bigint,passage:int,score:double,question:double,answer:double>>"
_LEAK = pa.list_(pa.struct([("item_id", pa.int64()), ("passage", pa.int32()), ("score", pa.float64()), ("question", pa.float64()), ("answer", pa.float64())]))


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (letters and digits, lower case) of all texts, and the first word of each."""
    data, offsets = utf8(texts)
    data = _MARKS[data]
    starts, ends, first = word_spans(data, offsets)
    return span_hashes(data, starts, ends), first


def _trigrams(words: np.ndarray) -> np.ndarray:
    """Distinct trigrams of a run of words; a shorter run is one."""
    size = min(3, len(words))
    if not size:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        total = mix(total + words[k : len(words) - size + 1 + k])
    return np.unique(total)


def _in_order(words: np.ndarray, others: np.ndarray) -> float:
    """Share of the words that stand in ``others`` in the same order (longest common subsequence, one bit per word)."""
    places: dict[int, int] = {}
    for k, word in enumerate(words.tolist()):
        places[word] = places.get(word, 0) | 1 << k
    whole = left = (1 << len(words)) - 1
    for word in others.tolist():
        met = left & places.get(word, 0)
        left = ((left + met) | (left - met)) & whole
    return 1 - left.bit_count() / len(words) if len(words) else 1.0


def _aligned(words: np.ndarray, passage: np.ndarray) -> tuple[float, float]:
    """Shares of the question's and of the answer's words in order, at the shift at which most words meet. A few words
    more or less before a word (a seventh of the part and two) are allowed."""
    at, there = np.nonzero(words[:, None] == passage[None, :])
    if not len(at):
        return 0.0, 0.0
    shifts, counts = np.unique(there - at, return_counts=True)
    shift, cut, slack = int(shifts[np.argmax(counts)]), -(-2 * len(words) // 3), 2 + len(words) // 7
    near = lambda a, b: passage[max(0, shift + a - slack) : max(0, shift + b + slack)]
    return _in_order(words[:cut], near(0, cut)), _in_order(words[cut:], near(cut, len(words)))


def _parts(items: DataFrame) -> DataFrame:
    """item_id, part, words (hashes in order) of every item; an item without words has none."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            hashes, first = _words(batch.column("text"))
            rows = []
            for item, a, b in zip(batch.column("item_id").to_pylist(), first[:-1].tolist(), first[1:].tolist()):
                pieces = np.array_split(hashes[a:b].view(np.int64), -(-(b - a) // PART)) if b > a else []
                rows += [(item, k, piece) for k, piece in enumerate(pieces)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.list_(pa.int64())))], ["item_id", "part", "words"])

    return items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("item_id IS NOT NULL").mapInArrow(cut, "item_id long, part int, words array<long>")


@dataclass
class Index:
    """Postings of the parts, by term: part, weight, and the largest weight of each block of parts.

    Weights are BM25 weights over the part's own best score, so a part scores 1 if a passage holds all its terms.
    """

    items: np.ndarray
    terms: np.ndarray
    parts: list[np.ndarray]
    weights: list[np.ndarray]
    largest: np.ndarray
    blocks: np.ndarray  # [term][block]
    questions: list[np.ndarray]
    answers: list[np.ndarray]
    words: list[np.ndarray]

    @staticmethod
    def build(items: np.ndarray, words: list[np.ndarray], frequency: dict[int, int], count: int, mean: float) -> Index:
        entries: dict[int, list[tuple[int, float]]] = {}
        for part, own in enumerate(words):
            terms, tf = np.unique(own, return_counts=True)
            df = np.array([frequency[int(t)] for t in terms.view(np.int64)], float)
            weight = np.log(1 + (count - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(own) / mean))
            for term, value in zip(terms.tolist(), (weight / weight.sum()).tolist()):
                entries.setdefault(term, []).append((part, value))
        terms = np.array(sorted(entries), np.uint64)
        parts = [np.array([p for p, _ in entries[t]], np.int64) for t in terms.tolist()]
        weights = [np.array([w for _, w in entries[t]]) for t in terms.tolist()]
        blocks = np.zeros((len(terms), -(-len(words) // BLOCK)), np.float32)
        for k, (p, w) in enumerate(zip(parts, weights)):
            np.maximum.at(blocks[k], p // BLOCK, w)
        cuts = [-(-2 * len(own) // 3) for own in words]
        return Index(items, terms, parts, weights, blocks.max(axis=1) if len(terms) else np.zeros(0), blocks,
                     [_trigrams(own[:c]) for own, c in zip(words, cuts)], [_trigrams(own[c:]) for own, c in zip(words, cuts)], words)

    def __post_init__(self) -> None:
        self.inside: list[dict[int, tuple[list[int], list[float]]]] = [{} for _ in range(self.blocks.shape[1])]
        for term, (parts, weights) in enumerate(zip(self.parts, self.weights)):
            for part, weight in zip(parts.tolist(), weights.tolist()):
                own = self.inside[part // BLOCK].setdefault(term, ([], []))
                own[0].append(part)
                own[1].append(weight)

    def search(self, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """Block-max WAND: all (part, score) of at least ``threshold`` for the distinct terms of a passage.

        Blocks whose largest weights cannot reach the threshold are skipped whole. In the others cursors move over the
        postings: the pivot is the first part at which the largest weights of the cursors before it reach the threshold,
        and only pivots are scored.
        """
        found: list[tuple[int, float]] = []
        for block in np.flatnonzero(self.blocks[terms].sum(axis=0) >= threshold - 1e-4).tolist():
            inside = self.inside[block]
            cursors = [[*inside[t], float(self.blocks[t, block]), 0] for t in terms.tolist() if t in inside]
            while cursors:
                cursors.sort(key=lambda c: c[0][c[3]])
                total, pivot = 0.0, -1
                for k, c in enumerate(cursors):
                    total += c[2]
                    if total >= threshold - 1e-4:
                        pivot = k
                        break
                if pivot < 0:
                    break
                part = cursors[pivot][0][cursors[pivot][3]]
                if cursors[0][0][cursors[0][3]] == part:
                    here = [c for c in cursors if c[0][c[3]] == part]
                    score = sum(c[1][c[3]] for c in here)
                    if score >= threshold:
                        found.append((part, score))
                    target = part + 1
                else:
                    target = part
                for c in cursors:
                    while c[3] < len(c[0]) and c[0][c[3]] < target:
                        c[3] += 1
                cursors = [c for c in cursors if c[3] < len(c[0])]
        return found

    def leaks(self, hashes: np.ndarray, first: np.ndarray, threshold: float, verified: float) -> list[list[dict]]:
        """Verified items of every text. Passages whose terms cannot reach the threshold, by the largest weights of their
        lists and then of their blocks, are not searched."""
        found: list[list[dict]] = [[] for _ in range(len(first) - 1)]
        if not len(self.terms) or not len(hashes):
            return found
        term = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        known = np.flatnonzero(self.terms[term] == hashes)
        counts = np.diff(first)
        cells = -(-counts // PART)
        base = np.cumsum(cells) - cells
        text = np.repeat(np.arange(len(counts)), counts)[known]
        cell = base[text] + (known - first[text]) // PART
        pairs = np.unique(cell * len(self.terms) + term[known])
        cell, term = pairs // len(self.terms), pairs % len(self.terms)
        total = int(cells.sum())
        owner = np.repeat(np.arange(len(counts)), cells)
        begin = np.searchsorted(cell, np.arange(total + 1))
        bound = np.bincount(cell, self.largest[term], total)
        follows = np.append(owner[1:] == owner[:-1], False)
        for passage in np.flatnonzero(bound + np.where(follows, np.append(bound[1:], 0), 0) >= threshold - 1e-5).tolist():
            own = term[begin[passage] : begin[passage + 1 + int(follows[passage])]]
            own = np.unique(own) if follows[passage] else own
            self._verify(found[owner[passage]], passage, own, hashes, first, owner, base, threshold, verified)
        return found

    def _verify(self, out: list[dict], passage: int, own: np.ndarray, hashes: np.ndarray, first: np.ndarray, owner: np.ndarray, base: np.ndarray, threshold: float, verified: float) -> None:
        hits = self.search(own, threshold)
        if not hits:
            return
        at = int(owner[passage])
        begin = int(first[at]) + (passage - int(base[at])) * PART
        held = hashes[begin : min(begin + 2 * PART, int(first[at + 1]))]
        grams = _trigrams(held)
        for part, score in hits:
            question = float(np.isin(self.questions[part], grams).mean())
            answer = float(np.isin(self.answers[part], grams).mean()) if len(self.answers[part]) else question
            if question < 1 or answer < 1:
                ordered = _aligned(self.words[part], held)
                question, answer = max(question, ordered[0]), max(answer, ordered[1]) if len(self.answers[part]) else max(question, ordered[0])
            if question >= verified and answer >= (verified if len(self.words[part]) // 3 > SHORT else min(verified, 0.5)):
                item = int(self.items[part])
                same = next((k for k, leak in enumerate(out) if leak["item_id"] == item), None)
                leak = {"item_id": item, "passage": begin - int(first[at]), "score": score, "question": question, "answer": answer}
                if same is None:
                    out.append(leak)
                elif out[same]["score"] < score:
                    out[same] = leak


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = RETRIEVED, verified: float = VERIFIED) -> DataFrame:
    """All columns of ``docs`` and ``leaks``: an array of (item_id, passage, score, question, answer), one per test item
    that the text holds; ``passage`` is the first word of the passage.

    Every passage of 128 words, every 64 words, of every whole text is a query. All parts of items (item_id, text) at or
    above ``threshold`` are retrieved; a part whose question (its first two thirds) and answer (the rest) both have at
    least ``verified`` of their trigrams in the passage, or of their words in order near one place of it, is a leak; of an
    answer of up to SHORT words half is enough. ``question`` and ``answer`` are the larger shares. Document frequencies count all items. Items fall into
    indexes of bounded size, which search one after the other.

    Null or empty texts and items without words match nothing; items with null ids take no part; items repeated under one
    id count once per text. Repeated documents have equal results; other columns pass through. Empty tables give no leaks.
    """
    docs = docs.drop("leaks")
    parts = materialise(_parts(items.select("item_id", "text").distinct()))
    frequency = materialise(parts.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    count, mean, postings = parts.agg(F.count(F.lit(1)), F.avg(F.size("words")), F.sum(F.size("words"))).first()
    indexes = max(1, -(-(postings or 0) // INDEX_POSTINGS))
    found = docs.withColumn("leaks", F.array().cast(_LEAKS))
    for number in range(indexes):
        held = parts.filter(F.pmod(F.xxhash64("item_id", "part"), F.lit(indexes)) == number)
        rows = held.orderBy("item_id", "part").toPandas()  # bounded by INDEX_POSTINGS
        used = frequency.join(held.select(F.explode("words").alias("term")).distinct(), "term").toPandas()
        index = Index.build(rows["item_id"].to_numpy(), [np.asarray(w, np.int64).view(np.uint64) for w in rows["words"]], dict(zip(used["term"].tolist(), used["df"].tolist())), count, mean or 1.0)
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in text_batches(batches):
                before = batch.column("leaks").to_pylist()
                now = index.leaks(*_words(batch.column("text")), threshold, verified)
                merged = [old + [leak for leak in new if leak["item_id"] not in {x["item_id"] for x in old}] for old, new in zip(before, now)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(merged, _LEAK)], batch.schema.names)

        found = found.mapInArrow(search, found.schema)
        if number + 1 < indexes:
            found = materialise(found)
    return found
