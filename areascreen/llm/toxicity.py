"""Toxicity from a gap-weighted subsequence kernel, a support vector machine and Nyström landmarks."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from areascreen.llm.bytetext import span_hashes, utf8, word_spans
from areascreen.llm.common import labelled, text_batches

#: Labelled documents that the model is fitted on, at most: a bounded sample in hash order of the id.
TRAINING_ROWS = 3000
#: Length of the subsequences, the most characters that one spans, and the weight of each of these.
ORDER, SPAN, DECAY = 3, 5, 0.5
#: Letters that the kernel compares at once. Longer strings are covered by windows of this length at half its distance.
WINDOW = 16
#: Landmarks, clean words among them, rounds of choosing the toxic sentences, steps of each fit, clean strings in it.
LANDMARKS, CLEAN_LANDMARKS, ROUNDS, STEPS, CLEAN = 160, 48, 5, 300, 16_000
#: One training document in so many is left out of the fit and turns decision values into scores.
CALIBRATION = 4
#: Toxic documents that share a string before it counts beside their most toxic one.
SUPPORT = 5
#: Weight of known strings with one letter inserted, beside the strings themselves, in the fit.
INSERTED = 0.02
#: Decision values below this count as this: a clean string's margin.
FLOOR = -1.0

_SIZE = 32  # character classes: 26 letters, 3 for bytes of other letters, a cut in a long string, begin and end
_CUT, _BEGIN, _END, _DROPPED = 29, 30, 31, 255
_CLASS = np.full(256, _DROPPED, np.uint8)
for _k in range(26):
    _CLASS[65 + _k] = _CLASS[97 + _k] = _k
for _digit, _letter in zip(b"013457", b"oieast"):  # digits that stand for letters
    _CLASS[_digit] = _letter - 97
_CLASS[128:192] = 26 + np.arange(64) % 3

@cache
def _places(length: int) -> tuple[np.ndarray, np.ndarray]:
    """All ascending triples of places within SPAN in a word, and the weight of each: DECAY to the characters it spans."""
    triples = np.array([t for t in combinations(range(length), ORDER) if t[-1] - t[0] < SPAN], np.int64).reshape(-1, ORDER)
    return triples.T, (DECAY ** (triples[:, -1] - triples[:, 0] + 1)).astype(np.float32)


def subsequences(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For words of one length, as rows of classes: the triples of each, and the weights of their places."""
    (a, b, c), weights = _places(letters.shape[1])
    wide = letters.astype(np.int32)
    return (wide[:, a] * _SIZE + wide[:, b]) * _SIZE + wide[:, c], weights


def self_kernels(keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Kernel of each word with itself: squares of the summed weights of equal triples."""
    order = np.argsort(keys, axis=1)
    ranked = np.take_along_axis(keys, order, 1)
    first = np.ones(ranked.shape, bool)
    first[:, 1:] = ranked[:, 1:] != ranked[:, :-1]
    starts = np.flatnonzero(first)
    part = np.add.reduceat(weights[order].ravel(), starts) if len(starts) else np.zeros(0)
    return np.bincount(starts // keys.shape[1], part * part, minlength=len(keys)) if keys.size else np.ones(len(keys))


@dataclass
class Words:
    """The letter strings of a batch: runs in ``letters``, the text of each, and its classes before and after it."""

    letters: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    edges: tuple[np.ndarray, np.ndarray]
    hashes: np.ndarray

    def unique(self) -> tuple[np.ndarray, np.ndarray]:
        """An example of each distinct string, and the string of each run."""
        _, example, which = np.unique(self.hashes, return_index=True, return_inverse=True)
        return example, which

    def blocks(self, example: np.ndarray, cells: int = 4_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Distinct strings by length, in blocks of bounded memory: their numbers, and their classes as rows."""
        size = self.ends[example] - self.starts[example]
        for length in np.unique(size[size >= ORDER]):
            chosen = np.flatnonzero(size == length)
            step = max(1, cells // len(_places(int(length) + 2)[1]))
            for begin in range(0, len(chosen), step):
                part = chosen[begin : begin + step]
                inner = self.letters[self.starts[example[part]][:, None] + np.arange(length)]
                yield part, np.column_stack([self.edges[0][example[part]], inner, self.edges[1][example[part]]])


def letter_strings(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Letter strings of all texts: each word without its other characters, and each run of single letters joined."""
    starts, ends, first = word_spans(data, offsets)
    classes = _CLASS[data]
    kept = np.flatnonzero(classes != _DROPPED)
    letters = classes[kept]
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    begin, end = np.searchsorted(kept, starts), np.searchsorted(kept, ends)
    alone = (end - begin == 1).astype(np.int8)
    edges = np.ones(len(starts) + 1, bool)  # a run of single letters ends where the text or the kind of word changes
    if len(starts):
        edges[1:-1] = (alone[1:] != alone[:-1]) | (text[1:] != text[:-1])
    bounds = np.flatnonzero(edges)
    runs = np.flatnonzero(alone[bounds[:-1]] & (np.diff(bounds) >= ORDER)) if len(starts) else np.zeros(0, np.int64)
    head, tail = bounds[:-1][runs], bounds[1:][runs] - 1
    begin, end = np.concatenate([begin, begin[head]]), np.concatenate([end, end[tail]])
    text = np.concatenate([text, text[head]])
    count = np.maximum(1, -(-(end - begin - WINDOW) // (WINDOW // 2)) + 1)
    part = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    whole = (np.repeat(begin, count), np.repeat(end, count))
    begin = whole[0] + part * (WINDOW // 2)
    end = np.minimum(whole[1], begin + WINDOW)
    edges = (np.where(begin == whole[0], _BEGIN, _CUT).astype(np.uint8), np.where(end == whole[1], _END, _CUT).astype(np.uint8))
    hashes = span_hashes(letters, begin, end) ^ (edges[0].astype(np.uint64) * np.uint64(64) + edges[1])
    return Words(letters, begin, end, np.repeat(text, count), edges, hashes)


@dataclass
class Machine:
    """The decision function. It is a sum of kernels with landmarks, hence one weight per subsequence."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    share: float = 0.5

    def distinct(self, words: Words, example: np.ndarray) -> np.ndarray:
        """Decision value of distinct strings, FLOOR at least. The self kernel, at least the sum of squared weights, is
        worked out only where that bound leaves the value above the floor."""
        found = np.full(len(example), FLOOR)
        table = self.weights.astype(np.float32)
        for part, letters in words.blocks(example):
            keys, weights = subsequences(letters)
            total = table[keys] @ weights
            open_ = np.flatnonzero(total / np.sqrt(np.sum(weights * weights)) + self.bias > FLOOR) if self.bias <= FLOOR else np.arange(len(part))
            own = self_kernels(keys[open_], weights)
            found[part[open_]] = np.maximum(FLOOR, total[open_] / np.sqrt(own) + self.bias)
        return found

    def values(self, words: Words) -> np.ndarray:
        """Decision value of every letter string."""
        example, which = words.unique()
        return self.distinct(words, example)[which]

    def raw(self, words: Words, texts: int) -> np.ndarray:
        """Value of the most toxic sentence of each text: of its most toxic string; NaN without strings."""
        best = np.full(texts, -np.inf)
        np.maximum.at(best, words.text, self.values(words))
        return np.where(np.isinf(best), np.nan, best)

    def scores(self, raw: np.ndarray) -> np.ndarray:
        known = 1 / (1 + np.exp(-np.clip(self.slope * raw + self.shift, -60, 60)))
        return np.where(np.isnan(raw), 0.0, known)


def _kernels(words: Words, example: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Normalised kernels of distinct strings with the landmarks (columns of ``_embedding``)."""
    found = np.zeros((len(example), landmarks.shape[1]), np.float32)
    for part, letters in words.blocks(example, 100_000):
        keys, weights = subsequences(letters)
        scaled = weights / np.sqrt(self_kernels(keys, weights))[:, None]
        for k in range(keys.shape[1]):
            found[part] += landmarks[keys[:, k]] * scaled[:, k : k + 1]
    return found


def _embedding(words: Words, example: np.ndarray) -> np.ndarray:
    """Normalised subsequence vectors of distinct strings, one column each."""
    table = np.zeros((_SIZE**ORDER, len(example)), np.float32)
    for part, letters in words.blocks(example):
        keys, weights = subsequences(letters)
        own = self_kernels(keys, weights)
        for row, column in enumerate(part):
            np.add.at(table[:, column], keys[row], weights / np.sqrt(own[row]))
    return table


def _with_insertions(words: Words, example: np.ndarray) -> tuple[Words, np.ndarray]:
    """Strings with one more letter at every inner place, and the number of the string that each comes from."""
    made, source = [], []
    for k, w in enumerate(example):
        letters = words.letters[words.starts[w] : words.ends[w]]
        for place in range(1, len(letters)) if len(letters) < WINDOW else ():
            made.append(np.insert(letters, place, (7 * place + 5 * k + int(letters[0])) % 26))
            source.append(k)
    sizes = np.array([len(m) for m in made], np.int64)
    ends = np.cumsum(sizes)
    edges = (np.full(len(made), _BEGIN, np.uint8), np.full(len(made), _END, np.uint8))
    return Words(np.concatenate(made) if made else np.zeros(0, np.uint8), ends - sizes, ends, np.zeros(len(made), np.int64), edges, np.zeros(len(made), np.uint64)), np.array(source, np.int64)


def _all_strings(texts: list[str], rows: int = 256) -> Words:
    """``letter_strings`` of a long list, a few texts at a time; each distinct string's letters are kept once."""
    parts, held = [], {}
    letters: list[np.ndarray] = []
    size = 0
    for at in range(0, len(texts), rows):
        words = letter_strings(*utf8(pa.array(texts[at : at + rows], pa.string())))
        example, which = words.unique()
        starts = np.zeros(len(example), np.int64)
        for k, w in enumerate(example.tolist()):
            key = int(words.hashes[w])
            if key not in held:
                held[key] = size
                letters.append(words.letters[words.starts[w] : words.ends[w]])
                size += len(letters[-1])
            starts[k] = held[key]
        lengths = words.ends - words.starts
        pairs = np.unique(words.text * len(example) + which) if len(which) else np.zeros(0, np.int64)  # a string counts once per text
        kept = example[pairs % len(example)] if len(pairs) else pairs
        parts.append((starts[pairs % len(example)] if len(pairs) else pairs, lengths[kept], pairs // max(1, len(example)) + at, words.edges[0][kept], words.edges[1][kept], words.hashes[kept]))
    joined = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 6
    return Words(np.concatenate(letters) if letters else np.zeros(0, np.uint8), joined[0], joined[0] + joined[1], joined[2], (joined[3], joined[4]), joined[5])


def fit(texts: list[str], labels: list[int]) -> Machine:
    """Fit the machine to labelled documents.

    A sentence is as toxic as its most toxic string, a document as its most toxic sentence. Sentences of clean
    documents are clean. Which sentences of a toxic document are toxic is learned: first those with strings that toxic
    documents alone use, then, round by round, those that the machine finds. A string of one document teaches nothing.
    """
    unique = dict(zip(texts, labels))  # copies of a document say nothing more about its strings
    aside = {t: y for t, y in unique.items() if zlib.crc32(t.encode()) % CALIBRATION == 0}
    if len(set(aside.values())) == 2 and len(set(unique.values())) == 2:
        unique = {t: y for t, y in unique.items() if t not in aside} if len({y for t, y in unique.items() if t not in aside}) == 2 else unique
    else:
        aside = unique
    texts, labels = list(unique), list(unique.values())
    toxic = np.array(labels, np.int64)
    share = float(toxic.mean()) if len(toxic) else 0.5
    words = _all_strings(texts)
    example, which = words.unique()
    long_enough = (words.ends - words.starts)[example] >= ORDER
    if len(set(labels)) < 2 or not long_enough.any():
        return Machine(np.zeros(_SIZE**ORDER), FLOOR, 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))), share)
    pairs = np.unique(words.text * len(example) + which)  # each string once per document
    doc, word = pairs // len(example), pairs % len(example)
    bad, clean = np.bincount(word, toxic[doc], len(example)), np.bincount(word, 1 - toxic[doc], len(example))
    prior = np.log((np.maximum(bad - 1, 0) + 0.05) / toxic.sum()) - np.log((clean + 0.5) / (1 - toxic).sum())
    ranked = np.flatnonzero(long_enough)[np.argsort(-(prior * np.sqrt(bad))[long_enough], kind="stable")]
    usual = np.flatnonzero(long_enough)[np.argsort(-clean[long_enough], kind="stable")]
    chosen = np.unique(np.concatenate([ranked[: LANDMARKS - CLEAN_LANDMARKS], usual[:CLEAN_LANDMARKS]]))
    table = _embedding(words, example[chosen])
    size, basis = np.linalg.eigh(table.T.astype(np.float64) @ table)
    kept = size > 1e-3
    root = (basis[:, kept] / np.sqrt(size[kept])) @ basis[:, kept].T

    negative = np.flatnonzero((clean > 0) & (clean > 0.02 * bad) & long_enough)
    negative = negative[np.argsort(words.hashes[example[negative]])]  # hash order
    inside = (toxic[doc] == 1) & long_enough[word] & (clean[word] <= 0.02 * bad[word])
    value, vector, machine = prior, np.zeros(len(chosen) + 1), None
    for turn in range(ROUNDS):
        held = np.full(len(texts), -np.inf)
        np.maximum.at(held, doc[inside], value[word[inside]])
        over = 2.0 if turn == 0 else 0.0
        positive = np.unique(word[inside & (bad[word] > 1) & ((value[word] >= held[doc]) | ((value[word] > over) & (bad[word] >= SUPPORT)))])
        if not len(positive):
            break
        hardest = negative[np.argsort(-value[negative], kind="stable")[:CLEAN]]
        wrong = np.unique(np.concatenate([hardest, negative[:CLEAN], usual[:CLEAN][clean[usual[:CLEAN]] > 0.02 * bad[usual[:CLEAN]]]]))
        rows = np.concatenate([positive, wrong])
        sign = np.concatenate([np.ones(len(positive)), -np.ones(len(wrong))])
        mass = np.concatenate([bad[positive] / toxic.sum(), clean[wrong] / (1 - toxic).sum()])  # documents that each decides
        x = _kernels(words, example[rows], table) @ root
        known = positive[bad[positive] >= SUPPORT]
        altered, source = _with_insertions(words, example[known])
        if len(source):
            x = np.concatenate([x, _kernels(altered, np.arange(len(source)), table) @ root])
            sign = np.append(sign, np.ones(len(source)))
            mass = np.append(mass, INSERTED * bad[known[source]] / toxic.sum())
        mean, square = 0.0, 0.0
        for t in range(1, STEPS + 1):  # squared hinge loss, Adam steps
            slack = np.maximum(0, 1 - sign * (x @ vector[:-1] + vector[-1]))
            pull = mass * slack * sign
            gradient = np.append(x.T @ pull, pull.sum()) - 1e-7 * np.append(vector[:-1], 0)
            mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
            vector = vector + 0.1 * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-9)
        machine = Machine(table.astype(np.float64) @ (root @ vector[:-1]), float(vector[-1]), share=share)
        value = machine.distinct(words, example)
    if machine is None:
        return Machine(np.zeros(_SIZE**ORDER), FLOOR, share=share)
    toxic = np.array(list(aside.values()), np.int64)
    raw = machine.raw(_all_strings(list(aside)), len(aside))
    known = ~np.isnan(raw)
    slope, shift = 1.0, 0.0
    for _ in range(2000):
        wrong = toxic[known] - 1 / (1 + np.exp(-np.clip(slope * raw[known] + shift, -60, 60)))
        slope, shift = slope + 0.5 * ((wrong * raw[known]).mean() - 1e-4 * slope), shift + 0.5 * wrong.mean()
    machine.slope, machine.shift = float(slope), float(shift)
    return machine


def score_toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """All columns of ``docs`` and ``toxic_score``: 0 to 1, higher where label 1 is likelier.

    The model learns from ``labels`` (doc_id, toxic) of rows that are not held out, at most ``rows`` of them. A score
    depends on the text alone, and on all of it. Characters inserted into a word, other than letters, are dropped;
    inserted letters and gaps are what the kernel tolerates.

    A null or empty text, or one without words, scores 0. Without labels of both kinds every other score is the share
    of label 1. Repeated rows score the same; other columns pass through untouched; an empty table gives no rows.
    """
    taken = labelled(docs, labels, "toxic", rows).select("text", "label").toPandas()  # bounded by ``rows``
    machine = fit(taken["text"].tolist(), taken["label"].tolist())
    docs = docs.drop("toxic_score")
    schema = docs.select("*", F.lit(0.0).alias("toxic_score")).schema

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            words = letter_strings(*utf8(batch.column("text").cast(pa.string())))
            scores = machine.scores(machine.raw(words, len(batch)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*batch.schema.names, "toxic_score"])

    return docs.mapInArrow(compute, schema)
