"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from areascreen.llm.bytetext import LOWER, span_hashes, utf8, word_spans
from areascreen.llm.common import held_out, labelled, text_batches

#: Labelled documents that the model is fitted on, at most: a bounded sample in hash order of the id.
TRAINING_ROWS = 4000
#: Rounds in which the lines of bad documents are labelled anew, and steps of each fit.
ROUNDS, STEPS, RATE, PENALTY = 3, 120, 0.15, 1e-4

_KINDS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b".,;:'\"?-()", b"!", b"|", b"%&$#*@^~=+_/\\<>{}[]`"]
_KIND = np.full(256, len(_KINDS) + 1, np.uint8)  # other control bytes
_KIND[128:] = len(_KINDS)
for _k, _members in enumerate(_KINDS):
    _KIND[list(_members)] = _k


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every non-empty line, and the first line of each text (one more at the end)."""
    cut = np.zeros(len(data) + 1, bool)
    cut[np.flatnonzero(data == 10) + 1] = True
    cut[offsets] = True
    cut[-1] = True
    starts = np.flatnonzero(cut)
    starts, ends = starts[:-1], starts[1:].copy()
    ends -= (data[ends - 1] == 10) if len(ends) else 0
    full = ends > starts
    starts, ends = starts[full], ends[full]
    return starts, ends, np.searchsorted(starts, offsets)


def line_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Features of every line: its own, and those of the line before and after it in its text."""
    n = len(starts)
    size = (ends - starts).astype(np.float32)
    own = np.zeros((n, len(_KINDS) + 11), np.float32)
    kind = _KIND[data]
    for k in range(len(_KINDS) + 2):
        counts = np.concatenate([[0], np.cumsum(kind == k, dtype=np.int64)])
        own[:, k] = (counts[ends] - counts[starts]) / size
    at = len(_KINDS) + 2
    letters = own[:, 0] + own[:, 1] + own[:, len(_KINDS)]
    own[:, at] = np.log1p(size) / 6
    own[:, at + 1] = np.minimum(1 / np.maximum(own[:, 3], 0.01), 40) / 20  # bytes per blank: word length
    own[:, at + 2] = own[:, 1] / np.maximum(letters, 0.01)
    own[:, at + 3] = (kind[starts] == 1) * 1.0
    own[:, at + 4] = (data[ends - 1] == 46) * 1.0
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    hashes = span_hashes(data, starts, ends) ^ (text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, which, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    own[:, at + 5] = np.minimum(counts[which] - 1, 4) / 4  # the same line elsewhere in its text
    own[:, at + 6] = 1
    begin, end, word = word_spans(data, np.append(starts, len(data)))
    words = span_hashes(LOWER[data], begin, end)
    twice = np.zeros(len(words) + 1, np.int64)  # words like the one before, or the one before that
    for gap in (1, 2):
        twice[1 + gap :] |= words[gap:] == words[:-gap]
    twice[1 + word[:-1][np.diff(word) > 0]] = 0
    held = np.maximum(np.diff(word), 1)
    own[:, at + 7] = np.diff(np.cumsum(twice)[word]) / held
    own[:, at + 8] = np.log1p(held) / 6
    before, after = np.zeros_like(own), np.zeros_like(own)
    if n:
        same = text[1:] == text[:-1]
        before[1:][same] = own[:-1][same]
        after[:-1][same] = own[1:][same]
    return np.concatenate([own, before, after], axis=1)


@dataclass
class Field:
    """Weights of the field: line features to the log odds of "good", and the scores of neighbouring labels."""

    weights: np.ndarray
    links: np.ndarray  # [label before][label]
    slope: float = 1.0
    shift: float = 0.0
    share: float = 0.5  # of label 1 among the training rows

    def marginals(self, features: np.ndarray, first: np.ndarray, pairs: bool = False):
        """Probability of "good" for every line; with ``pairs`` also the summed probabilities of neighbouring labels."""
        score = np.zeros((len(features), 2))
        score[:, 1] = features @ self.weights
        counts = np.diff(first)
        texts = np.argsort(-counts, kind="stable")
        begin, held = first[:-1][texts], counts[texts]
        longest = int(held[0]) if len(held) else 0
        forward, backward = np.zeros_like(score), np.zeros_like(score)
        for t in range(longest):  # all texts of more than t lines at once
            live = begin[: np.searchsorted(-held, -t)] + t
            forward[live] = score[live]
            if t:
                step = forward[live - 1][:, :, None] + self.links
                forward[live] += np.logaddexp(step[:, 0], step[:, 1])
        for t in range(longest - 2, -1, -1):
            live = begin[: np.searchsorted(-held, -(t + 1))] + t
            step = self.links + (score[live + 1] + backward[live + 1])[:, None, :]
            backward[live] = np.logaddexp(step[:, :, 0], step[:, :, 1])
        both = forward + backward
        good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -60, 60)))
        if not pairs:
            return good
        inner = np.ones(len(features), bool)
        inner[first[:-1][counts > 0]] = False
        here = np.flatnonzero(inner)
        joint = forward[here - 1][:, :, None] + self.links + (score[here] + backward[here])[:, None, :]
        joint -= joint.max(axis=(1, 2), keepdims=True)
        joint = np.exp(joint)
        return good, (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0), here

    def raw(self, features: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Mean marginal of each text's lines, weighted by length; NaN without lines."""
        good = np.concatenate([[0], np.cumsum(self.marginals(features, first) * size)])
        total = np.concatenate([[0], np.cumsum(size)])
        with np.errstate(invalid="ignore", divide="ignore"):
            return (good[first[1:]] - good[first[:-1]]) / (total[first[1:]] - total[first[:-1]])

    def scores(self, raw: np.ndarray) -> np.ndarray:
        clipped = np.clip(raw, 1e-3, 1 - 1e-3)
        value = 1 / (1 + np.exp(-(self.slope * np.log(clipped / (1 - clipped)) + self.shift)))
        return np.where(np.isnan(raw), self.share, value)


def _ascend(weights: np.ndarray, gradient, steps: int) -> np.ndarray:
    """Adam steps along ``gradient(weights)``."""
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    for t in range(1, steps + 1):
        g = gradient(weights)
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        weights = weights + RATE * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    return weights


def fit(texts: list[str], labels: list[int]) -> Field:
    """Fit the field to labelled documents. All lines of a good document are good. Lines of a bad one start as bad; then
    those that the model holds good are relabelled, but for the worst line of each document."""
    made, sizes, ends_of = [], [], [np.zeros(1, np.int64)]
    for at in range(0, len(texts), 128):  # a few texts at a time: features are small beside what makes them
        data, offsets = utf8(pa.array(texts[at : at + 128], pa.string()))
        starts, ends, part = lines(data, offsets)
        made.append(line_features(data, starts, ends, part))
        sizes.append(ends - starts)
        ends_of.append(part[1:] + ends_of[-1][-1])
    if not made:
        return Field(np.zeros(0), np.zeros((2, 2)))
    features, size, first = np.concatenate(made).astype(np.float64), np.concatenate(sizes).astype(np.float64), np.concatenate(ends_of)
    quality, counts = np.array(labels, np.int64), np.diff(first)
    share = float(quality.mean()) if len(quality) else 0.5
    field = Field(np.zeros(features.shape[1]), np.zeros((2, 2)), share=share)
    if not len(features) or len(set(labels)) < 2:
        return field
    text = np.repeat(np.arange(len(counts)), counts)
    given = quality[text].astype(np.float64)
    n = features.shape[1]
    for turn in range(ROUNDS):
        def gradient(values: np.ndarray, given=given) -> np.ndarray:
            model = Field(values[:n], values[n:].reshape(2, 2))
            good, joint, here = model.marginals(features, first, pairs=True)
            seen = np.zeros((2, 2))
            np.add.at(seen, (given[here - 1].astype(int), given[here].astype(int)), 1.0)
            return np.concatenate([features.T @ (given - good), (seen - joint).ravel()]) / len(features) - PENALTY * values

        values = _ascend(np.concatenate([field.weights, field.links.ravel()]), gradient, STEPS)
        field = Field(values[:n], values[n:].reshape(2, 2), share=share)
        if turn < ROUNDS - 1:
            good = field.marginals(features, first)
            worst = np.minimum.reduceat(good, first[:-1][counts > 0])[np.searchsorted(np.flatnonzero(counts > 0), text)]
            given = np.where(quality[text] == 1, 1.0, ((good > 0.5) & (good > worst)).astype(np.float64))
    raw = np.clip(field.raw(features, first, size), 1e-3, 1 - 1e-3)
    known = ~np.isnan(raw)
    odds, truth = np.log(raw[known] / (1 - raw[known])), quality[known]

    def calibrate(values: np.ndarray) -> np.ndarray:
        wrong = truth - 1 / (1 + np.exp(-(values[0] * odds + values[1])))
        return np.array([(wrong * odds).mean(), wrong.mean()]) - 1e-3 * values

    field.slope, field.shift = (float(v) for v in _ascend(np.array([1.0, 0.0]), calibrate, 400))
    return field


def score_quality(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """All columns of ``docs`` and ``quality_score``: 0 to 1, higher where label 1 is likelier.

    The model learns from ``labels`` (doc_id, quality) of rows that are not held out, at most ``rows`` of them. A score
    depends on the text alone. Whole texts are read; a line is what stands between line breaks, and empty lines count
    for nothing.

    A null, empty or blank-line text scores the share of label 1 among the training rows. Without labels of both kinds
    every score is that share (0.5 without any). Repeated rows score the same; other columns pass through untouched; an
    empty table gives no rows.
    """
    taken = labelled(docs, labels, "quality", rows).select("text", "label").toPandas()  # bounded by ``rows``
    field = fit(taken["text"].tolist(), taken["label"].tolist())
    fitted = taken["label"].nunique() > 1
    docs = docs.drop("quality_score")
    schema = docs.select("*", F.lit(0.0).alias("quality_score")).schema

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            data, offsets = utf8(batch.column("text").cast(pa.string()))
            starts, ends, first = lines(data, offsets)
            if fitted:
                raw = field.raw(line_features(data, starts, ends, first), first, (ends - starts).astype(np.float64))
            else:
                raw = np.full(len(batch), np.nan)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(field.scores(raw))], [*batch.schema.names, "quality_score"])

    return docs.mapInArrow(compute, schema)


def with_fold(scored: DataFrame, score: str, threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted of scored documents."""
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), F.col(score).alias("score"), (F.col(score) >= threshold).cast("int").alias("predicted"))
