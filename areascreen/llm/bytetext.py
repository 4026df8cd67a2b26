"""Vectorised words and shingles of UTF-8 texts as 64-bit hashes (numpy, used inside tasks)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RANDOM = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
_PLACE = _RANDOM.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
_powers: dict[str, np.ndarray] = {}


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offset of each; a null is an empty text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(base: int, count: int) -> np.ndarray:
    held = _powers.get(str(base))
    if held is None or len(held) < count:
        held = np.full(max(count, 1 << 20), base, np.uint64)
        held[0] = 1
        held = np.multiply.accumulate(held)
        if count <= 1 << 23:
            _powers[str(base)] = held
    return held[:count]


#: Bytes of a span hashed as one sum. Sums of powers modulo 2**64 agree for some long words of a regular form (from about
#: 512 letters on), whatever the base, so a longer span is hashed piece by piece.
PIECE = 64


def _sums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(_BASE, len(data)), out=total[1:])
    return mix((total[ends] - total[starts]) * _power(_INVERSE, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte span [start, end), the same wherever the span stands.

    A span over ``PIECE`` bytes is cut into pieces; the hash of each is mixed with its place before they are added up.
    """
    long = np.flatnonzero(ends - starts > PIECE)
    if not len(long):
        return _sums(data, starts, ends)
    hashes = _sums(data, starts, np.minimum(ends, starts + PIECE))
    pieces = -(-(ends[long] - starts[long]) // PIECE)
    first = np.cumsum(pieces) - pieces
    place = np.arange(pieces.sum()) - np.repeat(first, pieces)
    begin = np.repeat(starts[long], pieces) + place * PIECE
    parts = _sums(data, begin, np.minimum(begin + PIECE, np.repeat(ends[long], pieces)))
    told = mix(parts + (place + 1).astype(np.uint64) * np.uint64(_BASE))
    hashes[long] = mix(np.add.reduceat(told, first) + (ends[long] - starts[long]).astype(np.uint64) * _PLACE[0])
    return hashes


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word (no blanks 0x20, 0x09-0x0D), and the first word of each text (one more at the end)."""
    inside = ~SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:] = ~inside[:-1]
    after[:-1] = ~inside[1:]
    starts = np.flatnonzero(inside & (before | cut[:-1]))
    ends = np.flatnonzero(inside & (after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def shingle_hashes(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of ``words`` lower-cased words, and the first of each text (one more at the end).

    A text of fewer words has its whole sequence as one shingle; a text without words has none.
    """
    data, offsets = utf8(texts)
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets)
    hashes = span_hashes(data, starts, ends)
    counts = np.diff(first)
    made = np.where(counts == 0, 0, np.maximum(counts - words + 1, 1))
    bounds = np.concatenate([[0], np.cumsum(made)])
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1], made) + np.repeat(first[:-1], made)
    size = np.repeat(np.minimum(counts, words), made)
    value = size.astype(np.uint64)
    for k in range(words):
        inside = k < size
        value = value + np.where(inside, hashes[np.where(inside, at + k, 0)] * _PLACE[k], np.uint64(0)) if len(at) else value
    return mix(value), bounds


def distinct_sets(values: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct values of each text."""
    return [np.unique(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
