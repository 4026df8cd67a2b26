"""License scan: MinHash bands over overlapping windows of words retrieve templates, exact containment verifies them."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from areascreen.llm.bytetext import mix
from areascreen.llm.common import text_batches
from areascreen.llm.decontaminate import _words

#: Statements and usual notices of public licenses (fixed values). Whole texts stand in ``license_texts``.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "all-rights-reserved": "All rights reserved.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or
        agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF
        ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
        as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
        FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "LGPL-notice": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
        License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This
        library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "MPL-2.0-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
}


def _texts() -> dict[str, str]:
    """Whole texts of licenses by name, read from the package."""
    held = sorted((f for f in files("areascreen.llm").joinpath("license_texts").iterdir() if f.name.endswith(".txt")), key=lambda f: f.name)
    return {f"{f.name.removesuffix('.txt')}-text": f.read_text("utf-8", "replace") for f in held}


#: Templates to look for; a parameter of the operator.
TEMPLATES = NOTICES | _texts()
#: Words of the windows of a template that is longer than one, and of the steps between them.
WINDOW, STEP = 32, 16
#: Bands and values per band, of words for a template of one window. A window that shares three quarters of a template's
#: words meets it with probability 0.998, one with the same words always.
BANDS, ROWS = 8, 2
#: The same for windows of long templates, of two-word shingles: 0.995 where CONTAINED of them stand in both.
LONG_BANDS, LONG_ROWS = 24, 4
#: Share of a window's two-word shingles that must stand in the text.
CONTAINED = 0.8

_RANDOM = np.random.Generator(np.random.PCG64(271828))
_FACTOR = _RANDOM.integers(0, 2**64, LONG_BANDS * LONG_ROWS, dtype=np.uint64) | np.uint64(1)
_SHIFT = _RANDOM.integers(0, 2**64, LONG_BANDS * LONG_ROWS, dtype=np.uint64)
_TOP, _CHAIN = np.uint64(48), np.uint64(0x9E3779B97F4A7C15)


def _pairs(words: np.ndarray) -> np.ndarray:
    """Hashes of the pairs of neighbouring words."""
    return mix(mix(words[:-1]) + words[1:])


def _shingles(words: np.ndarray) -> np.ndarray:
    """Distinct pairs of neighbouring words; a single word stands for itself."""
    return np.unique(_pairs(words) if len(words) > 1 else words)


def _levels(values: np.ndarray, longest: int) -> dict[int, np.ndarray]:
    """Smallest value of every window of 1, 2, 4, ... values, up to ``longest``."""
    held, size = {1: values}, 1
    while 2 * size <= min(longest, len(values)):
        held[2 * size] = np.minimum(held[size][:-size], held[size][size:])
        size *= 2
    return held


def _sliding(levels: dict[int, np.ndarray], length: int) -> np.ndarray:
    """Smallest value of every window of ``length``."""
    size = 1 << (length.bit_length() - 1)
    if size not in levels or len(levels[1]) < length:
        return np.zeros(0, np.uint64)
    held = levels[size]
    return np.minimum(held[: len(levels[1]) - length + 1], held[length - size :]) if length > size else held


def _key(minima: list[np.ndarray]) -> np.ndarray:
    """One value for the minima of a band."""
    total = minima[0]
    for values in minima[1:]:
        total = (total ^ (total >> np.uint64(29))) * _CHAIN + values
    return total * _CHAIN


class Lookup:
    """Band values of windows, sorted: a table of their first 16 bits rules most others out."""

    def __init__(self, keys: np.ndarray, pieces: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        self.keys, self.pieces = keys[order], pieces[order]
        self.flag = np.zeros(1 << 16, bool)
        self.flag[self.keys >> _TOP] = True

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``keys`` and the window of each equal value."""
        at = np.flatnonzero(self.flag[keys >> _TOP])
        low, high = np.searchsorted(self.keys, keys[at]), np.searchsorted(self.keys, keys[at], "right")
        count = high - low
        every = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(at, count), self.pieces[every]


class Scanner:
    """Windows of the templates with their band values. ``pieces`` has the template and first word of each window."""

    def __init__(self, words: list[np.ndarray]) -> None:
        self.pieces: list[tuple[int, int]] = []
        self.runs: list[np.ndarray] = []
        for template, own in enumerate(words):
            last = max(0, len(own) - WINDOW)
            for begin in [*range(0, last, STEP), last]:
                self.pieces.append((template, begin))
                self.runs.append(own[begin : begin + WINDOW])
        self.cut = [len(own) > WINDOW for own in words]
        self.long = np.array([len(words[t]) > WINDOW for t, _ in self.pieces], bool)
        self.sizes = np.array([len(r) for r in self.runs], np.int64)
        self.shingles = [_shingles(r) for r in self.runs]
        self.least = np.array([CONTAINED * len(s) for s in self.shingles])
        self.known = np.unique(np.concatenate(self.shingles)) if self.runs else np.zeros(0, np.uint64)
        self.flag = np.zeros(1 << 16, bool)
        self.flag[self.known >> _TOP] = True
        #: (windows of words or of pairs, values per band, bands, {values per window: Lookup of each band})
        self.kinds = [self._kind(np.flatnonzero(~self.long), 0, BANDS, ROWS), self._kind(np.flatnonzero(self.long), 1, LONG_BANDS, LONG_ROWS)]

    def _kind(self, chosen: np.ndarray, pair: int, bands: int, rows: int) -> tuple[int, int, int, dict[int, list[Lookup]]]:
        lookups = {}
        for length in np.unique(self.sizes[chosen]).tolist():
            own = chosen[self.sizes[chosen] == length]
            values = [_pairs(self.runs[p]) if pair else self.runs[p] for p in own]
            lookups[length] = [Lookup(_key([np.array([(v * _FACTOR[k] + _SHIFT[k]).min() for v in values], np.uint64) for k in range(b * rows, (b + 1) * rows)]), own) for b in range(bands)]
        return pair, rows, bands, lookups

    def scan(self, hashes: np.ndarray, first: np.ndarray) -> list[list[tuple[int, int, float]]]:
        """(template, first word, containment) of every text: each place where a template or a run of its windows stands."""
        found: list[list[tuple[int, int, float]]] = [[] for _ in range(len(first) - 1)]
        if not len(hashes) or not self.runs:
            return found
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        pairs = _pairs(hashes)
        inner = np.append(text[1:] == text[:-1], False)[: len(pairs)]
        seen = np.zeros(len(pairs), bool)
        maybe = np.flatnonzero(self.flag[pairs >> _TOP] & inner)
        seen[maybe] = np.isin(pairs[maybe], self.known)
        sums = np.concatenate([[0], np.cumsum(seen)])
        hits: dict[tuple[int, int], list[tuple[float, int, int]]] = {}
        for window, piece in self._retrieved(hashes, pairs, first, text, sums):
            at = int(text[window])
            end = min(window + int(self.sizes[piece]), int(first[at + 1]))
            own = pairs[window : end - 1] if end > window + 1 else hashes[window:end]
            share = float(np.isin(self.shingles[piece], own).mean())
            if share >= CONTAINED:
                hits.setdefault((at, piece), []).append((-share, window - int(first[at]), end - window))
        runs: dict[tuple[int, int], list[tuple[int, int, int, float]]] = {}
        for (at, piece), windows in hits.items():
            template, begin = self.pieces[piece]
            runs.setdefault((at, template), []).extend((p, p + n, begin, -s) for s, p, n in _apart(windows))
        for (at, template), windows in sorted(runs.items()):
            found[at].extend((template, place, share) for place, share in (_joined(windows) if self.cut[template] else sorted((w[0], w[3]) for w in windows)))
        return found

    def _dense(self, first: np.ndarray, text: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of the texts with a window that holds as many known pairs as a window of a long template needs, and the
        first word of each such text (one more at the end)."""
        ends = np.minimum(np.arange(len(text)) + WINDOW - 1, len(sums) - 1)
        chosen = np.unique(text[sums[ends] - sums[np.minimum(np.arange(len(text)), len(sums) - 1)] >= self.least[self.long].min() - 1e-9])
        counts = np.diff(first)[chosen]
        bounds = np.concatenate([[0], np.cumsum(counts)])
        return np.arange(bounds[-1]) + np.repeat(first[chosen] - bounds[:-1], counts), bounds

    def _retrieved(self, hashes: np.ndarray, pairs: np.ndarray, first: np.ndarray, text: np.ndarray, sums: np.ndarray) -> list[tuple[int, int]]:
        """(window, piece) that share a band, at every word, and shorter texts whole. Windows with fewer known pairs than
        their containment needs are left out before they are verified one by one."""
        kept: list[np.ndarray] = []
        whole_batch = (np.arange(len(hashes)), first)
        for pair, rows, bands, lookups in self.kinds:
            if not lookups or not len(pairs):
                continue
            index, first_ = self._dense(first, text, sums) if pair else whole_batch
            if not len(index):
                continue
            units = pairs[np.minimum(index, len(pairs) - 1)] if pair else hashes
            owner, counts = text[index], np.diff(first_)
            few = {n: np.flatnonzero((counts > pair) & (counts < n)) for n in lookups}
            some = np.flatnonzero((counts > pair) & (counts < max(lookups)))
            bounds = np.column_stack([first_[some], first_[some + 1] - pair]).ravel()
            for band in range(bands):
                levels, rest = [], []
                for k in range(band * rows, (band + 1) * rows):
                    values = units * _FACTOR[k] + _SHIFT[k]
                    levels.append(_levels(values, max(lookups)))
                    rest.append(np.minimum.reduceat(np.append(values, np.uint64(2**64 - 1)), bounds)[::2] if len(some) else np.zeros(0, np.uint64))
                for length, tables in lookups.items():
                    at, piece = tables[band].find(_key([_sliding(level, length - pair) for level in levels]))
                    whole = (at + length <= len(owner)) & (owner[at] == owner[np.minimum(at + length - 1, len(owner) - 1)])
                    at, piece = at[whole], piece[whole]
                    chosen = np.searchsorted(some, few[length])
                    short, own = tables[band].find(_key([r[chosen] for r in rest]))
                    at, piece = index[np.concatenate([at, first_[few[length][short]]])], np.concatenate([piece, own])
                    end = np.minimum(at + length, first[text[at] + 1])
                    enough = (sums[np.maximum(end - 1, at)] - sums[at] >= self.least[piece] - 1e-9) | (self.sizes[piece] == 1)
                    kept.append(at[enough] * len(self.runs) + piece[enough])
        every = np.unique(np.concatenate(kept)) if kept else np.zeros(0, np.int64)
        return list(zip((every // len(self.runs)).tolist(), (every % len(self.runs)).tolist()))


def _apart(windows: list[tuple[float, int, int]], part: float = 0.0) -> list[tuple[float, int, int]]:
    """Windows (rank, place, words), smallest rank first, of which a better one covers no more than ``part``."""
    kept: list[tuple[float, int, int]] = []
    places: list[tuple[int, int]] = []
    for window in sorted(windows):
        place, end = window[1], window[1] + window[2]
        k = bisect_left(places, (place, 0))
        if all(min(end, b) - max(place, a) <= part * window[2] for a, b in places[max(0, k - 1) : k + 1]):
            places.insert(k, (place, end))
            kept.append(window)
    return kept


def _joined(windows: list[tuple[int, int, int, float]]) -> list[tuple[int, float]]:
    """(first word, mean containment) of each run of a template's windows (place, end, first word in the template,
    containment): windows that follow in text and template and leave no gap. Runs half inside a longer one are left out."""
    runs: list[list] = []  # place, end, last place, its first word in the template, containments
    ends: list[list] = []  # runs that may go on
    for place, end, begin, share in sorted(windows):
        ends = [r for r in ends if place <= r[1]]
        fits = [r for r in ends if begin > r[3] and abs((begin - r[3]) - (place - r[2])) < STEP]
        if fits:
            run = min(fits, key=lambda r: abs((begin - r[3]) - (place - r[2])))
            run[1], run[2], run[3] = max(run[1], end), place, begin
            run[4].append(share)
        else:
            runs.append([place, end, place, begin, [share]])
            ends.append(runs[-1])
    found = {(r[0], r[1] - r[0]): float(np.mean(r[4])) for r in sorted(runs, key=lambda r: float(np.mean(r[4])))}
    return sorted((place, found[place, size]) for _, place, size in _apart([(-size - share / 2, place, size) for (place, size), share in found.items()], 0.5))


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """All columns of ``docs`` and ``licenses``: an array of (template, word, containment), one per place of a template.

    Words are letters and digits in lower case. A template of more than WINDOW words is cut into windows of that length
    every STEP words. For every such window and every shorter template, windows of its length start at every word of
    every whole text; a text shorter than that is one window. Windows that share a band are verified: at least CONTAINED
    of the two-word shingles stand in the text's window. Of verified windows that overlap the best one counts; windows
    of a long template that follow each other make one place, with their mean containment.

    Null or empty texts and templates without words have none. Repeated rows have equal results; other columns pass
    through; an empty table gives no rows.
    """
    hashes, first = _words(pa.array(list(templates.values()), pa.string()))
    runs = {name: hashes[a:b] for name, a, b in zip(templates, first[:-1], first[1:]) if b > a}
    names, scanner = list(runs), Scanner(list(runs.values()))
    shared = docs.sparkSession.sparkContext.broadcast(scanner)
    kind = pa.list_(pa.struct([("template", pa.string()), ("word", pa.int32()), ("containment", pa.float64())]))
    docs = docs.drop("licenses")
    schema = docs.withColumn("licenses", F.array().cast("array<struct<template:string,word:int,containment:double>>")).schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = shared.value
        for batch in text_batches(batches):
            found = scanner.scan(*_words(batch.column("text")))
            rows = [[{"template": names[t], "word": w, "containment": c} for t, w, c in own] for own in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], schema.names)

    return docs.mapInArrow(scan, schema)
