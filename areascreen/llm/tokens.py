"""Token ids of many texts through a public tokenizer, each distinct unit encoded once per worker."""

from __future__ import annotations

import numpy as np
from tokenizers import Tokenizer

from areascreen.llm.bytetext import LOWER, SPACE, span_hashes, word_spans

#: Distinct units whose ids a worker keeps; beyond it the memory starts afresh.
KEPT_UNITS = 2_000_000

# Byte classes. A word of letters and plain punctuation alone splits into runs that the tokenizer treats one by one;
# any other word (digits, apostrophes, marks of special tokens, other scripts) goes to the tokenizer whole.
_LETTER, _MARK, _OTHER = 0, 1, 2
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[[ord(c) for c in '!"#$%&()*+,-./:;=?@[\\]^_`{}~']] = _MARK


class UnitTokenizer:
    """Ids equal to ``Tokenizer.encode(text, add_special_tokens=False)`` for tokenizers that split on white space."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)  # ids that end a run
        for piece, number in self.tokenizer.get_vocab().items():
            self.last[number] = piece.endswith("</w>")
        self._forget()

    def _forget(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the first id of each text (one more at the end)."""
        starts, ends, plain, first = self._units(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        keys, example, unit = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > KEPT_UNITS:
            self._forget()
        place = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[place] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            self._learn(data, starts[example[new]], ends[example[new]], plain[example[new]], keys[new])
            place = np.searchsorted(self.keys, keys)
        at, size = self.at[place][unit], self.size[place][unit]
        bounds = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.arange(bounds[-1]) + np.repeat(at - bounds[:-1], size)]
        return ids, bounds[first]

    def _units(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, first = word_spans(data, offsets)
        if not len(starts):
            return starts, ends, np.zeros(0, bool), first
        kind = _CLASS[data]
        latin = np.flatnonzero(data[:-1] == 0xC3)  # two-byte letters of Latin-1, but for the two signs among them
        latin = latin[(data[latin + 1] != 0x97) & (data[latin + 1] != 0xB7)]
        kind[latin] = kind[latin + 1] = _LETTER
        others = np.concatenate([[0], np.cumsum(kind == _OTHER)])
        plain = others[ends] == others[starts]
        inside = np.zeros(len(data) + 1, np.int32)  # marks the bytes of plain words
        inside[starts[plain]] += 1
        inside[ends[plain]] -= 1
        split = np.zeros(len(data), bool)
        split[1:] = kind[1:] != kind[:-1]
        split &= np.cumsum(inside[:-1]) > 0
        split[starts] = True
        cuts = np.flatnonzero(split)
        word = np.searchsorted(starts, cuts, "right") - 1
        stops = np.minimum(np.append(cuts[1:], len(data)), ends[word])
        return cuts, stops, plain[word], np.append(np.searchsorted(cuts, starts), len(cuts))[first]

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, plain: np.ndarray, keys: np.ndarray) -> None:
        raw = data.tobytes()
        words = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist())]
        at, sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        found, held = [self.ids], len(self.ids)
        runs = np.flatnonzero(plain)
        for begin in range(0, len(runs), 4096):  # one encoding for many runs, cut at word ends
            block = runs[begin : begin + 4096]
            flat = np.array(self.tokenizer.encode(" ".join([words[k] for k in block.tolist()]), add_special_tokens=False).ids, np.uint32)
            cuts = np.concatenate([[0], np.flatnonzero(self.last[flat]) + 1])
            if len(cuts) != len(block) + 1:
                raise ValueError("the tokenizer does not treat runs of letters and marks one by one")
            at[block], sizes[block] = held + cuts[:-1], np.diff(cuts)
            found.append(flat)
            held += len(flat)
        rest = np.flatnonzero(~plain).tolist()
        for k, encoding in zip(rest, self.tokenizer.encode_batch([words[k] for k in rest], add_special_tokens=False)):
            found.append(np.array(encoding.ids, np.uint32))
            at[k], sizes[k] = held, len(found[-1])
            held += len(found[-1])
        self.ids = np.concatenate(found)
        order = np.argsort(merged := np.concatenate([self.keys, keys]), kind="stable")
        self.keys, self.at, self.size = merged[order], np.concatenate([self.at, at])[order], np.concatenate([self.size, sizes])[order]


_held: dict[str, UnitTokenizer] = {}


def held_tokenizer(path: str) -> UnitTokenizer:
    """The tokenizer of this worker; its memory of units serves all tasks that the worker runs."""
    if path not in _held:
        _held[path] = UnitTokenizer(path)
    return _held[path]
