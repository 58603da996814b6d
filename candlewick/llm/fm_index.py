"""An FM-index over integer symbols in numpy: suffix array, wavelet matrix, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order; doubling, and after the first rounds only where suffixes are still equal."""
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int64)
    bits = max(1, int(symbols.max()).bit_length() + 1)
    packed = max(1, min(8, 62 // bits))
    padded = np.concatenate([symbols.astype(np.int64) + 1, np.zeros(packed, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(packed):
        key = key << bits | padded[j : j + n]
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[n] = -1
    depth = packed
    while True:
        single = new & np.concatenate([new[1:], [True]])
        open_at = np.flatnonzero(~single)  # places in the order whose group has more members
        if not len(open_at):
            return order
        suffix = order[open_at]
        following = rank[np.minimum(suffix + depth, n)]
        group = rank[suffix]
        resorted = np.lexsort((following, group))
        order[open_at] = suffix = suffix[resorted]
        group, following = group[resorted], following[resorted]
        differs = np.concatenate([[True], (group[1:] != group[:-1]) | (following[1:] != following[:-1])])
        new[open_at] = differs
        rank[suffix] = np.maximum.accumulate(np.where(differs, open_at, 0))
        depth *= 2


class WaveletMatrix:
    """Rank and access of symbols by bit planes; a plane is packed words with counts before each word."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.planes, self.zeros = bits, [], []
        current = symbols
        for level in range(bits - 1, -1, -1):
            ones = (current >> level) & 1
            packed = np.packbits(np.concatenate([ones.astype(np.uint8), np.zeros(64 + -len(ones) % 64, np.uint8)]), bitorder="little").view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            self.planes.append((packed, before))
            self.zeros.append(len(ones) - int(before[-1]))
            current = np.concatenate([current[ones == 0], current[ones == 1]])

    @staticmethod
    def _ones(plane: tuple[np.ndarray, np.ndarray], at: np.ndarray) -> np.ndarray:
        packed, before = plane
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[word] + np.bitwise_count(packed[word] & mask)

    def rank(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each symbol before ``low`` and before ``high``."""
        start = np.zeros_like(low)
        for k, plane in enumerate(self.planes):
            one = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            s, a, b = (self._ones(plane, x) for x in (start, low, high))
            start = np.where(one, self.zeros[k] + s, start - s)
            low = np.where(one, self.zeros[k] + a, low - a)
            high = np.where(one, self.zeros[k] + b, high - b)
        return low - start, high - start

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros(len(at), np.int64)
        for k, plane in enumerate(self.planes):
            packed, _ = plane
            one = (packed[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0
            ones = self._ones(plane, at)
            symbol = symbol << 1 | one
            at = np.where(one, self.zeros[k] + ones, at - ones)
        return symbol


class FMIndex:
    """Backward search and locating over one shard's symbols; symbol 0 never occurs in a pattern."""

    SAMPLE = 8

    def __init__(self, symbols: np.ndarray, alphabet: int):
        text = np.append(symbols.astype(np.int64) + 1, 0)  # the end is smaller than every symbol
        order = suffix_array(text)
        self.size, self.bits = len(text), int(alphabet + 1).bit_length()
        self.last = WaveletMatrix(text[order - 1], self.bits)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet + 2))])
        sampled = order % self.SAMPLE == 0
        self.sampled, self.row = sampled, np.cumsum(sampled) - 1
        self.position = order[sampled]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of right-aligned patterns; all patterns step backwards together."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        width = patterns.shape[1]
        for back in range(width):
            live = np.flatnonzero((lengths > back) & (high > low))
            if not len(live):
                break
            symbol = patterns[live, width - 1 - back] + 1
            a, b = self.last.rank(symbol, low[live], high[live])
            low[live], high[live] = self.first[symbol] + a, self.first[symbol] + b
        high[lengths == 0] = 0
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: step back through the text until a sampled row."""
        position, steps, left = np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        rows = rows.copy()
        while len(left):
            there = self.sampled[rows[left]]
            done = left[there]
            position[done] = self.position[self.row[rows[done]]] + steps
            left = left[~there]
            symbol = self.last.access(rows[left])
            before, _ = self.last.rank(symbol, rows[left], rows[left])
            rows[left] = self.first[symbol] + before
            steps += 1
        return position
