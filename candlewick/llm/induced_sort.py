"""External induced sorting: suffix order and common prefixes through disk-backed bucket queues.

Suffixes are L (larger than their successor) or S; an S suffix after an L suffix is
S*. Sorted S* suffixes induce the L suffixes in one ascending pass, and these the S
suffixes in one descending pass. A pass is a monotone priority queue: an entry's
priority is (its symbol, the rank of its successor), entries of a symbol arrive in the
order of that rank, so a queue per symbol is popped front to back. Entries carry the
rank, and popping them yields the common prefix with the one before as one more than
the least common prefix between the successors' ranks. S* suffixes are sorted by
naming the S* substrings with the same two passes and recursing on the names.

Queues spill to unnamed temporary files of the task, which go when it ends; nothing
else ever reads them. Large results are memory-mapped in the same way.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from candlewick.llm.fm_index import suffix_array

#: Bytes that the queues of a pass, or one result array, keep in memory; and entries popped at a time.
MEMORY_BYTES = 32 << 20
PIECE = 1 << 20


def array(size: int, kind: type, memory: int) -> np.ndarray:
    """Zeros, in memory or in an unnamed temporary file."""
    if size * np.dtype(kind).itemsize <= memory:
        return np.zeros(size, kind)
    return np.memmap(tempfile.TemporaryFile(), kind, "w+", shape=(size,))


class BucketQueues:
    """A monotone priority queue: a first-in first-out queue of (position, rank) for every symbol."""

    def __init__(self, memory: int):
        self.memory, self.held = memory, 0
        self.kept: dict[int, list[np.ndarray]] = {}
        self.spilled: dict[int, list[tuple[int, int]]] = {}
        self.file = None

    def push(self, symbol: int, entries: np.ndarray) -> None:
        self.kept.setdefault(symbol, []).append(entries)
        self.held += entries.nbytes
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for symbol, parts in self.kept.items():
            for part in parts:
                self.spilled.setdefault(symbol, []).append((self.file.tell(), len(part)))
                self.file.write(np.ascontiguousarray(part).tobytes())
        self.kept, self.held = {}, 0

    def pop(self, symbol: int) -> Iterator[np.ndarray]:
        """All entries of a symbol in order, also those pushed meanwhile, a piece at a time."""
        while symbol in self.spilled or symbol in self.kept:
            if symbol in self.spilled:  # older than what is in memory
                for at, size in self.spilled.pop(symbol):
                    self.file.seek(at)
                    yield np.frombuffer(self.file.read(size * 16), np.int64).reshape(size, 2)
                continue
            parts = self.kept.pop(symbol, [])
            self.held -= sum(p.nbytes for p in parts)
            if parts:
                whole = np.concatenate(parts) if len(parts) > 1 else parts[0]
                for first in range(0, len(whole), PIECE):
                    yield whole[first : first + PIECE]


@dataclass
class Given:
    """Sorted entries a pass starts from: positions, classes (None: all differ), common prefixes with the one before."""

    position: np.ndarray
    mark: np.ndarray | None
    prefix: np.ndarray | None


@dataclass
class Sequence:
    """What a pass popped, in order: positions, classes or ranks, common prefixes, and which came out of a queue."""

    position: np.ndarray
    mark: np.ndarray | None
    prefix: np.ndarray | None
    induced: np.ndarray


def _induce(text: np.ndarray, size: int, given: Given, sign: int, limit: int, runs: np.ndarray | None, memory: int) -> Sequence:
    """One pass; ``sign`` 1 ascending (L suffixes from S*), -1 descending (S suffixes from L)."""
    ranked = given.mark is None
    position, induced = array(size, np.int64, memory), array(size, bool, memory)
    mark = None if ranked else array(size, np.int64, memory)
    prefix = array(size, np.uint16, memory) if ranked else None
    queues, done, classes = BucketQueues(memory), 0, -1
    first = text[given.position]
    symbols = np.unique(text)[::sign].tolist()
    lows = np.searchsorted(first if sign > 0 else -first.astype(np.int64), [sign * s for s in symbols], "left")
    highs = np.append(lows[1:], len(first))

    def push_before(entries: np.ndarray, ranks: np.ndarray, symbol: int, equal: bool) -> None:
        before = entries - 1
        before, ranks = before[entries > 0], ranks[entries > 0]
        at = text[before]
        chosen = (at > symbol if sign > 0 else at < symbol) | (equal & (at == symbol))
        before, ranks, at = before[chosen], ranks[chosen], at[chosen]
        order = np.argsort(at, kind="stable")
        at = at[order]
        pairs = np.stack([before[order], ranks[order]], 1)
        edges = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1, [len(at)]])
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if high > low:
                queues.push(int(at[low]), pairs[low:high])

    for symbol, low, high in zip(symbols, lows.tolist(), highs.tolist()):
        last_rank, last_place = -1, -1  # of the entry popped before in this bucket
        for entries in queues.pop(symbol):
            places, ranks = entries[:, 0], entries[:, 1]
            stop = done + len(places)
            position[done:stop], induced[done:stop] = places, True
            if ranked:
                if last_rank >= 0:
                    prefix[done] = min(limit, 1 + int(prefix[last_rank + 1 : ranks[0] + 1].min()))
                if len(ranks) > 1:
                    least = np.minimum.reduceat(prefix[ranks[0] + 1 : ranks[-1] + 1], ranks[:-1] - ranks[0])
                    prefix[done + 1 : stop] = np.minimum(least + 1, limit)
                own = np.arange(done, stop)
            else:
                own = classes + np.cumsum(np.concatenate([[ranks[0] != last_rank], ranks[1:] != ranks[:-1]]))
                mark[done:stop], classes = own, int(own[-1])
            last_rank, last_place = int(ranks[-1]), int(places[-1])
            push_before(places, own, symbol, True)
            done = stop
        for begin in range(low, high, PIECE):
            places = given.position[begin : min(high, begin + PIECE)]
            stop = done + len(places)
            position[done:stop] = places
            if ranked:
                prefix[done:stop] = given.prefix[begin : begin + len(places)]
                if begin == low:
                    prefix[done] = min(limit, int(runs[last_place]), int(runs[places[0]])) if last_place >= 0 else 0
                own = np.arange(done, stop)
            else:
                marks = given.mark[begin : begin + len(places)]
                own = classes + np.cumsum(np.concatenate([[begin == low or marks[0] != given.mark[begin - 1]], marks[1:] != marks[:-1]]))
                mark[done:stop], classes = own, int(own[-1])
            push_before(np.asarray(places), own, symbol, False)
            done = stop
    return Sequence(position[:done], None if ranked else mark[:done], prefix[:done] if ranked else None, induced[:done])


def _larger(sequence: Sequence) -> Given:
    """The L suffixes of an ascending pass, in descending order."""
    chosen = np.flatnonzero(sequence.induced)[::-1]
    prefix = None
    if sequence.prefix is not None:
        prefix = np.zeros(len(chosen), np.uint16)
        prefix[1:] = sequence.prefix[chosen[:-1]]
    return Given(sequence.position[chosen], None if sequence.mark is None else sequence.mark[chosen], prefix)


def _common(text: np.ndarray, one: np.ndarray, two: np.ndarray, limit: int) -> np.ndarray:
    """Common prefixes, up to ``limit``, of pairs of suffixes, by direct comparison of what is still equal."""
    out = np.zeros(len(one), np.uint16)
    step = 1 if text.itemsize > 1 else 8
    padded = np.concatenate([text, np.zeros(limit + 8, text.dtype)])
    words = padded if step == 1 else np.lib.stride_tricks.as_strided(padded, (len(padded) - 7, 8), (1, 1))
    live = np.arange(len(one))
    for at in range(0, limit, step):
        a, b = words[np.minimum(one[live] + at, len(text))], words[np.minimum(two[live] + at, len(text))]
        if step == 1:
            equal = (a == b).astype(np.uint16)
        else:
            differs = a != b
            equal = np.where(differs.any(1), differs.argmax(1), 8).astype(np.uint16)
        out[live] += equal
        live = live[equal == step]
        if not len(live):
            break
    return np.minimum(out, limit)


def _kinds(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each suffix is S, places where the symbol changes or the text ends)."""
    n = len(text)
    change = np.append(text[1:] != text[:-1], True)
    at = np.where(change, np.arange(n), n)
    ahead = np.minimum.accumulate(at[::-1])[::-1]
    smaller = np.zeros(n, bool)
    inner = ahead < n - 1
    smaller[inner] = text[ahead[inner]] < text[ahead[inner] + 1]
    smaller[n - 1] = True
    return smaller, ahead


def _star_order(text: np.ndarray, stars: np.ndarray, larger: int, memory: int) -> np.ndarray:
    """S* positions in suffix order: names of S* substrings by two passes, then recursion on the names."""
    order = stars[np.argsort(text[stars], kind="stable")]
    up = _induce(text, larger + len(stars), Given(order, np.zeros(len(order), np.int64), None), 1, 0, None, memory)
    down = _induce(text, len(text), _larger(up), -1, 0, None, memory)
    is_star = np.zeros(len(text), bool)
    is_star[stars] = True
    chosen = is_star[down.position]
    found, classes = down.position[chosen][::-1], down.mark[chosen][::-1]
    names = np.zeros(len(text), np.int64)
    names[found] = 1 + np.concatenate([[0], np.cumsum(classes[1:] != classes[:-1])]) if len(found) else 0
    reduced = names[stars]  # the end of the text comes last and is 0
    if reduced.max(initial=0) + 1 == len(stars):
        return stars[np.argsort(reduced)]
    if reduced.nbytes <= memory:
        return stars[suffix_array(reduced)]
    return stars[suffix_order(reduced, 0, memory)[0]]


def suffix_order(text: np.ndarray, limit: int, memory: int = MEMORY_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in ascending order, common prefix of each with the one before, up to ``limit``).

    The last symbol must be smaller than all others and occur once.
    """
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64), np.zeros(1, np.uint16)
    smaller, ahead = _kinds(text)
    stars = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    larger = n - int(smaller.sum())
    runs = np.minimum(ahead + 1 - np.arange(n), max(1, limit)).astype(np.uint16)
    order = _star_order(text, stars, larger, memory)
    prefix = np.zeros(len(order), np.uint16)
    if limit:
        prefix[1:] = _common(text, order[:-1], order[1:], limit)
    up = _induce(text, larger + len(stars), Given(order, None, prefix), 1, limit, runs, memory)
    down = _induce(text, n, _larger(up), -1, limit, runs, memory)
    suffixes = np.append(n - 1, down.position[::-1])
    common = np.zeros(n, np.uint16)
    common[2:] = down.prefix[1:][::-1]  # the end shares nothing with what follows it
    return suffixes, common
