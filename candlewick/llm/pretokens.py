"""Byte-level pre-tokens by a deterministic transducer whose chunk state maps compose by prefix scan.

The automaton reads the class of each code point and says where pre-tokens start. A
start can be known one code point late (white space, contractions), so a transition
emits "here" and "one before". Chunks are read in lockstep from every possible state,
the resulting state maps compose in a logarithmic scan, and a second reading from the
right states writes the starts.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import numpy as np

from candlewick.llm.common import text_hashes

SPACE, BLANK, LETTER, NUMBER, OTHER, QUOTE, SHORT, R, V, E, L = range(11)
SYMBOLS = 11
(START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, ONE_SPACE, ONE_BLANK, RUN_SPACE, RUN_BLANK, AFTER_QUOTE, QUOTE_R, QUOTE_V, QUOTE_L, SHORTENED) = range(13)
STATES = 13
HERE, BEFORE = 1, 2
CHUNK = 64
# Code points the byte-level pattern takes as white space.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_LETTERS = {LETTER, SHORT, R, V, E, L}


def _fresh(symbol: int) -> int:
    if symbol in _LETTERS:
        return IN_LETTERS
    return {NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, QUOTE: AFTER_QUOTE}[symbol]


def _step(state: int, symbol: int) -> tuple[int, int]:
    """(next state, starts) after reading ``symbol``."""
    late = BEFORE if state in (QUOTE_R, QUOTE_V, QUOTE_L) else 0
    if symbol in (SPACE, BLANK):
        if state in (ONE_SPACE, ONE_BLANK, RUN_SPACE, RUN_BLANK):
            return (RUN_SPACE if symbol == SPACE else RUN_BLANK), 0
        return (ONE_SPACE if symbol == SPACE else ONE_BLANK), HERE | late
    if state in (ONE_SPACE, RUN_SPACE):
        joined = _fresh(symbol) if symbol != QUOTE else IN_OTHERS
        return joined, BEFORE if state == RUN_SPACE else 0
    if state == RUN_BLANK:
        return _fresh(symbol), BEFORE | HERE
    if state == AFTER_QUOTE:
        if symbol in (OTHER, QUOTE):
            return IN_OTHERS, 0
        pending = {SHORT: SHORTENED, R: QUOTE_R, V: QUOTE_V, L: QUOTE_L}
        if symbol in pending:
            return pending[symbol], 0
    elif late:
        if symbol == (L if state == QUOTE_L else E):
            return SHORTENED, 0
        return _fresh(symbol), late if symbol in _LETTERS else late | HERE
    elif (state == IN_LETTERS and symbol in _LETTERS) or (state == IN_NUMBERS and symbol == NUMBER):
        return state, 0
    elif state == IN_OTHERS and symbol in (OTHER, QUOTE):
        return state, 0
    return _fresh(symbol), HERE


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Next state and starts by state * 2 * SYMBOLS + symbol; the upper symbols begin a text."""
    move, mark = np.zeros((STATES, 2 * SYMBOLS), np.uint8), np.zeros((STATES, 2 * SYMBOLS), np.uint8)
    for state in range(STATES):
        late = BEFORE if state in (QUOTE_R, QUOTE_V, QUOTE_L) else 0
        for symbol in range(SYMBOLS):
            move[state, symbol], mark[state, symbol] = _step(state, symbol)
            move[state, symbol + SYMBOLS], begun = _step(START, symbol)
            mark[state, symbol + SYMBOLS] = begun | late
    return move.ravel(), mark.ravel()


#: Code points below this have a table of their own; most texts need no more.
_COMMON = 0x3001


@functools.cache
def _classes(limit: int) -> np.ndarray:
    """The symbol of every code point below ``limit``."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(limit)), np.uint8, limit)
    table[WHITE] = BLANK
    table[32], table[39] = SPACE, QUOTE
    for letters, symbol in (("stmd", SHORT), ("r", R), ("v", V), ("e", E), ("l", L)):
        table[[ord(x) for x in letters]] = symbol
    return table


def _scan(maps: np.ndarray) -> np.ndarray:
    """Prefix compositions of the chunks' state maps: row i maps a state before chunk 0 to the one after chunk i."""
    step = 1
    while step < len(maps):
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].copy(), axis=1)
        step *= 2
    return maps


def starts(symbols: np.ndarray) -> np.ndarray:
    """Whether a pre-token starts at each code point; the first symbol begins a text."""
    n = len(symbols)
    if not n:
        return np.zeros(0, bool)
    move, mark = _tables()
    width = 2 * SYMBOLS
    rows = -(-n // CHUNK)
    grid = np.full(rows * CHUNK, OTHER, np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(rows, CHUNK).T)
    maps = np.repeat(np.arange(STATES, dtype=np.uint16)[:, None], rows, axis=1)
    for column in grid:
        maps = move[maps * width + column].astype(np.uint16)
    after = _scan(np.ascontiguousarray(maps.T))
    state = np.zeros(rows, np.uint16)
    state[1:] = after[:-1, START]
    marks = np.empty((CHUNK, rows), np.uint8)
    for i, column in enumerate(grid):
        at = state * width + column
        marks[i] = mark[at]
        state = move[at].astype(np.uint16)
    marks = marks.T.ravel()
    first = (marks[:n] & HERE) > 0
    first[:-1] |= (marks[1:n] & BEFORE) > 0
    if n == len(marks):
        first[-1] |= state[-1] in (QUOTE_R, QUOTE_V, QUOTE_L)
    else:  # what follows the last code point is padding: a pending contraction is none
        first[n - 1] |= bool(marks[n] & BEFORE) and _pending(symbols)
    return first


def _pending(symbols: np.ndarray) -> bool:
    """Whether the text ends in a quote and r, v or l that may have begun a contraction."""
    return len(symbols) > 1 and symbols[-1] % SYMBOLS in (R, V, L)


def pretokens(data: np.ndarray, offsets: np.ndarray, special: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(byte starts, byte ends, hashes) of the pre-tokens of all texts; a special string is one of its own."""
    raw = data.tobytes()
    points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    symbols = _classes(_COMMON if int(points.max(initial=0)) < _COMMON else 0x110000)[points]
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    begins = offsets[:-1][offsets[1:] > offsets[:-1]]
    cuts, at = [], raw.find(special) if special else -1
    while at >= 0:
        row = int(np.searchsorted(offsets, at, "right")) - 1
        if at + len(special) <= offsets[row + 1]:  # else it spans two texts
            cuts.append(at)
            at = raw.find(special, at + len(special))
        else:
            at = raw.find(special, at + 1)
    cut = np.array(cuts, np.int64)
    ends = cut + len(special)
    begin = np.zeros(len(data) + 1, bool)
    begin[begins] = begin[cut] = begin[ends] = True
    symbols = symbols + np.where(begin[heads], SYMBOLS, 0).astype(np.uint8)
    first = starts(symbols)
    if len(cut):
        inside = np.zeros(len(data) + 1, np.int32)
        inside[cut + 1] += 1
        inside[ends] -= 1
        first &= np.cumsum(inside)[heads] == 0
    begin_at = heads[first]
    end_at = np.append(begin_at[1:], len(data))
    return begin_at, end_at, text_hashes(data, begin_at, end_at)


@functools.cache
def vocabulary(path: str) -> tuple[dict[bytes, int], bytes, int]:
    """(bytes to id, the special string, its id) of a byte-level BPE file."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    added = {x["content"]: x["id"] for x in spec["added_tokens"]}
    if len(added) > 1:
        raise ValueError("one special token at most is supported")
    ids = {bytes(shown[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
    text, number = next(iter(added.items()), ("", -1))
    return ids, text.encode(), number


class Seen:
    """A bounded map from 64-bit hashes to numbers, sorted, kept by a Python worker between batches.

    What was looked up longest ago goes first, half of the map at a time.
    """

    def __init__(self, limit: int):
        self.limit, self.keys, self.values, self.used, self.clock = limit, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, whether known) of distinct keys."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        self.clock += 1
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[at] == keys
        self.used[at[known]] = self.clock
        return self.values[at], known

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """New keys in ascending order."""
        at = np.searchsorted(self.keys, keys)
        self.keys, self.values = np.insert(self.keys, at, keys), np.insert(self.values, at, values)
        self.used = np.insert(self.used, at, self.clock)

    @property
    def full(self) -> bool:
        return len(self.keys) > self.limit

    def halve(self) -> np.ndarray:
        """Forget the half that was looked up longest ago; gives the values of the rest."""
        kept = np.sort(np.argsort(-self.used, kind="stable")[: self.limit // 2])
        self.keys, self.values, self.used = self.keys[kept], self.values[kept], self.used[kept]
        return self.values
