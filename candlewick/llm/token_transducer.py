"""Token counts by compiled finite-state transducers.

Two deterministic transducers run over a text. The first splits it into pre-tokens
(``pretokens``: chunk state maps, composed by a prefix scan). The second reads the
bytes of a pre-token; its transitions carry the number of tokens by which the count
of the prefix changes. Its states are compiled from the vocabulary when first
reached: a state holds every open hypothesis (place in the token trie, token before
it, count so far). A byte-pair encoding is the only token sequence in which every
neighbouring pair encodes to itself, so exactly one hypothesis ends at each byte.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from candlewick.llm.common import extended, text_slices, trimmed
from candlewick.llm.pretokens import Seen, pretokens, vocabulary

#: States a worker keeps compiled, and pre-tokens whose count it remembers; beyond them it starts afresh.
MAX_STATES = 300_000
MAX_SEEN = 1_000_000
_SLOTS = 1 << 21


class ByteTransducer:
    """The second transducer, compiled state by state."""

    def __init__(self, path: str, max_states: int = MAX_STATES):
        import tiktoken

        ids, _, _ = vocabulary(path)
        self.max_states = max_states
        self.token = {i: t for t, i in ids.items()}
        self.pairs = tiktoken.Encoding("pairs", pat_str=r"[\s\S]+", mergeable_ranks=ids, special_tokens={})
        self.child: dict[tuple[int, int], int] = {}
        self.ends: dict[int, int] = {}
        self.inner: set[int] = {0}
        nodes = 1
        for token, number in ids.items():
            node = 0
            for byte in token:
                self.inner.add(node)
                if (node, byte) not in self.child:
                    self.child[node, byte] = nodes
                    nodes += 1
                node = self.child[node, byte]
            self.ends[node] = number
        self.clear()

    def clear(self) -> None:
        self.start = ((0, -1, 0),)
        self.states = [self.start]
        self.number = {self.start: 0}
        self.keys = np.full(_SLOTS, -1, np.int64)
        self.moves = np.zeros(_SLOTS, np.int32)
        self.gains = np.zeros(_SLOTS, np.int16)
        self.edges = 0

    @functools.lru_cache(maxsize=1 << 19)  # noqa: B019 - one object lives as long as its worker
    def joins(self, left: int, right: int) -> bool:
        """Whether two neighbouring tokens encode to themselves."""
        return left < 0 or self.pairs._encode_single_piece(self.token[left] + self.token[right]) == [left, right]

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """(next state, tokens gained) of one transition."""
        moved, ended = [], None
        for node, before, count in self.states[state]:
            node = self.child.get((node, byte))
            if node is None:
                continue
            if node in self.inner:
                moved.append((node, before, count))
            if ended is None and node in self.ends and self.joins(before, self.ends[node]):
                ended = (0, self.ends[node], count + 1)
        gain = ended[2]
        following = tuple((node, before, count - gain) for node, before, count in [*moved, ended])
        if following not in self.number:
            self.number[following] = len(self.states)
            self.states.append(following)
        return self.number[following], gain

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """The table slot of each key, or the free one where it belongs."""
        at = (keys * 0x9E3779B1 >> 7) & (_SLOTS - 1)
        todo = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & (_SLOTS - 1)
            todo = todo[(self.keys[at[todo]] != keys[todo]) & (self.keys[at[todo]] >= 0)]
        return at

    def step(self, states: np.ndarray, read: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and gains of many pairs (state, byte)."""
        keys = states.astype(np.int64) << 8 | read
        at = self._slots(keys)
        if (unknown := self.keys[at] < 0).any():
            for key in np.unique(keys[unknown]).tolist():
                slot = self._slots(np.array([key]))[0]
                self.keys[slot], (self.moves[slot], self.gains[slot]) = key, self.compile(key >> 8, key & 255)
                self.edges += 1
            at = self._slots(keys)
        return self.moves[at], self.gains[at]

    def counts(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of every span, all read in lockstep."""
        if len(self.states) > self.max_states or self.edges > _SLOTS // 2:
            self.clear()
        total = np.zeros(len(begins), np.int64)
        order = np.argsort(begins - ends, kind="stable")  # the longest first
        left = (ends - begins)[order]
        states, at = np.zeros(len(begins), np.int32), begins[order].copy()
        live, depth = len(order), 0
        while live := int(np.searchsorted(-left[:live], -depth, "left")):
            states[:live], gain = self.step(states[:live], data[at[:live]])
            total[order[:live]] += gain
            at[:live] += 1
            depth += 1
            if self.edges > _SLOTS * 3 // 4:  # all states are renumbered: start these spans again
                self.clear()
                return np.concatenate([self.counts(data, b, e) for b, e in zip(np.array_split(begins, 2), np.array_split(ends, 2))])
        return total


@functools.cache
def transducer(path: str) -> tuple[ByteTransducer, Seen]:
    return ByteTransducer(path), Seen(MAX_SEEN)


def slice_counts(data: np.ndarray, offsets: np.ndarray, path: str) -> np.ndarray:
    """Tokens of each text of a slice."""
    machine, seen = transducer(path)
    _, special, _ = vocabulary(path)
    begins, ends, hashes = pretokens(data, offsets, special)
    if not len(begins):
        return np.zeros(len(offsets) - 1, np.int64)
    distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    if seen.full:
        seen.halve()
    counts, known = seen.find(distinct)
    new = first[~known]
    if len(new):
        counts[~known] = machine.counts(data, begins[new], ends[new])
        if special:
            raw = data.tobytes()
            alone = [i for i in new[ends[new] - begins[new] == len(special)] if raw[begins[i] : ends[i]] == special]
            counts[inverse[alone]] = 1
        seen.add(distinct[~known], counts[~known])
    before = np.concatenate([[0], np.cumsum(counts[inverse])])
    return before[np.searchsorted(begins, offsets[1:])] - before[np.searchsorted(begins, offsets[:-1])]


def token_counts(docs: DataFrame, tokenizer: str, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_bytes and n_tokens of every row of ``docs``.

    A null text is empty and has no tokens; the file's special string counts as one
    token wherever it stands in a text. Rows are independent: repeated ids and extra
    columns do no harm, an empty table gives no rows. Kept columns named n_bytes or
    n_tokens are replaced.
    """
    keep = tuple(k for k in keep if k not in ("n_bytes", "n_tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            for start, stop, data, offsets in text_slices(column):
                kept = [batch.column(i).slice(start, stop - start) for i in range(batch.num_columns - 1)]
                sizes = [pa.array(np.diff(offsets)), pa.array(slice_counts(data, offsets, tokenizer))]
                yield pa.RecordBatch.from_arrays([*kept, *sizes], names=[*keep, "n_bytes", "n_tokens"])

    source = docs.select(*keep, docs[text].alias("__text"))
    return source.mapInArrow(trimmed(run), extended(StructType(source.schema.fields[:-1]), "n_bytes long, n_tokens long"))
