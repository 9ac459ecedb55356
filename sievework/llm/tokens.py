"""Operator 1: token counts by a linear longest-match automaton.

A word is a run of characters other than ASCII white space. It is read as one space followed by its
UTF-8 bytes, and split greedily from the left into the longest tokens of a byte-level vocabulary, as a
word-piece tokenizer does. The vocabulary is compiled once into a trie with failure links; each failure
link knows how many tokens are popped when it is taken, so a word's count needs one pass over its bytes
and no piece is ever built. Every single byte is a token, so every word has a count.

Defined results: a null or empty text has no words and no tokens; every input row gives one output row,
repeated rows and null identifiers too; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded, encoded, slices, split_words

#: Words of more bytes are read one by one; shorter ones in step with each other.
LONG = 96


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file: one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class Automaton:
    """Trie, failure links and popped counts over byte tokens, as flat arrays of a size fixed by the vocabulary."""

    def __init__(self, tokens: Iterable[bytes]):
        space = b"\t\n\v\f\r "
        kept = {t for t in tokens if t and not any(c in space for c in t[1:]) and (t[0] not in space or t[0] == 32)}
        kept |= {bytes([c]) for c in range(256)}
        edges: list[dict[int, int]] = [{}]
        final = [False]
        for t in sorted(kept):
            at = 0
            for c in t:
                if c not in edges[at]:
                    edges[at][c] = len(edges)
                    edges.append({})
                    final.append(False)
                at = edges[at][c]
            final[at] = True
        fail, pops = np.zeros(len(edges), np.int32), np.zeros(len(edges), np.int32)
        fail[0] = -1
        todo = deque([0])
        while todo:
            u = todo.popleft()
            for c, v in edges[u].items():
                todo.append(v)
                if final[v]:
                    fail[v], pops[v] = 0, 1
                    continue
                z, n = fail[u], pops[u]
                while z >= 0 and c not in edges[z]:
                    n += pops[z]
                    z = fail[z]
                fail[v], pops[v] = (edges[z][c] if z >= 0 else -1), n
        self.fail, self.pops = fail, pops
        self._hash([(u << 8 | c, v) for u, d in enumerate(edges) for c, v in d.items()])

    def _hash(self, pairs: list[tuple[int, int]]) -> None:
        """Open addressing: each key goes to the first free slot from its own on."""
        size = 1 << (2 * len(pairs)).bit_length()
        self.shift, self.mask = np.uint64(64 - size.bit_length() + 1), size - 1
        self.keys, self.next = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
        for (key, v), slot in zip(pairs, self._slot(np.array([k for k, _ in pairs], np.int64)).tolist(), strict=True):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & self.mask
            self.keys[slot], self.next[slot] = key, v

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def goto(self, states: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The child of each state by each byte, or -1."""
        keys = states.astype(np.int64) << 8 | chars
        slots = self._slot(keys)
        out = np.full(len(keys), -1, np.int32)
        todo = np.arange(len(keys))
        while len(todo):
            there = self.keys[slots[todo]]
            hit = there == keys[todo]
            out[todo[hit]] = self.next[slots[todo[hit]]]
            todo = todo[~hit & (there >= 0)]
            slots[todo] = (slots[todo] + 1) & self.mask
        return out

    def step(self, states: np.ndarray, chars: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Reads one byte in each state; adds the tokens that failure links pop."""
        states, todo = states.copy(), np.arange(len(states))
        while len(todo):
            child = self.goto(states[todo], chars[todo])
            went = child >= 0
            states[todo[went]] = child[went]
            todo = todo[~went]
            counts[todo] += self.pops[states[todo]]
            states[todo] = self.fail[states[todo]]
        return states

    def count(self, words: pa.Array) -> np.ndarray:
        """The number of tokens of each non-empty word."""
        words = words.cast(pa.binary())
        sizes = np.diff(np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4)) if len(words) else np.zeros(0, np.int32)
        starts = np.frombuffer(words.buffers()[1], np.int32, len(words), words.offset * 4).astype(np.int64) if len(words) else np.zeros(0, np.int64)
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        counts, states = np.zeros(len(words), np.int64), np.zeros(len(words), np.int32)
        first = self.goto(np.zeros(1, np.int32), np.array([32]))[0]
        states[:] = first
        order = np.argsort(-sizes, kind="stable")
        longs = int(np.searchsorted(-sizes[order], -LONG, side="left"))
        for w in order[:longs].tolist():
            states[w], counts[w] = self._alone(data[starts[w] : starts[w] + sizes[w]].tobytes(), int(first))
        order = order[longs:]
        for at in range(int(sizes[order[0]]) if len(order) else 0):
            order = order[: int(np.searchsorted(-sizes[order], -at, side="left"))]
            n = np.zeros(len(order), np.int64)
            states[order] = self.step(states[order], data[starts[order] + at], n)
            counts[order] += n
        todo = np.flatnonzero(states > 0)
        while len(todo):
            counts[todo] += self.pops[states[todo]]
            states[todo] = self.fail[states[todo]]
            todo = todo[states[todo] > 0]
        return counts

    def _alone(self, word: bytes, state: int) -> tuple[int, int]:
        if not hasattr(self, "_edges"):
            used = self.keys >= 0
            self._edges = dict(zip(self.keys[used].tolist(), self.next[used].tolist(), strict=True))
        edges, pops, fail, n = self._edges, self.pops, self.fail, 0
        for c in word:
            while (child := edges.get(state << 8 | c)) is None:
                n += int(pops[state])
                state = int(fail[state])
            state = child
        return state, n


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_words and n_tokens of every row of ``docs`` (doc_id, text).

    vocabulary: path, on the driver, of a rank file of a byte-level vocabulary. What it compiles to is
    broadcast; its size is fixed by the vocabulary (some MB) and doesn't depend on ``docs``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(read_ranks(vocabulary)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for rows in slices(batches):
            words, n = split_words(rows.column("text"))
            codes, names = encoded(words)
            ends = np.concatenate([[0], np.cumsum(machine.count(names)[codes])])
            stops = np.cumsum(n)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n), pa.array(ends[stops] - ends[stops - n])], ["doc_id", "n_words", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return bounded(docs).select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, n_words long, n_tokens long")
