"""Operator 3: packing into windows by minimum bin slack.

Each document's token ids are cut into full windows and one rest. How often each rest length occurs, at
most 4,095 numbers, is all that the plan needs: time and again the longest remaining length is joined
by the multiset of remaining lengths that fills the window closest to its capacity (a subset sum over
bits, with the counts traced back), and that pattern is used as often as the counts allow. So the plan
is of bounded size for any corpus. Rows learn their place from their rank among the rests of their
length: a rank within a partition plus the counts of the partitions before, with no group gathered.

Defined results: a null or empty text is one piece, the end token alone; repeated rows and null
identifiers are packed like others; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import threading
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, cut, encoded, release, slices

CAPACITY, END_ID = 4096, 2
#: Distinct stems whose ids a worker keeps.
KEPT_WORDS = 1_000_000
#: Stems that the tokenizer is given at once; what it returns of each is some kilobytes.
LOT = 2_000
#: Text bytes that are read in one step.
STEP_BYTES = 4 << 20
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, part int, rank long"


class Store:
    """Numbers by 128-bit keys: open addressing in flat arrays, read and filled many keys at a time."""

    def __init__(self, room: int):
        size = 1 << max(10, (room - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - size.bit_length() + 1), size - 1
        self.a, self.b, self.value = np.zeros(size, np.uint64), np.zeros(size, np.uint64), np.full(size, -1, np.int32)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        out, slot, todo = np.full(len(a), -1, np.int64), (a >> self.shift).astype(np.int64), np.arange(len(a))
        while len(todo):
            at = slot[todo]
            there = self.value[at]
            hit = (there >= 0) & (self.a[at] == a[todo]) & (self.b[at] == b[todo])
            out[todo[hit]] = there[hit]
            todo = todo[~hit & (there >= 0)]
            slot[todo] = (slot[todo] + 1) & self.mask
        return out

    def add(self, a: np.ndarray, b: np.ndarray, values: np.ndarray) -> None:
        """Adds keys that it doesn't have, each once."""
        slot, todo = (a >> self.shift).astype(np.int64), np.arange(len(a))
        while len(todo):
            free = todo[self.value[slot[todo]] < 0]
            at, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.a[at], self.b[at], self.value[at] = a[won], b[won], values[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            full = self.value[slot[todo]] >= 0
            slot[todo[full]] = (slot[todo[full]] + 1) & self.mask


class Ids:
    """Token ids of texts, by the ids of their white-space-parted chunks, which are independent of each other.

    The tokenizer lower-cases, turns white space into word limits and parts letters and digits from signs
    before anything else. So a text's ids are those of its chunks, joined, and a chunk's ids are those of
    its stem and of the full stops and commas after it. Stems' ids are kept. Texts that may hold a
    special token's string go to the tokenizer whole.
    """

    def __init__(self, definition: str, kept: int = KEPT_WORDS):
        # a task has one core: threads of its own would only take those of others, and memory each
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.kept = kept
        self.special = sorted({t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()})
        self._clear()

    def _clear(self) -> None:
        self.store = Store(2 * self.kept)
        self.flat, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _slots(self, names: pa.Array) -> np.ndarray:
        """Places of the names' ids."""
        if len(self.sizes) + len(names) > self.kept:
            self._clear()
        names = names.to_pylist()
        a, b = np.frombuffer(b"".join([xxhash.xxh3_128_digest(w) for w in names]), np.uint64).reshape(-1, 2).T
        if len(names) > self.kept:  # a step with more stems than are kept
            self.store = Store(2 * len(names))
        slots = self.store.find(a, b)
        new = np.flatnonzero(slots < 0)
        if len(new):
            flat, sizes = [], []
            for at in range(0, len(new), LOT):
                ids = [e.ids for e in self.tokenizer.encode_batch_fast([names[k] for k in new[at : at + LOT].tolist()], add_special_tokens=False)]
                sizes.append(np.fromiter(map(len, ids), np.int32, len(ids)))
                flat.append(np.fromiter((x for y in ids for x in y), np.uint32, int(sizes[-1].sum())))
            slots[new] = np.arange(len(self.sizes), len(self.sizes) + len(new))
            self.store.add(a[new], b[new], slots[new])
            size = np.concatenate(sizes)
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(size, dtype=np.int64) - size])
            self.sizes, self.flat = np.concatenate([self.sizes, size]), np.concatenate([self.flat, *flat])
        return slots

    def _chunks(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Places of the ids of each chunk's two parts; the second is that of the empty string for most."""
        stems = pc.utf8_rtrim(names, ".,")
        # a capital I with a dot ends in a mark when it is lowered, and marks go with signs
        stems = pc.if_else(pc.match_substring_regex(stems, r"([^\x{130}\PL]|\pN)$"), stems, names)
        n = pc.utf8_length(stems).to_numpy(zero_copy_only=False)
        ended = np.flatnonzero(pc.utf8_length(names).to_numpy(zero_copy_only=False) > n)
        kinds = {"": 0}
        ends = np.zeros(len(names), np.int64)
        ends[ended] = [kinds.setdefault(x[k:], len(kinds)) for x, k in zip(names.take(pa.array(ended)).to_pylist(), n[ended].tolist(), strict=True)]
        codes, parts = encoded(pa.concat_arrays([pa.array(list(kinds), stems.type), stems]))
        slots = self._slots(parts)[codes]
        return slots[len(kinds) :], slots[ends]

    def of(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, document after document, and the number of ids of each."""
        text = pc.fill_null(text, "")
        low = pc.ascii_lower(text)
        lists = pc.ascii_split_whitespace(text)
        words = lists.flatten()
        n_words = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        codes, names = encoded(words)
        if not len(names):
            return np.zeros(0, np.uint32), np.zeros(len(text), np.int64)
        # the tokenizer composes marks before it lower-cases: only where there are none may letters be lowered first
        stems, ends = self._chunks(pc.if_else(pc.string_is_ascii(names), pc.ascii_lower(names), names))
        slots = np.stack([stems[codes], ends[codes]], 1).ravel()
        sizes = self.sizes[slots]
        upto = np.cumsum(sizes, dtype=np.int64)
        places = np.repeat((self.starts[slots] - upto + sizes).astype(np.int32), sizes)  # some million ids at most
        del slots, sizes
        places += np.arange(len(places), dtype=np.int32)
        ids = self.flat[places]
        del places
        stops = np.concatenate([[0], upto])[2 * np.cumsum(n_words)]
        counts = np.diff(stops, prepend=0)
        whole = np.zeros(len(text), bool)
        for s in self.special:
            whole |= pc.match_substring(low, s).to_numpy(zero_copy_only=False)
        if whole.any():
            parts = np.split(ids, stops[:-1])
            for k in np.flatnonzero(whole).tolist():
                parts[k] = np.array(self.tokenizer.encode(text[k].as_py(), add_special_tokens=False).ids, np.uint32)
            ids, counts = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        return ids, counts


#: What a worker process keeps from one task to the next, and what drops it.
_MAKERS: dict[str, Ids] = {}
_TIMERS: list[threading.Timer] = []
IDLE_S = 8


def maker_of(definition: str, kept: int = KEPT_WORDS) -> Ids:
    """The worker's store of ids; a worker that gets no further task soon gives its memory back (see ``rest``)."""
    while _TIMERS:
        _TIMERS.pop().cancel()
    key = f"{hashlib.sha256(definition.encode()).hexdigest()} {kept}"
    if key not in _MAKERS:
        _MAKERS.clear()
        _MAKERS[key] = Ids(definition, kept)
    return _MAKERS[key]


def drop() -> None:
    """Forgets the store, and gives its memory back to the system."""
    _MAKERS.clear()
    release()


def rest() -> None:
    """Called as a task ends: the store is dropped unless another task asks for it in time."""
    timer = threading.Timer(IDLE_S, drop)
    timer.daemon = True
    _TIMERS.append(timer)
    timer.start()


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times, [(length, count), ...]) of each pattern; together they use up ``counts`` exactly.

    Each pattern begins with the longest length left. Bits of an integer are the sums that the lengths
    tried so far can reach; one integer is kept a length, from which the counts are traced back. Trying
    ends as soon as the window can be full. A pattern uses up at least one length, so there are no more
    patterns than lengths.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    lengths, patterns = sorted(left, reverse=True), []
    while lengths:
        room = capacity - lengths[0]
        whole, reach = (1 << (room + 1)) - 1, 1
        steps: list[tuple[int, int]] = []
        for k, n in enumerate(lengths):
            if n > room:
                continue
            before, most = reach, min(left[n] - (k == 0), room // n)
            steps.append((n, before))
            size = 1
            while most > 0:
                take = min(size, most)
                reach |= (reach << (n * take)) & whole
                most, size = most - take, size * 2
            if reach >> room & 1:
                break
        total, chosen = reach.bit_length() - 1, {lengths[0]: 1}
        for n, before in reversed(steps):
            while not before >> total & 1:
                chosen[n], total = chosen.get(n, 0) + 1, total - n
        times = min(left[n] // c for n, c in chosen.items())
        patterns.append((times, sorted(chosen.items(), reverse=True)))
        for n, c in chosen.items():
            left[n] -= times * c
        lengths = [n for n in lengths if left[n]]
    return patterns


class Places:
    """Where the piece of a rank among those of its length lies; as large as the plan."""

    def __init__(self, patterns: list[tuple[int, list[tuple[int, int]]]]):
        used: dict[int, int] = {}
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        sequence = 0
        for times, chosen in patterns:
            at = 0
            for n, c in chosen:
                rows.setdefault(n, []).append((used.get(n, 0), c, sequence, at))
                used[n] = used.get(n, 0) + times * c
                at += n * c
            sequence += times
        self.rows = {n: np.array(x, np.int64) for n, x in rows.items()}

    def of(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequences, offsets = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
        order = np.argsort(lengths, kind="stable")
        kinds, firsts = np.unique(lengths[order], return_index=True)
        for n, own in zip(kinds.tolist(), np.split(order, firsts[1:]), strict=True):
            table = self.rows[n]
            first, each, sequence, at = table[np.searchsorted(table[:, 0], ranks[own], side="right") - 1].T
            k = ranks[own] - first
            sequences[own], offsets[own] = sequence + k // each, at + k % each * n
        return sequences, offsets


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, kept: int = KEPT_WORDS, step: int = STEP_BYTES) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece, and its rank among those of its length in its partition."""
    shared = docs.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text("utf-8"))

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()  # what an earlier stage left in this worker
        maker, seen, part = maker_of(shared.value, kept), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for rows in slices(batches, most=step):
            ids, counts = maker.of(rows.column("text"))
            ends = np.cumsum(counts)
            full = np.insert(ids, ends, np.uint32(end_id)).astype("<u4")
            counts = counts + 1
            ends = np.cumsum(counts)
            n = -(-counts // capacity)
            of = np.repeat(np.arange(len(counts)), n)
            start = (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)) * capacity
            length = np.minimum(capacity, counts[of] - start)
            at, data = (ends - counts)[of] + start, memoryview(full.tobytes())
            crc = [zlib.crc32(data[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), length.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            kinds, firsts, each = np.unique(length[order], return_index=True, return_counts=True)
            rank = np.empty(len(length), np.int64)
            rank[order] = np.arange(len(order)) - np.repeat(firsts - seen[kinds], each)
            seen[kinds] += each
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id").take(pa.array(of)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(counts[of]), pa.array(np.full(len(of), part, np.int32)), pa.array(rank)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "rank"],
            )
        rest()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return bounded(docs).select("doc_id", "text").mapInArrow(cut_up, f"doc_id {kind}, {PIECES}")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, kept: int = KEPT_WORDS, step: int = STEP_BYTES) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of ``docs`` (doc_id, text).

    tokenizer: path, on the driver, of the tokenizer's definition, which is broadcast (its size is fixed).
    kept, step: distinct stems whose ids a worker keeps, and text bytes of one step; memory against time.
    The pieces are written once, without their ids; the plan is made on the driver from at most
    ``capacity`` counts, and is broadcast.
    """
    made = cut(pieces(docs, tokenizer, capacity, end_id, kept, step))
    by_part = made.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_part = by_part.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    counts = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    shared = docs.sparkSession.sparkContext.broadcast(Places(plan(counts, capacity)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sequence, offset = shared.value.of(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), pa.array(sequence), pa.array(offset)], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    ranked = made.join(by_part, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("base"))
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(place, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
