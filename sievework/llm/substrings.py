"""Operator 9: removal of repeated passages behind a count-min prefilter.

A window of 35 words stands for the smallest hash of its runs of eight words (its anchor): windows that are equal
have equal anchors. Every partition counts the anchors it selects in a sketch of its own; the merged
sketch never undercounts, so a window whose anchor it puts below two occurs once, for certain. The
second pass hashes only the other windows, on 128 bits, and groups them exactly. Within some hundred
thousand windows a task resolves repeats itself and sends one row for each repeated window, so a window
that is everywhere reaches its group at most once for each such run. The sketch has a largest size;
a larger corpus makes it pass more windows to the exact grouping, which then still decides.

Defined results: null and empty texts have no words; texts of fewer words than a window lose nothing;
windows of repeated rows repeat each other; rows with equal identifier and text get equal results; a null
identifier is an identifier of its own; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import GOLD, Bits, bounded, cut, encoded, mix, pair_hash, slices, split_words

WINDOW, ANCHOR = 35, 8
#: Rows of the sketch, its cells a row for each anchor that is to be expected, and its most cells a row.
DEPTH, CELLS_EACH, MOST_CELLS = 2, 8, 1 << 28
BLOCK = 1 << 18
#: Windows that a task groups by itself before it sends them.
FLUSH = 250_000
#: Text bytes of one step; hashing needs some hundred bytes for each word of it.
STEP_BYTES = 3 << 19
#: What names a row; 128 bits, as wrong words go if two rows share a name.
row_digest = xxhash.xxh3_128_digest


def word_hashes(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every word, and the number of words of each row."""
    words, counts = split_words(text)
    codes, names = encoded(words)
    if not len(names):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), counts
    both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x) for x in names.cast(pa.binary()).to_pylist()), np.uint64).reshape(-1, 2)
    return both[codes, 0], both[codes, 1], counts


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` words, doubled up from shorter runs."""
    done, power, have = None, words, 1
    rest, shift = size, 0
    while rest:
        if rest & 1:
            done = power[: len(words) - shift] if done is None else pair_hash(done[: max(0, len(words) - shift - have + 1)], power[shift:][: max(0, len(words) - shift - have + 1)])
            shift += have
        rest >>= 1
        if rest:
            power, have = pair_hash(power[: max(0, len(power) - have)], power[have:]), have * 2
    return done[: max(0, len(words) - size + 1)]


def sliding(x: np.ndarray, size: int, best) -> np.ndarray:  # noqa: ANN001
    """``best`` (np.minimum or np.maximum) over each run of ``size`` values."""
    if len(x) < size:
        return x[:0]
    have = 1
    while have * 2 <= size:
        x, have = best(x[: len(x) - have], x[have:]), have * 2
    return best(x[: len(x) - (size - have)], x[size - have :]) if size > have else x


class Anchored:
    """The windows of some rows: where they start, and their anchors."""

    def __init__(self, first: np.ndarray, counts: np.ndarray, window: int, anchor: int):
        self.window, self.reach = window, window - anchor + 1
        n = len(first)
        stops = np.cumsum(counts)
        row = np.repeat(np.arange(len(counts)), counts)
        inside = np.arange(n) + window <= stops[row] if n else np.zeros(0, bool)
        self.row = row
        self.starts = np.flatnonzero(inside)
        self.grams = run_hashes(first, anchor) if n >= anchor else np.zeros(0, np.uint64)
        low = sliding(self.grams, self.reach, np.minimum) if len(self.starts) else np.zeros(0, np.uint64)
        self.anchors = low[self.starts]
        self._low, self._inside = low, inside

    def selected(self) -> np.ndarray:
        """Each occurrence of an anchor that some window selects, once (and ties of equal runs, which may only overcount)."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        low = np.where(self._inside[: len(self._low)], self._low, np.uint64(0))
        pad = np.zeros(self.reach - 1, np.uint64)
        most = sliding(np.concatenate([pad, low, pad]), self.reach, np.maximum)
        return self.grams[most[: len(self.grams)] == self.grams]


def cells_of(hashes: np.ndarray, cells: int) -> list[np.ndarray]:
    return [(mix(hashes + np.uint64((k + 1) * int(GOLD) & (1 << 64) - 1)) & np.uint64(cells - 1)).astype(np.int64) for k in range(DEPTH)]


def _packed(cells: np.ndarray) -> bytes:
    return cells.astype("<u4").tobytes()


def sketch(docs: DataFrame, cells: int, window: int, anchor: int) -> list[np.ndarray]:
    """For each row of the merged sketch, a bitmap of the cells that count two or more.

    Partitions send the cells they met, once or more often, by block of cells; tasks merge blocks.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in range(DEPTH)]
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for k, parts in enumerate(held):
                found, times = np.unique(np.concatenate(parts), return_counts=True)
                of = found // BLOCK
                blocks, firsts = np.unique(of, return_index=True)
                once, twice = [], []
                for one, n in zip(np.split(found % BLOCK, firsts[1:]), np.split(times, firsts[1:]), strict=True):
                    once.append(_packed(one[n == 1]))
                    twice.append(_packed(one[n > 1]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(blocks), k, np.int32)), pa.array(blocks), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], ["layer", "block", "once", "twice"])
                parts.clear()

        for rows in slices(batches, most=STEP_BYTES):
            first, _, counts = word_hashes(rows.column("text"))
            taken = Anchored(first, counts, window, anchor).selected()
            if len(taken):
                for parts, found in zip(held, cells_of(taken, cells), strict=True):
                    parts.append(found)
                size += len(taken)
            if size > 1_000_000:
                yield from flush()
                size = 0
        if size:
            yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for layer, block, once, twice in zip(*(b.column(c).to_pylist() for c in ("layer", "block", "once", "twice")), strict=True):
                seen = state.setdefault((layer, block), np.zeros(BLOCK, np.uint8))
                one = np.frombuffer(once, "<u4")
                seen[one] = np.minimum(seen[one] + 1, 2)
                seen[np.frombuffer(twice, "<u4")] = 2
        for (layer, block), seen in state.items():
            if (seen > 1).any():
                yield pa.RecordBatch.from_arrays([pa.array([layer], pa.int32()), pa.array([block], pa.int64()), pa.array([np.packbits(seen > 1, bitorder="little").tobytes()], pa.binary())], ["layer", "block", "bits"])

    parts = docs.select("text").mapInArrow(count, "layer int, block long, once binary, twice binary")
    merged = parts.repartition("layer", "block").mapInArrow(merge, "layer int, block long, bits binary")
    out = [np.zeros(max(cells, BLOCK) // 8, np.uint8) for _ in range(DEPTH)]
    for row in merged.toLocalIterator():  # at most MOST_CELLS bits a row of the sketch
        at = row["block"] * BLOCK // 8
        out[row["layer"]][at : at + BLOCK // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def maybe_repeated(hashes: np.ndarray, bits: list[np.ndarray], cells: int) -> np.ndarray:
    found = np.ones(len(hashes), bool)
    for layer, at in zip(bits, cells_of(hashes, cells), strict=True):
        found &= (layer[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return found


def _row_keys(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """128 bits, in two halves, that stand for a row's identifier and whole text."""
    ids = (b"" if i is None else i.to_bytes(8, "little", signed=True) for i in rows.column("doc_id").to_pylist())
    texts = rows.column("text").cast(pa.binary()).to_pylist()
    made = b"".join(row_digest(i + b"|" + (t or b"")) for i, t in zip(ids, texts, strict=True))
    both = np.frombuffer(made, np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _spans(starts: np.ndarray, window: int) -> list[int]:
    """Start and end, in turn, of the runs of words that ascending window starts cover."""
    split = np.flatnonzero(np.diff(starts) > window)
    return np.stack([np.insert(starts[split + 1], 0, starts[0]), np.append(starts[split], starts[-1]) + window], 1).ravel().tolist()


CANDIDATE = "wa long, wb long, n int, ka long, kb long, start int, spans array<int>"


def candidate_windows(docs: DataFrame, bits: list[np.ndarray], cells: int, window: int, anchor: int) -> DataFrame:
    """Rows of three kinds: a window that its task met once (n 1, with its document and start); one that it
    met more often (n 2); and the spans of a document that the task has found repeated (n 2, under a key of its own).
    The first kind comes in the order of documents, which lets shuffle files compress."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        docs_of: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            a, b, start, doc = (np.concatenate([h[k] for h in held]) for k in range(4))
            ka, kb = (np.concatenate(k) for k in zip(*docs_of, strict=True))
            order = np.lexsort((b, a))
            new = np.concatenate([[True], (np.diff(a[order].view(np.int64)) != 0) | (np.diff(b[order].view(np.int64)) != 0)])
            group = np.cumsum(new) - 1
            several = np.bincount(group)[group] > 1
            single, many, one = np.sort(order[~several]), order[several], order[several & new]
            many = many[np.lexsort((start[many], doc[many]))]
            owners, firsts = np.unique(doc[many], return_index=True)
            spans = [_spans(x, window) for x in np.split(start[many], firsts[1:])] if len(many) else []
            own = doc[single]
            yield batch(a[single], b[single], 1, (ka[own], kb[own]), start[single], None)
            yield batch(a[one], b[one], 2, None, None, None)
            if len(owners):
                keys, part = (ka[owners], kb[owners]), owners.astype(np.uint64)  # a key of its own in the grouping
                yield batch(mix(keys[0].view(np.uint64)), mix(keys[1].view(np.uint64) + part), 2, keys, None, spans)
            held.clear()
            docs_of.clear()

        def batch(a, b, n, keys, start, spans):  # noqa: ANN001, ANN202
            none = lambda kind: pa.nulls(len(a), kind)
            columns = [
                pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(len(a), n, np.int32)),
                *([none(pa.int64())] * 2 if keys is None else map(pa.array, keys)),
                none(pa.int32()) if start is None else pa.array(start.astype(np.int32)),
                none(pa.list_(pa.int32())) if spans is None else pa.array(spans, pa.list_(pa.int32())),
            ]
            return pa.RecordBatch.from_arrays(columns, ["wa", "wb", "n", "ka", "kb", "start", "spans"])

        for rows in slices(batches, most=STEP_BYTES):
            first, second, counts = word_hashes(rows.column("text"))
            made = Anchored(first, counts, window, anchor)
            at = made.starts[maybe_repeated(made.anchors, shared.value, cells)]
            if len(at):
                before = np.cumsum(counts) - counts
                row = made.row[at]
                base = sum(len(d[0]) for d in docs_of)
                held.append((run_hashes(first, window)[at], run_hashes(second, window)[at], at - before[row], row + base))
                docs_of.append(_row_keys(rows))
                size += len(at)
            if size > FLUSH:
                yield from flush()
                size = 0
        if size:
            yield from flush()

    return docs.mapInArrow(find, CANDIDATE)


def repeated_spans(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """ka, kb (see ``_row_keys``), starts of repeated windows, and spans of words (starts and ends in turn) that others cover."""
    letters = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    expected = letters // 5 * 2 // (window - anchor + 2)  # anchors: two in each stretch of as many runs as a window has
    cells = min(MOST_CELLS, max(BLOCK, 1 << (CELLS_EACH * expected).bit_length()))
    found = candidate_windows(docs, sketch(docs, cells, window, anchor), cells, window, anchor)
    total = F.sum("n").over(Window.partitionBy("wa", "wb"))
    known = found.withColumn("total", total).where("total > 1 AND ka IS NOT NULL")
    lists = F.collect_list("start").alias("starts"), F.flatten(F.collect_list("spans")).alias("spans")
    return known.groupBy("ka", "kb").agg(*lists)


def without_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of ``docs`` (doc_id, text); with_text: and kept_text.

    window: words of a passage; anchor: words of the runs among which its anchor is chosen.
    """
    docs = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spans = cut(repeated_spans(docs, window, anchor))
    filter_ = Bits.of(spans, "ka", spans.count(), plain=True)
    shared = docs.sparkSession.sparkContext.broadcast(filter_)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds ka and kb; results of documents without spans are worked out at once, and the text goes no further."""
        for rows in slices(batches):
            ka, kb = _row_keys(rows)
            wait = shared.value.has_plain(ka).tolist()
            texts = rows.column("text").to_pylist()
            done = [None if w else t or "" for t, w in zip(texts, wait, strict=True)]
            later = pa.array([t if w else None for t, w in zip(texts, wait, strict=True)], pa.string())
            more = [pa.array(ka), pa.array(kb), later]
            yield _kept(rows.column("doc_id"), done, None, with_text, more, ["ka", "kb", "text"])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            yield _kept(rows.column("doc_id"), [t or "" for t in rows.column("text").to_pylist()], (rows.column("starts"), rows.column("spans")), with_text, [], [], window)

    result = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    first = docs.mapInArrow(known, result + ", ka long, kb long, text string")
    done = first.where("n_words IS NOT NULL").drop("ka", "kb", "text")
    waiting = first.where("n_words IS NULL").select("doc_id", "ka", "kb", "text").join(spans, ["ka", "kb"], "left")
    return done.unionByName(waiting.select("doc_id", "text", "starts", "spans").mapInArrow(remove, result))


def _kept(ids: pa.Array, texts: list[str | None], found: tuple[pa.Array, pa.Array] | None, with_text: bool, more: list[pa.Array], names: list[str], window: int = WINDOW) -> pa.RecordBatch:
    n_words, n_removed, digests, kept = [], [], [], []
    none = [None] * len(texts)
    starts, spans = (x.to_pylist() for x in found) if found is not None else (none, none)
    for text, start, span in zip(texts, starts, spans, strict=True):
        if text is None:
            for x in (n_words, n_removed, digests, kept):
                x.append(None)
            continue
        words = text.encode().split()
        n = len(words)
        if start or span:
            gone = np.zeros(n + 1, np.int32)
            own, ends = np.array(start, np.int64), np.array(span, np.int64).reshape(-1, 2)
            for at, by in ((own, 1), (own + window, -1), (ends[:, 0], 1), (ends[:, 1], -1)):
                np.add.at(gone, at, by)
            words = [w for w, g in zip(words, np.cumsum(gone)[:n].tolist(), strict=True) if not g]
        joined = b" ".join(words)
        n_words.append(n)
        n_removed.append(n - len(words))
        digests.append(hashlib.sha256(joined).hexdigest())
        kept.append(joined.decode() if with_text else None)
    columns = [ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), *([pa.array(kept, pa.string())] if with_text else []), *more]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else []), *names])
