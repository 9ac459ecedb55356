"""Windows of tokens over whole corpora: what may repeat is found by anchors, the rest by exact groups.

A window's anchor is the smallest hash of the shorter runs inside it, so equal windows have equal anchors and
neighbours mostly share one. Anchors are counted first, four bytes each; a filter of fixed size then lets
pass the windows whose anchor occurs more than once, and only those are shuffled, a run that shares its
anchor in one row. Groups are exact: by SHA-256, or by the window's hash and its anchor.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import md5, sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import bounded, cut, sweep

#: Runs of letters, digits and underscores, and single signs; line ends are found too, to count lines.
TOKEN = re.compile(r"\w+|[^\w\t\f\r ]")
#: Text bytes that one step works on, anchors that are gathered before they are dealt out, and windows grouped at once.
SLICE_BYTES, LOT, GROUPED = 2 << 20, 1 << 20, 1 << 20
#: The filter: parts by the first bits of an anchor's hash, and bits of a part, as powers of two.
PARTS, PART_BITS = 10, 19
BASE = 0x9E3779B97F4A7C15
#: Tokens of a block, and blocks that are compared beyond a run's ends: in the first two rounds, and in further ones by turns.
REACH = [(1, 8), (1, 64), (64, 512), (1, 64)]
#: Bits of the filter of paths, as a power of two, and bits that a path gets if there is room.
PATH_BITS, EACH_PATH = 26, 12
#: So many runs are broadcast to the files rather than joined with them.
FEW = 20_000
#: Beyond that, so many hashes of paths at most are.
SPOTS = 1 << 18
#: Files with equal texts: so many paths are broadcast, and a row holds about so many copies.
COPIES, KIN = 1 << 19, 256
RUNS = "path_a string, path_b string, shift int, lo int, hi int, open int, a0 int, a1 int, b0 int, b1 int"
RUN = [c.split()[0] for c in RUNS.split(", ")]
PAIR, ANSWER = RUN[:3], ["left", "left_lines", "right", "right_lines"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rolled(t: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` numbers."""
    if len(t) < size:
        return np.zeros(0, np.uint64)
    one, length, out, done = t, 1, None, 0
    while True:
        times = np.uint64(pow(BASE, length, 1 << 64))
        if size & length:
            out = one if out is None else out[: len(one) - done] * times + one[done:]
            done += length
        if 2 * length > size:
            return _mix(out)
        one, length = one[:-length] * times + one[length:], 2 * length


def _sliding(x: np.ndarray, size: int, better: np.ufunc) -> np.ndarray:
    """The least or largest of every ``size`` neighbours."""
    length = 1
    while 2 * length <= size:
        x, length = better(x[:-length], x[length:]), 2 * length
    rest = size - length
    return better(x[: len(x) - rest], x[rest:]) if rest else x


class Tokens:
    """Tokens of some files, one after the other: their hashes and lines, where each file begins, and the windows inside files."""

    def __init__(self, rows: pa.RecordBatch, size: int, values: bool = False):
        held = [TOKEN.findall(t or "") for t in rows.column("text").to_pylist()]
        if "tokens" in rows.schema.names:
            for k, tokens in enumerate(rows.column("tokens").to_pylist()):
                if tokens is not None:
                    held[k] = tokens
        given = [k for k, x in enumerate(held) if x and isinstance(x[0], dict)]
        lines = {k: [t["line"] for t in held[k]] for k in given}
        for k in given:
            held[k] = [t["value"] for t in held[k]]
        flat = [v for x in held for v in x]
        coded = pa.array(flat, pa.string()).dictionary_encode()
        codes, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
        counts = np.fromiter(map(len, held), np.int64, len(held))
        of = np.repeat(np.arange(len(held)), counts)
        ends = codes == names.index("\n") if "\n" in names else np.zeros(len(codes), bool)
        if given:
            ends &= ~np.isin(of, given)
        upto = np.concatenate([[0], np.cumsum(ends)])
        begin = np.cumsum(counts) - counts
        self.line = (upto[:-1] - upto[begin][of])[~ends].astype(np.int32)
        own = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in names), np.uint64, len(names))
        codes, of = codes[~ends], of[~ends]
        self.hash, self.of, self.size = own[codes], of, size
        self.counts = np.bincount(of, minlength=len(held)).astype(np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        for k, x in lines.items():
            self.line[self.starts[k] : self.starts[k] + self.counts[k]] = x
        if values:
            self.text = "\x1f".join([v for v, end in zip(flat, ends.tolist(), strict=True) if not end]).encode()
            self.at = np.concatenate([[0], np.cumsum((pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False)[codes] if len(codes) else codes) + 1, dtype=np.int64)])
        n = max(0, len(of) - size + 1)
        self.inside = of[:n] == of[len(of) - n :]

    def windows(self) -> np.ndarray:
        return _rolled(self.hash, self.size)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """The anchor of every window, and the hashes of all runs that are some window's anchor, one for each place."""
        n = len(self.inside)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        k = (self.size + 1) // 2
        runs = _rolled(self.hash, k) | np.uint64(1)  # never 0
        span = self.size - k + 1
        least = _sliding(runs, span, np.minimum)
        edge = np.zeros(span - 1, np.uint64)
        most = _sliding(np.concatenate([edge, np.where(self.inside, least, np.uint64(0)), edge]), span, np.maximum)
        return _mix(least), _mix(runs[most == runs])

    def digests(self, where: np.ndarray) -> list[bytes]:
        """SHA-256 of the windows that begin at ``where``; their tokens are joined by U+001F."""
        text = self.text
        return [sha256(text[a:b]).digest() for a, b in zip(self.at[where].tolist(), (self.at[where + self.size] - 1).tolist(), strict=True)]


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about SLICE_BYTES of text; one longer text is a run of its own."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, side="right")))
            yield batch.slice(at, to - at)
            at = to


def whole(files: DataFrame) -> DataFrame:
    """Files (path, text, or tokens) with one row a path; tokens of rows that share a path are put in order of their lines."""
    from .duplication import word_tokens

    if "tokens" in files.columns:
        return bounded(files.select("path", F.lit("").alias("text"), "tokens"))
    files = bounded(files.select("path", "text"))
    many = files.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("path").alias("many"))
    if many.isEmpty():
        return files
    many = cut(many)
    alone = files.join(many, F.col("path").eqNullSafe(F.col("many")), "left_anti")
    joined = word_tokens(files.join(many, F.col("path").eqNullSafe(F.col("many")), "left_semi")).select("path", F.lit("").alias("text"), "tokens")
    return alone.unionByName(joined, allowMissingColumns=True)


def least_windows(files: DataFrame, size: int) -> DataFrame:
    """path, windows and least_hash (SHA-256) of every file with a window; one narrow pass."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            t, out = Tokens(batch, size, values=True), ([], [], [])
            for path, start, count in zip(batch.column("path").to_pylist(), t.starts.tolist(), t.counts.tolist(), strict=True):
                if count >= size:
                    for column, x in zip(out, (path, count - size + 1, min(t.digests(np.arange(start, start + count - size + 1))).hex()), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["path", "windows", "least_hash"])

    return whole(files).mapInArrow(rows, "path string, windows long, least_hash string")


class Paths:
    """Bits of the paths of some files; of fixed size at most, so others may pass too."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def has(self, keys: np.ndarray) -> np.ndarray:
        """keys: xxhash64 of the paths."""
        keys, last = keys.view(np.uint64), np.uint64(32 * len(self.words) - 1)
        spots = [keys & last, (keys >> np.uint64(32)) & last]
        return np.logical_and(*((self.words[x >> np.uint64(5)] >> (x & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1 for x in spots))

    @classmethod
    def of(cls, paths: DataFrame, count: int) -> Paths:
        bits = 1 << min(PATH_BITS, max(13, (EACH_PATH * count).bit_length()))
        key = F.xxhash64("path")
        rows = paths.select(F.explode(F.array(*(F.pmod(x, F.lit(bits)) for x in (key, F.shiftrightunsigned(key, 32))))).alias("p"))
        found = rows.groupBy(F.floor(F.col("p") / 32).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 32 AS int))")).alias("m")).toArrow()
        words = np.zeros(bits // 32, np.uint32)
        words[found["w"].to_numpy()] = found["m"].to_numpy().astype(np.uint32)
        return cls(words)


def texts(files: DataFrame, size: int) -> DataFrame:
    """path, same (SHA-256 of the text; of the path, if the file holds tokens), covered (lines from its first window to its last) and lines (up to its last token)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            t = Tokens(batch, 1)
            full, covered, lines = np.flatnonzero(t.counts), *np.zeros((2, batch.num_rows), np.int64)
            lines[full] = t.line[t.starts[full] + t.counts[full] - 1].astype(np.int64) + 1
            full = full[t.counts[full] >= size]
            covered[full] = lines[full] - t.line[t.starts[full]]
            if size == 1:  # no window reaches over empty lines
                covered = np.bincount(t.of[np.append(True, (np.diff(t.line) != 0) | (np.diff(t.of) != 0))[: len(t.of)]], minlength=batch.num_rows)
            same = [sha256(b"t" + (x or "").encode()).digest() for x in batch.column("text").to_pylist()]
            if "tokens" in batch.schema.names:
                for k in np.flatnonzero(batch.column("tokens").is_valid().to_numpy(zero_copy_only=False)).tolist():
                    path = batch.column("path")[k].as_py()
                    same[k] = sha256(b"n" if path is None else b"p" + path.encode()).digest()
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(same, pa.binary()), pa.array(covered), pa.array(lines)], ["path", "same", "covered", "lines"])

    return files.mapInArrow(rows, "path string, same binary, covered long, lines long")


def _parted(files: DataFrame, named: DataFrame, count: int) -> tuple[DataFrame, DataFrame]:
    """The files whose path is in ``named``, and few others (all once there are far too many); and the rest."""
    shared = files.sparkSession.sparkContext.broadcast(Paths.of(named, count))
    names = files.columns

    def part(of: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(shared.value.has(batch.column("key").to_numpy()) == of)).select(names)

        return rows

    keyed = files.withColumn("key", F.xxhash64("path"))
    return keyed.mapInArrow(part(True), files.schema), keyed.mapInArrow(part(False), files.schema)


def first_of_each(files: DataFrame, named: DataFrame, count: int) -> DataFrame:
    """The files whose path is in ``named``, and few others; lets all pass once there are far too many."""
    return _parted(files, named, count)[0]


def _kin(files: DataFrame, size: int) -> DataFrame:
    """One file of each group of equal texts, with same (16 bytes of the text's SHA-256) and kin (all paths of the group); both are null if the text is there once.

    A large group is split by its paths' hashes, so that a row stays small: it has one such file for each KIN paths.
    """
    texts = files.where("tokens IS NULL") if "tokens" in files.columns else files
    texts = cut(texts.where(F.length("text") >= size).select("path", F.unhex(F.substring(F.sha2("text", 256), 1, 32)).alias("same")))
    many = texts.groupBy("same").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    salt = F.pmod(F.xxhash64("path"), F.ceil(F.col("n") / KIN)).alias("salt")
    kin = cut(texts.join(many, "same").groupBy("same", salt).agg(F.array_sort(F.collect_list("path")).alias("kin")))
    count = kin.agg(F.coalesce(F.sum(F.size("kin")), F.lit(0))).first()[0]
    sweep(files.sparkSession)
    if not count:
        return files
    first = F.col("path") == F.col("kin")[0]
    members = kin.select("same", "kin", F.explode("kin").alias("path")).select("path", first.alias("first"), *(F.when(first, F.col(c)).alias(c) for c in ("same", "kin")))
    if count <= COPIES:
        held = files.join(F.broadcast(members), "path", "left")
    else:  # the texts that are there once are not shuffled, but for a few
        held, alone = _parted(files, members, count)
        held = held.join(members, "path", "left").unionByName(alone, allowMissingColumns=True)
    return held.where("first IS NULL OR first").drop("first")


_HELD: dict[str, np.ndarray] = {}


class Filter:
    """Bits of the anchors that occur more than once; its size is fixed, and what passes wrongly is settled exactly."""

    def __init__(self, parts: dict[int, bytes]):
        self.name, self.parts = uuid.uuid4().hex, parts

    def passes(self, anchors: np.ndarray) -> np.ndarray:
        if self.name not in _HELD:
            _HELD.clear()
            bits = np.zeros((1 << PARTS, 1 << (PART_BITS - 3)), np.uint8)
            for k, x in self.parts.items():
                bits[k] = np.frombuffer(zlib.decompress(x), np.uint8)
            _HELD[self.name] = bits.ravel()
        spots = anchors >> np.uint64(64 - PARTS - PART_BITS)
        return (_HELD[self.name][spots >> np.uint64(3)] >> (spots & np.uint64(7)).astype(np.uint8)) & 1 == 1

    @classmethod
    def of(cls, files: DataFrame, size: int) -> Filter:
        """Deals the anchors' hashes to the parts, 32 bits each beyond the part's, and sets the bits of those seen twice."""

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[np.ndarray] = []
            for batch in slices(batches):
                held.append(Tokens(batch, size).anchors()[1] >> np.uint64(32 - PARTS))
                if sum(map(len, held)) > LOT:
                    yield dealt(np.concatenate(held))
                    held = []
            if held:
                yield dealt(np.concatenate(held))

        def dealt(found: np.ndarray) -> pa.RecordBatch:
            """Each hash once, or twice if it is there more often."""
            names, counts = np.unique(found, return_counts=True)
            names = np.repeat(names, np.minimum(counts, 2))
            part = (names >> np.uint64(32)).astype(np.int32)
            kinds, firsts = np.unique(part, return_index=True)
            data = [x.astype("<u4").tobytes() for x in np.split(names & np.uint64(0xFFFFFFFF), firsts[1:])] if len(kinds) else []
            return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(data, pa.binary())], ["part", "data"])

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list[bytes]] = {}
            for batch in batches:
                for part, data in zip(batch.column("part").to_pylist(), batch.column("data").to_pylist(), strict=True):
                    held.setdefault(part, []).append(data)
            for part in list(held):
                x = np.sort(np.frombuffer(b"".join(held.pop(part)), "<u4"))
                spots = x[1:][x[1:] == x[:-1]] >> np.uint32(32 - PART_BITS)
                if len(spots):
                    bits = np.zeros(1 << PART_BITS, np.uint8)
                    bits[spots] = 1
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)], pa.binary())], ["part", "data"])

        kind = "part int, data binary"
        found = files.mapInArrow(deal, kind).repartition("part").mapInArrow(count, kind).collect()
        return cls({r["part"]: bytes(r["data"]) for r in found})


def window_groups(files: DataFrame, size: int) -> DataFrame:
    """hash (SHA-256), occurrences and files of windows that occur more than once."""
    files = whole(files)
    shared = files.sparkSession.sparkContext.broadcast(Filter.of(files, size))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            t = Tokens(batch, size, values=True)
            where = np.flatnonzero(t.inside)
            where = where[shared.value.passes(t.anchors()[0][where])]
            digests, n, held = t.digests(where), Counter(), Counter()
            of = t.of[where]
            firsts = np.flatnonzero(np.diff(of, prepend=-1)).tolist()
            for a, b in zip(firsts, [*firsts[1:], len(of)], strict=False):  # none if nothing passes
                n.update(digests[a:b])
                held.update(set(digests[a:b]))
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64()), pa.array([held[x] for x in n], pa.int64())], ["hash", "n", "files"])

    found = files.mapInArrow(rows, "hash binary, n long, files long").groupBy("hash").agg(F.sum("n").alias("occurrences"), F.sum("files").alias("files"))
    return found.where("occurrences > 1").select(F.lower(F.hex("hash")).alias("hash"), "occurrences", "files")


def _spread(firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of every row."""
    return np.repeat(firsts - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))


def _binary(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts * data.itemsize)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _grouped(files: DataFrame, size: int, fold: Callable[[pa.Table, np.ndarray, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """``fold`` of rows that may hold repeated windows, all rows of an anchor at once.

    A row is a run of windows of one file that share an anchor: anchor, path, pos, hashes, each window's first and last
    line, and 15 bits of the tokens before and after (-1: none). fold gets rows in order of anchors, their windows' numbers and hashes.
    If files have ``kin``, a row also has same, kin and whole (its file's last window, first and last line). A file with kin gives
    one window at least, since each of its windows is there in every copy.
    """
    shared = files.sparkSession.sparkContext.broadcast(Filter.of(files, size))
    names, related = ["anchor", "path", "pos", "hashes", "begins", "ends", "before", "after"], "kin" in files.columns
    names += ["same", "kin", "whole"] if related else []

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            t = Tokens(batch, size)
            where, anchors = np.flatnonzero(t.inside), t.anchors()[0]
            passes = shared.value.passes(anchors[where])
            if related:
                held = batch.column("kin").is_valid().to_numpy(zero_copy_only=False)
                once = np.flatnonzero(~passes & held[t.of[where]])
                passes[once[np.unique(t.of[where[once]], return_index=True)[1]]] = True
            where = where[passes]
            if not len(where):
                continue
            first = np.ones(len(where), bool)
            first[1:] = (np.diff(where) != 1) | (anchors[where[1:]] != anchors[where[:-1]]) | (t.of[where[1:]] != t.of[where[:-1]])
            at, to = where[first], where[np.append(first[1:], True)] + size
            counts, of = to - size - at + 1, t.of[at]
            begin, end = t.starts[of], (t.starts + t.counts)[of]
            before = np.where(at > begin, (t.hash[at - 1] >> np.uint64(49)).astype(np.int16), np.int16(-1))
            after = np.where(to < end, (t.hash[np.minimum(to, len(t.hash) - 1)] >> np.uint64(49)).astype(np.int16), np.int16(-1))
            columns = [
                pa.array(anchors[at].view(np.int64)), batch.column("path").take(pa.array(of)), pa.array((at - begin).astype(np.int32)), _binary(t.windows()[where], counts),
                _binary(t.line[where], counts), _binary(t.line[where + size - 1], counts), pa.array(before), pa.array(after),
            ]
            if related:
                full = np.where(t.counts > 0, t.starts, 0)
                facts = np.stack([t.counts - size, t.line[full], t.line[np.maximum(full + t.counts - 1, 0)]], axis=1).astype(np.int32)
                facts = _binary(facts.ravel(), np.full(len(facts), 3))
                columns += [x.take(pa.array(of, mask=~held[of])) for x in (batch.column("same"), batch.column("kin"), facts)]
            yield pa.RecordBatch.from_arrays(columns, names)

    def number(rows: pa.Table | pa.RecordBatch) -> int:
        """Windows in all copies of the rows."""
        counts = pc.divide(pc.binary_length(rows.column("hashes")), 8)
        return int(pc.sum(pc.multiply(counts, pc.fill_null(pc.list_value_length(rows.column("kin")), 1)) if related else counts).as_py())

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, windows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            windows += number(batch)
            if windows > GROUPED:
                rows = pa.Table.from_batches(held).combine_chunks()
                anchors = rows.column("anchor").to_numpy()
                to = int(np.searchsorted(anchors, anchors[-1]))  # the last anchor may go on
                if to:
                    yield folded(rows.slice(0, to))
                rest = rows.slice(to)
                held, windows = rest.to_batches(), number(rest)
        if held:
            yield folded(pa.Table.from_batches(held))

    def folded(rows: pa.Table) -> pa.RecordBatch:
        counts = pc.binary_length(rows.column("hashes")).to_numpy().astype(np.int64) // 8
        return fold(rows, counts, np.frombuffer(b"".join(rows.column("hashes").to_pylist()), np.uint64))

    kind = "anchor long, path string, pos int, hashes binary, begins binary, ends binary, before short, after short"
    kind += ", same binary, kin array<string>, whole binary" if related else ""
    return files.mapInArrow(deal, kind).repartition("anchor").sortWithinPartitions("anchor").mapInArrow(group, schema)


def _order(base: np.ndarray, counts: np.ndarray, hashes: np.ndarray, anchors: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows in groups of equal ones, ordered by their rows' ``key`` inside: each one's row, its number among all windows, and whether its group goes on.

    base: each row's first window's number.
    """
    by = np.argsort(key, kind="stable")
    at = _spread(base[by], counts[by])
    order = np.argsort(hashes[at], kind="stable")
    row = np.repeat(by, counts[by])[order]
    at = at[order]
    anchors = anchors[row]
    # two windows of one hash and several anchors aren't equal; they are parted, in the order of anchors
    same = hashes[at[1:]] == hashes[at[:-1]]
    if (same & (anchors[1:] != anchors[:-1])).any():
        order = np.lexsort((np.arange(len(at)), anchors, hashes[at]))
        row, at, anchors = row[order], at[order], anchors[order]
        same = hashes[at[1:]] == hashes[at[:-1]]
    return row, at, same & (anchors[1:] == anchors[:-1])


def _copies(rows: pa.Table) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Each row once for every path of its kin: the row's number, the path, a number for the text (-1: there once) and what ``whole`` has."""
    n, paths = rows.num_rows, rows.column("path").combine_chunks()
    none = np.full(n, -1, np.int64), np.zeros((n, 3), np.int32)
    if "kin" not in rows.column_names or rows.column("kin").null_count == n:
        return np.arange(n), paths, *none
    kin = rows.column("kin").combine_chunks()
    text, facts, held = *none, kin.is_valid().to_numpy(zero_copy_only=False)
    text[held] = rows.column("same").combine_chunks().filter(pa.array(held)).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    facts[held] = np.frombuffer(b"".join(rows.column("whole").drop_null().to_pylist()), np.int32).reshape(-1, 3)
    row = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(kin), 1).to_numpy(zero_copy_only=False))
    at = row.copy()
    at[held[row]] = n + np.arange(int(held[row].sum()))
    return row, pa.concat_arrays([paths, kin.flatten()]).take(pa.array(at)), text[row], facts[row]


def repeated_lines(files: DataFrame, size: int) -> DataFrame:
    """path and duplicated (lines that a repeated window covers) of files with such lines."""

    def fold(rows: pa.Table, counts: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
        row, at, same = _order(np.cumsum(counts) - counts, counts, hashes, rows.column("anchor").to_numpy(), np.zeros(len(counts), np.int8))
        hit = np.zeros(len(at), bool)
        hit[1:] |= same
        hit[:-1] |= same
        row, at = row[hit], at[hit]
        begins, ends = (np.frombuffer(b"".join(rows.column(c).to_pylist()), np.int32)[at] for c in ("begins", "ends"))
        # windows of a row are in order of lines, and each overlaps the next
        order = np.lexsort((at, row))
        row, begins, ends = row[order], begins[order], ends[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (begins[1:] > ends[:-1] + 1)
        last = np.append(new[1:], True) if len(row) else new
        return pa.RecordBatch.from_arrays([pa.array(rows.column("path").combine_chunks().take(pa.array(row[new]))), pa.array(begins[new]), pa.array(ends[last])], ["path", "begin", "end"])

    found = _grouped(files, size, fold, "path string, begin int, end int")
    spans = F.array_sort(F.collect_set(F.struct("begin", "end")))
    step = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["begin"], a["upto"] + 1) + 1)).cast("long").alias("n"), F.greatest(a["upto"], s["end"]).alias("upto"))
    return found.groupBy("path").agg(spans.alias("spans")).select("path", F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("upto")), step)["n"].alias("duplicated"))


def links(files: DataFrame, size: int) -> DataFrame:
    """Runs of linked places, the earlier place first; n places of a window give n - 1 links.

    path_a, path_b, shift, lo, hi; open: 1 if the run may go on before lo, 2 behind hi; first and last lines in both files.
    A window's places are chained within buckets of files, and the buckets' first places among each other.
    Of equal texts one is cut into windows, whose places are those in all copies; a link of one place of two copies stands for all of both.
    """

    def fold(rows: pa.Table, counts: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
        of, paths, text, facts = _copies(rows)
        coded = paths.dictionary_encode()
        names = coded.dictionary.to_pylist()
        rank = np.empty(len(names), np.int64)  # in order of paths
        rank[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
        bucket = np.fromiter((md5(x.encode(), usedforsecurity=False).digest()[0] for x in names), np.int64, len(names))
        codes, pos = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), rows.column("pos").to_numpy().astype(np.int64)[of]
        place = (rank[codes] << 32) + pos
        base, counts = (np.cumsum(counts) - counts)[of], counts[of]
        row, at, same = _order(base, counts, hashes, rows.column("anchor").to_numpy()[of], np.argsort(np.lexsort((place, bucket[codes]))))
        own = pos[row] + at - base[row]
        head = np.ones(len(row), bool)
        head[1:] = ~same | (bucket[codes[row[1:]]] != bucket[codes[row[:-1]]])
        heads = np.maximum.accumulate(np.where(head, np.arange(len(row)), 0))
        b = np.flatnonzero(same) + 1
        a = np.where(head[b], heads[b - 1], b - 1)
        swap = place[row[a]] - pos[row[a]] + own[a] > place[row[b]] - pos[row[b]] + own[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        ka, kb = codes[row[a]], codes[row[b]]
        lo, shift = own[a], own[b] - own[a]
        copied = (shift == 0) & (text[row[a]] >= 0) & (text[row[a]] == text[row[b]])
        pairs, firsts = np.unique(ka[copied] * len(names) + kb[copied], return_index=True)
        whole = facts[row[a[copied][firsts]]]
        a, b, ka, kb, lo, shift = (x[~copied] for x in (a, b, ka, kb, lo, shift))
        order = np.lexsort((lo, shift, kb, ka))
        a, b, ka, kb, lo, shift = (x[order] for x in (a, b, ka, kb, lo, shift))
        new = np.ones(len(lo), bool)
        new[1:] = (np.diff(lo) != 1) | (np.diff(shift) != 0) | (ka[1:] != ka[:-1]) | (kb[1:] != kb[:-1])
        last = np.append(new[1:], True) if len(lo) else new
        begins, ends = (np.frombuffer(b"".join(rows.column(c).to_pylist()), np.int32) for c in ("begins", "ends"))
        before, after = (rows.column(c).to_numpy()[of] for c in ("before", "after"))
        stop = base + counts - 1

        def goes_on(x: np.ndarray, y: np.ndarray, edge: np.ndarray, around: np.ndarray, step: int) -> np.ndarray:
            """Whether the next windows may be alike: equal windows share their anchor, so they lie in these rows, or behind the ends of both."""
            (rx, ax), (ry, ay) = (row[x], at[x]), (row[y], at[y])
            out_x, out_y = ax == edge[rx], ay == edge[ry]
            top = len(hashes) - 1
            inner = hashes[np.clip(ax + step, 0, top)] == hashes[np.clip(ay + step, 0, top)]
            return np.where(out_x | out_y, out_x & out_y & (around[rx] >= 0) & (around[rx] == around[ry]), inner)

        left, right = goes_on(a[new], b[new], base, before, -1), goes_on(a[last], b[last], stop, after, 1)
        numbers = (shift[new], lo[new], lo[last], left + 2 * right, begins[at[a[new]]], ends[at[a[last]]], begins[at[b[new]]], ends[at[b[last]]])
        none = np.zeros(len(pairs), np.int32)
        numbers = [np.concatenate(x).astype(np.int32) for x in zip(numbers, (none, none, whole[:, 0], none, whole[:, 1], whole[:, 2], whole[:, 1], whole[:, 2]), strict=True)]
        both = np.concatenate([ka[new], pairs // len(names)]), np.concatenate([kb[new], pairs % len(names)])
        return pa.RecordBatch.from_arrays([*(coded.dictionary.take(pa.array(k)) for k in both), *map(pa.array, numbers)], RUN)

    return _joined(_grouped(files, size, fold, RUNS), size)


def _joined(runs: DataFrame, size: int) -> DataFrame:
    """Runs of one diagonal whose tokens touch or overlap become one: the windows between them are equal too."""
    along = Window.partitionBy(*PAIR).orderBy("lo")
    upto = F.max("hi").over(along.rowsBetween(Window.unboundedPreceding, -1))
    rows = runs.withColumn("new", F.when(F.col("lo") <= upto + size, 0).otherwise(1)).withColumn("island", F.sum("new").over(along))
    open_ = F.min_by("open", "lo").bitwiseAND(F.lit(1)).bitwiseOR(F.max_by("open", "hi").bitwiseAND(F.lit(2)))
    return rows.groupBy(*PAIR, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), open_.alias("open"), F.min("a0").alias("a0"), F.max("a1").alias("a1"), F.min("b0").alias("b0"), F.max("b1").alias("b1")).drop("island")


def _asked(open_: DataFrame, files: DataFrame, size: int, block: int, most: int) -> DataFrame:
    """Hashes of up to ``most`` blocks of tokens before and behind both places of every run, the nearest first, and the line where each block ends."""
    one = lambda path, by, side: open_.select(F.col(path).alias("asked"), F.struct("id", F.lit(side).alias("side"), "open", (F.col("lo") + by).alias("first"), (F.col("hi") + by + size - 1).alias("last")).alias("ask"))
    asks = one("path_a", F.lit(0), 0).unionByName(one("path_b", F.col("shift"), 1)).groupBy("asked").agg(F.collect_list("ask").alias("asks"))
    if open_.count() <= FEW:
        asks = F.broadcast(asks)
    else:  # files that no run asks about aren't shuffled, but for those that share a spot
        spot = lambda path: F.pmod(F.xxhash64(path), F.lit(SPOTS)).alias("spot")
        spots = asks.select(spot("asked")).distinct()
        files = files.join(F.broadcast(spots), spot("path") == F.col("spot"), "left_semi")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            t, out, held = Tokens(batch, size), [], 0
            for start, count, asks in zip(t.starts.tolist(), t.counts.tolist(), batch.column("asks").to_pylist(), strict=True):
                for x in asks:
                    first, behind = start + x["first"], start + x["last"] + 1
                    n, m = (min(most, room // block) if x["open"] & bit else 0 for bit, room in ((1, first - start), (2, start + count - behind)))
                    left, right = t.hash[first - n * block : first], t.hash[behind : behind + m * block]
                    left, right = _rolled(left, block)[::block][::-1], _rolled(right, block)[::block]
                    out.append((x["id"], x["side"], left.tobytes(), t.line[first - n * block : first : block][::-1].tobytes(), right.tobytes(), t.line[behind + block - 1 : behind + m * block : block].tobytes()))
                    held += len(left) + len(right)
                    if held > LOT // 8:
                        yield answers(out)
                        out, held = [], 0
            if out:
                yield answers(out)

    def answers(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.int64(), pa.int32(), *[pa.binary()] * 4], strict=True)], ["id", "side", *ANSWER])

    return files.join(asks, F.col("path") == F.col("asked")).drop("asked").mapInArrow(rows, "id long, side int, left binary, left_lines binary, right binary, right_lines binary")


def _alike(a: bytes, b: bytes) -> int:
    """How many blocks are equal, from the first on."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // 8
    return int(np.flatnonzero(np.frombuffer(a[:n], np.uint64) != np.frombuffer(b[:n], np.uint64))[0])


def _grown(open_: DataFrame, asked: DataFrame, block: int, most: int) -> DataFrame:
    """Runs longer by the equal blocks at both ends, and whether they may go on."""
    side = lambda k, s: asked.where(F.col("side") == k).drop("side").toDF("id", *(f"{s}_{c}" for c in ANSWER))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                left, right = (_alike(r[f"a_{c}"], r[f"b_{c}"]) for c in ("left", "right"))
                lines = [r["a0"], r["a1"], r["b0"], r["b1"]]
                for k, (n, c) in enumerate(((left, "a_left"), (right, "a_right"), (left, "b_left"), (right, "b_right"))):
                    if n:
                        lines[k] = int.from_bytes(r[f"{c}_lines"][4 * n - 4 : 4 * n], "little")
                going = r["open"] if block > 1 else (left == most) + 2 * (right == most)
                out.append((r["path_a"], r["path_b"], r["shift"], r["lo"] - left * block, r["hi"] + right * block, going, *lines))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k < 2 else pa.int32()) for k, c in enumerate(zip(*out, strict=True))], RUN)

    return open_.join(side(0, "a"), "id").join(side(1, "b"), "id").mapInArrow(rows, RUNS)


def blocks(files: DataFrame, size: int) -> DataFrame:
    """Maximal blocks: path_a, path_b, starts, ends (lines) and tokens of runs of windows that two linked places share.

    A run of links that may go on, where places between its two were linked instead, is extended by equal tokens: a few,
    some more, then by turns blocks of tokens and single ones, until both its ends are known.
    """
    files = whole(files)
    found = cut(links(_kin(files, size), size))
    sweep(files.sparkSession)
    out, open_, turn = found.where("open = 0"), found.where("open > 0"), 0
    while not open_.isEmpty():
        block, most = REACH[min(turn, 2 + turn % 2)]
        open_ = cut(open_.withColumn("id", F.monotonically_increasing_id()))
        grown = cut(_joined(_grown(open_, _asked(open_, files, size, block, most), block, most), size))
        sweep(files.sparkSession)
        out, open_, turn = out.unionByName(grown.where("open = 0")), grown.where("open > 0"), turn + 1
    return out.select(*RUN).distinct().select("path_a", "path_b", F.col("a0").alias("start_a"), F.col("a1").alias("end_a"), F.col("b0").alias("start_b"), F.col("b1").alias("end_b"), (F.col("hi") - F.col("lo") + size).cast("long").alias("token_count"))
