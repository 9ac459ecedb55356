"""Operator 4: exact deduplication by a log-structured merge index.

Digests of normalised texts go into memtables, which are flushed as sorted runs, each with a filter; a flush
asks the filters of older runs, and digests that one holds are hits, counted there. Runs
are compacted, level by level, keeping the smallest identifier (or, by the sign given to identifiers, the
largest) and the number of rows of each digest. Every input partition builds an index of its own first,
so that a text that fills a third of the table reaches the shuffle once a partition; the partitions'
runs are then dealt by digest and compacted again. Digests with several rows are hits: the texts behind
them are compared byte by byte, first with the same partition's holder, then across partitions. Only
hits' texts travel, one a partition. Should two texts share a digest, their rows are grouped by text.

Defined results: null counts as the empty text, and empty texts are equal to each other; of rows with
the identifier that stays, repeated rows included, exactly one is kept; a null identifier stays only if
all of its group are null; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bits, bounded, cut, fresh, slices, without_keys

MEMTABLE, FANOUT = 8192, 4
#: Stands for a null identifier: after all others.
NO_ID = 1 << 63

Entry = tuple[bytes, int, int, int]  # digest, signed identifier, place, rows


class Run:
    """Entries sorted by digest, with a filter over the digests."""

    def __init__(self, entries: list[Entry]):
        self.entries, self.digests = entries, [e[0] for e in entries]
        self.size = max(64, 10 * len(entries))
        self.filter = np.zeros(self.size // 8 + 1, np.uint8)
        spots = self._spots(self.digests)
        np.bitwise_or.at(self.filter, spots >> 3, np.uint8(1) << (spots & 7).astype(np.uint8))

    def _spots(self, digests: list[bytes]) -> np.ndarray:
        """Three bits of each digest."""
        parts = np.frombuffer(b"".join(d[:24].ljust(24, b"\0") for d in digests), "<u8").reshape(-1, 3)
        return (parts % np.uint64(self.size)).astype(np.int64)

    def may_hold(self, digests: list[bytes]) -> np.ndarray:
        spots = self._spots(digests)
        return ((self.filter[spots >> 3] >> (spots & 7).astype(np.uint8)) & 1).all(1)

    def place(self, digest: bytes) -> int | None:
        at = bisect_left(self.digests, digest)
        return at if at < len(self.digests) and self.digests[at] == digest else None


def merged(runs: list[list[Entry]]) -> Iterator[Entry]:
    """One entry a digest, in order: the smallest identifier (then place), and all rows."""
    for digest, same in groupby(heapq.merge(*runs), key=lambda e: e[0]):
        first = next(same)
        yield digest, first[1], first[2], first[3] + sum(e[3] for e in same)


class Index:
    """A memtable over levels of runs; FANOUT runs of a level are compacted into one of the next."""

    def __init__(self, memtable: int = MEMTABLE):
        self.most, self.memtable, self.levels = memtable, {}, []

    def put(self, digest: bytes, identifier: int, place: int, rows: int = 1) -> None:
        held = self.memtable.get(digest)
        self.memtable[digest] = (identifier, place, rows) if held is None else (*min(held[:2], (identifier, place)), held[2] + rows)
        if len(self.memtable) >= self.most:
            self.flush()

    def flush(self) -> None:
        """The memtable as a run; digests that an older run holds, by its filter and then by search, are hits and stay there."""
        for run in (r for level in self.levels for r in level):
            if not self.memtable:
                return
            names = list(self.memtable)
            for k in np.flatnonzero(run.may_hold(names)).tolist():
                if (at := run.place(names[k])) is not None:
                    held, new = run.entries[at], self.memtable.pop(names[k])
                    run.entries[at] = (names[k], *min(held[1:3], new[:2]), held[3] + new[2])
        if not self.memtable:
            return
        run, self.memtable = sorted((d, *e) for d, e in self.memtable.items()), {}
        for level in self.levels:
            level.append(Run(run))
            if len(level) < FANOUT:
                return
            run = list(merged([r.entries for r in level]))
            level.clear()
        self.levels.append([Run(run)])

    def entries(self) -> Iterator[Entry]:
        """The whole index, compacted, by digest."""
        self.flush()
        return merged([r.entries for level in self.levels for r in level])

    def get(self, digest: bytes) -> Entry | None:
        found = [(digest, *self.memtable[digest])] if digest in self.memtable else []
        runs = [r for level in self.levels for r in level if r.may_hold([digest])[0]]
        found += [r.entries[at] for r in runs if (at := r.place(digest)) is not None]
        return next(merged([[e] for e in found]), None)


def sha256(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


ENTRY = "digest binary, signed long, place long, rows long, null_id boolean"


def _entry_batches(index: Index) -> Iterator[pa.RecordBatch]:
    rows: list[Entry] = []

    def batch() -> pa.RecordBatch:
        digest, signed, place, n = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(digest, pa.binary()), pa.array([0 if s == NO_ID else s for s in signed], pa.int64()), pa.array(place, pa.int64()), pa.array(n, pa.int64()), pa.array([s == NO_ID for s in signed])],
            ["digest", "signed", "place", "rows", "null_id"],
        )

    for e in index.entries():
        rows.append(e)
        if len(rows) == MEMTABLE:
            yield batch()
            rows = []
    if rows:
        yield batch()


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(b"".join(d[:16].ljust(16, b"\0") for d in digests), ">i8").astype(np.int64).reshape(-1, 2)
    return flat[:, 0], flat[:, 1]


def exact_groups(docs: DataFrame, keep: str = "smallest", digest: Callable[[bytes], bytes] = sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of ``docs`` (doc_id, text).

    keep: which identifier of a group stays, ``smallest`` or ``largest``. digest: a test may give a weak one.
    """
    sign = -1 if keep == "largest" else 1

    def normal(text: pa.Array) -> list[bytes]:
        return pc.ascii_lower(pc.fill_null(text, "")).cast(pa.binary()).to_pylist()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for rows in slices(batches):
            texts = normal(rows.column("text"))
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(range(at, at + len(texts)), pa.int64()), pa.array([digest(t) for t in texts], pa.binary()), pa.array([hashlib.sha256(t).hexdigest() for t in texts])],
                ["doc_id", "place", "digest", "text_sha256"],
            )
            at += len(texts)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Index()
        for b in batches:
            for d, i, p in zip(b.column("digest").to_pylist(), b.column("doc_id").to_pylist(), b.column("place").to_pylist(), strict=True):
                own.put(d, NO_ID if i is None else sign * i, p)
        return _entry_batches(own)

    def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Index()
        for b in batches:
            for d, s, p, n, none in zip(*(b.column(c).to_pylist() for c in ("digest", "signed", "place", "rows", "null_id")), strict=True):
                own.put(d, NO_ID if none else s, p, n)
        return _entry_batches(own)

    docs = bounded(docs).select(F.col("doc_id").cast("long"), "text")
    rows = cut(docs.mapInArrow(digests, "doc_id long, place long, digest binary, text_sha256 string"))
    runs = rows.select("doc_id", "place", "digest").mapInArrow(index, ENTRY)
    hits = runs.repartition("digest").mapInArrow(compact, ENTRY).where("rows > 1")
    hits = cut(hits.select("digest", F.when(~F.col("null_id"), sign * F.col("signed")).alias("keep_id"), F.col("place").alias("keep_place"), F.col("rows").alias("group_size")))
    wrong = _collisions(docs, hits, normal, digest)
    if wrong is not None:
        hits = hits.join(wrong, "digest", "left_anti")
    out = rows.join(hits, "digest", "left")
    held = [F.col("doc_id"), F.when(F.col("keep_place").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.coalesce(F.col("place") == F.col("keep_place"), F.lit(True)).alias("kept"), F.col("text_sha256")]
    if wrong is None:
        return out.select(*held)
    best = F.min(F.struct(F.col("doc_id").isNull(), sign * F.col("doc_id"), "place"))
    parted = rows.join(wrong, "digest", "left_semi")
    fixed = parted.groupBy("text_sha256").agg(best.alias("b"), F.count(F.lit(1)).alias("group_size")).select("text_sha256", (sign * F.col("b.col2")).alias("keep_id"), F.col("b.place").alias("keep_place"), "group_size")
    return out.join(wrong, "digest", "left_anti").select(*held).unionByName(parted.join(fixed, "text_sha256").select(*held))


def without_copies(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others), one of each group of equal texts, with all their columns.

    Rows are told apart by identifier and digest; of repeated rows the first by its columns (as JSON) stays.
    """
    found = cut(exact_groups(docs, keep).where("group_size > 1").select("doc_id", "text_sha256", "kept"))
    null, known = F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long"))
    many = found.groupBy(null.alias("none"), known.alias("known"), "text_sha256").agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n"))
    many = cut(many.where("NOT stays OR n > 1"))
    text = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = [null, known, F.sha2(text, 256)]
    single = without_keys(docs, many.select("none", "known", "text_sha256"), key)
    repeated = cut(many.where("stays").select("none", "known", "text_sha256"))
    if repeated.isEmpty():
        return single
    # of rows with one identifier and text, the first by its JSON stays: columns of any type, maps too, have one
    names = fresh(docs, "none", "known", "digest")
    rows = docs.withColumns(dict(zip(names, key, strict=True))).join(repeated.toDF(*names), names, "left_semi")
    order, whole = fresh(rows, "order", "whole")
    rows = rows.withColumn(order, F.to_json(F.struct(*(_quoted(c) for c in docs.columns)), {"ignoreNullFields": "false"}))
    one = rows.groupBy(*names).agg(F.min_by(F.struct(*(_quoted(c) for c in docs.columns)), order).alias(whole))
    return single.unionByName(one.select(*(F.col(whole).getField(c).alias(c) for c in docs.columns)))


def _quoted(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def _collisions(docs: DataFrame, hits: DataFrame, normal: Callable, digest: Callable) -> DataFrame | None:
    """Digests whose hits differ byte for byte, or None if, as ever with SHA-256, there are none."""
    found = hits.mapInArrow(_split_digest, "h1 long, h2 long")
    count = hits.count()
    if not count:
        return None
    one, two = (Bits.of(found.select(F.col(c).alias("k")), "k", count, plain=True) for c in ("h1", "h2"))
    filters = docs.sparkSession.sparkContext.broadcast((one.words, one.bits, two.words, two.bits))

    def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first text of each hit in the partition, and any that differs from it."""
        w1, b1, w2, b2 = filters.value
        first, sizes = {}, 0
        for rows in slices(batches):
            texts = normal(rows.column("text"))
            keys = [digest(t) for t in texts]
            h1, h2 = _halves(keys)
            out = []
            for k in np.flatnonzero(Bits(w1, b1).has_plain(h1) & Bits(w2, b2).has_plain(h2)).tolist():
                if (held := first.get(keys[k])) is None or held != texts[k]:
                    first.setdefault(keys[k], texts[k])
                    sizes += len(texts[k]) * (held is None)
                    out.append(k)
            if sizes > 256 << 20:  # later rows then meet their holder across partitions
                first, sizes = {}, 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([keys[k] for k in out], pa.binary()), pa.array([texts[k] for k in out], pa.binary())], ["digest", "bytes"])

    texts = docs.mapInArrow(holders, "digest binary, bytes binary")
    wrong = texts.groupBy("digest").agg(F.min("bytes").alias("a"), F.max("bytes").alias("b")).where("a != b").select("digest")
    wrong = cut(wrong.join(hits.select("digest"), "digest", "left_semi"))
    return wrong if wrong.count() else None


def _split_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _halves(b.column("digest").to_pylist())], ["h1", "h2"])


ORACLE_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(x) AS text_sha256
FROM t WINDOW g AS (PARTITION BY x)
"""
