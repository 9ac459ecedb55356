"""Operator 7: near-duplicates by an inverted join over the coordinates of MinHash signatures.

Every document is a set of word shingles with a signature of K coordinates. Two sets that are similar
enough agree in at least MATCHES of the coordinates, but for a chance below one in a hundred million;
so they agree in at least one of the first K - MATCHES + 1, and only these prefix coordinates are posted.
MATCHES depends on the similarity that is asked for.
Under each coordinate-value pair, collisions over all coordinates are counted, skipping documents whose
sizes alone rule a link out. Candidates are confirmed on their full sets.

Equal sets are one class from the start. Pairs within a component are never listed: of all that agree
with it often enough, every document proposes its best match only; what is confirmed joins components;
and in the next round each proposes its best match in another component that it hasn't tried. So a round
has at most one pair a document. Documents that still agree with another component after the rounds by
signature are settled by an exact prefix join on their full sets, in rounds of the same kind, until a round
joins nothing; the few pairs that are left are then confirmed all at once, so no link that could join two
components is lost. Long lists are dealt to blocks, and only pairs of blocks meet in a task:
inside a list, signatures of 48 bytes are compared with all of about their size, which grows with the square of
the list, but what leaves a task is a row a document.
Components are found by alternating large and small stars.

Defined results: words are lower-cased in A-Z only; a text with fewer words than a shingle is one shingle;
null and empty texts have an empty set and are linked with nothing; rows with equal sets are linked;
rows that share an identifier count as one document in links; rows with a null identifier take the
component of their set, which is null if no row with an identifier is in it, and are kept only then;
columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import GOLD, Bits, bounded, cut, hash_words, mix, pair_hash, release, shuffle_partitions, slices, split_words, sweep, without_keys

SHINGLE, SHARE = 3, 85
#: By the least share that they hold for: at similarity 0.85, 48 coordinates agree in fewer than 24 with a chance of
#: about 2e-9, and at 0.8 in fewer than 21 with one of about 6e-9.
K, MATCHES = 48, {85: 24, 80: 21}
#: Longer lists are dealt to blocks of about so many rows (some 100 bytes each), and pairs of blocks meet in a task.
BLOCK = 1 << 14
#: Comparisons that are made at once; lists up to SHORT rows are compared with others of their size; rows that are
#: read at once.
STEP, SHORT, PACK = 1 << 19, 24, 1 << 14
#: How often documents look for a partner in another component by signatures, after the first time.
SIGNATURE_ROUNDS = 1
#: Rounds by prefixes end when at most one proposal in so many is confirmed.
LEAST_JOINING = 8
#: Up to so many edges, 16 MB, are joined by one task.
FEW_EDGES = 1 << 20
#: How well rows of a list fit each other; 0: not at all.
Score = Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray], np.ndarray]
FACTORS = mix(np.arange(1, K + 1, dtype=np.uint64) * GOLD) | np.uint64(1)


def matches(share: int) -> int:
    """In how many coordinates documents of this similarity agree."""
    if share < min(MATCHES):
        raise ValueError("the number of matches is chosen for similarities of 0.8 or more")
    return MATCHES[max(s for s in MATCHES if s <= share)]


def prefix(share: int) -> int:
    return K - matches(share) + 1


def shingle_sets(text: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """The ascending distinct shingle hashes of each row."""
    words, counts = split_words(pc.ascii_lower(text))
    hashes = hash_words(words)
    runs = hashes.copy()
    for k in range(1, size):
        runs = pair_hash(runs[: len(hashes) - k], hashes[k:]) if len(hashes) > k else runs[:0]
    out, stops = [], np.cumsum(counts)
    for stop, n in zip(stops.tolist(), counts.tolist(), strict=True):
        at = stop - n
        if n >= size:
            out.append(np.unique(runs[at : stop - size + 1]))
        elif n:
            one = hashes[at : at + 1] ^ np.uint64(n)
            for k in range(1, n):
                one = pair_hash(one, hashes[at + k : at + k + 1])
            out.append(one)
        else:
            out.append(hashes[:0])
    return out


def signature(hashes: np.ndarray) -> np.ndarray:
    """The smallest value of each coordinate's hash function over the set, spread over 64 bits."""
    low = np.full(K, np.uint64(2**64 - 1))
    for at in range(0, len(hashes), 8192):
        low = np.minimum(low, (hashes[at : at + 8192] * FACTORS[:, None]).min(axis=1))
    return mix(low + np.arange(K, dtype=np.uint64) * GOLD)


def described(docs: DataFrame, size: int = SHINGLE, share: int = SHARE) -> DataFrame:
    """doc_id, n (set size), k1 and k2 (hash of the set), sig (8 bits a coordinate) and post (values of the prefix)."""
    posted = prefix(share)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            sets = shingle_sets(rows.column("text"), size)
            keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
            signs = np.stack([signature(s) for s in sets]) if sets else np.zeros((0, K), np.uint64)
            post = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * posted), pa.array(np.ascontiguousarray(signs[:, :posted]).view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array([x.tobytes() for x in (signs >> np.uint64(56)).astype(np.uint8)], pa.binary()), post],
                ["doc_id", "n", "k1", "k2", "sig", "post"],
            )

    return docs.mapInArrow(describe, "doc_id long, n long, k1 long, k2 long, sig binary, post array<bigint>")


def postings(nodes: DataFrame, live: Bits, crowded: Bits, share: int) -> DataFrame:
    """token, long and the columns of ``nodes`` but post: a row for each posted value that may be among the live ones.

    long: whether the value may be among the crowded ones.
    """
    shared, posted = nodes.sparkSession.sparkContext.broadcast((live, crowded)), prefix(share)
    carried = nodes.drop("post")
    names = carried.columns

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alive, many = shared.value
        for rows in batches:
            token = rows.column("post").flatten().to_numpy()
            kept = np.flatnonzero(alive.has_plain(token))
            token, of = token[kept], pa.array(kept // posted)
            columns = [pa.array(token), pa.array(many.has_plain(token)), *(rows.column(c).take(of) for c in names)]
            yield pa.RecordBatch.from_arrays(columns, ["token", "long", *names])

    kinds = StructType().add("token", "long").add("long", "boolean")
    return nodes.mapInArrow(post, StructType([*kinds.fields, *carried.schema.fields]))


def in_blocks(rows: DataFrame, count: Column) -> DataFrame:
    """``rows`` (token, cid, ...) with x and y: a list of ``count`` rows is dealt to blocks, and each row sent to
    every pair (x, y) of blocks that its own, ``block``, is in, so that no task holds a long list."""
    blocks = F.ceil(count / BLOCK).cast("int")
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("cid"), blocks).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return met.select(
        *rows.columns, "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y")
    )


def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Runs of whole lists from rows sorted by token, x and y: their columns, where lists start, and their sizes.

    Lists of one row or of one component are left out. tried_a and tried_b are the rows of pairs of a list
    that were tried before, both ways, in the order of tried_a.
    """

    def starts_of(rows: pa.Table) -> np.ndarray:
        changes = np.zeros(rows.num_rows, bool)
        changes[0] = True
        for c in ("token", "x", "y"):
            values = rows[c].to_numpy()
            changes[1:] |= values[1:] != values[:-1]
        return np.flatnonzero(changes)

    def pack(rows: pa.Table) -> dict[str, np.ndarray] | None:
        starts, comp = starts_of(rows), rows["comp"].to_numpy()
        sizes = np.diff(starts, append=rows.num_rows)
        mixed = np.minimum.reduceat(comp, starts) != np.maximum.reduceat(comp, starts)
        if not mixed.any():
            return None
        rows, sizes = rows.filter(pa.array(np.repeat(mixed, sizes))), sizes[mixed]
        out = {c: rows[c].to_numpy() for c in rows.column_names if c not in ("sig", "tried")}
        out |= {"sizes": sizes, "starts": np.cumsum(sizes) - sizes}
        if "sig" in rows.column_names:
            out["sig"] = np.frombuffer(b"".join(rows["sig"].to_pylist()), np.uint8).reshape(-1, K)
        none = np.zeros(0, np.int64)
        out |= {"tried_a": none, "tried_b": none}
        if "tried" in rows.column_names:
            tried = rows["tried"].combine_chunks()
            lengths = pc.fill_null(pc.list_value_length(tried), 0).to_numpy().astype(np.int64)
            out |= _tried(out["cid"], np.repeat(np.arange(len(sizes)), sizes), lengths, tried.flatten().to_numpy())
        return out

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= PACK:
            rows = pa.Table.from_batches(held)
            last = int(starts_of(rows)[-1])
            if last:
                held = rows.slice(last).to_batches()
                if made := pack(rows.slice(0, last)):
                    yield made
    if held and (made := pack(pa.Table.from_batches(held))):
        yield made


def _tried(cid: np.ndarray, of: np.ndarray, lengths: np.ndarray, tried: np.ndarray) -> dict[str, np.ndarray]:
    """The rows of pairs that were tried before; of: each row's list, lengths: how many partners it tried."""
    names = np.unique(cid)
    one = np.repeat(np.arange(len(cid)), lengths)
    at = np.minimum(np.searchsorted(names, tried), len(names) - 1)
    known = names[at] == tried
    one, at = one[known], at[known]
    keys = of * len(names) + np.searchsorted(names, cid)
    order = np.argsort(keys, kind="stable")
    asked = of[one] * len(names) + at
    spot = np.minimum(np.searchsorted(keys, asked, sorter=order), len(keys) - 1)
    other = order[spot]
    here = keys[other] == asked
    a, b = np.concatenate([one[here], other[here]]), np.concatenate([other[here], one[here]])
    order = np.argsort(a, kind="stable")
    return {"tried_a": a[order], "tried_b": b[order]}


def agreements(sig: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many coordinates rows ``a`` agree with rows ``b``; rows of pairs are found by broadcasting."""
    if a.ndim > 2:
        return (sig[a] == sig[b]).sum(-1)
    total = np.zeros((a.shape[0], b.shape[1]), np.uint8)
    for x, y in zip(np.ascontiguousarray(sig[a[:, 0]].T), np.ascontiguousarray(sig[b[0]].T), strict=True):
        total += x[:, None] == y[None, :]
    return total.astype(np.int64)


def by_signature(share: int) -> Score:
    """The matches of two rows of a list, where they and the sizes allow a link."""
    least = matches(share)

    def score(rows: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        agree = agreements(rows["sig"], a, b)
        x, y = rows["n"][a], rows["n"][b]
        return np.where((agree >= least) & (100 * np.minimum(x, y) >= share * np.maximum(x, y)), agree, 0)

    return score


def by_prefix(share: int) -> Score:
    """What the rest of two sets after a shared shingle can hold beyond the overlap that a link needs, plus one."""

    def score(rows: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n, left = rows["n"], rows["n"] - rows["pos"] + 1
        spare = np.minimum(left[a], left[b]) - least_overlap(n[a], n[b], share)
        return np.maximum(spare + 1, 0)

    return score


def partners(score: Score, share: int, want: str):  # noqa: ANN201
    """cid, other, into, score: rows of a list and partners in another component that they didn't try yet.

    want: ``best`` for each row's best partner, ``each`` for the best in each component (``into``), both without
    the rows of the list's largest component, which are met from the others' side; ``any`` for the best of all
    rows; ``every`` for all pairs, the smaller identifier first. Short lists of one size are compared
    together; in a long one rows come by size, so each is compared with a run of the list only.
    """

    def chosen(rows: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, ...]:
        """a, b: rows along the axes of ``value``, whose last one is the partners'."""
        a, b = (np.broadcast_to(x, value.shape).reshape(-1, value.shape[-1]) for x in (a, b))
        value = value.reshape(a.shape)
        if want in ("best", "any"):
            j = value.argmax(1)
            i = np.flatnonzero(value[np.arange(len(value)), j])
            at = i, j[i]
        else:
            i, j = np.nonzero(value)
            if want == "every":
                keep = rows["cid"][a[i, j]] < rows["cid"][b[i, j]]
            else:
                order = np.lexsort((-value[i, j], rows["comp"][b[i, j]], i))
                i, j = i[order], j[order]
                into = rows["comp"][b[i, j]]
                keep = np.ones(len(i), bool)
                keep[1:] = (i[1:] != i[:-1]) | (into[1:] != into[:-1])
            at = i[keep], j[keep]
        a, b = a[at], b[at]
        return rows["cid"][a], rows["cid"][b], rows["comp"][b], value[at]

    def short(rows: dict[str, np.ndarray], m: int) -> Iterator[tuple[np.ndarray, ...]]:
        starts = rows["starts"][rows["sizes"] == m]
        step = max(1, (1 << 22) // (m * m * K))
        for at in range(0, len(starts), step):
            of = starts[at : at + step, None] + np.arange(m)
            a, b = of[:, :, None], of[:, None, :]
            value = score(rows, a, b)
            comp = rows["comp"]
            alike = comp[a] == comp[b]
            value[alike] = 0
            # lists in two blocks are compared across them only
            value[(rows["x"][a] != rows["y"][a]) & (rows["block"][a] == rows["block"][b])] = 0
            if want in ("best", "each"):
                many = alike.sum(2)
                top = np.take_along_axis(comp[of], many.argmax(1)[:, None], 1)
                value[(comp[of] == top) & (many.max(1) > 1)[:, None]] = 0
            low, high = np.searchsorted(rows["tried_a"], (of[0, 0], of[-1, -1] + 1))
            if high > low:
                i, j = rows["tried_a"][low:high], rows["tried_b"][low:high]
                line = np.searchsorted(of[:, 0], i, "right") - 1
                inside = (i - of[line, 0] < m) & (j - of[line, 0] < m)
                line, i, j = line[inside], i[inside], j[inside]
                value[line, i - of[line, 0], j - of[line, 0]] = 0
            yield chosen(rows, a, b, value)

    def long(rows: dict[str, np.ndarray], start: int, size: int) -> Iterator[tuple[np.ndarray, ...]]:
        whole = np.arange(start, start + size)
        comp, block, n = (rows[c][whole] for c in ("comp", "block", "n"))
        asks = np.ones(size, bool)
        if want in ("best", "each"):
            names, sizes = np.unique(comp, return_counts=True)
            if sizes.max() > 1:
                asks = comp != names[sizes.argmax()]
        x, y = rows["x"][start], rows["y"][start]
        one, two = block == x, block == y
        low, high = np.searchsorted(rows["tried_a"], (start, start + size))
        tried_a, tried_b = rows["tried_a"][low:high] - start, rows["tried_b"][low:high] - start
        for mine, theirs in ((one, two),) if x == y else ((one, two), (two, one)):
            asked, among = np.flatnonzero(mine & asks), np.flatnonzero(theirs)
            step = max(16, STEP // max(1, len(among)))
            for at in range(0, len(asked), step):
                a = asked[at : at + step]
                low = np.searchsorted(n[among], -(-n[a[0]] * share // 100), "left")
                high = np.searchsorted(n[among], n[a[-1]] * 100 // share, "right")
                b = among[low:high]
                if not len(b):
                    continue
                value = score(rows, whole[a][:, None], whole[b][None, :])
                value[comp[a][:, None] == comp[b][None, :]] = 0
                place = np.full((2, size), -1)
                place[0, a], place[1, b] = np.arange(len(a)), np.arange(len(b))
                i, j = place[0, tried_a], place[1, tried_b]
                met = (i >= 0) & (j >= 0)
                value[i[met], j[met]] = 0
                yield chosen(rows, whole[a][:, None], whole[b][None, :], value)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in packs(batches):
            out = [f for m in np.unique(rows["sizes"]).tolist() if m <= SHORT for f in short(rows, m)]
            for k in np.flatnonzero(rows["sizes"] > SHORT).tolist():
                out += long(rows, int(rows["starts"][k]), int(rows["sizes"][k]))
            columns = [np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True)]
            for at in range(0, len(columns[0]) if columns else 0, 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 20_000]) for c in columns], ["cid", "other", "into", "score"])
        release()

    return find


PARTNER = "cid long, other long, into long, score long"


def dealt(listed: DataFrame) -> DataFrame:
    at = [F.col(c) for c in ("token", "x", "y")]
    return listed.repartition(shuffle_partitions(listed), *at).sortWithinPartitions(*at, "n", "cid")


def least_overlap(x: np.ndarray | int, y: np.ndarray | int, share: int) -> np.ndarray:
    """The intersection that sets of these sizes need to be linked."""
    return -(-(x + y) * share // (100 + share))


def proposals(listed: DataFrame, score: Score, share: int, want: str) -> DataFrame:
    """cid and other: the best partner of each document over all its lists, in each component if ``want`` is ``each``."""
    found = dealt(listed).mapInArrow(partners(score, share, want), PARTNER)
    best = F.max_by("other", F.struct(F.col("score"), -F.col("other"))).alias("other")
    return cut(found.groupBy("cid", *(["into"] if want == "each" else [])).agg(best).select("cid", "other"))


def full_sets(ids: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """cid and s, the set, of the documents among ``ids`` (cid); built again from their texts."""
    filter_ = Bits.of(ids, "cid", ids.count())
    shared = docs.sparkSession.sparkContext.broadcast(filter_)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            may = shared.value.has([rows.column(c).to_numpy() for c in ("p0", "p1")])
            rows = rows.filter(pa.array(may))
            if rows.num_rows:
                sets = shingle_sets(rows.column("text"), size)
                ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
                flat = pa.array(np.concatenate(sets).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), flat)], ["cid", "s"]
                )

    places = [p.alias(f"p{i}") for i, p in enumerate(filter_.places("doc_id"))]
    asked = docs.where("doc_id IS NOT NULL").select("doc_id", "text", *places)
    return cut(asked.mapInArrow(build, "cid long, s array<bigint>").join(ids.select("cid"), "cid", "left_semi"))


def confirmed(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    one, two = (sets.select(F.col("cid").alias(c), F.col("s").alias(f"s{c}")) for c in ("a", "b"))
    common = F.size(F.array_intersect("sa", "sb"))
    both = pairs.join(one, "a").join(two, "b").select(
        "a", "b", common.alias("c"), (F.size("sa") + F.size("sb")).alias("t")
    )
    return cut(both.where(100 * F.col("c") >= share * (F.col("t") - F.col("c"))).select("a", "b").distinct())


def rare_first(open_: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """token, cid, n, pos, df: the shingles of each open document's prefix that others have too.

    Shingles are ordered by how many of these documents have them. Sets that are linked share one of each
    other's first shingles, and what follows it in either set must be long enough for the overlap; so
    copies that differ in many rare shingles meet nobody.
    """
    own = sets.join(open_, "cid", "left_semi")
    each = own.select("cid", F.size("s").cast("long").alias("n"), F.explode("s").alias("token"))
    many = each.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # those of one document only come first: a shared shingle's place counts them without a row for each
    shared = each.join(many, "token")
    rank = F.row_number().over(Window.partitionBy("cid").orderBy("df", "token")).cast("long")
    total = F.count(F.lit(1)).over(Window.partitionBy("cid"))
    placed = shared.withColumn("pos", F.col("n") - total + rank)
    return cut(placed.where(F.col("pos") <= F.col("n") - F.ceil(F.col("n") * share / 100) + 1))


def joined_components(nodes: DataFrame, links: DataFrame, *more: str) -> DataFrame:
    """cid, comp and ``more`` of ``nodes`` (cid and these)."""
    comps = components(links).withColumnRenamed("node", "cid")
    return nodes.join(comps, "cid", "left").select("cid", F.coalesce("comp", "cid").alias("comp"), *more)


def ordered_pairs(found: DataFrame) -> DataFrame:
    return found.select(F.least("cid", "other").alias("a"), F.greatest("cid", "other").alias("b")).distinct()


def linked(nodes: DataFrame, docs: DataFrame, share: int, size: int) -> DataFrame | None:
    """a, b: links that join the same components as all links do; None if there are no candidates at all."""
    spark = nodes.sparkSession
    counts = nodes.select(F.explode("post").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("c"))
    counts = cut(counts.where("c > 1"))
    long = cut(counts.where(F.col("c") > BLOCK))
    live = Bits.of(counts, "token", counts.count(), most_bits=1 << 27, plain=True)
    crowded = Bits.of(long, "token", long.count(), plain=True)

    any_long = not long.isEmpty()

    def listed(of: DataFrame) -> DataFrame:
        posted = postings(of, live, crowded, share)
        block = {c: F.lit(0) for c in ("block", "x", "y")}
        if not any_long:
            return posted.drop("long").withColumns(block)
        many = posted.where("long").drop("long").join(long, "token", "left")
        many = in_blocks(many, F.coalesce("c", F.lit(1))).drop("c")
        return posted.where("NOT long").drop("long").withColumns(block).unionByName(many)

    tried = proposals(listed(nodes.withColumn("comp", F.col("cid"))), by_signature(share), share, "any")
    near = tried.select("cid")  # agreement is mutual, so these are all that agree with any other
    if near.isEmpty():
        return None
    sets = full_sets(near, docs, size)
    links = confirmed(ordered_pairs(tried), sets, share)
    met = nodes.join(near, "cid", "left_semi")

    def state() -> DataFrame:
        """cid, comp and tried, the partners that the document proposed before."""
        before = tried.groupBy("cid").agg(F.collect_list("other").alias("tried"))
        return cut(joined_components(near, links).join(before, "cid", "left"))

    def by_lists(want: str) -> DataFrame:
        return proposals(listed(met.join(state(), "cid")), by_signature(share), share, want)

    for _ in range(SIGNATURE_ROUNDS):
        sweep(spark)
        found = by_lists("best")
        tried = tried.unionByName(found)
        links = links.unionByName(confirmed(ordered_pairs(found), sets, share))
    # whoever still agrees with another component is settled by an exact join of the sets' prefixes
    sweep(spark)
    open_ = by_lists("any").select("cid")
    if open_.isEmpty():
        return links
    rare = in_blocks(rare_first(open_, sets, share), F.col("df")).drop("df")
    joins = True
    while joins:
        sweep(spark)
        found = proposals(rare.join(state(), "cid"), by_prefix(share), share, "each")
        more = confirmed(ordered_pairs(found), sets, share)
        tried, links = tried.unionByName(found), links.unionByName(more)
        joins = LEAST_JOINING * more.count() > found.count()
    # what prefixes can tell apart is joined by now, so few pairs are left
    rest = dealt(rare.join(state(), "cid")).mapInArrow(partners(by_prefix(share), share, "every"), PARTNER)
    return links.unionByName(confirmed(cut(ordered_pairs(rest)), sets, share))


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and comp of at most FEW_EDGES edges: each node takes the smallest name around it, and that one's, until none changes."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    edges = pa.Table.from_batches(held)
    names, at = np.unique(np.concatenate([edges["u"].to_numpy(), edges["v"].to_numpy()]), return_inverse=True)
    u, v = at[: len(at) // 2], at[len(at) // 2 :]
    above = np.arange(len(names))
    while True:
        low = np.minimum(above[u], above[v])
        new = above.copy()
        for x in (u, v, above[u], above[v]):
            np.minimum.at(new, x, low)
        new = np.minimum(new, new[new])
        if (new == above).all():
            break
        above = new
    moved = np.flatnonzero(above != np.arange(len(names)))
    yield pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(names[above[moved]])], ["node", "comp"])


def components(links: DataFrame) -> DataFrame:
    """node and comp, the smallest node that it reaches, for every node that isn't the smallest itself."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    if edges.count() <= FEW_EDGES:
        return cut(edges.coalesce(1).mapInArrow(_stars, "node long, comp long"))
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        seen = state
        ways = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = ways.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(lower.select("u", F.col("m").alias("v")))
        edges = cut(small.distinct())


def near_components(docs: DataFrame, share: int = SHARE, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text).

    share: documents are linked if 100 times their sets' intersection is at least ``share`` times their
    union; at least 80.
    """
    docs = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = cut(described(docs, size, share))
    one = [F.any_value(c).alias(c) for c in ("n", "sig", "post")]
    classes = cut(rows.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("cid"), *one))
    # sets of fewer shingles are linked with equal ones only
    nodes = classes.where(F.col("cid").isNotNull() & (F.col("n") * (100 - share) >= share))
    links = linked(nodes.select("cid", "n", "sig", "post"), docs, share, size)
    named = classes.select("k1", "k2", "cid")
    named = joined_components(named, links, "k1", "k2") if links else named.withColumn("comp", F.col("cid"))
    out = rows.select("doc_id", "n", "k1", "k2").join(named.drop("cid"), ["k1", "k2"], "left")
    own = F.when(F.col("n") > 0, F.col("comp")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_copies(docs: DataFrame, share: int = SHARE, size: int = SHINGLE, *more: tuple[int, int]) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others), one document of each component, with all their columns.

    more: further rules (share, size); documents that any of the rules links are in one component then.
    An identifier stays if any row with it is kept; rows without an identifier stay.
    """
    gone = None
    for rule in ((share, size), *more):
        named = near_components(docs, *rule).where("doc_id IS NOT NULL")
        named = named.groupBy("doc_id").agg(F.max("kept").alias("stays"), F.min("component_id").alias("comp"))
        named = cut(named.where("NOT stays").select(F.col("doc_id").alias("a"), F.col("comp").alias("b")))
        gone = gone.unionByName(named) if gone else named
        sweep(docs.sparkSession)
    ids = components(gone).select("node") if more else gone.select("a")
    return without_keys(docs, ids, [F.col("doc_id").cast("long")])
