"""Operator 2: URL filter by a cascade of Bloom filters.

The corpus's hosts are the complete universe of keys. Level 1 encodes the listed hosts, level 2 the
hosts of the corpus that pass level 1 wrongly, level 3 the listed hosts that pass level 2, and so on
until a level has no false positive. A host's place in the list is then the parity of the first level
that it fails, exactly and without a join against the list. Rules by host and path prefix come before
the list.

Keys are dealt into shards by hash, so that one task builds the cascade of a bounded number of keys.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule and is on
no list; repeated rows are judged each on its own; null identifiers are kept; columns besides page_id
and url are ignored. A listed host that no page has costs space only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, cut, fresh

#: (rule, verdict): host and path prefix; the longest that fits wins.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Hosts that the list names: unwanted sites, with the prefixes and endings that they are reached by.
LISTED = tuple(f"{prefix}{name}.example.{end}" for name in ("adult-x", "casino-win", "cheap-pills", "spam-farm") for prefix in ("", "blog.", "m.", "www.") for end in ("com", "net", "org"))
#: Keys of one shard, about, and bytes of cascades that are broadcast at once.
SHARD_KEYS, AT_ONCE = 200_000, 32 << 20
MOST_LEVELS = 48


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fits(rule: str, host: Column, path: Column) -> Column:
    """Whether the rule's host is the host or a parent domain of it, and its path begins the path."""
    name, slash, rest = rule.partition("/")
    return ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)


def _places(h1: np.ndarray, h2: np.ndarray, level: int, bits: int, hashes: int) -> np.ndarray:
    """Bit numbers, one row a hash function; each level has functions of its own."""
    salt = np.uint64((level * 0x9E3779B97F4A7C15 + 1) & (2**64 - 1))
    a = (h1 ^ salt) * np.uint64(0xBF58476D1CE4E5B9)
    a ^= a >> np.uint64(31)
    b = (h2 + salt) * np.uint64(0x94D049BB133111EB)
    b = (b ^ (b >> np.uint64(29))) | np.uint64(1)
    return ((a + np.arange(hashes, dtype=np.uint64)[:, None] * b) >> np.uint64(20)) % np.uint64(bits)


class Cascade:
    """Levels of (bits, hash functions, bitmap); exact for every key it was built over."""

    def __init__(self, levels: list[tuple[int, int, bytes]]):
        self.levels = [(bits, hashes, np.frombuffer(x, np.uint8)) for bits, hashes, x in levels]

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, listed: np.ndarray) -> Cascade:
        """The first level lets through about as many others as there are listed keys, the next ones half."""
        inside, outside, levels = np.flatnonzero(listed), np.flatnonzero(~listed), []
        while len(inside):
            if len(levels) == MOST_LEVELS:
                raise ValueError("listed and other keys share their 128-bit hashes")
            rate = min(0.5, max(1e-6, len(inside) / max(1, len(outside)))) if not levels else 0.5
            hashes = max(1, round(-np.log2(rate)))
            bits = int(len(inside) * max(1, hashes) * 1.4427) + 64
            one = np.zeros((bits + 7) // 8 * 8, np.uint8)
            one[_places(h1[inside], h2[inside], len(levels), bits, hashes).ravel()] = 1
            levels.append((bits, hashes, np.packbits(one).tobytes()))
            passed = outside[cls._pass(levels[-1], len(levels) - 1, h1[outside], h2[outside])]
            inside, outside = passed, inside
        return cls(levels)

    @staticmethod
    def _pass(level: tuple, number: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        bits, hashes, data = level
        data = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data
        at = _places(h1, h2, number, bits, hashes)
        return ((data[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1).all(axis=0)

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Whether each key is listed; holds for keys of the universe that the cascade was built over."""
        out, todo = np.full(len(h1), len(self.levels) % 2 == 1), np.arange(len(h1))
        for k, level in enumerate(self.levels):
            passed = self._pass(level, k, h1[todo], h2[todo])
            out[todo[~passed]] = k % 2 == 1
            todo = todo[passed]
        return out


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2")]


def cascades(keys: DataFrame, listed: DataFrame, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """One row (shard, shards, levels) for each shard with listed keys.

    keys, listed: frames with a column ``key``; keys may repeat, and each is counted once, so that a
    frequent key costs no more than a rare one.
    """
    universe = (
        keys.select("key", F.lit(False).alias("in")).unionByName(listed.select("key", F.lit(True).alias("in")))
        .where(F.col("key").isNotNull()).groupBy("key").agg(F.max("in").alias("in")).select(*_hashes(F.col("key")), "in")
    )
    universe = cut(universe)  # counted and built from
    count = universe.count()
    shards = max(1, -(-count // shard_keys))

    def build(table: pa.Table) -> pa.Table:
        h1, h2 = (table[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
        made = Cascade.build(h1, h2, table["in"].to_numpy(zero_copy_only=False).astype(bool))
        levels = [{"bits": b, "hashes": k, "data": x.tobytes()} for b, k, x in made.levels]
        return pa.table({"shard": pa.array([table["shard"][0].as_py()], pa.int32()), "levels": pa.array([levels], LEVELS)})

    LEVELS = pa.list_(pa.struct([("bits", pa.int64()), ("hashes", pa.int32()), ("data", pa.binary())]))
    return (
        universe.withColumn("shard", F.pmod("h2", F.lit(shards)).cast("int")).groupBy("shard")
        .applyInArrow(build, "shard int, levels array<struct<bits: long, hashes: int, data: binary>>")
        .withColumn("shards", F.lit(shards))
    )


def with_listed(df: DataFrame, made: DataFrame, key: str, name: str = "listed", at_once: int = AT_ONCE) -> DataFrame:
    """Adds the column ``name``: whether ``df[key]`` is listed.

    The cascades are measured, dealt into lots of at most ``at_once`` bytes, and each lot is broadcast in
    a pass of its own; a pass over one lot is written before the next one begins. At one listed key in ten,
    32 MB hold some 29 million listed keys (9.3 bits each).
    """
    sizes = made.select("shard", "shards", F.expr("aggregate(levels, 0L, (n, x) -> n + length(x.data))").alias("n")).orderBy("shard").toLocalIterator()
    lots, held, shards = [[]], 0, 1
    for row in sizes:
        shards = row["shards"]
        if lots[-1] and held + row["n"] > at_once:
            lots, held = [*lots, []], 0
        lots[-1].append(row["shard"])
        held += row["n"]
    hashes = fresh(df, "h1", "h2")
    df = df.withColumn(name, F.lit(False)).withColumns(dict(zip(hashes, (F.xxhash64(key), F.xxhash64(F.lit(7), key)), strict=True)))
    for k, lot in enumerate(lots):
        rows = made.where(F.col("shard").isin(lot)).select("shard", "levels").collect() if lot else []
        shared = df.sparkSession.sparkContext.broadcast({r["shard"]: [(x["bits"], x["hashes"], bytes(x["data"])) for x in r["levels"]] for r in rows})
        place, at = df.columns.index(name), shards

        def judge(batches: Iterator[pa.RecordBatch], shared=shared, place=place, at=at) -> Iterator[pa.RecordBatch]:
            held, ready = shared.value, {}
            for batch in batches:
                h1, h2 = (batch.column(c).to_numpy().view(np.uint64) for c in hashes)
                found = batch.column(name).to_numpy(zero_copy_only=False).astype(bool).copy()
                of = np.mod(h2.view(np.int64), at)
                order = np.argsort(of, kind="stable")
                names, starts = np.unique(of[order], return_index=True)
                for s, own in zip(names.tolist(), np.split(order, starts[1:]), strict=True):  # the shards that are present
                    if s in held:
                        if s not in ready:
                            ready[s] = Cascade(held[s])
                        found[own] = ready[s].has(h1[own], h2[own])
                yield batch.set_column(place, name, pa.array(found))

        df = df.mapInArrow(judge, df.schema)
        if k + 1 < len(lots):
            df = cut(df)
    return df.drop(*hashes)


def judge_urls(pages: DataFrame, listed: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and listed of every row of ``pages`` (page_id, url).

    listed: hosts to block where no rule fits, in a column ``key``.
    """
    host, path = host_and_path(F.col("url"))
    parsed = bounded(pages).select("page_id", host.alias("host"), path.alias("path"))
    made = cascades(parsed.select(F.col("host").alias("key")), listed).cache()
    try:
        judged = with_listed(parsed, made, "host")
    finally:
        made.unpersist()
    by_length = sorted(rules, key=lambda r: (-len(r[0]), r[0]))

    def first(values: list[str | None], otherwise: Column) -> Column:
        out = otherwise
        for (rule, _), value in reversed(list(zip(by_length, values, strict=True))):
            out = F.when(fits(rule, F.col("host"), F.col("path")), F.lit(value)).otherwise(out)
        return out

    return judged.select(
        "page_id", "host", "path",
        first([r for r, _ in by_length], F.lit(None).cast("string")).alias("rule"),
        first([v for _, v in by_length], F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "listed",
    )


def listed_hosts(spark: SparkSession, hosts: tuple[str, ...] = LISTED) -> DataFrame:
    return spark.createDataFrame([(h,) for h in hosts], "key string")


#: The same verdicts by plain SQL.
ORACLE_SQL = r"""
WITH named AS (SELECT prefix || name || '.example.' || ending AS key FROM (VALUES ('adult-x'), ('casino-win'), ('cheap-pills'), ('spam-farm')) a(name), (VALUES (''), ('blog.'), ('m.'), ('www.')) b(prefix), (VALUES ('com'), ('net'), ('org')) c(ending)),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, '.' || host AS d,
  host IN (SELECT key FROM named) AS listed FROM h),
m AS (SELECT *, CASE WHEN suffix(d, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN suffix(d, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN suffix(d, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN suffix(d, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM r)
SELECT page_id, host, path, rule, CASE rule WHEN 'example.com/de/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow' WHEN 'net/' THEN 'block'
  ELSE CASE WHEN listed THEN 'block' ELSE 'allow' END END AS verdict, listed
FROM m
"""
