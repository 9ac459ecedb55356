"""Results kept between scans: keys, hits, eviction and hit rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_ENTRIES = 10_000


def cache_key(path: Column, content: Column, rules_hash: str, options: str) -> Column:
    """A key over everything that a result depends on: path, content, rules and options."""
    return F.sha2(F.concat_ws("\x1f", path, F.sha2(content, 256), F.lit(rules_hash), F.lit(options)), 256)


def hits(files: DataFrame, entries: DataFrame) -> DataFrame:
    """Files (key, ...) whose result is kept."""
    return files.join(entries.select("key"), "key", "left_semi")


def misses(files: DataFrame, entries: DataFrame) -> DataFrame:
    return files.join(entries.select("key"), "key", "left_anti")


def hit_rate(files: DataFrame, entries: DataFrame) -> DataFrame:
    """One row: files, hits and hit_rate (0 without files)."""
    marked = files.join(entries.select("key", F.lit(1).alias("hit")).distinct(), "key", "left")
    counts = marked.agg(F.count(F.lit(1)).alias("files"), F.count("hit").alias("hits"))
    return counts.withColumn("hit_rate", F.when(F.col("files") > 0, F.col("hits") / F.col("files")).otherwise(0.0))


def most_recent(entries: DataFrame, most: int = MOST_ENTRIES) -> DataFrame:
    """The entries (key, accessed_at) used last; a top-n that every partition cuts first."""
    return entries.orderBy(F.col("accessed_at").desc(), "key").limit(most)


def valid_entries(entries: DataFrame, engine_version: str, rules_hash: str) -> DataFrame:
    """Entries of this engine and these rules; others are void."""
    return entries.where((F.col("engine_version") == engine_version) & (F.col("rules_hash") == rules_hash))


def touched(entries: DataFrame, used: DataFrame, now: Column) -> DataFrame:
    """Entries with their last use set where a key was used."""
    marked = entries.join(used.select("key", F.lit(True).alias("_used")).distinct(), "key", "left")
    return marked.withColumn("accessed_at", F.when(F.col("_used"), now).otherwise(F.col("accessed_at"))).drop("_used")


def latest(entries: DataFrame) -> DataFrame:
    """The entry of each key that was written last."""
    order = Window.partitionBy("key").orderBy(F.col("written_at").desc())
    return entries.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
