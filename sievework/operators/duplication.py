"""Duplicated code: token windows, blocks and percentages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut
from . import repeats

WINDOW_TOKENS, MOST_BLOCKS, MOST_FINDINGS = 100, 100, 50


def normal_token(kind: Column, value: Column) -> Column:
    """$ID, $NUM or $STR by what the kind's name holds, in that order, else the value itself."""
    low = F.lower(kind)
    return F.when(low.contains("identifier"), "$ID").when(low.rlike("number|integer|float"), "$NUM").when(low.contains("string"), "$STR").otherwise(value)


def word_tokens(files: DataFrame) -> DataFrame:
    """path and tokens (an array of value and line) of files (path, text): runs of letters and digits, and single signs, by line."""
    rows = files.select("path", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    rows = rows.select("path", "line", F.posexplode(F.regexp_extract_all("t", F.lit(r"([\p{L}\p{N}_]+|[^\s\p{L}\p{N}_])"), F.lit(1))).alias("at", "value"))
    one = F.struct("line", "at", "value")
    return rows.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(one)), lambda t: F.struct(t["line"].alias("line"), t["value"].alias("value"))).alias("tokens"))


def windows(files: DataFrame, size: int = WINDOW_TOKENS, digest: bool = False) -> DataFrame:
    """path, pos, start_line, end_line and hash of every run of ``size`` tokens; files hold their tokens in an array.

    hash: two 64-bit hashes of the tokens' hashes, which are made once a token; or, with ``digest``, SHA-256 of the tokens.
    """
    starts = F.when(F.size("tokens") >= size, F.sequence(F.lit(0), F.size("tokens") - size)).otherwise(F.array().cast("array<int>"))
    if digest:
        run = F.slice("tokens", F.col("pos") + 1, size)
        key = F.sha2(F.array_join(F.transform(run, lambda t: t["value"]), "\x1f"), 256)
        rows = files.withColumn("pos", F.explode(starts))
    else:
        rows = files.withColumn("hashes", F.transform("tokens", lambda t: F.xxhash64(t["value"]))).withColumn("pos", F.explode(starts))
        run = F.slice("hashes", F.col("pos") + 1, size)
        key = F.struct(F.xxhash64(run).alias("a"), F.xxhash64(F.lit(7), run).alias("b"))
    line = lambda k: F.get("tokens", F.col("pos") + k)["line"]
    return rows.select("path", "pos", line(0).alias("start_line"), line(size - 1).alias("end_line"), key.alias("hash"))


def window_groups(found: DataFrame) -> DataFrame:
    """hash, occurrences and files of windows that occur more than once."""
    each = found.groupBy("hash", "path").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("hash").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("files")).where("occurrences > 1")


def repeated(found: DataFrame) -> DataFrame:
    """The occurrences of windows that occur more than once; counts come first, so a frequent window isn't gathered."""
    many = found.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return found.join(many.select("hash"), "hash", "left_semi")


def percentage(files: DataFrame, size: int = WINDOW_TOKENS) -> DataFrame:
    """One row: duplicated_lines, total_lines (up to each file's last token) and duplicate_pct; files hold text, or tokens."""
    files = repeats.whole(files)
    texts = cut(repeats.texts(files, size))
    groups = cut(texts.groupBy("same").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path")))
    # of equal texts one is looked at, as others may share its windows; each of its own occurs more than once
    lines = texts.join(groups.where("n > 1").select("same"), "same", "left_semi").select("path", F.col("covered").alias("duplicated"))
    if not lines.isEmpty():
        files = repeats.first_of_each(files, groups.select("path"), groups.count())
    lines = lines.unionByName(repeats.repeated_lines(files, size)).groupBy("path").agg(F.max("duplicated").alias("n"))
    lines = lines.agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("duplicated_lines"))
    both = lines.join(texts.agg(F.coalesce(F.sum("lines"), F.lit(0).cast("long")).alias("total_lines")), F.lit(True))  # one row each
    return both.withColumn("duplicate_pct", F.when(F.col("total_lines") > 0, F.col("duplicated_lines") / F.col("total_lines") * 100).otherwise(0.0))


def links(occurrences: DataFrame) -> DataFrame:
    """path_a, pos, path_b, shift: places of equal windows, the earlier one first; n places of a window give n - 1 links.

    A window's places are chained within buckets of files, and the buckets' first places among each other, so
    that no task sorts all places of a frequent window.
    """
    place = F.struct("path", "pos")
    rows = occurrences.select("hash", F.substring(F.md5("path"), 1, 2).alias("bucket"), place.alias("a"))
    inside = Window.partitionBy("hash", "bucket").orderBy("a")
    rows = rows.withColumns({"b": F.lead("a").over(inside), "first": F.row_number().over(inside) == 1})
    heads = rows.where("first").withColumn("b", F.lead("a").over(Window.partitionBy("hash").orderBy("bucket")))
    both = rows.unionByName(heads).where("b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return both.select(F.col("a.path").alias("path_a"), F.col("a.pos").alias("pos"), F.col("b.path").alias("path_b"), (F.col("b.pos") - F.col("a.pos")).alias("shift"))


def diagonals(found: DataFrame, size: int = WINDOW_TOKENS) -> DataFrame:
    """Maximal blocks: path_a, path_b, starts, ends (lines) and tokens of runs of windows that two linked places share.

    Each link is extended both ways: all windows that are equal along its diagonal are looked up, and the run
    that holds a link is one block, whichever of its windows were linked. Windows are cut once.
    """
    at = cut(repeated(cut(found)))
    linked = cut(links(at).distinct())
    along = at.withColumnRenamed("path", "path_a").join(linked.select("path_a", "path_b", "shift").distinct(), "path_a")
    there = at.select(F.col("path").alias("path_b"), F.col("pos").alias("pos_b"), F.col("hash").alias("hash_b"), F.col("start_line").alias("b_start"), F.col("end_line").alias("b_end"))
    along = along.withColumn("pos_b", F.col("pos") + F.col("shift")).join(there, ["path_b", "pos_b"]).where("hash = hash_b")
    along = along.join(linked.withColumn("link", F.lit(True)), ["path_a", "pos", "path_b", "shift"], "left")
    # positions of a run less their ranks are alike
    rank = F.row_number().over(Window.partitionBy("path_a", "path_b", "shift").orderBy("pos"))
    return along.withColumn("island", F.col("pos") - rank).groupBy("path_a", "path_b", "shift", "island").agg(
        F.min("start_line").alias("start_a"), F.max("end_line").alias("end_a"), F.min("b_start").alias("start_b"), F.max("b_end").alias("end_b"),
        (F.count(F.lit(1)) + size - 1).alias("token_count"), F.max("link").alias("linked"),
    ).where("linked").drop("shift", "island", "linked")


def merged_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks in the order of file A, its line, file B and its line; neighbours are one if they are of one pair and touch, or are a line apart, on both sides.

    Tokens add up. One file's blocks are folded together, as they come in order.
    """
    numbers = [F.col(c).cast("long").alias(c) for c in ("start_a", "end_a", "start_b", "end_b", "token_count")]
    names = ["path_a", "path_b", "start_a", "end_a", "start_b", "end_b", "token_count"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list = []
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                path_a, path_b, start_a, end_a, start_b, end_b, count = row
                if last and last[0] == path_a and last[1] == path_b and start_a <= last[3] + 1 and start_b <= last[5] + 1:
                    last[3], last[4], last[5], last[6] = max(last[3], end_a), min(last[4], start_b), max(last[5], end_b), last[6] + count
                    continue
                if last:
                    out.append(last)
                last = list(row)
            if out:
                yield batch_of(out)
        if last:
            yield batch_of([last])

    def batch_of(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k < 2 else pa.int64()) for k, c in enumerate(zip(*rows, strict=True))], names)

    ordered = blocks.select("path_a", "path_b", *numbers).repartition("path_a").sortWithinPartitions("path_a", "start_a", "path_b", "start_b", "end_a", "end_b", "token_count")
    merged = ordered.mapInArrow(fold, "path_a string, path_b string, start_a long, end_a long, start_b long, end_b long, token_count long")
    return merged.withColumn("line_count", F.col("end_a") - F.col("start_a") + 1)


def largest(blocks: DataFrame, most: int = MOST_BLOCKS) -> DataFrame:
    """The blocks of most lines, a report's top list."""
    return blocks.orderBy(F.col("line_count").desc(), "path_a", "start_a", "path_b", "start_b").limit(most)
