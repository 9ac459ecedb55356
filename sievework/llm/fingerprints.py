"""Operator 6: document fingerprints by a threshold-scaled sketch, with DataFrame functions only.

A text's shingles are the runs of five words (A-Z lower-cased); shorter texts with words are one shingle.
A sketch keeps every shingle hash below a fixed fraction of all 64-bit values, so that sketches can be
merged and show how much of a short document a long one contains. A sketch with fewer than FEW such
hashes keeps its FEW smallest instead, and so covers more than the fraction. Two sketches are compared
below the smaller of the two limits up to which they are complete.

The next document is found without a global sort: documents are dealt into ranges of the identifier by
quantiles, and each range gets a copy of the first document of the range that follows.

Defined results: null counts as empty; a text without words has an empty sketch, alike (1) to another
empty one and unlike (0) all others; rows are ordered by descending identifier (null last), then text
(descending), so repeated rows follow one another; a single row is its own next; columns besides doc_id
and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, shuffle_partitions

SHINGLE, SCALE, FEW = 5, 8, 16
TOP = (1 << 63) - 1


def _limit(scale: int) -> int:
    """Hashes below it, as signed numbers, are one in ``scale`` of all."""
    return -(1 << 63) + (1 << 64) // scale


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """The hash of each run of ``size`` words, in order."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.transform(F.filter(F.split(lowered, SPACE), lambda w: w != ""), lambda w: F.xxhash64(w))
    runs = lambda w: F.slice(F.transform(w, lambda _, i: F.xxhash64(*[F.get(w, i + k) for k in range(size)])), 1, F.greatest(F.size(w) - (size - 1), F.lit(1)))
    return _with(words, lambda w: F.when(F.size(w) > 0, runs(w)).otherwise(F.array().cast("array<bigint>")))


def _with(value: Column, use) -> Column:  # noqa: ANN001
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sketch(text: Column, scale: int = SCALE, few: int = FEW) -> Column:
    """A struct: ``hashes``, ascending and distinct, and ``upto``, the largest hash up to which none is missing."""

    def kept(all_: Column) -> Column:
        low = F.array_sort(F.array_distinct(F.filter(all_, lambda h: h < _limit(scale))))
        return _with(low, lambda x: F.when(F.size(x) >= few, F.struct(x.alias("hashes"), F.lit(_limit(scale) - 1).alias("upto"))).otherwise(smallest(all_)))

    def smallest(all_: Column) -> Column:
        every = F.array_sort(F.array_distinct(all_))
        return _with(every, lambda x: F.struct(F.slice(x, 1, few).alias("hashes"), F.when(F.size(x) <= few, F.lit(TOP)).otherwise(F.get(x, F.lit(few - 1))).alias("upto")))

    return _with(shingle_hashes(text), kept)


def written(made: Column) -> Column:
    """A sketch as a string: 16 hexadecimal digits a hash, after those of the limit."""
    return F.concat(F.lpad(F.hex(made["upto"]), 16, "0"), F.lit(":"), F.array_join(F.transform(made["hashes"], lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles, 0 to 1."""
    upto = F.least(a["upto"], b["upto"])
    within = lambda s: F.filter(s["hashes"], lambda h: h <= upto)
    both = F.size(F.array_intersect(within(a), within(b)))
    either = F.size(within(a)) + F.size(within(b)) - both
    return F.when(F.size(a["hashes"]) + F.size(b["hashes"]) == 0, F.lit(1.0)).when(either > 0, both / either).otherwise(F.lit(0.0)).cast("double")


def containment(part: Column, whole: Column) -> Column:
    """Estimated share of the shingles of ``part`` that ``whole`` has, 0 to 1."""
    upto = F.least(part["upto"], whole["upto"])
    within = lambda s: F.filter(s["hashes"], lambda h: h <= upto)
    return F.when(F.size(within(part)) > 0, F.size(F.array_intersect(within(part), within(whole))) / F.size(within(part))).otherwise(F.lit(0.0)).cast("double")


def merged(a: Column, b: Column) -> Column:
    """The sketch of two documents together."""
    upto = F.least(a["upto"], b["upto"])
    return F.struct(F.array_sort(F.filter(F.array_union(a["hashes"], b["hashes"]), lambda h: h <= upto)).alias("hashes"), upto.alias("upto"))


def _range_of(df: DataFrame, ranges: int) -> Column:
    """The range of a row's identifier, 0 for the largest; found by bisection in the quantiles."""
    steps = max(1, (ranges - 1).bit_length())
    points = [i / (1 << steps) for i in range(1, 1 << steps)]
    cuts = df.agg(F.percentile_approx("doc_id", points, 100_000).alias("q")).first()["q"] or []
    cuts = [int(x) for x in cuts] + [TOP] * ((1 << steps) - 1 - len(cuts))
    array = F.array(*[F.lit(x).cast("long") for x in cuts])
    at = F.aggregate(F.lit(list(reversed([1 << k for k in range(steps)]))), F.lit(0), lambda low, step: F.when(F.get(array, low + step - 1) <= F.col("doc_id"), low + step).otherwise(low))
    return F.when(F.col("doc_id").isNull(), F.lit(1 << steps)).otherwise(F.lit((1 << steps) - 1) - at)


def with_next(df: DataFrame, ranges: int | None = None) -> DataFrame:
    """Adds next_text and next_sketch of the document that follows by descending identifier; the first follows the last."""
    ranges = ranges or min(4096, 4 * shuffle_partitions(df))
    df = df.withColumn("range", _range_of(df, ranges)).withColumn("copy", F.lit(False))
    order = [F.col("doc_id").desc_nulls_last(), F.col("text").desc_nulls_last()]
    first = F.struct((F.coalesce(F.col("doc_id"), F.lit(-TOP - 1)).alias("id")), F.col("doc_id").isNotNull().alias("known"), F.coalesce("text", F.lit("")).alias("t"))
    heads = df.groupBy("range").agg(F.max_by(F.struct("doc_id", "text", "sketch"), F.struct(first["known"], first["id"], first["t"])).alias("head"))
    around = Window.orderBy("range")  # one row a range
    heads = heads.withColumn("to", F.coalesce(F.lag("range").over(around), F.max("range").over(Window.partitionBy())))
    heads = heads.select("head.doc_id", "head.text", "head.sketch", F.col("to").alias("range"), F.lit(True).alias("copy"))
    inside = Window.partitionBy("range").orderBy("copy", *order)
    both = df.select("doc_id", "text", "sketch", "range", "copy").unionByName(heads)
    return both.withColumns({"next_text": F.lead("text").over(inside), "next_sketch": F.lead("sketch").over(inside)}).where("not copy").drop("range", "copy")


def fingerprints(docs: DataFrame, scale: int = SCALE, few: int = FEW) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, in_next of every row of ``docs`` (doc_id, text).

    in_next: estimated share of the document's shingles that the next one has.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(own.withColumn("sketch", sketch(F.col("text"), scale, few)))
    n = F.char_length("text")
    replaced = F.floor(n / 3).cast("int")
    edited = F.concat(F.left("text", n - replaced), F.left("next_text", replaced))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "sketch", "next_sketch", edited.alias("edited"))
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited"), scale, few))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), written(F.col("sketch")).alias("fingerprint"), written(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"), containment(F.col("sketch"), F.col("next_sketch")).alias("in_next"),
    )
