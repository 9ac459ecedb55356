"""Operator 8: mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents, shuffled by a hash of their identifiers, and may pass up to
three times. A document's virtual finish time is the words of its source up to and with it, divided by
the source's target; the mix is the documents of all sources sorted by finish time, cut off where the
total budget is used up. Sums within a source are taken in two steps, over hash ranges and within each
range, so that no source is gathered; the cut is found the same way, over ranges of the finish time.

Defined results: a null text has size 0; documents of size 0, and sources with nothing else, take
nothing; rows without a source are a source of their own, the last; repeated rows are queued each; rows
that are alike in identifier, source and size are taken or left together; a null identifier sorts first;
columns besides doc_id, source and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, fresh

WEIGHTS, MOST_TIMES = (5, 2, 1), 3
#: Sources whose ends, some hundred bytes each, are broadcast.
FEW_SOURCES = 10_000
#: Rows of one range, about.
RANGE_ROWS = 20_000


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, times: int = MOST_TIMES) -> DataFrame:
    """Adds ``target`` to one row a source (no_source, name, source_size).

    Shares of the total in proportion to the weights, at most ``times`` the size; what exceeds that goes
    to the others by weight. With sources in the order of limit by weight, the level of the others is
    what is left over the weight that is left; it rises as long as the next source is at its limit and
    falls after that, so the final level is the highest. The table has one row a source.
    """
    everything = Window.partitionBy()
    order = Window.orderBy("no_source", "name")
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), "no_source", "name").rowsBetween(Window.unboundedPreceding, -1)
    left = lambda c: F.sum(c).over(everything) - F.coalesce(F.sum(c).over(by_limit), F.lit(0.0))
    return (
        sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
        .withColumn("limit", F.col("source_size").cast("double") * times)
        .withColumn("rest", F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("limit").over(by_limit), F.lit(0.0)))
        .withColumn("level", F.max(F.col("rest") / left("weight")).over(everything))
        .select("no_source", "name", "source_size", F.least("limit", F.col("level") * F.col("weight")).alias("target"))
    )


def _ahead(queue: DataFrame, digits: int) -> tuple[DataFrame, DataFrame]:
    """Ranges of the hash, and for each source and range the words of the ranges before."""
    ranged = queue.withColumn("range", F.substring("key", 1, digits))
    sums = ranged.groupBy("no_source", "name", "range").agg(F.sum("size").alias("in_range"))
    before = Window.partitionBy("no_source", "name").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return ranged, sums.withColumn("base", F.coalesce(F.sum("in_range").over(before), F.lit(0))).drop("in_range")


def _key() -> Column:
    """Documents are queued in the order of it."""
    return F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD + "+")), F.lit(0)).cast("long")


def queued(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, times: int = MOST_TIMES) -> DataFrame:
    """doc_id, no_source, name, key, size, source_size, target and ``upto``: the words of the source up to and with the row."""
    queue = cut(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("name"),
            _key().alias("key"), _size().alias("size"),
        )
    )
    digits = 1
    while queue.count() > RANGE_ROWS * 16**digits and digits < 5:
        digits += 1
    ranged, base = _ahead(queue, digits)
    goals = targets(queue.groupBy("no_source", "name").agg(F.sum("size").alias("source_size")), weights, times)
    base = base.join(goals, ["no_source", "name"])
    upto = F.sum("size").over(Window.partitionBy("no_source", "name", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    rows = ranged.join(base, ["no_source", "name", "range"]).withColumn("upto", F.col("base") + upto)
    return cut(rows.select("doc_id", "no_source", "name", "key", "size", "source_size", "target", "upto"))


def _finish(time: int) -> Column:
    """Virtual finish time in a pass of the source; null for sources that take nothing."""
    return F.when(F.col("target") > 0, (F.lit(time) * F.col("source_size") + F.col("upto")).cast("double") / F.col("target"))


def _spot(finish: Column) -> Column:
    return F.struct(finish.alias("finish"), "no_source", "name", "key", "doc_id", "size")


def last_taken(rows: DataFrame, times: int = MOST_TIMES) -> tuple | None:
    """The last of all occurrences, sorted by finish time, that the budget (the words of all rows) holds."""
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")).first()
    if not whole["words"]:
        return None
    spread = max(1024, whole["n"] * times // RANGE_ROWS)
    every = rows.where("size > 0 and target > 0").select("size", F.explode(F.array(*[_spot(_finish(t)) for t in range(times)])).alias("spot"))
    every = every.withColumn("range", F.floor(F.least(F.col("spot.finish"), F.lit(3.0)) * spread).cast("long"))
    sums = every.groupBy("range").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("upto", F.sum("words").over(Window.orderBy("range")))
    over = sums.where(F.col("upto") > whole["words"]).orderBy("range").first()
    if over is None:
        return tuple(every.agg(F.max("spot").alias("s")).first()["s"])
    start = over["upto"] - over["words"]
    inside = every.where(F.col("range") == over["range"]).withColumn("upto", start + F.sum("size").over(Window.partitionBy("range").orderBy("spot")))
    found = inside.where(F.col("upto") <= whole["words"]).agg(F.max("spot").alias("s")).first()["s"]
    if found is None and start:
        found = every.where(F.col("range") < over["range"]).agg(F.max("spot").alias("s")).first()["s"]
    return tuple(found) if found is not None else None


def _times(last: tuple | None, times: int) -> Column:
    """How often a row is taken: the passes in which its place isn't behind the last that was taken."""
    if last is None:
        return F.lit(0)
    finish, no_source, name, key, doc_id, size = last
    end = F.struct(F.lit(float(finish)).alias("finish"), F.lit(no_source).alias("no_source"), F.lit(name).alias("name"), F.lit(key).alias("key"), F.lit(doc_id).cast("long").alias("doc_id"), F.lit(size).cast("long").alias("size"))
    taken = F.lit(0)
    for t in range(times):
        taken = taken + F.when((F.col("size") > 0) & (F.col("target") > 0) & (_spot(_finish(t)) <= end), 1).otherwise(0)
    return taken


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, times: int = MOST_TIMES) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every row of ``docs`` (doc_id, source, text)."""
    rows = queued(docs, weights, times)
    return rows.select(
        "doc_id", F.when(~F.col("no_source"), F.col("name")).alias("source"), "size", "source_size", "target",
        (F.col("size") * _times(last_taken(rows, times), times)).alias("taken"),
    )


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, times: int = MOST_TIMES) -> DataFrame:
    """The rows of ``docs`` (doc_id, source, text and any others) as often as the mix takes them, with all their columns.

    What a source's queue gives in each pass ends at one place of it, so one row a source tells all. Up to
    ``FEW_SOURCES`` such rows are broadcast and texts stay where they are; with more, texts are joined by source.
    """
    rows = queued(docs, weights, times)
    last = last_taken(rows, times)
    place = F.struct("key", "doc_id", "size")
    no_source, name, copy, spot, *end = fresh(docs, "no_source", "name", "copy", "spot", *(f"end{t}" for t in range(times)))
    ends = [F.max(F.when(_times(last, t + 1) > t, place)).alias(end[t]) for t in range(times)]
    ends = cut(rows.groupBy(F.col("no_source").alias(no_source), F.col("name").alias(name)).agg(*ends))
    if ends.count() <= FEW_SOURCES:
        ends = F.broadcast(ends)
    # the place is worked out before the join, so that words are counted once a row
    placed = docs.withColumn(spot, F.struct(_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), _size().alias("size")))
    fits = [F.when((F.col(spot)["size"] > 0) & (F.col(spot) <= F.col(e)), 1).otherwise(0) for e in end]
    same = (F.col("source").isNull() == F.col(no_source)) & (F.coalesce("source", F.lit("")) == F.col(name))
    each = placed.join(ends, same).withColumn(copy, F.explode(F.array_repeat(F.lit(1), sum(fits, F.lit(0)))))
    return each.select(*("`" + c.replace("`", "``") + "`" for c in docs.columns))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, ([5.0, 2.0, 1.0])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY source),
l AS (SELECT *, source_size::DOUBLE * 3 AS lim, sum(source_size::DOUBLE) OVER () AS total, sum(w) OVER () AS weights FROM s),
f AS (SELECT *, (total - coalesce(sum(lim) OVER p, 0)) / (weights - coalesce(sum(w) OVER p, 0)) AS level FROM l
  WINDOW p AS (ORDER BY lim / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, total, least(lim, (max(level) OVER ()) * w) AS target FROM f),
q AS (SELECT d.*, t.source_size, t.target, t.total, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
o AS (SELECT q.*, (CAST(e * source_size + upto AS DOUBLE)) / target AS finish FROM q, (VALUES (0), (1), (2)) AS v(e) WHERE size > 0 AND target > 0),
c AS (SELECT doc_id, k, size, source, sum(size) OVER (ORDER BY finish, source NULLS LAST, k, doc_id NULLS FIRST, size) <= total AS ok, upto FROM o),
n AS (SELECT doc_id, source, upto, size, count(*) FILTER (WHERE ok) AS times FROM c GROUP BY ALL)
SELECT q.doc_id, q.source, q.size, q.source_size, q.target, CAST(q.size * coalesce(n.times, 0) AS BIGINT) AS taken
FROM q LEFT JOIN n ON q.doc_id IS NOT DISTINCT FROM n.doc_id AND q.source IS NOT DISTINCT FROM n.source AND q.upto = n.upto AND q.size = n.size
"""
