"""Operator 5: preference formatting of paired conversations, with DataFrame functions only.

A pair is a chosen and a rejected conversation. The longest prefix of turns that both share is rendered
once, as the prompt; what follows in each is its completion. A mask lists the spans of a completion that
training learns from: the texts and end marks of the learned role's turns.

A turn is rendered as ``<|role|>``, a line feed, its text, ``<|end|>`` and a line feed. Where a role or
text holds ``<|`` itself, a zero-width space parts the two characters, so no text can forge a mark.

Defined results: a null role or text counts as empty; turns are ordered by turn number (null first),
then role and text, so repeated rows are repeated turns; pairs are rows of the chosen frame's
conversations, and a conversation that only one frame has is paired with an empty one; equal
conversations are all prompt, with empty completions and masks; columns besides the four are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEARNED = "assistant"
#: Conversations of one group in which rejected answers are found, about.
GROUP = 4000
TURNS = "array<struct<turn: bigint, role: string, text: string>>"


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and its turns in order, one row a conversation."""
    one = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """The number of leading turns with the same role and text."""
    least = F.least(F.size(a), F.size(b))
    first = F.array_position(F.transform(F.slice(a, 1, least), lambda t, i: (t["role"] == F.get(b, i)["role"]) & (t["text"] == F.get(b, i)["text"])), False)
    return F.when(first > 0, first - 1).otherwise(least).cast("int")


def _plain(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<\u200b|"))


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|"), _plain(turn["role"]), F.lit("|>\n"), _plain(turn["text"]), F.lit("<|end|>\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def mask(turns: Column, learned: str = LEARNED) -> Column:
    """``start-end`` of each learned span in the rendered turns, in code points, end exclusive, joined by commas."""
    marks = F.transform(turns, lambda t: F.struct((F.char_length(_plain(t["role"])) + 5).alias("head"), (F.char_length(_plain(t["text"])) + 7).alias("body"), (t["role"] == learned).alias("learned")))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def add(seen: Column, m: Column) -> Column:
        start = seen["at"] + m["head"]
        span = F.concat(start.cast("string"), F.lit("-"), (start + m["body"]).cast("string"))
        return F.struct((start + m["body"] + 1).alias("at"), F.when(m["learned"], F.concat(seen["spans"], F.array(span))).otherwise(seen["spans"]).alias("spans"))

    return F.aggregate(marks, empty, add, lambda s: F.array_join(s["spans"], ","))


def format_pairs(pairs: DataFrame, learned: str = LEARNED) -> DataFrame:
    """Rows with chosen_turns and rejected_turns as prompt, completions and masks; other columns stay."""
    a, b = F.col("chosen_turns"), F.col("rejected_turns")
    others = [c for c in pairs.columns if c not in ("chosen_turns", "rejected_turns")]
    rest = lambda x: F.slice(x, F.col("n_prompt_turns") + 1, F.size(x))
    rows = pairs.withColumn("n_prompt_turns", common_turns(a, b))
    return rows.select(
        *others, "n_prompt_turns", render(F.slice(a, 1, F.col("n_prompt_turns"))).alias("prompt"),
        render(rest(a)).alias("chosen"), mask(rest(a), learned).alias("chosen_mask"), render(rest(b)).alias("rejected"), mask(rest(b), learned).alias("rejected_mask"),
    )


def format_preferences(chosen: DataFrame, rejected: DataFrame, learned: str = LEARNED) -> DataFrame:
    """conv_id, n_prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask of turns paired by conv_id."""
    a = conversations(chosen).select("conv_id", F.col("turns").alias("chosen_turns"))
    b = conversations(rejected).select(F.col("conv_id").alias("other"), F.col("turns").alias("rejected_turns"))
    none = F.array().cast(TURNS)
    both = a.join(b, F.col("conv_id").eqNullSafe(F.col("other")), "full")
    return format_pairs(both.select(F.coalesce("conv_id", "other").alias("conv_id"), F.coalesce("chosen_turns", none).alias("chosen_turns"), F.coalesce("rejected_turns", none).alias("rejected_turns")), learned)


def with_swapped_answers(turns: DataFrame, learned: str = LEARNED, group: int = GROUP) -> DataFrame:
    """conv_id, chosen_turns and rejected_turns: a conversation, and itself with the last learned text of another.

    The other is the next by identifier (first after last) of those whose identifiers' hashes share some
    leading digits; the number of digits follows the number of conversations, so groups stay small. A
    conversation with no learned turn, or next to one, is its own rejected one.
    """
    held = conversations(turns)
    count, digits = turns.select("conv_id").distinct().count(), 0
    while count > group * 16**digits:
        digits += 1
    places = F.filter(F.transform(F.col("turns"), lambda t, i: F.when(t["role"] == learned, i)), lambda i: i.isNotNull())
    held = held.withColumn("at", F.element_at(F.concat(F.array(F.lit(-1)), places), -1))
    held = held.withColumn("answer", F.when(F.col("at") >= 0, F.get("turns", F.col("at"))["text"]))
    own = F.substring(F.md5(F.coalesce(F.col("conv_id").cast("string"), F.lit(""))), 1, digits)
    ordered = Window.partitionBy("own").orderBy(F.col("conv_id").asc_nulls_first())
    held = held.withColumn("own", own).withColumn("other", F.lead("answer").over(ordered))
    rank, first = F.row_number().over(ordered), F.first("answer").over(ordered)
    held = held.withColumn("last", rank == F.count(F.lit(1)).over(Window.partitionBy("own")))
    held = held.withColumn("other", F.when(F.col("last"), first).otherwise(F.col("other")))
    swapped = F.transform("turns", lambda t, i: F.when((i == F.col("at")) & F.col("other").isNotNull(), F.struct(t["turn"].alias("turn"), t["role"].alias("role"), F.col("other").alias("text"))).otherwise(t))
    return held.select("conv_id", F.col("turns").alias("chosen_turns"), swapped.alias("rejected_turns"))


def preference_rows(turns: DataFrame) -> DataFrame:
    """One formatted pair a conversation of ``turns`` (conv_id, turn, role, text)."""
    return format_pairs(with_swapped_answers(turns))


ORACLE_SQL = """
WITH t AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM t),
c AS (SELECT conv_id, max(pos) AS len, coalesce(max(pos) FILTER (WHERE role = 'assistant'), 0) AS at FROM n GROUP BY conv_id),
g AS (SELECT *, (SELECT CASE WHEN count(*) > 4000 THEN 1 + CAST(ceil(ln(count(*) / 4000.0) / ln(16) - 1) AS INT) ELSE 0 END FROM c) AS digits FROM c),
a AS (SELECT g.*, substr(md5(coalesce(CAST(g.conv_id AS VARCHAR), '')), 1, digits) AS own, n.text AS answer FROM g LEFT JOIN n ON g.conv_id IS NOT DISTINCT FROM n.conv_id AND g.at = n.pos),
o AS (SELECT *, CASE WHEN row_number() OVER w = count(*) OVER (PARTITION BY own) THEN first_value(answer) OVER w ELSE lead(answer) OVER w END AS other
  FROM a WINDOW w AS (PARTITION BY own ORDER BY conv_id NULLS FIRST)),
r AS (SELECT n.conv_id, n.pos, o.at, n.role, n.text, CASE WHEN n.pos = o.at AND o.other IS NOT NULL THEN o.other ELSE n.text END AS swapped, o.len FROM n JOIN o ON n.conv_id IS NOT DISTINCT FROM o.conv_id),
p AS (SELECT conv_id, coalesce(min(pos) FILTER (WHERE text <> swapped) - 1, max(len)) AS n_prompt_turns FROM r GROUP BY conv_id),
s AS (SELECT r.*, p.n_prompt_turns, '<|' || replace(role, '<|', '<' || chr(8203) || '|') || '|>' || chr(10) AS head,
  replace(text, '<|', '<' || chr(8203) || '|') || '<|end|>' AS b1, replace(swapped, '<|', '<' || chr(8203) || '|') || '<|end|>' AS b2 FROM r JOIN p ON r.conv_id IS NOT DISTINCT FROM p.conv_id),
z AS (SELECT *, coalesce(sum(length(head) + length(b1) + 1) FILTER (WHERE pos > n_prompt_turns) OVER w, 0) + length(head) AS s1, coalesce(sum(length(head) + length(b2) + 1) FILTER (WHERE pos > n_prompt_turns) OVER w, 0) + length(head) AS s2
  FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id, CAST(max(n_prompt_turns) AS INT) AS n_prompt_turns,
  coalesce(string_agg(head || b1 || chr(10), '' ORDER BY pos) FILTER (WHERE pos <= n_prompt_turns), '') AS prompt,
  coalesce(string_agg(head || b1 || chr(10), '' ORDER BY pos) FILTER (WHERE pos > n_prompt_turns), '') AS chosen,
  coalesce(string_agg(CAST(CAST(s1 AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(s1 + length(b1) AS BIGINT) AS VARCHAR), ',' ORDER BY pos) FILTER (WHERE pos > n_prompt_turns AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(head || b2 || chr(10), '' ORDER BY pos) FILTER (WHERE pos > n_prompt_turns), '') AS rejected,
  coalesce(string_agg(CAST(CAST(s2 AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(s2 + length(b2) AS BIGINT) AS VARCHAR), ',' ORDER BY pos) FILTER (WHERE pos > n_prompt_turns AND role = 'assistant'), '') AS rejected_mask
FROM z GROUP BY conv_id
"""
