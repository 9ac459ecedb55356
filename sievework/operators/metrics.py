"""Lines of code and complexity, over tables of lines and syntax nodes."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..lineage import cut
from ..sources.nodes import folded

MOST_CYCLOMATIC, MOST_COGNITIVE = 15, 25


@dataclass(frozen=True)
class Kinds:
    """Node kinds that a language's metrics look at."""

    functions: tuple[str, ...]
    decisions: tuple[str, ...]
    comments: tuple[str, ...] = ("comment",)
    logical: tuple[str, ...] = ("boolean_operator",)
    #: Where a logical kind has other operators too: the tokens below it that make it logical.
    signs: tuple[str, ...] = ()


#: Node kinds of each language's grammar. Nodes of other languages than Python come as a table.
LANGUAGES = {
    "TypeScript": Kinds(("function_declaration", "arrow_function", "method_definition"), ("if_statement", "for_statement", "for_in_statement", "while_statement", "do_statement", "switch_case", "catch_clause", "ternary_expression"), ("comment",), ("binary_expression",), ("&&", "||")),
    "Java": Kinds(("method_declaration", "constructor_declaration"), ("if_statement", "for_statement", "enhanced_for_statement", "while_statement", "do_statement", "switch_label", "catch_clause", "ternary_expression"), ("line_comment", "block_comment"), ("binary_expression",), ("&&", "||")),
    "Python": Kinds(("function_definition",), ("if_statement", "elif_clause", "for_statement", "while_statement", "except_clause", "conditional_expression"), ("comment",), ("boolean_operator",)),
    "Go": Kinds(("function_declaration", "method_declaration"), ("if_statement", "for_statement", "expression_case", "type_case", "communication_case"), ("comment",), ("binary_expression",), ("&&", "||")),
    "CSharp": Kinds(("method_declaration", "constructor_declaration"), ("if_statement", "for_statement", "for_each_statement", "while_statement", "do_statement", "switch_section", "catch_clause", "conditional_expression"), ("comment",), ("binary_expression",), ("&&", "||")),
    "Ruby": Kinds(("method",), ("if", "elsif", "for", "while", "until", "when", "rescue", "conditional"), ("comment",), ("binary",), ("&&", "||")),
    "Php": Kinds(("function_definition", "method_declaration"), ("if_statement", "else_if_clause", "for_statement", "foreach_statement", "while_statement", "do_statement", "case_statement", "catch_clause", "conditional_expression"), ("comment",), ("binary_expression",), ("&&", "||")),
    "Kotlin": Kinds(("function_declaration",), ("if_expression", "for_statement", "while_statement", "do_while_statement", "when_entry", "catch_block"), ("line_comment", "multiline_comment"), ("conjunction_expression", "disjunction_expression")),
}
LANGUAGES["JavaScript"] = LANGUAGES["TypeScript"]


def line_counts(files: DataFrame, comments: DataFrame | None = None, prefix: str = r"^\s*(#|//)") -> DataFrame:
    """path, total_lines, code_lines, blank_lines, comment_lines of files (path, text).

    comments: rows (path, start_row, end_row, from 0) of comments; a line that one touches isn't code, and
    a blank one inside a comment counts as both. Without it, lines that begin with a comment sign are comments.
    """
    rows = files.select("path", F.posexplode_outer(text.lines(F.col("text"))).alias("at", "line"))
    if comments is None:
        rows = rows.withColumn("comment", F.col("line").rlike(prefix))
    else:
        marked = comments.select("path", F.explode(F.sequence("start_row", "end_row")).alias("at")).distinct().withColumn("comment", F.lit(True))
        rows = rows.join(marked, ["path", "at"], "full")
    blank = text.trimmed(F.col("line")) == ""
    commented = F.coalesce("comment", F.lit(False))
    return rows.groupBy("path").agg(
        F.count("line").alias("total_lines"), F.count_if(F.col("line").isNotNull() & ~blank & ~commented).alias("code_lines"), F.count_if(F.col("line").isNotNull() & blank).alias("blank_lines"), F.count_if(commented).alias("comment_lines"),
    )


def function_metrics(nodes: DataFrame, kinds: Kinds) -> DataFrame:
    """path, node_id, name, start_line, end_line, loc, cyclomatic, cognitive, parameters of every function with a name.

    Nodes are written once, without what the metrics don't look at, so that several branches don't parse again.
    """
    function = F.col("kind").isin(*kinds.functions)
    seen = function | F.col("kind").isin(*kinds.decisions, *kinds.logical)
    slim = F.when(seen, F.col("path_from_root")).alias("path_from_root"), F.when(F.col("field_name") == "name", F.col("text")).alias("text")
    nodes = cut(nodes.select("path", "node_id", "parent_id", "kind", "field_name", "is_named", "ordinal", "start_row", "end_row", *slim))
    functions = nodes.where(function).select("path", "node_id", F.size("path_from_root").alias("fn_depth"), (F.col("start_row") + 1).alias("start_line"), (F.col("end_row") + 1).alias("end_line"))
    names = nodes.where("field_name = 'name'").groupBy("path", F.col("parent_id").alias("node_id")).agg(F.min_by("text", "ordinal").alias("name"))
    parameters = nodes.where("field_name = 'parameters'").select("path", F.col("node_id").alias("p"), F.col("parent_id").alias("f"))
    held = nodes.where("is_named").select("path", F.col("parent_id").alias("p")).join(parameters, ["path", "p"]).groupBy("path", F.col("f").alias("node_id")).agg(F.count(F.lit(1)).alias("parameters"))
    if kinds.signs:
        signed = nodes.where(~F.col("is_named") & F.col("kind").isin(*kinds.signs)).select("path", F.col("parent_id").alias("node_id")).distinct().withColumn("signed", F.lit(True))
        nodes = nodes.join(signed, ["path", "node_id"], "left")
    decision, logical = F.col("kind").isin(*kinds.decisions), F.col("kind").isin(*kinds.logical)
    if kinds.signs:
        logical = logical & F.coalesce("signed", F.lit(False))
    decisions = nodes.where(decision).groupBy("path").agg(F.collect_set("node_id").alias("decisions"))
    marks = nodes.where(decision | logical).select("path", F.col("node_id").alias("mark"), "path_from_root", decision.alias("is_decision")).join(decisions, "path", "left")
    above = F.filter("path_from_root", lambda n: F.array_contains(F.coalesce("decisions", F.array().cast("array<bigint>")), n) & (n != F.col("mark")))
    marks = marks.withColumn("above", above).select("path", "mark", "is_decision", "above", "path_from_root", F.explode("path_from_root").alias("node_id"))
    marks = marks.join(functions.select("path", "node_id"), ["path", "node_id"])
    below = F.size(F.filter("above", lambda n: F.array_position("path_from_root", n) > F.array_position("path_from_root", F.col("node_id"))))
    counted = marks.withColumn("nesting", below).groupBy("path", "node_id").agg(
        F.count(F.lit(1)).alias("marks"), F.sum(F.when(F.col("mark") == F.col("node_id"), 0).when(F.col("is_decision"), 1 + F.col("nesting")).otherwise(1)).alias("cognitive")
    )
    out = functions.join(names, ["path", "node_id"]).join(counted, ["path", "node_id"], "left").join(held, ["path", "node_id"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select("path", "node_id", "name", "start_line", "end_line", (F.col("end_line") - F.col("start_line") + 1).cast("long").alias("loc"), (zero(F.col("marks")) + 1).alias("cyclomatic"), zero(F.col("cognitive")).alias("cognitive"), zero(F.col("parameters")).alias("parameters"))


def functions_of(files: DataFrame, language: str = "Python") -> DataFrame:
    """``function_metrics`` of files (path, text), each file's made where it is parsed."""
    kinds = LANGUAGES[language]
    functions, decisions, logical, signs = map(frozenset, (kinds.functions, kinds.decisions, kinds.logical, kinds.signs))

    def fold(path: str, rows: list[dict]) -> list[tuple]:
        names: dict[int, tuple[int, str]] = {}
        lists: dict[int, int] = {}
        signed: set[int] = set()
        for r in rows:
            parent = r["parent_id"]
            if r["field_name"] == "name":
                names[parent] = min(names.get(parent, (r["ordinal"], r["text"])), (r["ordinal"], r["text"]))
            elif r["field_name"] == "parameters":
                lists[r["node_id"]] = parent
            if signs and not r["is_named"] and r["kind"] in signs:
                signed.add(parent)
        held, deciding = Counter(lists[r["parent_id"]] for r in rows if r["is_named"] and r["parent_id"] in lists), {r["node_id"] for r in rows if r["kind"] in decisions}
        own = {r["node_id"] for r in rows if r["kind"] in functions}
        marks, cognitive = Counter(), Counter()
        for r in rows:
            node = r["node_id"]
            decision = node in deciding
            if not decision and not (r["kind"] in logical and (not signs or node in signed)):
                continue
            nesting = 0
            for n in reversed(r["path_from_root"]):  # from the inside out: decisions met so far are those below n
                if n in own:
                    marks[n] += 1
                    cognitive[n] += 0 if n == node else 1 + nesting if decision else 1
                nesting += n in deciding and n != node
        return [
            (path, r["node_id"], names[r["node_id"]][1], r["start_row"] + 1, r["end_row"] + 1, r["end_row"] - r["start_row"] + 1, marks[r["node_id"]] + 1, cognitive[r["node_id"]], held[r["node_id"]])
            for r in rows if r["node_id"] in own and r["node_id"] in names
        ]

    return folded(files, fold, "path string, node_id long, name string, start_line int, end_line int, loc long, cyclomatic long, cognitive long, parameters long", language)


def threshold_findings(functions: DataFrame, cyclomatic: int = MOST_CYCLOMATIC, cognitive: int = MOST_COGNITIVE, tool: str = "sieve") -> DataFrame:
    """Findings of functions above a threshold."""
    out = None
    for name, most in (("cyclomatic", cyclomatic), ("cognitive", cognitive)):
        rule = F.lit(f"{tool}/metrics/{name}-complexity")
        snippet = F.concat(F.lit("function "), F.col("name"))
        rows = functions.where(F.col(name) > most).select(
            text.fingerprint(rule, F.col("path"), snippet).alias("fingerprint"), rule.alias("rule_id"), F.lit("medium").alias("severity"), F.lit("high").alias("confidence"), F.lit("metrics").alias("category"),
            text.normal_path(F.col("path")).alias("file_path"), "start_line", F.lit(0).alias("start_col"), snippet.alias("snippet"), F.col(name).alias("value"), F.lit(most).alias("threshold"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def file_maxima(functions: DataFrame) -> DataFrame:
    return functions.groupBy("path").agg(F.max("cyclomatic").alias("max_cyclomatic"), F.max("cognitive").alias("max_cognitive"), F.count(F.lit(1)).alias("functions"))


def project_totals(counts: DataFrame, functions: DataFrame) -> DataFrame:
    """One row: files, code_lines and mean_function_loc (0 without functions)."""
    files = counts.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("code_lines"), F.lit(0).cast("long")).alias("code_lines"))
    return files.join(functions.agg(F.coalesce(F.avg("loc"), F.lit(0.0)).alias("mean_function_loc")), F.lit(True))  # one row each


def code_by_language(counts: DataFrame) -> DataFrame:
    return counts.groupBy("language").agg(F.sum("code_lines").alias("code_lines"))
