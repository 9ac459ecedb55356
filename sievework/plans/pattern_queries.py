"""Every form of the pattern language over Python made from parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import patterns
from .scan_queries import table

#: By name: a query for each form of the language.
PATTERNS = {
    "absent_field": "(function_definition !return_type name: (identifier) @n)",
    "wildcard": '(call function: (identifier) @f arguments: (argument_list (_)) (#eq? @f "run")) @m',
    "literal": '(binary_operator "+") @m',
    "alternation": "[(integer) (string)] @x",
    "anchor": "(argument_list . (identifier) @first)",
    "quantifier": "(block (if_statement)? (return_statement) @r)",
    "grouping": '((identifier) @i (#eq? @i "c"))',
    "equal": '(call function: (identifier) @f (#eq? @f "eval")) @m',
    "no_match": '(call function: (identifier) @f (#not-match? @f "^(run|eval)$")) @m',
}


def _source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function for each part, whose lines follow the part's key and size."""
    text = F.expr(r"""concat(
      'def f', p_partkey, '(a, b)', if(p_size % 2 = 0, ' -> int', ''), ':\n',
      '    run(', elt(p_partkey % 3 + 1, '', 'a', '7, a'), ')\n',
      '    c = a ', if(p_size % 3 = 0, '+', '-'), ' b\n',
      if(p_size % 5 = 0, '    if a:\n        return "s"\n', ''),
      '    return ', if(p_size % 4 = 0, 'eval', 'open'), '(b)\n')""")
    return table(spark, sf_dir, "part").select(F.concat(F.lit("m/"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), text.alias("text"))


def pattern_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pattern, path, text and line of what each form captures; the files are parsed once."""
    return patterns.search_files(PATTERNS, _source(spark, sf_dir)).select("pattern", "path", "text", F.col("start_line").cast("long").alias("start_line"))


def _row(pattern: str, text: str, line: str, where: str = "true") -> str:
    return f"SELECT '{pattern}' AS pattern, path, {text} AS text, CAST({line} AS BIGINT) AS start_line FROM p WHERE {where}"


_LAST = "4 + CASE WHEN p_size % 5 = 0 THEN 2 ELSE 0 END"
_CALL = "CASE WHEN p_size % 4 = 0 THEN 'eval(b)' ELSE 'open(b)' END"

ORACLES = {
    "pattern_forms": "WITH p AS (SELECT *, 'm/' || p_partkey || '.py' AS path FROM part) " + " UNION ALL ".join([
        _row("absent_field", "'f' || p_partkey", "1", "p_size % 2 = 1"),
        _row("wildcard", "'run(' || CASE p_partkey % 3 WHEN 1 THEN 'a' ELSE '7, a' END || ')'", "2", "p_partkey % 3 > 0"),
        _row("literal", "'a + b'", "3", "p_size % 3 = 0"),
        _row("alternation", "'7'", "2", "p_partkey % 3 = 2"),
        _row("alternation", "'\"s\"'", "5", "p_size % 5 = 0"),
        _row("anchor", "'a'", "2", "p_partkey % 3 = 1"),
        _row("anchor", "'b'", _LAST),
        _row("quantifier", f"'return ' || {_CALL}", _LAST),
        _row("quantifier", "'return \"s\"'", "5", "p_size % 5 = 0"),
        _row("grouping", "'c'", "3"),
        _row("equal", "'eval(b)'", _LAST, "p_size % 4 = 0"),
        _row("no_match", "'open(b)'", _LAST, "p_size % 4 <> 0"),
    ]),
}
QUERIES = {"pattern_forms": pattern_forms}
