"""Queries for the smaller projections of findings, tokens, calls and advisories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ranks, text
from ..operators import duplication, findings, metrics, supply, taint
from ..sources import ignores
from .scan_queries import table


def valid_line_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as findings with ranges, many of which end before they start or count from 0."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_returnflag", "l_linenumber - 1 AS start_line", "l_suppkey % 5 AS start_col", "l_partkey % 6 AS end_line", "cast(l_quantity AS int) % 7 AS end_col"
    )
    return findings.valid_ranges(rows).groupBy("l_returnflag", "start_line", "end_line").agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("orders"))


def vulnerability_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.expr("elt(p_size % 6 + 1, 'sql-injection', 'command-injection', 'xss', 'path-traversal', 'ssrf', 'open-redirect')")
    return table(spark, sf_dir, "part").select("p_partkey", ranks.vulnerability_severity(kind).alias("severity"))


def normal_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as tokens of several kinds; a kind may name two things, and the first counts."""
    kind = F.expr("elt(p_size % 6 + 1, 'Identifier', 'float_literal', 'string_content', 'number', 'string_identifier', 'keyword')")
    return table(spark, sf_dir, "part").select("p_partkey", duplication.normal_token(kind, F.col("p_name")).alias("token"))


def declared_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as declarations: words that bring data in, and words that make it safe, which count more."""
    state = taint.declared_state(F.concat_ws(" ", "p_name", "p_type"), ["cold", "ECO", "hot"], ["widget", "STANDARD"])
    return table(spark, sf_dir, "part").select("p_partkey", state.alias("state"))


def clean_callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    callee = F.concat(F.expr("elt(s_suppkey % 4 + 1, 'this.', 'self.', 'self.this.', 'itself.')"), "s_name")
    return table(spark, sf_dir, "supplier").select("s_suppkey", taint.clean_callee(callee).alias("callee"))


def stale_databases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates as the dates of advisory databases, some missing or not readable."""
    updated = F.when(F.col("o_orderkey") % 7 == 0, F.lit(None)).when(F.col("o_orderkey") % 7 == 1, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return table(spark, sf_dir, "orders").select("o_orderkey", supply.is_stale(updated, 30, F.lit("1997-06-30").cast("date")).alias("stale"))


def advisory_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as advisories, and the last order as the last update."""
    last = table(spark, sf_dir, "orders").select(F.lit("last_updated").alias("key"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("value"))
    return supply.database_info(table(spark, sf_dir, "part"), last)


def first_snippet_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten of many lines: the words of each document, a line each."""
    snippet = F.array_join(F.split(F.coalesce("text", F.lit("")), " "), "\n")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.first_lines(snippet), 256).alias("snippet"))


def file_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as functions in the files of their orders."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("cast(l_orderkey AS string) AS path", "l_partkey % 40 AS cyclomatic", "l_suppkey % 60 AS cognitive")
    return metrics.file_maxima(rows)


_IGNORES = {
    ".gitignore": "# logs\n*.log\n/a2/b1\n",
    "a0/.gitignore": "!*1.log\nb3/\n",
    "a0/b0/.ignore": "*.py\n!10*.py\n",
}


def nested_ignores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files in folders by size, with ignore files at three levels: what they leave out."""
    path = F.expr("concat('a', p_size % 3, '/b', p_size % 4, '/', p_partkey, elt(p_partkey % 3 + 1, '.py', '.log', '.txt'))")
    held = spark.createDataFrame(list(_IGNORES.items()), "relative_path string, content string")
    held = held.withColumn("content", F.encode("content", "utf-8"))
    return ignores.ignored(table(spark, sf_dir, "part").select(path.alias("relative_path")), ignores.rules(held))


ORACLES = {
    "nested_ignores": """WITH f AS (SELECT 'a' || (p_size % 3) AS a, 'b' || (p_size % 4) AS b, CAST(p_partkey AS VARCHAR) AS k, ['.py', '.log', '.txt'][p_partkey % 3 + 1] AS e FROM part)
      SELECT a || '/' || b || '/' || k || e AS relative_path FROM f WHERE (a = 'a2' AND b = 'b1') OR (a = 'a0' AND b = 'b3') OR (e = '.log' AND NOT (a = 'a0' AND ends_with(k, '1')))
      OR (e = '.py' AND a = 'a0' AND b = 'b0' AND NOT starts_with(k, '10'))""",
    "valid_line_ranges": """WITH r AS (SELECT l_orderkey, l_returnflag, l_linenumber - 1 AS start_line, l_suppkey % 5 AS start_col, l_partkey % 6 AS end_line, CAST(l_quantity AS INT) % 7 AS end_col FROM lineitem)
      SELECT l_returnflag, start_line, end_line, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS orders FROM r WHERE least(start_line, start_col, end_line, end_col) >= 1 AND (end_line, end_col) >= (start_line, start_col) GROUP BY ALL""",
    "vulnerability_levels": "SELECT p_partkey, CASE WHEN p_size % 6 < 2 THEN 'critical' WHEN p_size % 6 < 5 THEN 'high' ELSE 'medium' END AS severity FROM part",
    "normal_tokens": "SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN '$ID' WHEN 1 THEN '$NUM' WHEN 2 THEN '$STR' WHEN 3 THEN '$NUM' WHEN 4 THEN '$ID' ELSE p_name END AS token FROM part",
    "declared_states": "SELECT p_partkey, CASE WHEN regexp_matches(p_name || ' ' || p_type, 'widget|STANDARD') THEN 'clean' WHEN regexp_matches(p_name || ' ' || p_type, 'cold|ECO|hot') THEN 'tainted' ELSE 'unknown' END AS state FROM part",
    "clean_callees": "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 2 THEN 'this.' WHEN 3 THEN 'itself.' ELSE '' END || s_name AS callee FROM supplier",
    "stale_databases": "SELECT o_orderkey, CASE WHEN o_orderkey % 7 < 2 THEN true ELSE date_diff('day', CAST(o_orderdate AS DATE), DATE '1997-06-30') > 30 END AS stale FROM orders",
    "advisory_info": "SELECT (SELECT count(*) FROM part) AS advisories, (SELECT strftime(max(o_orderdate), '%Y-%m-%d') FROM orders) AS last_updated",
    "first_snippet_lines": "SELECT doc_id, sha256(array_to_string(string_split(replace(coalesce(text, ''), ' ', chr(10)), chr(10))[1:10], chr(10))) AS snippet FROM documents",
    "file_maxima": "SELECT CAST(l_orderkey AS VARCHAR) AS path, max(l_partkey % 40) AS max_cyclomatic, max(l_suppkey % 60) AS max_cognitive, count(*) AS functions FROM lineitem GROUP BY ALL",
}
QUERIES = {f.__name__: f for f in (valid_line_ranges, vulnerability_levels, normal_tokens, declared_states, clean_callees, stale_databases, advisory_info, first_snippet_lines, file_maxima, nested_ignores)}
