"""Queries over the star schema, events, pages and tokens: changes, supply chain, duplication and data flow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sinks
from ..functions import ranks, text, versions
from ..operators import cache, duplication, findings, metrics, policy, repeats, supply, taint
from ..sources import files
from . import patterns
from .scan_queries import table

WINDOW = 20
MICROS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"


def diff_status_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as findings on lines of their order, orders as hunks of changed lines."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("file_path"), "l_linenumber", F.col("l_linenumber").alias("start_line"), (F.col("l_linenumber") + F.pmod("l_partkey", F.lit(3))).alias("end_line"), "l_partkey")
    hunks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("path"), (F.pmod("o_custkey", F.lit(6)) + 1).alias("start_line"), F.pmod("o_orderkey", F.lit(3)).alias("line_count"))
    marked = policy.with_diff_status(rows, hunks)
    return marked.groupBy("diff_status", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.sum("l_partkey").alias("parts"))


def diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("file_path"), F.col("l_linenumber").alias("start_line"), F.col("l_linenumber").alias("end_line"))
    hunks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.lit(2).alias("start_line"), F.pmod("o_orderkey", F.lit(3)).alias("line_count"))
    return policy.diff_counts(policy.with_diff_status(rows, hunks))


def changed_files_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of orders with high priority, as findings in changed files."""
    changed = table(spark, sf_dir, "orders").where("o_orderpriority LIKE '1%'").select(F.col("o_orderkey").cast("string").alias("path"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("file_path"), "l_returnflag", "l_quantity")
    return policy.in_changed_files(rows, changed).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


def _dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as dependencies on parts, with a version of three numbers."""
    key = F.col("l_partkey")
    version = F.concat_ws(".", F.pmod(F.col("l_suppkey"), F.lit(4)).cast("string"), F.pmod(F.col("l_linenumber"), F.lit(12)).cast("string"), F.col("l_quantity").cast("int").cast("string"))
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("part"), key.cast("string")).alias("name"), version.alias("version"), F.when(key % 2 == 0, "pypi").otherwise("maven").alias("ecosystem"), F.concat(F.lit("lock/"), F.col("l_orderkey").cast("string")).alias("lockfile_path"), F.col("l_linenumber").cast("long").alias("line"))


def _advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as advisories: a range by size, a score and perhaps a fixed version."""
    size, key = F.col("p_size"), F.col("p_partkey")
    upper = F.concat(F.pmod(size, F.lit(5)).cast("string"), F.lit("."), size.cast("string"))
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("ADV-"), key.cast("string")).alias("id"), F.when(key % 2 == 0, "pypi").otherwise("maven").alias("ecosystem"), F.concat(F.lit("part"), key.cast("string")).alias("package_name"),
        F.concat(F.when(size % 3 == 0, "<= ").otherwise("<"), upper).alias("affected_range"), F.when(size % 4 != 0, upper).alias("fixed_version"), F.when(size % 7 != 0, size / 5.0).alias("cvss_score"), F.col("p_name").alias("description"), F.lit(None).cast("string").alias("advisory_url"),
    )


_DEPS = """deps AS (SELECT 'part' || l_partkey AS name, (l_suppkey % 4) || '.' || (l_linenumber % 12) || '.' || CAST(l_quantity AS INT) AS version, CASE WHEN l_partkey % 2 = 0 THEN 'pypi' ELSE 'maven' END AS ecosystem, 'lock/' || l_orderkey AS lockfile_path, l_linenumber AS line,
  l_partkey, [l_suppkey % 4, l_linenumber % 12, CAST(l_quantity AS BIGINT)] AS v FROM lineitem),
adv AS (SELECT 'ADV-' || p_partkey AS id, p_partkey, p_size, [CAST(p_size % 5 AS BIGINT), CAST(p_size AS BIGINT), 0] AS top, CASE WHEN p_size % 4 <> 0 THEN (p_size % 5) || '.' || p_size END AS fixed_version, CASE WHEN p_size % 7 <> 0 THEN p_size / 5.0 END AS cvss_score FROM part),
hit AS (SELECT * FROM deps JOIN adv ON l_partkey = p_partkey WHERE CASE WHEN p_size % 3 = 0 THEN v <= top ELSE v < top END)"""
_CVSS = "CASE WHEN {0} IS NULL THEN 'medium' WHEN {0} >= 9 THEN 'critical' WHEN {0} >= 7 THEN 'high' WHEN {0} >= 4 THEN 'medium' WHEN {0} >= 0.1 THEN 'low' ELSE 'info' END"


def sca_match_dotted(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = supply.affected(_dependencies(spark, sf_dir), _advisories(spark, sf_dir), plain=True)
    return found.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("version").alias("versions"))


def sca_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = supply.dependency_findings(supply.affected(_dependencies(spark, sf_dir), _advisories(spark, sf_dir), plain=True))
    return found.select("fingerprint", "rule_id", "severity", "file_path", "start_line", "snippet")


def sca_match_semver(spark: SparkSession, sf_dir: str) -> DataFrame:
    deps = _dependencies(spark, sf_dir).withColumn("ecosystem", F.lit("npm"))
    advisories = _advisories(spark, sf_dir).withColumns({"ecosystem": F.lit("npm"), "affected_range": F.lit(">=1.2, <2.5.0 ")})
    return supply.affected(deps, advisories).groupBy("version").agg(F.count(F.lit(1)).alias("n"))


def purl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as packages of all ecosystems."""
    key = F.col("p_partkey")
    eco = F.get(F.array(*[F.lit(e) for e in supply.ECOSYSTEMS]), F.pmod(key, F.lit(6)).cast("int"))
    name = F.when(key % 6 == 0, F.concat(F.lit("@"), "p_brand", F.lit("/"), "p_name")).when(key % 12 == 2, F.concat_ws(":", "p_brand", "p_name")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", supply.purl(name, F.col("p_size").cast("string"), eco).alias("purl"))


def cvss_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.when(F.col("p_size") % 7 != 0, F.col("p_size") / 5.0)
    return table(spark, sf_dir, "part").select("p_partkey", ranks.cvss_severity(score).alias("severity"))


def sbom_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.components(_dependencies(spark, sf_dir)).select("ref", "name", "version", "purl")


def distinct_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supply.distinct_dependencies(_dependencies(spark, sf_dir)).groupBy("ecosystem").agg(F.count(F.lit(1)).alias("n"), F.min("lockfile_path").alias("first_lockfile"))


def advisory_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts' advisories, and new ones for the larger parts."""
    old = _advisories(spark, sf_dir).select("id", "ecosystem", "package_name", "affected_range")
    new = old.where("affected_range LIKE '<= %'").withColumn("affected_range", F.lit("< 99"))
    return supply.upserted(old, new, ["id", "ecosystem", "package_name"]).groupBy("affected_range").agg(F.count(F.lit(1)).alias("n"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.files_of(table(spark, sf_dir, "documents")).select(F.col("file_path").alias("path"), "text")


_TOKENS = r"""f AS (SELECT source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, coalesce(text, '') AS text FROM documents),
l AS (SELECT path, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM f),
t AS (SELECT path, line, unnest(regexp_extract_all(t, '([\p{L}\p{N}_]+|[^\s\p{L}\p{N}_])')) AS value, generate_subscripts(regexp_extract_all(t, '([\p{L}\p{N}_]+|[^\s\p{L}\p{N}_])'), 1) AS spot FROM l),
n AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line, spot) - 1 AS pos, count(*) OVER (PARTITION BY path) AS total FROM t)"""
_WINDOWS = _TOKENS + f""",
w AS (SELECT path, pos, line AS start_line, max(line) OVER g AS end_line, sha256(string_agg(value, chr(31)) OVER g) AS hash, total FROM n WINDOW g AS (PARTITION BY path ORDER BY pos ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)),
v AS (SELECT * FROM w WHERE pos + {WINDOW} <= total)"""


def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.least_windows(_files(spark, sf_dir), WINDOW)


def dup_window_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.window_groups(_files(spark, sf_dir), WINDOW)


def dup_percentage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplication.percentage(_files(spark, sf_dir), WINDOW)


def dup_blocks_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplication.merged_blocks(repeats.blocks(_files(spark, sf_dir), WINDOW))


def dup_largest_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplication.largest(dup_blocks_merged(spark, sf_dir))


def asof_last_def(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as uses of a user's value, other events as its definitions."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("name"), F.lit("p").alias("path"), F.lit("f").alias("fn"), F.expr(MICROS).alias("at"), "event_type", "value")
    defs = events.where("event_type <> 'purchase'").select("path", "fn", "name", F.col("at").alias("def_line"), F.col("event_id").alias("ord"), F.col("value").cast("string").alias("state"))
    uses = events.where("event_type = 'purchase'").select("path", "fn", "name", F.col("at").alias("use_line"), F.col("event_id").alias("use_id"))
    return taint.reaching_definitions(uses, defs.withColumn("ord", F.col("ord").cast("int"))).select("use_id", "name", "use_line", "def_line")


def earliest_tainted(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("name"), F.lit("p").alias("path"), F.lit("f").alias("fn"), F.expr(MICROS).alias("at"), "event_type", "value")
    defs = events.select("path", "fn", "name", F.col("at").alias("def_line"), F.when(F.col("value") > 90, "tainted").otherwise("clean").alias("state"))
    uses = events.select("path", "fn", "name", F.col("at").alias("use_line"), "event_id")
    return taint.earliest_tainted(uses, defs).select("event_id", "tainted_line")


def _flow(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Line items as assignments: in an order, the line uses what the line before it defines; discounted first lines are tainted."""
    items = table(spark, sf_dir, "lineitem").select(F.lit("p").alias("path"), F.col("l_orderkey").cast("string").alias("fn"), "l_linenumber", "l_discount", "l_tax", "l_partkey")
    name = lambda n: F.concat(F.lit("v"), n.cast("string"))
    state = F.when(F.col("l_tax") > 0.06, "clean").when((F.col("l_linenumber") == 1) & (F.col("l_discount") > 0.03), "tainted").otherwise("unknown")
    defs = items.select("path", "fn", name(F.col("l_linenumber")).alias("name"), F.col("l_linenumber").alias("def_line"), F.col("l_partkey").cast("int").alias("ord"), state.alias("state"))
    return defs, items.where("l_linenumber > 1").select("path", "fn", name(F.col("l_linenumber") - 1).alias("name"), F.col("l_linenumber").alias("use_line"))


def taint_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taint.propagate(*_flow(spark, sf_dir)).groupBy("state", "def_line").agg(F.count(F.lit(1)).alias("n"))


_SINKS = (("query", "sql-injection", [0]), ("db.query", "sql-injection", [1]), ("exec", "command-injection", [0, 1]))


def sink_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls."""
    callee = F.concat(F.get(F.array(F.lit("app.db."), F.lit("x."), F.lit("")), F.pmod("event_id", F.lit(3)).cast("int")), F.get(F.array(F.lit("query"), F.lit("exec"), F.lit("prequery"), F.lit("other")), F.pmod("user_id", F.lit(4)).cast("int")))
    calls = table(spark, sf_dir, "events").select(F.col("event_id").alias("call_id"), callee.alias("callee"))
    held = spark.createDataFrame([(k, f, v, a) for k, (f, v, a) in enumerate(_SINKS)], "ordinal int, function string, vulnerability string, tainted_args array<int>")
    return taint.sink_calls(calls, held).groupBy("callee", "function").agg(F.count(F.lit(1)).alias("n"))


def call_resolve_3tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as calls, suppliers as functions in files by nation, regions' nations as imports."""
    nation = lambda c: F.concat(F.lit("n"), F.col(c).cast("string"))
    name = lambda c: F.concat(F.lit("f"), F.pmod(c, F.lit(40)).cast("string"))
    functions = table(spark, sf_dir, "supplier").select(nation("s_nationkey").alias("path"), name("s_suppkey").alias("name"), F.concat(nation("s_nationkey"), F.lit("::"), name("s_suppkey")).alias("key")).distinct()
    calls = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("call_id"), nation("c_nationkey").alias("path"), F.concat(F.when(F.col("c_custkey") % 2 == 0, "this.").otherwise(""), name("c_custkey")).alias("callee"))
    imports = table(spark, sf_dir, "nation").select(nation("n_nationkey").alias("path"), F.lit("f7").alias("local_name"), F.concat(F.lit("n"), F.col("n_regionkey").cast("string")).alias("target"), F.lit("f3").alias("exported_name"))
    return taint.resolve_calls(calls, functions, imports).select("call_id", "callee_key")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("src"), F.explode(F.array(F.pmod(F.col("n_nationkey") * 3 + 1, F.lit(25)), F.pmod(F.col("n_nationkey") * 7 + F.col("n_regionkey"), F.lit(25)))).alias("dst"))


def reachability_depth5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taint.reachable(_edges(spark, sf_dir), table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("node")))


def import_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as imports of modules beside, above and below them."""
    module = F.get(F.array(F.lit("./m"), F.lit("../lib/m"), F.lit("pkg.m"), F.lit("./none")), F.pmod("n_nationkey", F.lit(4)).cast("int"))
    imports = table(spark, sf_dir, "nation").select(F.concat(F.lit("src/a"), F.col("n_regionkey").cast("string"), F.lit("/f"), F.col("n_nationkey").cast("string"), F.lit(".ts")).alias("path"), F.lit("x").alias("local_name"), F.concat(module, F.when(F.col("n_nationkey") % 4 < 3, F.col("n_regionkey").cast("string")).otherwise("")).alias("module"), F.lit("x").alias("exported_name"))
    known = [f"src/a{k}/m{k}.ts" for k in (0, 1)] + ["src/a1/m1.js", "src/a2/m2/index.ts", "src/lib/m3.tsx", "src/lib/m0.py", "pkg/m4.py"]
    return taint.resolve_imports(imports, spark.createDataFrame([(k,) for k in known], "path string")).select("path", "module", "target")


def lru_keep_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("key"), F.col("ts").alias("accessed_at"))
    return cache.most_recent(entries, 500)


def version_invalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("engine_version"), F.col("p_type").alias("rules_hash"))
    first = entries.agg(F.min("engine_version").alias("e"), F.min("rules_hash").alias("r")).first()
    return cache.valid_entries(entries, first["e"], first["r"]).select("key")


def discovery_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files: names by key, HTML as content."""
    key = F.col("page_id")
    ends = F.array(*[F.lit(x) for x in (".ts", ".py", ".html", ".test.ts", ".example.ts", ".GO")])
    tree = table(spark, sf_dir, "pages").select(F.concat(F.when(key % 9 == 0, "dist/").otherwise("src/"), F.lit("p"), key.cast("string"), F.get(ends, F.pmod(key, F.lit(6)).cast("int"))).alias("relative_path"), F.encode("html", "utf-8").alias("content"))
    return files.discovery_stats(files.discovered(tree, ["TypeScript", "Python"], ["dist/**"], max_kib=4))


def file_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    names = F.array(*[F.lit(x) for x in ("a/tests/x.py", "test_a.py", "latest.ts", ".env.example", "config.sample.ts", "src/FooTests.cs", "b/x.spec.tsx", "app.go", "lib/y.min.js", "z.rb")])
    path = F.get(names, F.pmod(key, F.lit(10)).cast("int"))
    return table(spark, sf_dir, "part").groupBy(path.alias("path")).agg(F.count(F.lit(1)).alias("n")).select("path", "n", files.is_test_file(F.col("path")).alias("is_test"), files.is_secrets_excluded(F.col("path")).alias("is_example"), files.is_generated(F.col("path")).alias("is_generated"), files.language(F.col("path")).alias("language"))


def hunk_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as diffs of one file with two hunks."""
    key = F.col("o_orderkey")
    diff = F.concat(F.lit("diff --git a/f"), key.cast("string"), F.lit(" b/f"), key.cast("string"), F.lit("\n--- a/x\n+++ b/x\n@@ -1,2 +"), F.pmod(key, F.lit(50)).cast("string"), F.lit(",3 @@ fn\n+x\n@@ -9 +"), F.pmod(F.col("o_custkey"), F.lit(90)).cast("string"), F.lit(" @@\n"))
    return policy.hunks_of(table(spark, sf_dir, "orders").select(key.alias("diff_id"), diff.alias("diff")))


def version_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' sizes and prices as versions, in order."""
    a = F.concat(F.col("p_size").cast("string"), F.lit(".10"))
    b = F.concat(F.pmod("p_partkey", F.lit(50)).cast("string"), F.when(F.col("p_partkey") % 3 == 0, ".9").when(F.col("p_partkey") % 3 == 1, ".10.0").otherwise(".x"))
    return table(spark, sf_dir, "part").select("p_partkey", versions.dotted_order(a, b).alias("ordering"))


def _python(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as Python functions, whose branches follow their size."""
    size = F.col("p_size")
    lines = F.transform(F.sequence(F.lit(1), F.pmod(size, F.lit(6)) + 1), lambda k: F.concat(F.repeat(F.lit("    "), k), F.lit("if a and b > "), k.cast("string"), F.lit(":")))
    body = F.concat(F.lit("def f"), F.col("p_partkey").cast("string"), F.lit("(a, b):\n"), F.array_join(lines, "\n"), F.lit("\n"), F.repeat(F.lit("    "), F.pmod(size, F.lit(6)) + 2), F.lit("return eval(a)\n"))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("m/"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), body.alias("text"))


def complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.functions_of(_python(spark, sf_dir)).select("path", "name", "loc", "cyclomatic", "cognitive", "parameters")


def complexity_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.threshold_findings(metrics.functions_of(_python(spark, sf_dir)), 9, 20).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


def pattern_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = patterns.search_files({"calls": '(call function: (identifier) @f (#match? @f "^(eval|exec)$")) @match'}, _python(spark, sf_dir))
    return found.select("path", "text", F.col("start_line").cast("long").alias("start_line"))


def normal_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("./a/../b/./"), F.col("n_name"), F.lit("\\x/../y"))
    return table(spark, sf_dir, "nation").select("n_nationkey", text.resolved_path(text.normal_path(raw)).alias("path"))


#: Blocks as SQL: repeated windows chained in buckets, their diagonals, runs that hold a link, and neighbours merged.
_BLOCKS = _WINDOWS + f""",
o AS (SELECT hash, path, pos, start_line, end_line, md5(path)[1:2] AS bucket FROM v WHERE hash IN (SELECT hash FROM v GROUP BY hash HAVING count(*) > 1)),
c AS (SELECT hash, bucket, path, pos, lead(path) OVER i AS next_path, lead(pos) OVER i AS next_pos, row_number() OVER i = 1 AS head FROM o WINDOW i AS (PARTITION BY hash, bucket ORDER BY path, pos)),
h AS (SELECT path, pos, lead(path) OVER i AS next_path, lead(pos) OVER i AS next_pos FROM c WHERE head WINDOW i AS (PARTITION BY hash ORDER BY bucket)),
e AS (SELECT path, pos, next_path, next_pos FROM c WHERE next_path IS NOT NULL UNION ALL SELECT * FROM h WHERE next_path IS NOT NULL),
lk AS (SELECT DISTINCT CASE WHEN swap THEN next_path ELSE path END AS path_a, CASE WHEN swap THEN next_pos ELSE pos END AS pos, CASE WHEN swap THEN path ELSE next_path END AS path_b, CASE WHEN swap THEN pos - next_pos ELSE next_pos - pos END AS shift
  FROM (SELECT *, path > next_path OR (path = next_path AND pos > next_pos) AS swap FROM e)),
d AS (SELECT DISTINCT path_a, path_b, shift FROM lk),
m AS (SELECT d.*, a.pos, a.start_line, a.end_line, b.start_line AS b_start, b.end_line AS b_end, lk.pos IS NOT NULL AS link FROM d JOIN o a ON a.path = d.path_a JOIN o b ON b.path = d.path_b AND b.pos = a.pos + d.shift AND b.hash = a.hash
  LEFT JOIN lk ON lk.path_a = d.path_a AND lk.path_b = d.path_b AND lk.shift = d.shift AND lk.pos = a.pos),
r AS (SELECT *, pos - row_number() OVER (PARTITION BY path_a, path_b, shift ORDER BY pos) AS island FROM m),
k AS (SELECT path_a, path_b, min(start_line) AS start_a, max(end_line) AS end_a, min(b_start) AS start_b, max(b_end) AS end_b, count(*) + {WINDOW - 1} AS token_count FROM r GROUP BY path_a, path_b, shift, island HAVING bool_or(link)),
s AS (SELECT *, row_number() OVER (PARTITION BY path_a ORDER BY start_a, path_b, start_b, end_a, end_b, token_count) AS i FROM k),
fo AS (SELECT path_a, path_b, start_a, end_a, start_b, end_b, token_count, i, 1 AS g FROM s WHERE i = 1
  UNION ALL SELECT s.path_a, s.path_b, CASE WHEN joins THEN fo.start_a ELSE s.start_a END, CASE WHEN joins THEN greatest(fo.end_a, s.end_a) ELSE s.end_a END, CASE WHEN joins THEN least(fo.start_b, s.start_b) ELSE s.start_b END,
    CASE WHEN joins THEN greatest(fo.end_b, s.end_b) ELSE s.end_b END, CASE WHEN joins THEN fo.token_count + s.token_count ELSE s.token_count END, s.i, CASE WHEN joins THEN fo.g ELSE fo.g + 1 END
  FROM fo JOIN s ON s.path_a = fo.path_a AND s.i = fo.i + 1, LATERAL (SELECT s.path_b = fo.path_b AND s.start_a <= fo.end_a + 1 AND s.start_b <= fo.end_b + 1 AS joins) AS x),
blocks AS (SELECT path_a, path_b, CAST(start_a AS BIGINT) AS start_a, CAST(end_a AS BIGINT) AS end_a, CAST(start_b AS BIGINT) AS start_b, CAST(end_b AS BIGINT) AS end_b, CAST(token_count AS BIGINT) AS token_count, CAST(end_a - start_a + 1 AS BIGINT) AS line_count
  FROM fo QUALIFY row_number() OVER (PARTITION BY path_a, g ORDER BY i DESC) = 1)"""

#: Taint as SQL: which definition reaches each use is fixed, so what it taints is reachability from the tainted ones.
_TAINT = """d AS MATERIALIZED (SELECT row_number() OVER () AS id, l_orderkey AS fn, 'v' || l_linenumber AS name, l_linenumber AS line, CAST(l_partkey AS INT) AS ord, CASE WHEN l_tax > 0.06 THEN 'clean' WHEN l_linenumber = 1 AND l_discount > 0.03 THEN 'tainted' ELSE 'unknown' END AS state FROM lineitem),
u AS (SELECT DISTINCT l_orderkey AS fn, 'v' || (l_linenumber - 1) AS name, l_linenumber AS line FROM lineitem WHERE l_linenumber > 1),
r AS (SELECT u.fn, u.line AS at, arg_max(d.id, d.line * 10000000000 + d.ord) AS src, max(d.line) AS since FROM u JOIN d ON d.fn = u.fn AND d.name = u.name AND d.line <= u.line GROUP BY u.fn, u.name, u.line),
way AS (SELECT src, e.id AS dst FROM r JOIN d e ON e.fn = r.fn AND e.line = r.at AND e.state = 'unknown' AND e.line > since),
t AS (SELECT id FROM d WHERE state = 'tainted' UNION SELECT dst FROM t JOIN way ON src = t.id)"""

ORACLES = {
    "taint_fixpoint": f"WITH RECURSIVE {_TAINT} SELECT CASE WHEN t.id IS NULL THEN d.state ELSE 'tainted' END AS state, d.line AS def_line, count(*) AS n FROM d LEFT JOIN t ON t.id = d.id GROUP BY ALL",
    "dup_blocks_merged": f"WITH RECURSIVE {_BLOCKS} SELECT * FROM blocks",
    "dup_largest_blocks": f"WITH RECURSIVE {_BLOCKS} SELECT * FROM blocks ORDER BY line_count DESC, path_a, start_a, path_b, start_b LIMIT 100",
    "diff_status_interval": "WITH h AS (SELECT o_orderkey, o_custkey % 6 + 1 AS s, o_custkey % 6 + o_orderkey % 3 AS e FROM orders WHERE o_orderkey % 3 > 0), m AS (SELECT l_linenumber, l_partkey, CASE WHEN EXISTS (SELECT 1 FROM h WHERE o_orderkey = l_orderkey AND l_linenumber + l_partkey % 3 >= s AND l_linenumber <= e) THEN 'new' ELSE 'context' END AS diff_status FROM lineitem) SELECT diff_status, l_linenumber, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS parts FROM m GROUP BY ALL",
    "diff_counts": "SELECT count(*) FILTER (WHERE n) AS new_findings, count(*) FILTER (WHERE NOT n) AS context_findings FROM (SELECT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderkey % 3 > 0 AND l_linenumber >= 2 AND l_linenumber <= 1 + o_orderkey % 3) AS n FROM lineitem)",
    "changed_files_prune": "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%') GROUP BY ALL",
    "sca_match_dotted": f"WITH {_DEPS} SELECT id, count(*) AS n, count(DISTINCT version) AS versions FROM hit GROUP BY id",
    "sca_findings": f"WITH {_DEPS}, r AS (SELECT *, 'sieve/sca/' || ecosystem || '/' || lower(id) AS rule_id, name || '@' || version AS snippet FROM hit) SELECT sha256(rule_id || lockfile_path || snippet) AS fingerprint, rule_id, {_CVSS.format('cvss_score')} AS severity, lockfile_path AS file_path, CAST(greatest(line, 1) AS BIGINT) AS start_line, snippet FROM r",
    "sca_match_semver": f"WITH {_DEPS} SELECT version, count(*) AS n FROM deps JOIN adv ON l_partkey = p_partkey WHERE v[1] * 10000 + v[2] * 100 + v[3] / 100.0 >= 10200 AND v[1] * 10000 + v[2] * 100 + v[3] / 100.0 < 20500 GROUP BY version",
    "purl": "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'pkg:npm/%40' || replace(p_brand, '@', '%40') || '/' || replace(p_name, '@', '%40') WHEN 1 THEN 'pkg:cargo/' || p_name WHEN 2 THEN 'pkg:maven/' || CASE WHEN p_partkey % 12 = 2 THEN p_brand || '/' || p_name ELSE p_name END WHEN 3 THEN 'pkg:golang/' || p_name WHEN 4 THEN 'pkg:pypi/' || lower(p_name) ELSE 'pkg:nuget/' || p_name END || '@' || p_size AS purl FROM part",
    "cvss_severity": f"SELECT p_partkey, {_CVSS.format('s')} AS severity FROM (SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN p_size / 5.0 END AS s FROM part)",
    "sbom_components": f"WITH {_DEPS}, d AS (SELECT DISTINCT name, version, ecosystem FROM deps) SELECT 'component-' || (row_number() OVER (ORDER BY name, version, ecosystem) - 1) AS ref, name, version, 'pkg:' || ecosystem || '/' || name || '@' || version AS purl FROM d",
    "distinct_dependencies": f"WITH {_DEPS}, d AS (SELECT name, version, ecosystem, min(lockfile_path) AS p FROM deps GROUP BY ALL) SELECT ecosystem, count(*) AS n, min(p) AS first_lockfile FROM d GROUP BY ecosystem",
    "advisory_upsert": "SELECT affected_range, count(*) AS n FROM (SELECT CASE WHEN p_size % 3 = 0 THEN '< 99' ELSE '<' || (p_size % 5) || '.' || p_size END AS affected_range FROM part) GROUP BY ALL",
    "token_windows": f"WITH {_WINDOWS} SELECT path, count(*) AS windows, min(hash) AS least_hash FROM v GROUP BY path",
    "dup_window_groups": f"WITH {_WINDOWS} SELECT hash, count(*) AS occurrences, count(DISTINCT path) AS files FROM v GROUP BY hash HAVING count(*) > 1",
    "dup_percentage": f"WITH {_WINDOWS}, r AS (SELECT * FROM v WHERE hash IN (SELECT hash FROM v GROUP BY hash HAVING count(*) > 1)), d AS (SELECT DISTINCT path, unnest(range(start_line, end_line + 1)) AS line FROM r) SELECT (SELECT count(*) FROM d) AS duplicated_lines, CAST(sum(m + 1) AS BIGINT) AS total_lines, (SELECT count(*) FROM d) / sum(m + 1) * 100 AS duplicate_pct FROM (SELECT path, max(line) AS m FROM n GROUP BY path)",
    "asof_last_def": "WITH e AS (SELECT event_id, CAST(user_id AS VARCHAR) AS name, epoch_us(ts) AS t, event_type FROM events), u AS (SELECT * FROM e WHERE event_type = 'purchase'), d AS (SELECT name, t FROM e WHERE event_type <> 'purchase') SELECT event_id AS use_id, u.name, u.t AS use_line, max(d.t) AS def_line FROM u LEFT JOIN d ON u.name = d.name AND d.t <= u.t GROUP BY ALL",
    "earliest_tainted": "WITH t AS (SELECT user_id, min(epoch_us(ts)) AS tainted_line FROM events WHERE value > 90 GROUP BY user_id) SELECT event_id, tainted_line FROM events JOIN t USING (user_id) WHERE tainted_line <= epoch_us(ts)",
    "sink_first_match": "WITH c AS (SELECT ['app.db.', 'x.', ''][event_id % 3 + 1] || ['query', 'exec', 'prequery', 'other'][user_id % 4 + 1] AS callee FROM events), s(ordinal, function) AS (VALUES (0, 'query'), (1, 'db.query'), (2, 'exec')) SELECT callee, (SELECT arg_min(function, ordinal) FROM s WHERE callee = function OR ends_with(callee, '.' || function)) AS function, count(*) AS n FROM c WHERE EXISTS (SELECT 1 FROM s WHERE callee = function OR ends_with(callee, '.' || function)) GROUP BY ALL",
    "call_resolve_3tier": "WITH f AS (SELECT DISTINCT 'n' || s_nationkey AS path, 'f' || s_suppkey % 40 AS name FROM supplier), k AS (SELECT *, path || '::' || name AS key FROM f), c AS (SELECT c_custkey AS call_id, 'n' || c_nationkey AS path, c_nationkey, 'f' || c_custkey % 40 AS name FROM customer) SELECT call_id, coalesce((SELECT min(key) FROM k WHERE k.path = c.path AND k.name = c.name), CASE WHEN c.name = 'f7' THEN (SELECT min(key) FROM k JOIN nation ON k.path = 'n' || n_regionkey AND n_nationkey = c.c_nationkey WHERE k.name = 'f3') END, (SELECT min(key) FROM k WHERE k.name = c.name)) AS callee_key FROM c",
    "reachability_depth5": "WITH RECURSIVE e AS (SELECT n_nationkey AS src, (n_nationkey * 3 + 1) % 25 AS dst FROM nation UNION SELECT n_nationkey, (n_nationkey * 7 + n_regionkey) % 25 FROM nation), r AS (SELECT r_regionkey AS entry, r_regionkey AS node, 0 AS depth FROM region UNION SELECT entry, dst, depth + 1 FROM r JOIN e ON node = src WHERE depth < 5) SELECT entry, node, min(depth) AS depth FROM r GROUP BY ALL",
    "import_candidates": "WITH i AS (SELECT n_regionkey AS r, n_nationkey % 4 AS k, 'src/a' || n_regionkey || '/f' || n_nationkey || '.ts' AS path, ['./m', '../lib/m', 'pkg.m', './none'][n_nationkey % 4 + 1] || CASE WHEN n_nationkey % 4 < 3 THEN CAST(n_regionkey AS VARCHAR) ELSE '' END AS module FROM nation), t AS (SELECT path, module, CASE WHEN k = 0 AND r IN (0, 1) THEN 'src/a' || r || '/m' || r || '.ts' WHEN k = 0 AND r = 2 THEN 'src/a2/m2/index.ts' WHEN k = 1 AND r = 3 THEN 'src/lib/m3.tsx' WHEN k = 1 AND r = 0 THEN 'src/lib/m0.py' WHEN k = 2 AND r = 4 THEN 'pkg/m4.py' END AS target FROM i) SELECT * FROM t WHERE target IS NOT NULL",
    "lru_keep_n": "SELECT CAST(event_id AS VARCHAR) AS key, ts AS accessed_at FROM events ORDER BY ts DESC, CAST(event_id AS VARCHAR) LIMIT 500",
    "version_invalidation": "SELECT p_partkey AS key FROM part WHERE p_brand = (SELECT min(p_brand) FROM part) AND p_type = (SELECT min(p_type) FROM part)",
    "discovery_counters": "WITH p AS (SELECT page_id, page_id % 6 AS k, octet_length(encode(html)) AS n FROM pages), d AS (SELECT CASE WHEN page_id % 9 = 0 THEN 'excluded' WHEN k IN (2, 5) THEN 'unsupported' WHEN n > 4096 THEN 'too_large' ELSE 'scanned' END AS d FROM p) SELECT count(*) FILTER (WHERE d = 'scanned') AS scanned, count(*) FILTER (WHERE d = 'excluded') AS excluded, count(*) FILTER (WHERE d = 'unsupported') AS unsupported, 0::BIGINT AS filtered, 0::BIGINT AS \"binary\", count(*) FILTER (WHERE d = 'too_large') AS too_large, 0::BIGINT AS not_utf8, count(*) AS total FROM d",
    "file_flags": "WITH f(k, path, is_test, is_example, is_generated, language) AS (VALUES (0, 'a/tests/x.py', true, false, false, 'Python'), (1, 'test_a.py', true, false, false, 'Python'), (2, 'latest.ts', false, false, false, 'TypeScript'), (3, '.env.example', false, true, false, NULL), (4, 'config.sample.ts', false, true, false, 'TypeScript'), (5, 'src/FooTests.cs', true, false, false, 'CSharp'), (6, 'b/x.spec.tsx', true, false, false, 'TypeScript'), (7, 'app.go', false, false, false, 'Go'), (8, 'lib/y.min.js', false, false, true, 'JavaScript'), (9, 'z.rb', false, false, false, 'Ruby')) SELECT path, count(*) AS n, is_test, is_example, is_generated, language FROM part JOIN f ON p_partkey % 10 = k GROUP BY ALL",
    "hunk_parse": "SELECT 'f' || o_orderkey AS path, CAST(o_orderkey % 50 AS INT) AS start_line, 3 AS line_count FROM orders UNION ALL SELECT 'f' || o_orderkey, CAST(o_custkey % 90 AS INT), 1 FROM orders",
    "version_order": "SELECT p_partkey, CASE WHEN p_size <> p_partkey % 50 THEN CASE WHEN p_size < p_partkey % 50 THEN -1 ELSE 1 END WHEN p_partkey % 3 = 0 THEN 1 WHEN p_partkey % 3 = 1 THEN 0 ELSE -1 END AS ordering FROM part",
    "complexity": "SELECT 'm/' || p_partkey || '.py' AS path, 'f' || p_partkey AS name, CAST(p_size % 6 + 3 AS BIGINT) AS loc, CAST(2 * (p_size % 6 + 1) + 1 AS BIGINT) AS cyclomatic, CAST((p_size % 6 + 1) * (p_size % 6 + 2) / 2 + p_size % 6 + 1 AS BIGINT) AS cognitive, 2::BIGINT AS parameters FROM part",
    "complexity_findings": "WITH m AS (SELECT 2 * (p_size % 6 + 1) + 1 AS a, (p_size % 6 + 1) * (p_size % 6 + 2) / 2 + p_size % 6 + 1 AS b FROM part) SELECT 'sieve/metrics/cyclomatic-complexity' AS rule_id, count(*) AS n FROM m WHERE a > 9 UNION ALL SELECT 'sieve/metrics/cognitive-complexity', count(*) FROM m WHERE b > 20",
    "pattern_search": "SELECT 'm/' || p_partkey || '.py' AS path, 'eval(a)' AS text, CAST(p_size % 6 + 3 AS BIGINT) AS start_line FROM part",
    "normal_paths": "SELECT n_nationkey, 'b/' || n_name || '/y' AS path FROM nation",
}
QUERIES = {f.__name__: f for f in (
    diff_status_interval, diff_counts, changed_files_prune, sca_match_dotted, sca_findings, sca_match_semver, purl, cvss_severity, sbom_components, distinct_dependencies, advisory_upsert, token_windows, dup_window_groups, dup_percentage,
    dup_blocks_merged, dup_largest_blocks, asof_last_def, earliest_tainted, taint_fixpoint, sink_first_match, call_resolve_3tier, reachability_depth5, import_candidates, lru_keep_n, version_invalidation, discovery_counters, file_flags, hunk_parse,
    version_order, complexity, complexity_findings, pattern_search, normal_paths,
)}
