"""Queries over ``documents`` and ``conversations`` as files: findings, policy, cache and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sinks
from ..functions import ranks, text
from ..operators import cache, compliance, findings, metrics, policy


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


_RULES = ", ".join(f"({_sql(r.id)}, {_sql(r.severity)}, {_sql(r.confidence)}, {_sql(r.category)}, {_sql(r.cwe_id)}, {_sql(r.pattern)})" for r in findings.TEXT_RULES)
_RANK = "list_position(['critical', 'high', 'medium', 'low', 'info'], {})"
_TRIM = r"regexp_replace({}, '^[\s\x{{85}}\p{{Z}}]+|[\s\x{{85}}\p{{Z}}]+$', '', 'g')"
#: Findings as SQL: lines of files, the rules that fit, capped severities and fingerprints.
FINDINGS = rf"""
rules(rule_id, sev, confidence, category, cwe_id, pattern) AS (VALUES {_RULES}),
files AS (SELECT source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS file_path, lang AS language, coalesce(text, '') AS text FROM documents),
lines AS (SELECT file_path, unnest(string_split(CASE WHEN ends_with(text, chr(10)) THEN text[:-2] ELSE text END, chr(10))) AS raw, generate_subscripts(string_split(CASE WHEN ends_with(text, chr(10)) THEN text[:-2] ELSE text END, chr(10)), 1) AS start_line FROM files WHERE text <> ''),
clean AS (SELECT file_path, start_line, regexp_replace(raw, '\r$', '') AS line FROM lines),
findings AS (SELECT sha256(rule_id || file_path || {_TRIM.format("line")}) AS fingerprint, rule_id,
  ['critical', 'high', 'medium', 'low', 'info'][greatest({_RANK.format("sev")}, CASE confidence WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END)] AS severity, confidence, category, cwe_id, file_path, start_line,
  strpos(line, regexp_extract(line, pattern)) AS start_col, line AS snippet
  FROM clean JOIN rules ON regexp_matches(line, pattern))"""


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.scan(findings.files_of(table(spark, sf_dir, "documents")))


def scan_text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir)


def scan_summary_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.severity_summary(found(spark, sf_dir))


WORD_RULES = (findings.TextRule("text/style/short-line", "low", "low", "quality", None, r"^.{1,40}$"),)


def findings_dedup_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = findings.scan(findings.files_of(table(spark, sf_dir, "documents")), WORD_RULES)
    return findings.drop_adjacent(held).select("file_path", "start_line", "rule_id", "fingerprint")


def severity_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.cap_severity(_parts(spark, sf_dir)).groupBy("severity", "confidence").agg(F.count(F.lit(1)).alias("n"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as findings: severity, confidence and category by size and key."""
    size = F.col("p_size")
    pick = lambda values, by: F.get(F.array(*[F.lit(v) for v in values]), F.pmod(by, F.lit(len(values))).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", pick(ranks.SEVERITIES, size).alias("severity"), pick(ranks.CONFIDENCES, F.col("p_partkey")).alias("confidence"), pick(ranks.CATEGORIES, F.col("p_partkey")).alias("category"), (size / 5.0).alias("cvss"))


PARTS = """parts AS (SELECT p_partkey, ['critical', 'high', 'medium', 'low', 'info'][p_size % 5 + 1] AS severity, ['high', 'medium', 'low'][p_partkey % 3 + 1] AS confidence,
  ['security', 'quality', 'secrets', 'metrics', 'sca'][p_partkey % 5 + 1] AS category, p_size / 5.0 AS cvss FROM part)"""


def min_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.with_confidence(found(spark, sf_dir), "medium").groupBy("confidence", "severity").agg(F.count(F.lit(1)).alias("n"))


def _directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with an inline suppression, made from findings: every third one's line, with or without the rule's name, on it or before it."""
    rows = found(spark, sf_dir).where("start_line % 3 = 0").select("file_path", "start_line", "rule_id").distinct()
    after = F.when(F.col("start_line") % 2 == 0, F.concat(F.lit("["), "rule_id", F.lit("] known"))).otherwise(F.lit(" */"))
    line = F.concat(F.lit("x = 1 // "), F.lit(findings.DIRECTIVE), after)
    return rows.select("file_path", F.concat(F.repeat(F.lit("\n"), (F.col("start_line") - 1).cast("int")), line).alias("text"))


def inline_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = findings.directives(_directives(spark, sf_dir)).select("file_path", "suppressed_line", "rule_id").distinct()
    return findings.inline_suppressed(found(spark, sf_dir), held).select("fingerprint", "rule_id", "file_path", "start_line")


def _suppressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppressions of the fingerprints that begin with 0 to 3: without end, over, ending on the day, and live."""
    ends = F.when(F.startswith("fingerprint", F.lit("0")), F.lit(None).cast("string"))
    for digit, day in (("1", "2024-05-31"), ("2", "2024-06-01"), ("3", "2024-06-02")):
        ends = ends.when(F.startswith("fingerprint", F.lit(digit)), F.lit(day))
    return found(spark, sf_dir).where("fingerprint < '4'").select("fingerprint", F.lit("known").alias("reason"), ends.alias("expires")).distinct()


def policy_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.policy_suppressed(found(spark, sf_dir), _suppressions(spark, sf_dir), F.lit("2024-06-01")).select("fingerprint", "rule_id", "file_path", "start_line")


def _baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A baseline of the fingerprints that end in an odd digit, and of one a customer that no finding has."""
    old = found(spark, sf_dir).where(r"fingerprint RLIKE '[13579bdf]$'").select("fingerprint")
    return old.unionByName(table(spark, sf_dir, "supplier").select(F.sha2("s_name", 256).alias("fingerprint")))


BASELINE = "base AS (SELECT fingerprint FROM findings WHERE regexp_matches(fingerprint, '[13579bdf]$') UNION SELECT sha256(s_name) FROM supplier)"


def baseline_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.against_baseline(found(spark, sf_dir), _baseline(spark, sf_dir))


def baseline_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = found(spark, sf_dir), _baseline(spark, sf_dir)
    return policy.common_fingerprints(a, b).withColumn("side", F.lit("both")).unionByName(policy.missing_fingerprints(a, b).withColumn("side", F.lit("current")))


def baseline_new_only_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.gate(policy.gate_input(found(spark, sf_dir), _baseline(spark, sf_dir)), _thresholds(spark))


_LIMITS = (
    ("fail", None, "critical", 0), ("fail", None, "high", 1000000), ("fail", None, "total", 100), ("fail", None, "low", None), ("fail", "security", "medium", 3), ("fail", "secrets", "critical", 100000),
    ("fail", "sca", "info", 0), ("warn", None, "medium", 1), ("warn", None, "info", 1000000), ("warn", "security", "high", 0),
)


def _thresholds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(_LIMITS), "level string, category string, severity string, threshold long")


LIMITS = "limits(level, category, severity, threshold) AS (VALUES " + ", ".join(f"({_sql(a)}, {_sql(b)}, {_sql(c)}, {'NULL::BIGINT' if d is None else d})" for a, b, c, d in _LIMITS) + ")"
BREACHES = """counts AS (SELECT CASE WHEN grouping(category) = 0 THEN category END AS c, CASE WHEN grouping(severity) = 0 THEN severity ELSE 'total' END AS s, count(*) AS actual FROM input GROUP BY GROUPING SETS ((category, severity), (severity), (category), ())),
asked AS (SELECT * FROM limits WHERE threshold IS NOT NULL AND NOT (level = 'warn' AND category IS NOT NULL)),
breaches AS (SELECT CAST(CASE WHEN level = 'warn' THEN 2000 WHEN category IS NOT NULL THEN 1000 ELSE 0 END + coalesce(list_position(['security', 'quality', 'secrets', 'metrics', 'sca'], category) - 1, 0) * 10
  + list_position(['critical', 'high', 'medium', 'low', 'info', 'total'], severity) - 1 AS INT) AS ordinal, level, category, severity, CAST(threshold AS BIGINT) AS threshold, coalesce(actual, 0) AS actual
  FROM asked LEFT JOIN counts ON category IS NOT DISTINCT FROM c AND severity = s WHERE coalesce(actual, 0) > threshold)"""
GATE = "SELECT ['PASS', 'WARN', 'FAIL'][coalesce(max(CASE level WHEN 'fail' THEN 2 ELSE 1 END), 0) + 1] AS result, count(*) AS breaches FROM breaches"


def gate_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.gate(found(spark, sf_dir), policy.default_thresholds(spark))


def gate_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.breaches(_parts(spark, sf_dir), _thresholds(spark))


def gate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.gate_counts(_parts(spark, sf_dir))


def policy_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as policies: a level by region and a threshold by key, some without one."""
    rows = table(spark, sf_dir, "nation").select(
        F.get(F.array(*[F.lit(x) for x in ranks.POLICY_LEVELS]), F.pmod("n_nationkey", F.lit(4)).cast("int")).alias("policy"), F.when(F.col("n_nationkey") % 2 == 0, "fail").otherwise("warn").alias("level"),
        F.lit(None).cast("string").alias("category"), F.get(F.array(*[F.lit(x) for x in ranks.SEVERITIES]), F.pmod(F.floor(F.col("n_nationkey") / 4), F.lit(5)).cast("int")).alias("severity"),
        F.when(F.col("n_regionkey") != 3, F.col("n_nationkey").cast("long")).alias("threshold"),
    )
    return policy.merge_thresholds(rows).select("level", "severity", "threshold")


def jsonl_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = found(spark, sf_dir)
    return sinks.event_lines(held, policy.gate(held, policy.default_thresholds(spark))).select(F.get_json_object("json", "$.event_type").alias("event_type"), F.get_json_object("json", "$.data.fingerprint").alias("fingerprint"), F.get_json_object("json", "$.data.result").alias("result"), F.get_json_object("json", "$.data.findings").alias("findings"))


def sarif_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = found(spark, sf_dir).withColumn("level", sinks.sarif_level(F.col("severity")))
    return held.groupBy("rule_id", "level").agg(F.count(F.lit(1)).alias("results"))


def _rule_frame(spark: SparkSession) -> DataFrame:
    named = {"text/secret/hex-blob": [("pci", "P-2"), ("pci", "none")], "text/pii/email": [("gdpr", "G-1"), ("gdpr", "G-1")]}
    return spark.createDataFrame([(r.id, r.cwe_id, r.severity, named.get(r.id, [])) for r in findings.TEXT_RULES], "rule_id string, cwe_id string, severity string, compliance array<struct<framework: string, requirement: string>>")


_CATEGORIES = (("pci", "P-1", "Stored card data", ["CWE-311"]), ("pci", "P-2", "Credentials", ["CWE-798", "CWE-259"]), ("pci", "P-3", "Logging", []), ("gdpr", "G-1", "Personal data", ["CWE-359", "CWE-200"]), ("gdpr", "G-2", "Access", ["CWE-284"]))


def _category_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(_CATEGORIES), "framework string, category_id string, title string, cwe_mappings array<string>")


_COMPLIANCE = (
    "categories(framework, category_id, title, cwes) AS (VALUES " + ", ".join(f"({_sql(a)}, {_sql(b)}, {_sql(c)}, {d}::VARCHAR[])" for a, b, c, d in _CATEGORIES) + "),\n"
    "named(rule_id, framework, category_id) AS (VALUES ('text/secret/hex-blob', 'pci', 'P-2'), ('text/pii/email', 'gdpr', 'G-1')),\n"
    "weak AS (SELECT DISTINCT framework, category_id, unnest(cwes) AS cwe_id FROM categories),\n"
    "both_ways AS (SELECT rule_id, framework, category_id FROM named UNION SELECT rule_id, framework, category_id FROM rules JOIN weak USING (cwe_id))"
)


def compliance_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compliance.coverage(_rule_frame(spark), _category_frame(spark), found(spark, sf_dir))


def compliance_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compliance.finding_counts(found(spark, sf_dir), _rule_frame(spark), _category_frame(spark))


def compliance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compliance.coverage_summary(_rule_frame(spark), _category_frame(spark))


def sarif_used_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.used_rules(_rule_frame(spark), found(spark, sf_dir)).select("rule_id", "severity")


def ordered_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compliance.ordered_hash(found(spark, sf_dir), F.concat("rule_id", F.lit(":1.0.0\n")), "rules_version")


def applicable_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files with flags, against rules by language."""
    files = findings.files_of(table(spark, sf_dir, "documents")).select("file_path", "language", F.col("file_path").rlike("/1[0-9]*\\.txt$").alias("is_secrets_excluded"), F.col("file_path").rlike("^src1/").alias("is_test_file"))
    rules = spark.createDataFrame([("a", "en", "secrets", False), ("b", "en", "security", True), ("c", "fr", "quality", False), ("d", "xx", "quality", False)], "rule_id string, rule_language string, category string, skip_test_files boolean")
    return findings.applicable(files, rules).groupBy("rule_id").agg(F.count(F.lit(1)).alias("files"))


def loc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.line_counts(findings.files_of(table(spark, sf_dir, "documents")).select(F.col("file_path").alias("path"), "text"), prefix=r"^\s*(#|//|The )")


def loc_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = findings.files_of(table(spark, sf_dir, "documents"))
    return metrics.code_by_language(metrics.line_counts(files.select(F.col("file_path").alias("path"), "text"), prefix=r"^\s*(#|//|The )").join(files.select(F.col("file_path").alias("path"), "language"), "path"))


def context_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = findings.files_of(table(spark, sf_dir, "documents"))
    rows = files.select("file_path", F.size(text.lines(F.col("text"))).cast("long").alias("n_lines"), F.length(text.context(F.col("text"), F.lit(2), 1)).alias("n_chars"))
    return rows.select("file_path", "n_lines", F.col("n_chars").cast("long").alias("context_chars"))


def mask_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in double quotes, masked."""
    held = found(spark, sf_dir).where("rule_id = 'text/secret/token-assignment'")
    return held.select("fingerprint", text.masked(F.regexp_extract("snippet", '"([^"]{16,})"', 1)).alias("masked"))


def cache_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against a cache that holds the even ones."""
    files = findings.files_of(table(spark, sf_dir, "documents")).withColumn("key", cache.cache_key(F.col("file_path"), F.col("text"), "r1", "L1"))
    return cache.hit_rate(files.select("key"), files.where(r"file_path RLIKE '[02468]\\.txt$'").select("key"))


def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = findings.files_of(table(spark, sf_dir, "documents"))
    return files.select("file_path", cache.cache_key(F.col("file_path"), F.col("text"), "r1", "L1").alias("key"))


_W = f"WITH {FINDINGS} "
_LOC = r"""counted AS (SELECT file_path AS path, count(*) AS total_lines, count(*) FILTER (WHERE NOT blank AND NOT comment) AS code_lines, count(*) FILTER (WHERE blank) AS blank_lines, count(*) FILTER (WHERE comment) AS comment_lines
FROM (SELECT file_path, """ + _TRIM.format("line") + r""" = '' AS blank, regexp_matches(line, '^\s*(#|//|The )') AS comment FROM clean) GROUP BY file_path UNION ALL SELECT file_path, 0, 0, 0, 0 FROM files WHERE text = '')"""  # fmt: skip

ORACLES = {
    "scan_text_rules": _W + "SELECT * FROM findings",
    "scan_summary_by_severity": _W + "SELECT " + ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in ranks.SEVERITIES) + ", count(*) AS total FROM findings",
    "findings_dedup_adjacent": _W + ", f AS (SELECT 'text/style/short-line' AS rule_id, file_path, start_line, sha256('text/style/short-line' || file_path || " + _TRIM.format("line") + ") AS fingerprint FROM clean WHERE regexp_matches(line, '^.{1,40}$')) SELECT file_path, start_line, rule_id, fingerprint FROM (SELECT *, lag(fingerprint) OVER (PARTITION BY file_path ORDER BY start_line) AS b FROM f) WHERE b IS NULL OR b <> fingerprint",
    "severity_cap": f"WITH {PARTS} SELECT ['critical', 'high', 'medium', 'low', 'info'][greatest({_RANK.format('severity')}, CASE confidence WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END)] AS severity, confidence, count(*) AS n FROM parts GROUP BY ALL",
    "min_confidence": _W + "SELECT confidence, severity, count(*) AS n FROM findings WHERE confidence IN ('high', 'medium') GROUP BY ALL",
    "inline_suppression": _W + "SELECT fingerprint, rule_id, file_path, start_line FROM findings f WHERE NOT (start_line % 3 = 0)",
    "policy_suppression": _W + "SELECT fingerprint, rule_id, file_path, start_line FROM findings WHERE NOT (starts_with(fingerprint, '0') OR starts_with(fingerprint, '3'))",
    "baseline_diff": _W + f", {BASELINE} SELECT coalesce(a.fingerprint, b.fingerprint) AS fingerprint, CASE WHEN b.fingerprint IS NULL THEN 'new' WHEN a.fingerprint IS NULL THEN 'resolved' ELSE 'baselined' END AS status FROM (SELECT DISTINCT fingerprint FROM findings) a FULL JOIN base b ON a.fingerprint = b.fingerprint",
    "baseline_set_operations": _W + f", {BASELINE} SELECT fingerprint, 'both' AS side FROM (SELECT fingerprint FROM findings INTERSECT SELECT fingerprint FROM base) UNION ALL SELECT fingerprint, 'current' FROM (SELECT fingerprint FROM findings EXCEPT SELECT fingerprint FROM base)",
    "baseline_new_only_gate": _W + f", {BASELINE}, {LIMITS}, input AS (SELECT * FROM findings WHERE fingerprint NOT IN (SELECT fingerprint FROM base)), {BREACHES} {GATE}",
    "gate_global": _W + f", limits(level, category, severity, threshold) AS (VALUES ('fail', NULL::VARCHAR, 'critical', 0)), input AS (SELECT * FROM findings), {BREACHES} {GATE}",
    "gate_category": f"WITH {PARTS}, {LIMITS}, input AS (SELECT * FROM parts), {BREACHES} SELECT * FROM breaches",
    "gate_counts": f"WITH {PARTS} SELECT CASE WHEN grouping(category) = 0 THEN category END AS category, CASE WHEN grouping(severity) = 0 THEN severity ELSE 'total' END AS severity, count(*) AS actual FROM parts GROUP BY GROUPING SETS ((category, severity), (severity), (category), ())",
    "policy_merge": "SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'fail' ELSE 'warn' END AS level, ['critical', 'high', 'medium', 'low', 'info'][(n_nationkey // 4) % 5 + 1] AS severity, CAST(arg_max(n_nationkey, (n_nationkey % 4) * 1000 - n_nationkey) AS BIGINT) AS threshold FROM nation WHERE n_regionkey <> 3 GROUP BY ALL",
    "jsonl_events": _W + "SELECT 'scan_started' AS event_type, NULL AS fingerprint, NULL AS result, NULL AS findings UNION ALL SELECT 'finding_detected', fingerprint, NULL, NULL FROM findings UNION ALL SELECT 'gate_evaluated', NULL, CASE WHEN count(*) FILTER (WHERE severity = 'critical') > 0 THEN 'FAIL' ELSE 'PASS' END, NULL FROM findings UNION ALL SELECT 'scan_completed', NULL, NULL, CAST(count(*) AS VARCHAR) FROM findings",
    "sarif_levels": _W + "SELECT rule_id, CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS level, count(*) AS results FROM findings GROUP BY ALL",
    "compliance_coverage": _W + f", {_COMPLIANCE}, ways AS (SELECT n.framework, n.category_id FROM named n JOIN findings f ON n.rule_id = f.rule_id UNION ALL SELECT w.framework, w.category_id FROM weak w JOIN findings f ON w.cwe_id = f.cwe_id), hit AS (SELECT framework, category_id, count(*) AS finding_count FROM ways GROUP BY ALL), m AS (SELECT framework, category_id, count(DISTINCT rule_id) AS mapped_rules FROM both_ways GROUP BY ALL) SELECT c.framework, c.category_id, c.title, coalesce(mapped_rules, 0) AS mapped_rules, coalesce(finding_count, 0) AS finding_count, CASE WHEN coalesce(mapped_rules, 0) > 0 THEN 'Covered' ELSE 'No Coverage' END AS status FROM categories c LEFT JOIN m USING (framework, category_id) LEFT JOIN hit USING (framework, category_id)",
    "compliance_findings": _W + f", {_COMPLIANCE}, ways AS (SELECT n.framework, n.category_id FROM named n JOIN findings f ON n.rule_id = f.rule_id UNION ALL SELECT w.framework, w.category_id FROM weak w JOIN findings f ON w.cwe_id = f.cwe_id) SELECT framework, category_id, count(*) AS finding_count FROM ways GROUP BY ALL",
    "compliance_summary": _W + f", {_COMPLIANCE}, u AS (SELECT framework, count(DISTINCT rule_id) AS total_rules, count(DISTINCT category_id) AS covered_categories FROM both_ways GROUP BY ALL), t AS (SELECT framework, count(*) AS total_categories FROM categories GROUP BY ALL) SELECT t.framework, total_categories, coalesce(total_rules, 0) AS total_rules, coalesce(covered_categories, 0) AS covered_categories, coalesce(covered_categories, 0) / total_categories * 100 AS coverage_percentage FROM t LEFT JOIN u USING (framework)",
    "sarif_used_rules": _W + "SELECT rule_id, sev AS severity FROM rules WHERE rule_id IN (SELECT rule_id FROM findings)",
    "ordered_hash": _W + "SELECT sha256(string_agg(rule_id || ':1.0.0' || chr(10), '' ORDER BY rule_id)) AS rules_version FROM (SELECT DISTINCT rule_id FROM findings)",
    "applicable_rules": _W + r", r(rule_id, lang, category, skip) AS (VALUES ('a', 'en', 'secrets', false), ('b', 'en', 'security', true), ('c', 'fr', 'quality', false), ('d', 'xx', 'quality', false)) SELECT r.rule_id, count(*) AS files FROM files JOIN r ON language = lang AND NOT (category = 'secrets' AND regexp_matches(file_path, '/1[0-9]*\.txt$')) AND NOT (skip AND starts_with(file_path, 'src1/')) GROUP BY ALL",
    "loc_stats": _W + f", {_LOC} SELECT * FROM counted",
    "loc_by_language": _W + f", {_LOC} SELECT language, CAST(sum(code_lines) AS BIGINT) AS code_lines FROM counted JOIN files ON path = file_path GROUP BY language",
    "context_snippets": _W + ", n AS (SELECT file_path, count(*) AS n_lines, coalesce(sum(length(line)) FILTER (WHERE start_line <= 3), 0) + greatest(least(count(*), 3) - 1, 0) AS context_chars FROM clean GROUP BY file_path) SELECT file_path, coalesce(n_lines, 0) AS n_lines, CAST(coalesce(context_chars, 0) AS BIGINT) AS context_chars FROM files LEFT JOIN n USING (file_path)",
    "mask_secrets": _W + """SELECT fingerprint, substr(s, 1, 4) || '****' || right(s, 4) AS masked FROM (SELECT fingerprint, regexp_extract(snippet, '"([^"]{16,})"', 1) AS s FROM findings WHERE rule_id = 'text/secret/token-assignment')""",
    "cache_hit_rate": _W + r"SELECT count(*) AS files, count(*) FILTER (WHERE regexp_matches(file_path, '[02468]\.txt$')) AS hits, count(*) FILTER (WHERE regexp_matches(file_path, '[02468]\.txt$')) / count(*) AS hit_rate FROM files",
    "cache_keys": _W + "SELECT file_path, sha256(file_path || chr(31) || sha256(text) || chr(31) || 'r1' || chr(31) || 'L1') AS key FROM files",
}
QUERIES = {f.__name__: f for f in (
    scan_text_rules, scan_summary_by_severity, findings_dedup_adjacent, severity_cap, min_confidence, inline_suppression, policy_suppression, baseline_diff, baseline_set_operations, baseline_new_only_gate, gate_global, gate_category, gate_counts,
    policy_merge, jsonl_events, sarif_levels, compliance_coverage, compliance_findings, compliance_summary, sarif_used_rules, ordered_hash, applicable_rules, loc_stats, loc_by_language, context_snippets, mask_secrets, cache_hit_rate, cache_keys,
)}
