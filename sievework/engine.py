"""A whole scan: files to findings, policy, gate and reports."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import dataclass, field
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import reachable, sinks
from .functions import text
from .operators import duplication, findings, metrics, policy, repeats, scopes, supply
from .operators.findings import TextRule
from .plans import patterns
from .sources import files as sources
from .sources import lockfiles, nodes, settings

COLUMNS = ("fingerprint", "rule_id", "severity", "confidence", "category", "cwe_id", "file_path", "start_line", "start_col", "snippet", "analysis_level")
RULES = Path(__file__).parent / "rules"

_KEY = "Move the value to a secret store and revoke it."
#: Public formats of credentials.
SECRET_RULES = (
    TextRule("sieve/secrets/generic/aws-access-key", "critical", "high", "secrets", "CWE-798", r"\b(AKIA|ASIA)[0-9A-Z]{16}\b", _KEY),
    TextRule("sieve/secrets/generic/azure-storage-key", "high", "high", "secrets", "CWE-798", r"AccountKey=[A-Za-z0-9+/]{86}==", _KEY),
    TextRule("sieve/secrets/generic/connection-string-password", "critical", "high", "secrets", "CWE-798", r"(?i)\b[a-z][a-z0-9+.-]*://[^:/\s]+:[^@/\s]{3,}@[^\s/]+", _KEY),
    TextRule("sieve/secrets/generic/generic-api-key", "high", "high", "secrets", "CWE-798", r"""(?i)\b(api[_-]?key|secret|token)\b\s*[:=]\s*["'][A-Za-z0-9_\-]{16,}["']""", _KEY),
    TextRule("sieve/secrets/generic/github-token", "critical", "high", "secrets", "CWE-798", r"\bgh[pousr]_[A-Za-z0-9]{36}\b", _KEY),
    TextRule("sieve/secrets/generic/gitlab-pat", "high", "high", "secrets", "CWE-798", r"\bglpat-[A-Za-z0-9_\-]{20}\b", _KEY),
    TextRule("sieve/secrets/generic/google-api-key", "high", "high", "secrets", "CWE-798", r"\bAIza[0-9A-Za-z_\-]{35}\b", _KEY),
    TextRule("sieve/secrets/generic/jwt-token", "high", "high", "secrets", "CWE-798", r"\beyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}", _KEY),
    TextRule("sieve/secrets/generic/npm-token", "high", "high", "secrets", "CWE-798", r"\bnpm_[A-Za-z0-9]{36}\b", _KEY),
    TextRule("sieve/secrets/generic/private-key-header", "critical", "high", "secrets", "CWE-798", r"-----BEGIN ([A-Z]+ )?PRIVATE KEY-----", _KEY),
    TextRule("sieve/secrets/generic/sendgrid-api-key", "high", "high", "secrets", "CWE-798", r"\bSG\.[A-Za-z0-9_\-]{22}\.[A-Za-z0-9_\-]{43}\b", _KEY),
    TextRule("sieve/secrets/generic/slack-webhook", "medium", "high", "secrets", "CWE-798", r"https://hooks\.slack\.com/services/T[A-Z0-9]+/B[A-Z0-9]+/[A-Za-z0-9]+", _KEY),
    TextRule("sieve/secrets/generic/twilio-api-key", "high", "high", "secrets", "CWE-798", r"\bSK[0-9a-f]{32}\b", _KEY),
)


def built_in_rules() -> list[dict]:
    """The rules that come with the package, checked."""
    rules = [r for p in sorted(RULES.glob("*.yaml")) for r in yaml.safe_load(p.read_text("utf-8"))]
    for r in rules:
        settings.check_rule(r)
    return rules


@dataclass
class Options:
    level: str = "L1"
    rules: list[dict] = field(default_factory=built_in_rules)
    least_confidence: str = "low"
    duplicate_tokens: int = duplication.WINDOW_TOKENS
    taint: dict = field(default_factory=lambda: scopes.PYTHON_TAINT)
    cyclomatic: int = metrics.MOST_CYCLOMATIC
    cognitive: int = metrics.MOST_COGNITIVE


def _shaped(rows: DataFrame, level: str) -> DataFrame:
    missing = {c: F.lit(None).cast("string") for c in ("cwe_id",) if c not in rows.columns}
    rows = rows.withColumns({**missing, "analysis_level": F.lit(level)})
    return rows.select(*[F.col(c).cast("int").alias(c) if c in ("start_line", "start_col") else c for c in COLUMNS])


def rule_findings(tree: DataFrame, rules: list[dict]) -> DataFrame | None:
    """Findings of pattern rules over nodes; a file's nodes stay together, so a cached table serves all rules."""
    out = None
    for r in rules:
        found = patterns.search(r["pattern"], tree)
        snippet = text.first_lines(F.col("text"))
        rows = found.select(
            text.fingerprint(F.lit(r["id"]), F.col("path"), snippet).alias("fingerprint"), F.lit(r["id"]).alias("rule_id"), F.lit(r["severity"]).alias("severity"), F.lit(r.get("confidence", "high")).alias("confidence"), F.lit(r["category"]).alias("category"),
            F.lit(r.get("cwe_id")).cast("string").alias("cwe_id"), text.normal_path(F.col("path")).alias("file_path"), "start_line", "start_col", snippet.alias("snippet"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def scan(spark: SparkSession, files: DataFrame, options: Options | None = None) -> DataFrame:
    """Findings of files (path, text, language, is_secrets_excluded, is_test_file), in order and without adjacent doubles.

    Caps, least confidence and inline suppressions hold for pattern and text rules; metrics, duplication and
    taint come after them. Nodes are parsed once and kept for all rules.
    """
    options = options or Options()
    python = files.where("language = 'Python'")
    tree = nodes.nodes_of(python.select("path", "text")).persist()
    searched = [r for r in options.rules if r.get("language", "Python") == "Python"]
    secrets = findings.scan(files.where("NOT is_secrets_excluded AND NOT is_test_file").select(F.col("path").alias("file_path"), "text"), SECRET_RULES)
    first = _shaped(secrets, "L1")
    if (by_rule := rule_findings(tree, searched)) is not None:
        first = first.unionByName(_shaped(findings.cap_severity(by_rule), "L1"))
    first = findings.with_confidence(first, options.least_confidence)
    quiet = findings.directives(files.select(F.col("path").alias("file_path"), "text")).withColumn("file_path", text.normal_path(F.col("file_path")))
    out = findings.inline_suppressed(first, quiet)
    measured = metrics.function_metrics(tree, metrics.LANGUAGES["Python"])
    out = out.unionByName(_shaped(metrics.threshold_findings(measured, options.cyclomatic, options.cognitive), "L1"))
    out = out.unionByName(_shaped(duplicate_findings(files.where(~sources.is_generated(F.col("path"))).select("path", "text"), options.duplicate_tokens), "L1"))
    if options.level in ("L2", "L3"):
        held = settings.sinks_frame(spark, options.taint)
        out = out.unionByName(_shaped(scopes.flow_findings(python, tree, held, options.taint), "L2"))
        if options.level == "L3":
            out = out.unionByName(_shaped(scopes.cross_file_findings(python, tree, held, options.taint), "L3"))
    return findings.ordered(findings.drop_adjacent(out))


def duplicate_findings(files: DataFrame, size: int, most: int = duplication.MOST_FINDINGS) -> DataFrame:
    """Findings of the largest duplicated blocks."""
    blocks = duplication.largest(duplication.merged_blocks(repeats.blocks(files, size)), most)
    rule = F.lit("sieve/quality/duplication")
    snippet = F.format_string("%d lines, also in %s:%d", "line_count", "path_b", F.col("start_b") + 1)
    return blocks.select(text.fingerprint(rule, F.col("path_a"), snippet).alias("fingerprint"), rule.alias("rule_id"), F.lit("low").alias("severity"), F.lit("high").alias("confidence"), F.lit("quality").alias("category"), text.normal_path(F.col("path_a")).alias("file_path"), (F.col("start_a") + 1).alias("start_line"), F.lit(0).alias("start_col"), snippet.alias("snippet"))


def dependency_findings(files: DataFrame, advisories: DataFrame) -> DataFrame:
    """Findings of lockfiles among files (path, text) against advisories."""
    return _shaped(supply.dependency_findings(supply.affected(lockfiles.dependencies(files), advisories)), "L1")


def main(argv: list[str] | None = None) -> int:
    """Scans a folder; ends with 1 if the gate fails."""
    ask = argparse.ArgumentParser(prog="sievework", description=main.__doc__)
    ask.add_argument("folder")
    ask.add_argument("--level", choices=("L1", "L2", "L3"), default="L1")
    ask.add_argument("--policy", help="a YAML file")
    ask.add_argument("--baseline", help="a JSON file of known fingerprints")
    ask.add_argument("--advisories", help="a Parquet table")
    ask.add_argument("--exclude", action="append", default=[])
    ask.add_argument("--format", default="json")
    ask.add_argument("--out", default="report")
    given = ask.parse_args(argv)
    formats = sinks.parse_formats(given.format)
    spark = reachable(SparkSession.builder.getOrCreate())
    tree = sources.read_tree(spark, given.folder)
    found = sources.discovered(tree, exclude=given.exclude).persist()
    files = found.where("disposition = 'scanned'").select(F.col("relative_path").alias("path"), "text", "language", "is_secrets_excluded", "is_test_file")
    rows = scan(spark, files, Options(level=given.level))
    if given.advisories:
        locks = found.where(text.file_name(F.col("relative_path")).isin(*lockfiles.PARSERS)).select(F.col("relative_path").alias("path"), F.col("content").cast("string").alias("text"))
        rows = rows.unionByName(dependency_findings(locks, spark.read.parquet(given.advisories)))
    policies = [yaml.safe_load(Path(given.policy).read_text("utf-8"))] if given.policy else [{"name": "default", "fail_on": {"critical": 0}}]
    limits, quiet = settings.policy_frames(spark, policies)
    rows = findings.policy_suppressed(rows, quiet).persist()
    known = spark.createDataFrame([(x,) for x in settings.load_baseline(given.baseline)], "fingerprint string") if given.baseline else None
    counted = policy.gate_input(rows, known)
    gate = policy.gate(counted, policy.merge_thresholds(limits))
    Path(given.out).mkdir(parents=True, exist_ok=True)
    if "json" in formats:
        document = {"schema_version": sinks.SCHEMA_VERSION, "summary": findings.severity_summary(rows).first().asDict(), "gate": gate.first().asDict(), "findings": [json.loads(r["json"]) for r in sinks.finding_lines(rows).toLocalIterator()]}
        Path(given.out, "report.json").write_text(json.dumps(document, indent=2, ensure_ascii=False), "utf-8")
    if "jsonl" in formats:
        sinks.write_lines(sinks.event_lines(rows, gate), f"{given.out}/events")
    if "sarif" in formats:
        named = spark.createDataFrame([(r["id"], r["severity"]) for r in built_in_rules()] + [(r.id, r.severity) for r in SECRET_RULES], "rule_id string, severity string")
        Path(given.out, "report.sarif").write_text(json.dumps(sinks.sarif(rows, named), indent=2, ensure_ascii=False), "utf-8")
    result = gate.first()["result"]
    print(f"{rows.count()} findings, {result}")
    return int(result == "FAIL")


if __name__ == "__main__":
    sys.exit(main())
