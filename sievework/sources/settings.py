"""Rules, frameworks, policies, baselines and taint settings from files, checked, as DataFrames."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..functions import ranks

RULE_SCHEMA = """rule_id string, name string, description string, severity string, category string, language string, analysis_level string, rule_type string, confidence string, pattern string, cwe_id string,
remediation string, references array<string>, tags array<string>, version string, metadata string, skip_test_files boolean, compliance array<struct<framework: string, requirement: string>>"""
BODIES = {"declarative": "pattern", "scripted": "script", "compiled": "plugin"}


def _yaml(path: Path):  # noqa: ANN202
    import yaml

    return yaml.safe_load(path.read_text("utf-8"))


def check_rule(rule: dict) -> None:
    """Raises ValueError for a rule without an id, with other than one body, with a body or level that its type doesn't have, or with an odd version."""
    if not rule.get("id"):
        raise ValueError("a rule has no id")
    kind = rule.get("rule_type", "declarative").lower()
    bodies = [b for b in BODIES.values() if rule.get(b) is not None]
    if len(bodies) != 1 or bodies[0] != BODIES.get(kind):
        raise ValueError(f"{rule['id']}: a {kind} rule has {', '.join(bodies) or 'no body'}")
    if (rule.get("analysis_level", "L1") == "L1") != (kind == "declarative"):
        raise ValueError(f"{rule['id']}: a {kind} rule can't be of level {rule.get('analysis_level', 'L1')}")
    if not re.fullmatch(r"\d+\.\d+\.\d+", str(rule.get("version", "1.0.0"))):
        raise ValueError(f"{rule['id']}: version {rule['version']}")
    for key, members in (("severity", ranks.SEVERITIES), ("category", ranks.CATEGORIES)):
        if str(rule.get(key, "")).lower() not in members:
            raise ValueError(f"{rule['id']}: {key} {rule.get(key)}")


def load_rules(folder: str) -> list[dict]:
    """All rules below a folder, by id; the first wrong one ends it."""
    rules = [_yaml(p) for p in sorted(Path(folder).rglob("*")) if p.suffix in (".yaml", ".yml")]
    for rule in rules:
        check_rule(rule)
    return sorted(rules, key=lambda r: r["id"])


def rules_frame(spark: SparkSession, rules: list[dict]) -> DataFrame:
    rows = [
        (
            r["id"], r.get("name"), r.get("description"), r["severity"].lower(), r["category"].lower(), r.get("language"), r.get("analysis_level", "L1"), r.get("rule_type", "declarative"), r.get("confidence", "medium"), r.get("pattern"),
            r.get("cwe_id"), r.get("remediation"), r.get("references", []), r.get("tags", []), str(r.get("version", "1.0.0")), json.dumps(r.get("metadata", {})), bool(r.get("skip_test_files")),
            [(c["framework"], c["requirement"]) for c in (r.get("metadata") or {}).get("compliance", [])],
        )
        for r in rules
    ]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def load_frameworks(spark: SparkSession, folder: str) -> DataFrame:
    """framework, category_id, title, cwe_mappings of the frameworks right in a folder."""
    files = sorted((_yaml(p) for p in Path(folder).iterdir() if p.suffix in (".yaml", ".yml")), key=lambda f: f["id"])
    rows = [(f["id"], c["id"], c.get("title"), c.get("cwe_mappings", [])) for f in files for c in f["categories"]]
    return spark.createDataFrame(rows, "framework string, category_id string, title string, cwe_mappings array<string>")


def check_policy(policy: dict) -> dict:
    if not policy.get("name"):
        raise ValueError("a policy has no name")
    if str(policy.get("schema_version", "1.0.0")) != "1.0.0":
        raise ValueError(f"schema version {policy['schema_version']}")
    if "fail_on" not in policy or policy.get("level", "project") not in ranks.POLICY_LEVELS:
        raise ValueError(f"policy {policy['name']}")
    return policy


def policy_frames(spark: SparkSession, policies: list[dict]) -> tuple[DataFrame, DataFrame]:
    """Thresholds (policy, level, category, severity, threshold) and suppressions (policy, fingerprint, reason, expires)."""
    limits, quiet = [], []
    for p in map(check_policy, policies):
        own = p.get("level", "project")
        parts = [("fail", None, p["fail_on"]), ("warn", None, p.get("warn_on") or {}), *(("fail", c, t or {}) for c, t in (p.get("category_overrides") or {}).items())]
        limits += [(own, level, category, s, t) for level, category, held in parts for s, t in held.items() if t is not None]
        quiet += [(own, s["fingerprint"], s.get("reason"), s.get("expires")) for s in p.get("suppressions", [])]
    return spark.createDataFrame(limits, "policy string, level string, category string, severity string, threshold long"), spark.createDataFrame(quiet, "policy string, fingerprint string, reason string, expires string")


def load_baseline(path: str) -> list[str]:
    """The fingerprints of a baseline; ValueError for a wrong version, count, form, order or double."""
    held = json.loads(Path(path).read_text("utf-8"))
    prints = held.get("fingerprints", [])
    if held.get("schema_version") != "1.0.0" or held.get("findings_count") != len(prints):
        raise ValueError("baseline: version or count")
    if any(not re.fullmatch("[0-9a-f]{64}", x) for x in prints) or any(a >= b for a, b in zip(prints, prints[1:], strict=False)):
        raise ValueError("baseline: fingerprints")
    return prints


def merge_taint(settings: list[dict]) -> dict:
    """Sources, sinks and sanitizers of all, one after the other; the last depth that is set."""
    out = {"sources": [], "sinks": [], "sanitizers": [], "max_depth": None}
    for s in settings:
        for key in ("sources", "sinks", "sanitizers"):
            out[key] += s.get(key) or []
        out["max_depth"] = s.get("max_depth", out["max_depth"])
    return out


def sinks_frame(spark: SparkSession, settings: dict) -> DataFrame:
    rows = [(k, s["function"], s.get("vulnerability", ""), s.get("tainted_args", [])) for k, s in enumerate(settings["sinks"])]
    return spark.createDataFrame(rows, "ordinal int, function string, vulnerability string, tainted_args array<int>")


def merged_config(*layers: dict) -> dict:
    """Defaults, home and project settings: lists are joined, each entry once; other values are replaced."""
    out: dict = {}
    for layer in layers:
        for key, value in layer.items():
            if isinstance(value, dict):
                out[key] = merged_config(out.get(key) or {}, value)
            elif isinstance(value, list):
                out[key] = list(dict.fromkeys([*(out.get(key) or []), *value]))
            elif value is not None:
                out[key] = value
    return out
