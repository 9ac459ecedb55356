"""Findings: text rules over files, severity caps, order, de-duplication and suppression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranks, text


@dataclass(frozen=True)
class TextRule:
    """A regular expression that is searched in every line; Java and RE2 must read it alike."""

    id: str
    severity: str
    confidence: str
    category: str
    cwe_id: str | None
    pattern: str
    remediation: str = ""


TEXT_RULES = (
    TextRule("text/secret/token-assignment", "critical", "high", "secrets", "CWE-798", r'(?i)\b(token|secret|password|api[_-]?key)\s*=\s*"[^"]{16,}"', "Move the value to a secret store."),
    TextRule("text/secret/hex-blob", "high", "medium", "secrets", "CWE-798", r"\b[0-9a-f]{40}\b", "Check whether the value is a credential."),
    TextRule("text/license/permissive", "info", "high", "quality", None, r"(?i)(MIT License|Apache License)", "Keep the notice."),
    TextRule("text/license/non-commercial", "medium", "high", "quality", None, r"(?i)CC BY-NC", "Don't use the text commercially."),
    TextRule("text/pii/email", "high", "high", "security", "CWE-359", r"[A-Za-z0-9._]+@[A-Za-z0-9.]+\.[a-z]{2,}", "Remove the address."),
    TextRule("text/pii/card-number", "high", "low", "security", "CWE-311", r"\b[0-9]{13,16}\b", "Remove the number."),
    TextRule("text/pii/ipv4", "medium", "medium", "security", "CWE-200", r"\b[0-9]{1,3}(\.[0-9]{1,3}){3}\b", "Remove the address."),
)


def files_of(docs: DataFrame) -> DataFrame:
    """Documents as files: path, language and text."""
    return docs.select(F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("file_path"), F.col("lang").alias("language"), F.coalesce("text", F.lit("")).alias("text"))


def scan(files: DataFrame, rules: tuple[TextRule, ...] = TEXT_RULES) -> DataFrame:
    """One finding for each line and rule that fit, from files (file_path, text).

    Rules are constants of one projection, so a file's lines are tested in one narrow pass, without a
    join; files in which no rule can fit don't unfold their lines. Patterns see one line at a time, so ``^`` and
    ``$`` are a line's ends; ``\\A`` and ``\\z`` aren't for them.
    """
    any_rule = F.lit(False)
    for r in rules:
        any_rule = any_rule | F.col("text").rlike("(?m)" + r.pattern)
    rows = files.where(any_rule).select("file_path", F.posexplode(text.lines(F.col("text"))).alias("at", "line"))
    found = [
        F.when(F.col("line").rlike(r.pattern), F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.confidence).alias("confidence"), F.lit(r.category).alias("category"), F.lit(r.cwe_id).cast("string").alias("cwe_id"), F.instr("line", F.regexp_extract("line", r.pattern, 0)).alias("start_col")))
        for r in rules
    ]
    rows = rows.withColumn("f", F.explode(F.array_compact(F.array(*found))))
    return rows.select(
        text.fingerprint(F.col("f.rule_id"), F.col("file_path"), F.col("line")).alias("fingerprint"), "f.rule_id", ranks.capped(F.col("f.severity"), F.col("f.confidence")).alias("severity"), "f.confidence", "f.category", "f.cwe_id",
        text.normal_path(F.col("file_path")).alias("file_path"), (F.col("at") + 1).cast("long").alias("start_line"), F.col("f.start_col").cast("long").alias("start_col"), F.col("line").alias("snippet"),
    )


def cap_severity(findings: DataFrame) -> DataFrame:
    return findings.withColumn("severity", ranks.capped(F.col("severity"), F.col("confidence")))


def with_confidence(findings: DataFrame, least: str) -> DataFrame:
    """Findings of at least this confidence."""
    return findings.where(ranks.rank(F.col("confidence"), ranks.CONFIDENCES) <= ranks.CONFIDENCES.index(least))


def valid_ranges(findings: DataFrame, start: tuple[str, str] = ("start_line", "start_col"), end: tuple[str, str] = ("end_line", "end_col")) -> DataFrame:
    """Findings whose range counts from 1 and doesn't end before it starts."""
    (sl, sc), (el, ec) = start, end
    return findings.where(f"{sl} >= 1 AND {sc} >= 1 AND {el} >= 1 AND {ec} >= 1 AND ({el} > {sl} OR ({el} = {sl} AND {ec} >= {sc}))")


ORDER = ("file_path", "start_line", "start_col", "rule_id")


def drop_adjacent(findings: DataFrame) -> DataFrame:
    """Drops a finding whose fingerprint is that of the one before it in the total order.

    The path leads the order and is part of the fingerprint, so files can be worked on apart.
    """
    order = Window.partitionBy("file_path").orderBy("start_line", "start_col", "rule_id", "fingerprint")
    before = F.lag("fingerprint").over(order)
    return findings.withColumn("_before", before).where("_before IS NULL OR _before != fingerprint").drop("_before")


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy(*ORDER, "fingerprint")


def severity_summary(findings: DataFrame) -> DataFrame:
    """One row: findings of each severity, and all."""
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in ranks.SEVERITIES]
    return findings.agg(*counts, F.count(F.lit(1)).alias("total"))


def applicable(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Pairs of files and rules: equal language, secrets rules not for exempt files, and marked rules not for tests.

    files: language, is_secrets_excluded, is_test_file; rules: rule_id, rule_language, category, skip_test_files.
    """
    fits = (F.col("language") == F.col("rule_language")) & ~((F.col("category") == "secrets") & F.col("is_secrets_excluded")) & ~(F.col("skip_test_files") & F.col("is_test_file"))
    return files.join(rules, fits)


DIRECTIVE = "sieve-ignore"


def directives(files: DataFrame, keyword: str = DIRECTIVE) -> DataFrame:
    """Inline suppressions (file_path, suppressed_line, rule_id, reason) of files (file_path, text).

    A comment sign must stand right before the keyword; only a line's first keyword counts; an empty or
    unclosed bracket names no rule.
    """
    line = F.col("line")
    rows = files.select("file_path", F.posexplode(text.lines(F.col("text"))).alias("at", "line")).where(line.contains(keyword))
    before, after = F.substring_index(line, keyword, 1), F.substring(line, F.instr(line, keyword) + len(keyword), F.length(line))
    rows = rows.withColumns({"before": before, "after": after}).where(F.col("before").rlike(r"(//|#|/\*)\s*$"))
    next_line = F.startswith("after", F.lit("-next-line"))
    rest = F.when(next_line, F.substring("after", 11, F.length("after"))).otherwise(F.col("after"))
    rows = rows.withColumns({"next": next_line, "rest": rest})
    id_ = text.trimmed(F.regexp_extract("rest", r"^\[([^\]]*)\]", 1))
    reason = text.trimmed(F.regexp_replace(text.trimmed(F.regexp_replace("rest", r"^\[[^\]]*\]", "")), r"(\*/)+$", ""))
    return rows.select("file_path", (F.col("at") + 1 + F.col("next").cast("int")).alias("suppressed_line"), F.nullif(id_, F.lit("")).alias("rule_id"), F.nullif(reason, F.lit("")).alias("reason"))


def inline_suppressed(findings: DataFrame, suppressions: DataFrame, kept: bool = True) -> DataFrame:
    """Findings that no directive on their line names (``kept``), or those that one does; a directive without a rule names all."""
    s = suppressions.select(F.col("file_path").alias("s_path"), F.col("suppressed_line").alias("s_line"), F.col("rule_id").alias("s_rule"))
    on = (F.col("file_path") == F.col("s_path")) & (F.col("start_line") == F.col("s_line")) & (F.col("s_rule").isNull() | (F.col("s_rule") == F.col("rule_id")))
    return findings.join(s, on, "left_anti" if kept else "left_semi")


def policy_suppressed(findings: DataFrame, suppressions: DataFrame, today: Column | None = None) -> DataFrame:
    """Findings whose fingerprint no live suppression names; one that expires today is over."""
    today = F.date_format(F.current_date(), "yyyy-MM-dd") if today is None else today
    live = suppressions.where(F.col("expires").isNull() | (F.col("expires") > today)).select("fingerprint")
    return findings.join(live, "fingerprint", "left_anti")


def mask_secrets(findings: DataFrame) -> DataFrame:
    """Masks the snippets of secrets findings; the token walk has no plain expression, so these rows, and only they, go through Python."""
    import pandas as pd

    @F.pandas_udf("string")
    def walk(snippets: pd.Series) -> pd.Series:
        return snippets.map(text.masked_snippet)

    return findings.withColumn("snippet", F.when(F.col("category") == "secrets", walk(F.when(F.col("category") == "secrets", F.col("snippet")))).otherwise(F.col("snippet")))
