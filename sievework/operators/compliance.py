"""Compliance: rules and findings against the categories of frameworks, and ordered hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def explicit_matches(rules: DataFrame, categories: DataFrame) -> DataFrame:
    """rule_id, framework, category_id by the entries that a rule names itself (rules: rule_id, compliance array of framework and requirement)."""
    named = rules.select("rule_id", F.explode("compliance").alias("c")).select("rule_id", F.col("c.framework").alias("framework"), F.col("c.requirement").alias("category_id"))
    return named.join(categories.select("framework", "category_id"), ["framework", "category_id"], "left_semi").select("rule_id", "framework", "category_id")


def cwe_matches(rules: DataFrame, categories: DataFrame) -> DataFrame:
    """rule_id, framework, category_id by weakness (rules: rule_id, cwe_id; categories: framework, category_id, cwe_mappings)."""
    mapped = categories.select("framework", "category_id", F.explode("cwe_mappings").alias("cwe_id")).distinct()
    return rules.select("rule_id", "cwe_id").join(mapped, "cwe_id").select("rule_id", "framework", "category_id")


def rule_matches(rules: DataFrame, categories: DataFrame) -> DataFrame:
    """Each rule at most once in a category."""
    return explicit_matches(rules, categories).unionByName(cwe_matches(rules, categories)).distinct()


def coverage(rules: DataFrame, categories: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """framework, category_id, title, mapped_rules, finding_count, status; categories without rules are kept."""
    mapped = rule_matches(rules, categories).groupBy("framework", "category_id").agg(F.count_distinct("rule_id").alias("mapped_rules"))
    out = categories.select("framework", "category_id", "title").join(mapped, ["framework", "category_id"], "left")
    out = out.withColumn("mapped_rules", F.coalesce("mapped_rules", F.lit(0).cast("long")))
    if findings is None:
        out = out.withColumn("finding_count", F.lit(0).cast("long"))
    else:
        out = out.join(finding_counts(findings, rules, categories), ["framework", "category_id"], "left").withColumn("finding_count", F.coalesce("finding_count", F.lit(0).cast("long")))
    return out.withColumn("status", F.when(F.col("mapped_rules") > 0, "Covered").otherwise("No Coverage"))


def coverage_summary(rules: DataFrame, categories: DataFrame) -> DataFrame:
    """framework, total_categories, covered_categories, total_rules, coverage_percentage."""
    unique = rule_matches(rules, categories).groupBy("framework").agg(F.count_distinct("rule_id").alias("total_rules"), F.count_distinct("category_id").alias("covered_categories"))
    all_ = categories.groupBy("framework").agg(F.count(F.lit(1)).alias("total_categories"))
    out = all_.join(unique, "framework", "left").na.fill(0, ["total_rules", "covered_categories"])
    return out.withColumn("coverage_percentage", F.when(F.col("total_categories") > 0, F.col("covered_categories") / F.col("total_categories") * 100).otherwise(0.0))


def finding_counts(findings: DataFrame, rules: DataFrame, categories: DataFrame, twice: bool = True) -> DataFrame:
    """Findings of each category, by their rule's entries and by their weakness.

    Findings are counted by rule and weakness first, so the joins work on a few rows. twice: one that
    matches both ways counts double.
    """
    by_rule = findings.groupBy("rule_id", "cwe_id").agg(F.count(F.lit(1)).alias("n"))
    named = explicit_matches(rules, categories).distinct().join(by_rule, "rule_id").select("framework", "category_id", "rule_id", "cwe_id", "n")
    mapped = categories.select("framework", "category_id", F.explode("cwe_mappings").alias("cwe_id")).distinct()
    weak = by_rule.join(mapped, "cwe_id").select("framework", "category_id", "rule_id", "cwe_id", "n")
    rows = named.unionByName(weak)
    return (rows if twice else rows.distinct()).groupBy("framework", "category_id").agg(F.sum("n").alias("finding_count"))


def ordered_hash(rows: DataFrame, entry, name: str, distinct: bool = True) -> DataFrame:  # noqa: ANN001
    """One row: SHA-256 of the sorted entries, joined; for tables as small as a rule set."""
    values = F.collect_set(entry) if distinct else F.collect_list(entry)
    return rows.agg(F.sha2(F.array_join(F.array_sort(values), ""), 256).alias(name))
