"""Ordered enumerations: their members in order, and expressions over their ranks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("critical", "high", "medium", "low", "info")
CATEGORIES = ("security", "quality", "secrets", "metrics", "sca")
CONFIDENCES = ("high", "medium", "low")
LEVELS = ("L1", "L2", "L3")
POLICY_LEVELS = ("organization", "team", "project", "local")
RESULTS = ("PASS", "WARN", "FAIL")
#: The highest severity that a finding of a confidence may have.
CEILING = {"high": "critical", "medium": "high", "low": "medium"}


def rank(value: Column, members: tuple[str, ...]) -> Column:
    """Place of a value among the members, from 0; null if it isn't one."""
    return F.nullif(F.array_position(F.array(*[F.lit(m) for m in members]), value), F.lit(0)) - 1


def member(place: Column, members: tuple[str, ...]) -> Column:
    return F.get(F.array(*[F.lit(m) for m in members]), place.cast("int"))


def capped(severity: Column, confidence: Column) -> Column:
    """The severity, lowered to the ceiling of the confidence."""
    ceiling = F.lit(0)
    for c, top in CEILING.items():
        ceiling = F.when(confidence == c, SEVERITIES.index(top)).otherwise(ceiling)
    return member(F.greatest(rank(severity, SEVERITIES), ceiling), SEVERITIES)


def cvss_severity(score: Column) -> Column:
    return F.when(score.isNull(), "medium").when(score >= 9.0, "critical").when(score >= 7.0, "high").when(score >= 4.0, "medium").when(score >= 0.1, "low").otherwise("info")


def vulnerability_severity(kind: Column) -> Column:
    return F.when(kind.isin("sql-injection", "command-injection"), "critical").when(kind.isin("xss", "path-traversal", "ssrf"), "high").otherwise("medium")
