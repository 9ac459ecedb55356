"""Versions: dotted comparison in plain expressions, and semantic version ranges."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _order(a: Column, b: Column) -> Column:
    """-1, 0 or 1 of two parts: as numbers if both are, else as text."""
    number = lambda x: F.when(x.rlike(r"^\+?[0-9]{1,20}$"), x.try_cast("decimal(38,0)"))
    x, y = number(a), number(b)
    as_numbers = x.isNotNull() & y.isNotNull()
    return F.when(as_numbers & (x < y), -1).when(as_numbers & (x > y), 1).when(as_numbers, 0).when(a < b, -1).when(a > b, 1).otherwise(0)


def dotted_order(a: Column, b: Column) -> Column:
    """-1, 0 or 1: dotted versions compared part by part, missing parts as 0."""
    left, right = F.split(a, r"\."), F.split(b, r"\.")
    places = F.sequence(F.lit(0), F.greatest(F.size(left), F.size(right)) - 1)
    orders = F.transform(places, lambda i: _order(F.coalesce(F.get(left, i), F.lit("0")), F.coalesce(F.get(right, i), F.lit("0"))))
    return F.coalesce(F.get(F.filter(orders, lambda x: x != 0), F.lit(0)), F.lit(0))


def dotted_key(version: Column) -> Column:
    """A text that sorts as a dotted version of numbers does; null if a part isn't a number of up to 20 digits.

    Parts have a fixed width and last parts of zero are left out, as missing parts count as 0.
    """
    parts = F.transform(F.split(version, r"\."), lambda p: F.lpad(F.regexp_replace(p, r"^\+", ""), 20, "0"))
    numbers = version.rlike(r"^\+?[0-9]{1,20}(\.\+?[0-9]{1,20})*$")
    return F.when(numbers, F.regexp_replace(F.array_join(parts, ""), "(0{20})+$", ""))


def upper_limit(range_: Column) -> Column:
    """The parts of ``< x`` and ``<= x``: version, key (see ``dotted_key``) and whether it is included; null for any other form."""
    plain = F.regexp_replace(range_, r"^\s+|\s+$", "")
    version = F.regexp_replace(F.regexp_extract(plain, r"^<=?(.*)$", 1), r"^\s+|\s+$", "")
    limit = F.struct(version.alias("version"), dotted_key(version).alias("key"), plain.startswith("<=").alias("included"))
    return F.when(plain.startswith("<"), limit)


def within(installed: Column, key: Column, limit: Column) -> Column:
    """Whether a version, with its key, is below a limit: both are read once a row, not once a pair."""
    by_key = (key < limit["key"]) | (limit["included"] & (key == limit["key"]))
    order = dotted_order(installed, limit["version"])
    by_parts = F.when(limit["included"], order <= 0).otherwise(order < 0)
    return F.when(limit.isNull(), False).when(key.isNotNull() & limit["key"].isNotNull(), by_key).otherwise(by_parts)


def below(installed: Column, range_: Column) -> Column:
    """Whether a version is within ``< x`` or ``<= x``; false for any other form."""
    return within(installed, dotted_key(installed), upper_limit(range_))


@dataclass(frozen=True, order=True)
class Version:
    """major, minor, patch, and the pre-release as a key that sorts as semantic versioning demands."""

    major: int
    minor: int
    patch: int
    before: tuple = ((1,),)

    @property
    def final(self) -> bool:
        return self.before == ((1,),)


_NUMBER = r"(?:0|[1-9]\d*)"
_VERSION = re.compile(rf"({_NUMBER})\.({_NUMBER})\.({_NUMBER})(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?")
_CLAUSE = re.compile(rf"(=|>=|>|<=|<|~|\^)?\s*(?:({_NUMBER})(?:\.({_NUMBER}|[*xX])(?:\.({_NUMBER}|[*xX])(?:-([0-9A-Za-z.-]+))?)?)?|([*xX]))(?:\+[0-9A-Za-z.-]+)?")


def _pre(text: str | None) -> tuple:
    if not text:
        return ((1,),)
    return (*((0, 0, int(p), "") if p.isdigit() else (0, 1, 0, p) for p in text.split(".")), (-1,))


@lru_cache(1 << 16)
def parse_version(text: str) -> Version | None:
    m = _VERSION.fullmatch(text)
    return Version(int(m[1]), int(m[2]), int(m[3]), _pre(m[4])) if m else None


def _clause(text: str):  # noqa: ANN202
    """(test, version with a pre-release or None) of one comparator; None if it can't be read."""
    m = _CLAUSE.fullmatch(text.strip())
    if not m:
        return None
    if m[6]:
        return (lambda v: True), None
    number = lambda x: None if x is None or x in "*xX" else int(x)
    op, major, minor, patch = m[1] or "^", int(m[2]), number(m[3]), number(m[4])
    if any(x and x in "*xX" for x in (m[3], m[4])) and m[1] is None:
        op = "="
    base = Version(major, minor or 0, patch or 0, _pre(m[5]))
    after = Version(major + 1, 0, 0, ((-2,),)) if minor is None else Version(major, minor + 1, 0, ((-2,),)) if patch is None else None  # above all that the partial version names
    tests = {
        "=": lambda v: v == base if after is None else base <= v < after,
        ">": lambda v: v > base if after is None else v >= after,
        ">=": lambda v: v >= base,
        "<": lambda v: v < base,
        "<=": lambda v: v <= base if after is None else v < after,
        "~": lambda v: base <= v < (after or Version(major, (minor or 0) + 1, 0, ((-2,),))),
        "^": lambda v: base <= v < (Version(major + 1, 0, 0, ((-2,),)) if major or minor is None else Version(0, minor + 1, 0, ((-2,),)) if minor or patch is None else Version(0, 0, patch + 1, ((-2,),))),
    }
    return tests[op], (base if m[5] else None)


@lru_cache(1 << 16)
def _clauses(range_: str) -> list:
    return [_clause(c) for c in range_.split(",")] if range_.strip() else [((lambda v: True), None)]


def semver_matches(installed: str, range_: str) -> bool | None:
    """Whether a version is in a comma-parted range; None if either can't be read.

    A pre-release is in the range only if some comparator names a pre-release of the same three numbers.
    """
    version, clauses = parse_version(installed), _clauses(range_)
    if version is None or any(c is None for c in clauses):
        return None
    if not all(test(version) for test, _ in clauses):
        return False
    return version.final or any(pre and (pre.major, pre.minor, pre.patch) == (version.major, version.minor, version.patch) for _, pre in clauses)


def _semver(installed: pd.Series, range_: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else semver_matches(a, b) for a, b in zip(installed, range_, strict=True)], dtype=object)


SEMVER = ("npm", "cargo", "nuget", "go")


def plain_version(installed: Column, ecosystem: Column) -> Column:
    return F.when(ecosystem == "go", F.regexp_replace(installed, "^v", "")).otherwise(installed)


def semver_match(plain: Column, range_: Column, ecosystem: Column) -> Column:
    """Whether a version is in a semantic range; null where the ecosystem has none or either can't be read."""
    return F.when(ecosystem.isin(*SEMVER), F.pandas_udf(_semver, "boolean")(plain, range_))


def version_matches(installed: Column, range_: Column, ecosystem: Column) -> Column:
    """Whether a version is affected: a semantic range where the ecosystem has them and both can be read, else dotted ``<`` and ``<=``."""
    plain = plain_version(installed, ecosystem)
    return F.coalesce(semver_match(plain, range_, ecosystem), below(plain, range_), F.lit(False))
