"""Changes of a working tree against a reference, by the git command."""

from __future__ import annotations

import subprocess
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators import policy


@dataclass
class Changes:
    """Changed files (path, change_type) and hunks (path, start_line, line_count); whole: the folder is in no repository, so all of it counts."""

    files: DataFrame | None
    hunks: DataFrame | None
    whole: bool = False


def _git(folder: str, *args: str) -> str:
    return subprocess.run(["git", "-C", folder, *args], check=True, capture_output=True, text=True).stdout


def changes(spark: SparkSession, folder: str, reference: str) -> Changes:
    """What changed below a folder since a reference; ValueError for one that git doesn't know."""
    try:
        _git(folder, "rev-parse", "--git-dir")
    except subprocess.CalledProcessError:
        return Changes(None, None, True)
    if reference.startswith("-"):
        raise ValueError(f"no reference: {reference}")
    try:
        _git(folder, "rev-parse", "--verify", "--quiet", f"{reference}^{{commit}}")
    except subprocess.CalledProcessError as e:
        raise ValueError(f"no reference: {reference}") from e
    scope = ["--relative", "--diff-filter=ACMR", reference, "--", "."]
    names = spark.createDataFrame([(x,) for x in _git(folder, "diff", "--name-status", *scope).splitlines()], "line string")
    diff = spark.createDataFrame([(0, _git(folder, "diff", "-U0", *scope))], "diff_id int, diff string")
    return Changes(policy.changed_files(names), policy.hunks_of(diff))


def is_prunable(files: int, changed: int) -> bool:
    """Whether pruning by changes saves much: no more than four fifths changed."""
    return changed * 5 <= files * 4
