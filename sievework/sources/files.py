"""Files of a tree or of a table: language, flags, filters and counters."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from . import ignores

#: Languages by extension (case counts).
LANGUAGES = {
    ".ts": "TypeScript", ".tsx": "TypeScript", ".js": "JavaScript", ".jsx": "JavaScript", ".mjs": "JavaScript", ".cjs": "JavaScript",
    ".java": "Java", ".py": "Python", ".pyi": "Python", ".go": "Go", ".cs": "CSharp", ".rb": "Ruby", ".php": "Php", ".kt": "Kotlin", ".kts": "Kotlin",
}
#: Names of files whose secrets are examples.
EXAMPLE_NAMES = (".env.example", ".env.sample", ".env.template", ".env.defaults", ".env.test", ".env.development", ".env.local.example", "example.env", "sample.env")
EXAMPLE_PARTS = (".example.", ".sample.", ".template.")
#: Folders and name endings of tests.
TEST_FOLDERS = ("/tests/", "/test/", "/__tests__/", "/spec/", "/fixtures/", "/testdata/")
TEST_ENDINGS = ("_test.go", ".test.ts", ".test.js", ".test.tsx", ".test.jsx", ".spec.ts", ".spec.js", ".spec.tsx", ".spec.jsx", "Test.cs", "Tests.cs", "_test.py")
#: Endings of generated files, which duplication skips.
GENERATED_ENDINGS = (".designer.cs", "modelsnapshot.cs", ".g.cs", ".generated.cs", ".g.i.cs", ".min.js", ".min.css", ".bundle.js", ".chunk.js")
SNIFFED = 8192


def language(path: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair]), F.nullif(text.extension(path), F.lit("")))


def is_secrets_excluded(path: Column) -> Column:
    name = F.lower(text.file_name(path))
    out = name.isin(*EXAMPLE_NAMES)
    for part in EXAMPLE_PARTS:
        out = out | name.contains(part)
    return out


def is_test_file(path: Column) -> Column:
    whole, name = F.concat(F.lit("/"), F.translate(path, "\\", "/")), text.file_name(F.translate(path, "\\", "/"))
    return whole.rlike("|".join(map(re.escape, TEST_FOLDERS))) | name.rlike("(" + "|".join(map(re.escape, TEST_ENDINGS)) + r")$|^test_.*\.py$")


def is_generated(path: Column) -> Column:
    return F.lower(path).rlike("(" + "|".join(map(re.escape, GENERATED_ENDINGS)) + ")$")


def is_binary(content: Column) -> Column:
    """Whether there is a zero byte near the start."""
    return F.position(F.lit(bytes(1)), F.substring(content, 1, SNIFFED)) > 0


def relative_to(root: str) -> Column:
    """The column ``path`` from a folder on."""
    base = "file:" + str(Path(root).resolve()) if "://" not in root and not root.startswith("file:") else root.rstrip("/")
    return F.substring(F.col("path"), F.lit(len(base) + 2), F.length("path"))


def read_tree(spark: SparkSession, root: str, nested_ignores: bool = True) -> DataFrame:
    """path, relative_path and content of the files below a folder that aren't hidden or left out by an ignore file.

    nested_ignores: look for ignore files in every folder.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rows = files.select("path", relative_to(root).alias("relative_path"), "content").where(~F.col("relative_path").rlike(r"(^|/)\."))
    if nested_ignores:
        held = ignores.rules(ignores.read_ignore_files(spark, root))
        rows = rows.join(ignores.ignored(rows.select("relative_path"), held), "relative_path", "left_anti").select("path", "relative_path", "content")
    return rows


def ignore_patterns(lines: list[str]) -> tuple[list[str], list[str]]:
    """Patterns of paths that an ignore file leaves out, and of those that it takes back in."""
    out: tuple[list[str], list[str]] = ([], [])
    for raw in lines:
        line = raw.rstrip()
        if not line or line.startswith("#"):
            continue
        back, line = line.startswith("!"), line.lstrip("!")
        rooted, line = "/" in line.rstrip("/"), line.strip("/")
        out[back].append(("^" if rooted else "(^|.*/)") + text.glob_pattern(line) + "(/.*)?$")
    return out


def discovered(files: DataFrame, languages: list[str] | None = None, exclude: list[str] = (), ignore: list[str] = (), max_kib: int = 0) -> DataFrame:
    """Adds language, flags, text and disposition to files (relative_path, content).

    disposition: why a file isn't scanned (excluded, unsupported, filtered, binary, too_large, not_utf8), or scanned.
    """
    path = F.col("relative_path")
    away, back = ignore_patterns(list(ignore))
    globs = ["^" + text.glob_pattern(g) + "$" for g in exclude]
    excluded = F.lit(False)
    for pattern in globs + away:
        excluded = excluded | path.rlike(pattern)
    for pattern in back:
        excluded = excluded & ~path.rlike(pattern)
    decoded = F.col("content").cast("string")
    reason = F.when(excluded, "excluded").when(language(path).isNull(), "unsupported")
    if languages:
        reason = reason.when(~language(path).isin(*languages), "filtered")
    reason = reason.when(is_binary(F.col("content")), "binary")
    if max_kib:
        reason = reason.when(F.length("content") > max_kib * 1024, "too_large")
    reason = reason.when(~F.is_valid_utf8(decoded), "not_utf8").otherwise("scanned")
    return files.withColumns({"language": language(path), "is_secrets_excluded": is_secrets_excluded(path), "is_test_file": is_test_file(path), "disposition": reason}).withColumn("text", F.when(F.col("disposition") == "scanned", decoded))


DISPOSITIONS = ("scanned", "excluded", "unsupported", "filtered", "binary", "too_large", "not_utf8")


def discovery_stats(files: DataFrame) -> DataFrame:
    return files.agg(*[F.count_if(F.col("disposition") == d).alias(d) for d in DISPOSITIONS], F.count(F.lit(1)).alias("total"))


def languages_found(files: DataFrame) -> DataFrame:
    """One row: the languages, in the order of their declaration."""
    order = list(dict.fromkeys(LANGUAGES.values()))
    every = F.array(*[F.lit(x) for x in order])
    return files.where("disposition = 'scanned'").agg(F.collect_set("language").alias("s")).select(F.filter(every, lambda x: F.array_contains("s", x)).alias("languages"))
