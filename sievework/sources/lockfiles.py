"""Lockfiles of eight kinds as dependencies: name, version, ecosystem, lockfile_path, line (0: unknown)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

SCHEMA = "name string, version string, ecosystem string, lockfile_path string, line long"
SKIPPED_FOLDERS = ("node_modules", "vendor", ".git")


def _of(kind: str, files: DataFrame) -> DataFrame:
    path = F.col("path")
    skipped = path.rlike(r"(^|/)(" + "|".join(x.replace(".", r"\.") for x in SKIPPED_FOLDERS) + ")/")
    return files.where((text.file_name(path) == kind) & ~skipped)


def _rows(df: DataFrame, name: Column, version: Column, ecosystem: str, line: Column | None = None) -> DataFrame:
    line = F.lit(0) if line is None else line
    return df.select(name.alias("name"), version.alias("version"), F.lit(ecosystem).alias("ecosystem"), F.col("path").alias("lockfile_path"), line.cast("long").alias("line"))


def _lines(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(text.lines(F.col("text"))).alias("at", "raw")).withColumn("raw", text.trimmed(F.col("raw")))


def npm(files: DataFrame) -> DataFrame:
    """package-lock.json, versions 2 and 3."""
    kind = "struct<lockfileVersion: int, packages: map<string, struct<version: string>>>"
    rows = _of("package-lock.json", files).select("path", F.from_json("text", kind).alias("j")).where("j.lockfileVersion >= 2")
    rows = rows.select("path", F.explode("j.packages").alias("key", "p")).where("key != '' AND p.version IS NOT NULL")
    return _rows(rows, F.substring_index("key", "node_modules/", -1), F.col("p.version"), "npm")


def gradle(files: DataFrame) -> DataFrame:
    """gradle.lockfile: group:artifact:version=configurations."""
    rows = _lines(_of("gradle.lockfile", files)).where("raw != '' AND raw NOT LIKE '#%' AND raw NOT LIKE 'empty=%'")
    parts = F.split(F.substring_index("raw", "=", 1), ":", 3)
    rows = rows.withColumn("p", parts).where(F.size("p") == 3)
    return _rows(rows, F.concat_ws(":", F.get("p", F.lit(0)), F.get("p", F.lit(1))), F.get("p", F.lit(2)), "maven", F.col("at") + 1)


def go(files: DataFrame) -> DataFrame:
    """go.sum: module, version (without its ``v`` and ``/go.mod``) and hash; the first of equal ones."""
    rows = _lines(_of("go.sum", files)).withColumn("p", F.split("raw", r"\s+")).where(F.size("p") >= 2)
    rows = rows.withColumns({"name": F.get("p", F.lit(0)), "version": F.regexp_replace(F.regexp_replace(F.get("p", F.lit(1)), "/go\\.mod$", ""), "^v", "")})
    first = Window.partitionBy("path", "name", "version").orderBy("at")
    rows = rows.withColumn("n", F.row_number().over(first)).where("n = 1")
    return _rows(rows, F.col("name"), F.col("version"), "go", F.col("at") + 1)


def requirements(files: DataFrame) -> DataFrame:
    """requirements.txt: ``==``, or the lower bound of ``>=``; names in lower case, without extras."""
    rows = _lines(_of("requirements.txt", files)).where(r"raw != '' AND raw NOT LIKE '#%' AND raw NOT LIKE '-%'")
    pattern = r"^([^=<>!~;\[\s]+)(?:\[[^\]]*\])?\s*(?:==|>=)\s*([^,;\s#]+)"
    rows = rows.withColumns({"name": F.lower(F.regexp_extract("raw", pattern, 1)), "version": F.regexp_extract("raw", pattern, 2)}).where("name != '' AND version != ''")
    return _rows(rows, F.col("name"), F.col("version"), "pypi", F.col("at") + 1)


def pipfile(files: DataFrame) -> DataFrame:
    """Pipfile.lock: default and develop."""
    kind = "struct<default: map<string, struct<version: string>>, develop: map<string, struct<version: string>>>"
    rows = _of("Pipfile.lock", files).select("path", F.from_json("text", kind).alias("j"))
    entries = F.concat(*[F.coalesce(F.map_entries(f"j.{k}"), F.array().cast("array<struct<key: string, value: struct<version: string>>>")) for k in ("default", "develop")])
    rows = rows.select("path", F.explode(entries).alias("e")).where("e.value.version IS NOT NULL")
    return _rows(rows, F.lower("e.key"), F.regexp_replace("e.value.version", "^==", ""), "pypi")


def nuget(files: DataFrame) -> DataFrame:
    """packages.lock.json: framework, package, resolved version; the first of equal ones."""
    kind = "struct<dependencies: map<string, map<string, struct<resolved: string>>>>"
    rows = _of("packages.lock.json", files).select("path", F.from_json("text", kind).alias("j"))
    rows = rows.select("path", F.explode("j.dependencies").alias("framework", "d")).select("path", F.explode("d").alias("name", "p")).where("p.resolved IS NOT NULL")
    return _rows(rows.select("path", "name", "p.resolved").distinct(), F.col("name"), F.col("resolved"), "nuget")


def _cargo(source: str) -> list[tuple[str, str]]:
    import tomllib

    packages = tomllib.loads(source).get("package", [])
    return [(p["name"], p["version"]) for p in packages if isinstance(p.get("name"), str) and isinstance(p.get("version"), str)]


def _maven(source: str) -> list[tuple[str, str]]:
    from xml.etree import ElementTree

    out = []
    for node in ElementTree.fromstring(source).iter():
        if node.tag.rpartition("}")[2] == "dependency":
            held = {c.tag.rpartition("}")[2]: (c.text or "").strip() for c in node}
            if all(held.get(k) for k in ("groupId", "artifactId", "version")):
                out.append((f"{held['groupId']}:{held['artifactId']}", held["version"]))
    return out


def _parsed(files: DataFrame, kind: str, ecosystem: str, parse: Callable[[str], list[tuple[str, str]]]) -> DataFrame:
    """Files that only a Python parser reads; one that can't be read gives nothing."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, source in zip(batch["path"], batch["text"], strict=True):
                try:
                    found = parse(source)
                except Exception:  # noqa: BLE001  as many kinds as parsers have; such a lockfile is skipped
                    continue
                out += [(name, version, ecosystem, path, 0) for name, version in found]
            yield pd.DataFrame(out, columns=["name", "version", "ecosystem", "lockfile_path", "line"])

    return _of(kind, files).select("path", "text").mapInPandas(rows, SCHEMA)


def cargo(files: DataFrame) -> DataFrame:
    return _parsed(files, "Cargo.lock", "cargo", _cargo)


def maven(files: DataFrame) -> DataFrame:
    return _parsed(files, "pom.xml", "maven", _maven)


PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "package-lock.json": npm, "Cargo.lock": cargo, "pom.xml": maven, "gradle.lockfile": gradle,
    "go.sum": go, "requirements.txt": requirements, "Pipfile.lock": pipfile, "packages.lock.json": nuget,
}


def dependencies(files: DataFrame, parsers: dict[str, Callable[[DataFrame], DataFrame]] = PARSERS) -> DataFrame:
    """Dependencies of all lockfiles among files (path, text); more parsers may be given by file name."""
    out = None
    for parse in parsers.values():
        out = parse(files) if out is None else out.unionByName(parse(files))
    return out
