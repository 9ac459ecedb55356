"""Supply chain: dependencies against advisories, package URLs, and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranks, text, versions

ECOSYSTEMS = ("npm", "cargo", "maven", "go", "pypi", "nuget")


def purl(name: Column, version: Column, ecosystem: Column) -> Column:
    tail = F.concat(F.lit("@"), version)
    maven = F.when(name.contains(":"), F.concat(F.substring_index(name, ":", 1), F.lit("/"), F.substring(name, F.instr(name, ":") + 1, F.length(name)))).otherwise(name)
    return (
        F.when(ecosystem == "npm", F.concat(F.lit("pkg:npm/"), F.replace(name, F.lit("@"), F.lit("%40")), tail))
        .when(ecosystem == "maven", F.concat(F.lit("pkg:maven/"), maven, tail))
        .when(ecosystem == "go", F.concat(F.lit("pkg:golang/"), name, tail))
        .when(ecosystem == "pypi", F.concat(F.lit("pkg:pypi/"), F.lower(name), tail))
        .otherwise(F.concat(F.lit("pkg:"), ecosystem, F.lit("/"), name, tail))
    )


def distinct_dependencies(deps: DataFrame) -> DataFrame:
    """The first row (by lockfile and line) of each name, version and ecosystem."""
    order = Window.partitionBy("name", "version", "ecosystem").orderBy("lockfile_path", "line")
    return deps.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def affected(deps: DataFrame, advisories: DataFrame, plain: bool = False) -> DataFrame:
    """Dependencies joined to the advisories whose range their version is in.

    An equi-join on ecosystem and package; ranges are tested on the pairs it leaves. Versions and limits are
    read before the join, once a row. plain: dotted comparison only, without Python.
    """
    version = F.col("version") if plain else versions.plain_version(F.col("version"), F.col("ecosystem"))
    left = deps.withColumn("_plain", version).withColumn("_key", versions.dotted_key(F.col("_plain")))
    right = advisories.withColumnRenamed("ecosystem", "a_ecosystem").withColumn("_limit", versions.upper_limit(F.col("affected_range")))
    pairs = left.join(right, (F.col("ecosystem") == F.col("a_ecosystem")) & (F.col("name") == F.col("package_name")))
    hit = versions.within(F.col("_plain"), F.col("_key"), F.col("_limit"))
    if not plain:
        hit = F.coalesce(versions.semver_match(F.col("_plain"), F.col("affected_range"), F.col("ecosystem")), hit)
    return pairs.where(hit).drop("a_ecosystem", "_plain", "_key", "_limit")


def dependency_findings(matches: DataFrame, tool: str = "sieve") -> DataFrame:
    """Findings of dependencies joined to advisories."""
    rule = F.concat(F.lit(f"{tool}/sca/"), F.col("ecosystem"), F.lit("/"), F.lower("id"))
    snippet = F.concat_ws("@", "name", "version")
    score = F.coalesce("cvss_score", F.lit(0.0))
    details = F.to_json(F.struct("advisory_url", F.col("id").alias("cve_id"), score.alias("cvss_score"), "ecosystem", "fixed_version", F.col("version").alias("installed_version"), F.col("name").alias("package_name")), {"ignoreNullFields": "false"})
    return matches.select(
        text.fingerprint(rule, F.col("lockfile_path"), snippet).alias("fingerprint"), rule.alias("rule_id"), ranks.cvss_severity(F.col("cvss_score")).alias("severity"), F.lit("sca").alias("category"),
        text.normal_path(F.col("lockfile_path")).alias("file_path"), F.greatest(F.col("line"), F.lit(1)).alias("start_line"), F.lit(0).alias("start_col"), snippet.alias("snippet"), "description",
        F.when(F.col("fixed_version").isNotNull(), F.concat(F.lit("Upgrade "), "name", F.lit(" to "), "fixed_version", F.lit(" or later."))).otherwise(F.lit("No fixed version is known.")).alias("remediation"),
        F.lit("L1").alias("analysis_level"), F.lit("high").alias("confidence"), details.alias("metadata"),
    )


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both, the new one where a key is in both."""
    order = Window.partitionBy(*keys).orderBy(F.col("_new").desc())
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_new")


def is_stale(updated: Column, days: int = 30, today: Column | None = None) -> Column:
    """Whether a database's date (RFC 3339, or null) is more than some days ago."""
    day = F.split_part(updated, F.lit("T"), F.lit(1)).try_cast("date")
    return F.coalesce(F.date_diff(F.current_date() if today is None else today, day) > days, F.lit(True))


def database_info(advisories: DataFrame, metadata: DataFrame) -> DataFrame:
    count = advisories.agg(F.count(F.lit(1)).alias("advisories"))
    updated = metadata.where("key = 'last_updated'").agg(F.max("value").alias("last_updated"))
    return count.join(updated, F.lit(True))  # one row each
