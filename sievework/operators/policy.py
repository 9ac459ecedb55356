"""Policy: merging levels, baselines, changed lines, and the gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranks

TOTAL = "total"
THRESHOLD_KEYS = (*ranks.SEVERITIES, TOTAL)


def merge_thresholds(thresholds: DataFrame) -> DataFrame:
    """(level, category, severity, threshold) of merged policies: for each field the most specific policy that sets it; of equally specific ones the strictest.

    thresholds: policy (its level's name), level (fail or warn), category (null: all), severity, threshold.
    """
    specific = ranks.rank(F.col("policy"), ranks.POLICY_LEVELS)
    return thresholds.where("threshold IS NOT NULL").groupBy("level", "category", "severity").agg(F.max_by("threshold", F.struct(specific, -F.col("threshold"))).alias("threshold"))


def merge_suppressions(suppressions: DataFrame) -> DataFrame:
    """One row a fingerprint: that of the most specific policy."""
    order = Window.partitionBy("fingerprint").orderBy(ranks.rank(F.col("policy"), ranks.POLICY_LEVELS).desc(), "reason")
    return suppressions.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def merge_lists(lists: DataFrame) -> DataFrame:
    """The union of each list's entries over all policies (list, entry)."""
    return lists.select("list", "entry").distinct()


def baseline_of(findings: DataFrame) -> DataFrame:
    return findings.select("fingerprint").distinct()


def against_baseline(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """fingerprint and status: new, baselined or resolved."""
    a = current.select(F.col("fingerprint").alias("a")).distinct()
    b = baseline.select(F.col("fingerprint").alias("b")).distinct()
    status = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "resolved").otherwise("baselined")
    return a.join(b, F.col("a") == F.col("b"), "full").select(F.coalesce("a", "b").alias("fingerprint"), status.alias("status"))


def common_fingerprints(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("fingerprint").intersect(b.select("fingerprint"))


def missing_fingerprints(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("fingerprint").subtract(b.select("fingerprint"))


def invalid_baseline(rows: DataFrame) -> DataFrame:
    """Rows (pos, fingerprint) of a baseline's list that break it: not 64 lower-case hexadecimal digits, out of order, or double."""
    before = F.lag("fingerprint").over(Window.orderBy("pos"))  # a list from one file
    rows = rows.withColumn("_before", before)
    why = F.when(~F.col("fingerprint").rlike("^[0-9a-f]{64}$"), "format").when(F.col("_before") == F.col("fingerprint"), "double").when(F.col("_before") > F.col("fingerprint"), "order")
    return rows.withColumn("reason", why).where("reason IS NOT NULL").drop("_before")


def with_diff_status(findings: DataFrame, hunks: DataFrame) -> DataFrame:
    """Adds diff_status: new if the finding's lines touch a changed hunk of its file, else context.

    findings: file_path, start_line, end_line; hunks: path, start_line, line_count. A hunk without lines touches nothing.
    """
    h = hunks.where("line_count > 0").select(F.col("path").alias("h_path"), F.col("start_line").alias("h_start"), (F.col("start_line") + F.col("line_count") - 1).alias("h_end"))
    on = (F.col("file_path") == F.col("h_path")) & (F.col("end_line") >= F.col("h_start")) & (F.col("start_line") <= F.col("h_end"))
    touched = findings.join(h, on, "left_semi").withColumn("diff_status", F.lit("new"))
    others = findings.join(h, on, "left_anti").withColumn("diff_status", F.lit("context"))
    return touched.unionByName(others)


def in_changed_files(findings: DataFrame, changed: DataFrame) -> DataFrame:
    return findings.join(changed.select(F.col("path").alias("file_path")), "file_path", "left_semi")


def diff_counts(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count_if(F.col("diff_status") == "new").alias("new_findings"), F.count_if(F.col("diff_status") == "context").alias("context_findings"))


def gate_input(findings: DataFrame, baseline: DataFrame | None = None, diff: bool = False) -> DataFrame:
    """Findings that the gate counts: not in the baseline, and on changed lines if there is a diff."""
    if baseline is not None:
        findings = findings.join(baseline.select("fingerprint").distinct(), "fingerprint", "left_anti")
    return findings.where("diff_status = 'new'") if diff else findings


def gate_counts(findings: DataFrame) -> DataFrame:
    """category (null: all), severity (or total) and actual, in one pass over findings (category, severity)."""
    counts = findings.groupingSets([["category", "severity"], ["severity"], ["category"], []], "category", "severity").agg(F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("actual"))
    return counts.select(F.when(F.col("_g").isin(0, 1), F.col("category")).alias("category"), F.when(F.col("_g").isin(0, 2), F.col("severity")).otherwise(TOTAL).alias("severity"), "actual")


def breaches(findings: DataFrame, thresholds: DataFrame) -> DataFrame:
    """ordinal, level, category, severity, threshold and actual of every threshold that is exceeded.

    A threshold without findings counts 0; one that is null isn't checked; a category's warn thresholds
    have no effect. Order: fail, fail by category, warn; severities from critical to info, then total.
    """
    counts = gate_counts(findings).select(F.col("category").alias("c"), F.col("severity").alias("s"), "actual")
    asked = thresholds.where("threshold IS NOT NULL AND NOT (level = 'warn' AND category IS NOT NULL)")
    on = F.col("category").eqNullSafe(F.col("c")) & (F.col("severity") == F.col("s"))
    rows = asked.join(counts, on, "left").withColumn("actual", F.coalesce("actual", F.lit(0).cast("long"))).where("actual > threshold")
    step = F.when(F.col("level") == "warn", 2).when(F.col("category").isNotNull(), 1).otherwise(0)
    place = step * 1000 + F.coalesce(ranks.rank(F.col("category"), ranks.CATEGORIES), F.lit(0)) * 10 + ranks.rank(F.col("severity"), THRESHOLD_KEYS)
    return rows.select(place.cast("int").alias("ordinal"), "level", "category", "severity", F.col("threshold").cast("long").alias("threshold"), "actual")


def gate(findings: DataFrame, thresholds: DataFrame) -> DataFrame:
    """One row: the result (FAIL over WARN over PASS) and the number of breaches."""
    worst = F.coalesce(F.max(F.when(F.col("level") == "fail", 2).otherwise(1)), F.lit(0))
    return breaches(findings, thresholds).agg(ranks.member(worst, ranks.RESULTS).alias("result"), F.count(F.lit(1)).alias("breaches"))


def default_thresholds(spark) -> DataFrame:  # noqa: ANN001
    """The default policy: no critical finding."""
    return spark.createDataFrame([("project", "fail", None, "critical", 0)], "policy string, level string, category string, severity string, threshold long")


def hunk_header(line: Column) -> tuple[Column, Column]:
    """Start and number of the new lines of a hunk header; one line if no number is given."""
    pattern = r"^@@[^+]*\+(\d+)(?:,(\d+))?"
    count = F.regexp_extract(line, pattern, 2)
    return F.regexp_extract(line, pattern, 1).try_cast("int"), F.when(count == "", 1).otherwise(count.try_cast("int"))


def hunks_of(diffs: DataFrame) -> DataFrame:
    """path, start_line and line_count of the hunks in unified diffs (diff_id, diff)."""
    rows = diffs.select("diff_id", F.posexplode(F.split("diff", "\r?\n")).alias("pos", "line"))
    path = F.when(F.startswith("line", F.lit("diff --git ")), F.get(F.split("line", " b/"), F.lit(1)))
    order = Window.partitionBy("diff_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("path", F.last(path, ignorenulls=True).over(order)).where(F.startswith("line", F.lit("@@")))
    start, count = hunk_header(F.col("line"))
    return rows.select("path", start.alias("start_line"), count.alias("line_count")).where("path IS NOT NULL AND start_line IS NOT NULL")


def changed_files(status: DataFrame) -> DataFrame:
    """path and change_type of ``git diff --name-status`` lines (line); only A, M, C and R with a score count."""
    parts = F.split("line", "\t")
    letter = F.get(parts, F.lit(0))
    kind = F.when(letter == "A", "Added").when(letter == "M", "Modified").when(letter == "C", "Copied").when(letter.rlike("^R[0-9]*$"), "Renamed")
    path = F.when(letter.rlike("^R"), F.coalesce(F.get(parts, F.lit(2)), F.get(parts, F.lit(1)))).otherwise(F.get(parts, F.lit(1)))
    return status.select(path.alias("path"), kind.alias("change_type")).where("change_type IS NOT NULL AND path IS NOT NULL")
