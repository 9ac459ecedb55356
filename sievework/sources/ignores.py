"""Ignore files in any folder of a tree: which paths they leave out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

#: Names of ignore files.
NAMES = (".gitignore", ".ignore")
RULES = "folder string, line long, pattern string, back boolean, folders_only boolean"


def read_ignore_files(spark: SparkSession, root: str) -> DataFrame:
    """relative_path and content of the ignore files below a folder.

    Spark's own readers pass over names that begin with a dot, so the driver lists the folder and reads these
    files, which are few and small.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(root)
    system = top.getFileSystem(conf)
    base, out = system.makeQualified(top).toString().rstrip("/"), []
    each = system.listFiles(top, True)
    while each.hasNext():
        path = each.next().getPath()
        if path.getName() in NAMES:
            stream = system.open(path)
            out.append((path.toString()[len(base) + 1 :], bytearray(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))))
            stream.close()
    return spark.createDataFrame(out, "relative_path string, content binary")


def _rule(raw: str) -> tuple[str, bool, bool] | None:
    """Pattern (of the path from the ignore file's folder), whether it takes back in, and whether it is for folders only."""
    line = raw.rstrip()
    if not line or line.startswith("#"):
        return None
    back, line = line.startswith("!"), line.removeprefix("!")
    folders_only, line = line.endswith("/"), line.rstrip("/")
    rooted = "/" in line
    return ("^" if rooted else "^(?:.*/)?") + text.glob_pattern(line.lstrip("/")) + "$", back, folders_only


def rules(ignore_files: DataFrame) -> DataFrame:
    """folder, line, pattern, back and folders_only of each line of ignore files (relative_path, content)."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["relative_path"], batch["content"], strict=True):
                folder = path.rpartition("/")[0]
                lines = bytes(content or b"").decode("utf-8", "replace").splitlines()
                out += [(folder, k, *rule) for k, raw in enumerate(lines) if (rule := _rule(raw))]
            yield pd.DataFrame(out, columns=["folder", "line", "pattern", "back", "folders_only"])

    return ignore_files.select("relative_path", "content").mapInPandas(parse, RULES)


def _joined(parts: Column, start: Column | int, size: Column) -> Column:
    return F.array_join(F.slice(parts, start, size), "/")


def ignored(files: DataFrame, held: DataFrame) -> DataFrame:
    """relative_path of the files that ``held`` (see ``rules``) leaves out.

    Of the rules that fit a path, the last line of the deepest folder's file decides; what lies below a
    folder that is left out stays out. Rules meet folders and files by an equi-join on the folder that they
    are in, and every folder is judged once, however many files it has.
    """
    parts = F.split("relative_path", "/")
    places = files.select("relative_path", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("k"), parts.alias("parts"))
    places = places.select("relative_path", _joined(F.col("parts"), 1, F.col("k")).alias("place"), (F.col("k") < F.size("parts")).alias("is_folder"))
    own = F.split("place", "/")
    above = places.select("place", "is_folder").distinct().select("place", "is_folder", own.alias("parts"), F.explode(F.sequence(F.lit(0), F.size(own) - 1)).alias("depth"))
    above = above.select("place", "is_folder", "depth", _joined(F.col("parts"), 1, F.col("depth")).alias("folder"), _joined(F.col("parts"), F.col("depth") + 1, F.size("parts")).alias("rest"))
    fits = above.join(held, "folder").where(F.rlike("rest", F.col("pattern")) & (F.col("is_folder") | ~F.col("folders_only")))
    judged = fits.groupBy("place", "is_folder").agg(F.max_by("back", F.struct("depth", "line")).alias("back")).where("NOT back")
    return places.join(judged.select("place", "is_folder"), ["place", "is_folder"], "left_semi").select("relative_path").distinct()
