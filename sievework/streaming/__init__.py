"""Streams: files are scanned as they arrive, and findings kept by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import cache, findings


def scan_arrivals(spark: SparkSession, landing: str, schema: str, out: str, checkpoint: str, rules_hash: str = "", to_files: Callable[[DataFrame], DataFrame] = findings.files_of) -> StreamingQuery:
    """Scans files that arrive in a folder, once each, and appends their findings with the key of what they depend on.

    A file is scanned by itself, so there is no state and no watermark; batches that are repeated after a
    failure replace their own folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        files = to_files(batch).withColumn("key", cache.cache_key(F.col("file_path"), F.col("text"), rules_hash, "L1"))
        found = findings.scan(files).join(files.select("file_path", "key"), "file_path")
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return spark.readStream.schema(schema).parquet(landing).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def severity_by_window(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of a stream's findings (ts, severity) in tumbling windows, closed when no late row can come."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "severity").agg(F.count(F.lit(1)).alias("findings"))
