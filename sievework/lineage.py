"""Cutting the lineage of frames that are read more than once."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Rows of one Arrow batch: Spark's own setting counts rows as if they were short, and files aren't.
BATCH_ROWS, BATCH_KEY = "1500", "spark.sql.execution.arrow.maxRecordsPerBatch"


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the folder in ``spark.checkpoint.dir`` and reads on from there.

    A session on one machine that names none gets a temporary folder; on a cluster that is an error, as
    executors couldn't read it.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="sievework-"))
    return df.checkpoint()


def bounded(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches suit files, unless the session's owner chose their size."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_KEY) == "10000":
        conf.set(BATCH_KEY, BATCH_ROWS)
    return df


def sweep(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files of frames that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
