"""sievework: scans, findings, policy, supply-chain and corpus analytics as Spark programs."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def reachable(spark: SparkSession) -> SparkSession:
    """Lets Python workers started from now on import this package from where it is.

    That serves one machine; on a cluster, submit the package with ``--py-files`` or install it.
    """
    held = spark.sparkContext.environment
    paths = [p for p in held.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        held["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark
