"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder in local mode (tests), else an error.

    On a cluster a machine's own folder would hold what its tasks wrote and
    nothing of the others, so there the setting is required.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="glyphledger-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")
