"""Storage that driver and executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Only where that is unset and Spark runs on this machine alone, a temporary folder takes its place."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir isn't set: on a cluster it must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tideway-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its rows written to the shared checkpoint folder and its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
