"""Lineage cuts for iterative operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares. Where none is set, a local one serves a session whose tasks
    run on the driver's machine; a cluster must set it."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not context.getCheckpointDir():
        if not path and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="riskweave-"))
    return (path or context.getCheckpointDir()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
