"""Checkpoints below the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

from ..schema import EngineError


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or in local mode alone a folder of our own where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise EngineError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def checkpointed(spark: SparkSession, df: DataFrame) -> DataFrame:
    """df written below the shared folder and read from there."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()
