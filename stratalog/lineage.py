"""Cutting a plan where several branches read the same intermediate rows."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that the session names. A private one is made in local mode only; a cluster must name one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="stratalog-"))
    return sc.getCheckpointDir()


def shared(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder once; what follows reads them there, also after executors are lost."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()
