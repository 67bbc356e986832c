"""Where loops keep what they have computed.

A loop of n joins would otherwise carry a plan of n joins. Every round ends in a
reliable checkpoint in the folder that driver and executors share, so a lost
executor costs one round and never the loop.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a session of one machine (master local) may go without it and gets a
    temporary folder; on a cluster no folder but a named one is sure to be shared."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="weftgraph-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Computes df now and ends its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
