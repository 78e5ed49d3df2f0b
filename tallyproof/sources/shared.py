"""Intermediate tables of iterative operators, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir; where that is unset, on one machine a temporary one, and refused on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    master = spark.sparkContext.master
    if not base and master.startswith("local") and not master.startswith("local-cluster"):
        base = tempfile.mkdtemp(prefix="tallyproof-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    if not base:
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    return f"{base.rstrip('/')}/tallyproof-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows, written once and read again, so that a loop's plan doesn't grow and lost executors cost one round."""
    where = shared_folder(df.sparkSession)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def ship_code(spark: SparkSession) -> None:
    """Let Python workers import this package where it lies at the same path as on the driver."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
