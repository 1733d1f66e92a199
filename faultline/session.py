"""The workers' import path, and tables that are worked out once."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[1])
#: Rows up to which a narrow table goes to every task.
FEW = 200_000


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where the driver found it; on a cluster it is installed there."""
    environment = spark.sparkContext.environment
    if ROOT not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, environment.get("PYTHONPATH")) if x)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.  Only a local session may do without; a cluster must name one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="faultline-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and go on from there: it is worked out once, outlives executors, and what is
    built on it reads only the columns that it needs."""
    out = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(out)
    return df.sparkSession.read.schema(df.schema).parquet(out)


def few(df: DataFrame) -> DataFrame:
    """A narrow staged table as a join's small side: broadcast behind a count of its rows, else left to a shuffle."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df
