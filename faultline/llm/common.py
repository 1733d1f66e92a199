"""Session helpers: tables, the shared folder, cutting lineage, and the workers' import path."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where the driver found it; on a cluster it is installed there."""
    environment = spark.sparkContext.environment
    if ROOT not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, environment.get("PYTHONPATH")) if x)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset a local
    session takes a temporary one and a cluster is refused."""
    context = spark.sparkContext
    if not (where := context.getCheckpointDir()):
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            where = tempfile.mkdtemp(prefix="faultline-")
        context.setCheckpointDir(where)
    return spark.conf.get("spark.checkpoint.dir", None) or where


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder's URI under the shared one; nothing is created yet."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """Compute once, into the shared folder: cuts lineage and survives the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of tables that are kept by now; it does so when the driver's garbage,
    which still refers to them, is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def keep_partitioned(df: DataFrame) -> DataFrame:
    """``keep`` that goes on knowing how the table is partitioned, which adaptive execution forgets."""
    spark = df.sparkSession
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return keep(df.select("*"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A key is hot if it holds more than this share of all rows, so fewer keys than that are.
HOT = 1000


def free(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_facts(rows: DataFrame, facts: DataFrame, key: str, by: Column) -> DataFrame:
    """rows with the columns of facts (kept; one row per key; n is how many of the rows have it), null where a key has
    none.  Keys that hold more than a thousandth of the rows are fewer than a thousand: their facts go to every task,
    and their rows are dealt by ``by``, so that no task gets all rows of one key."""
    total = facts.agg(F.sum("n")).first()[0] or 0
    names = [c for c in facts.columns if c not in (key, "n")]
    hot, cold, salt = (free(rows, x) for x in ("hot", "cold", "salt"))
    known = facts.withColumn("_facts", F.struct(*names))
    often = F.broadcast(known.where(F.col("n") > total // HOT).select(key, F.col("_facts").alias(hot)))
    # n is at least one, so this is zero, but no constant: that would be taken out of the join's keys
    rest = known.where(F.col("n") <= total // HOT).select(key, F.least("n", F.lit(0).cast("long")).alias(salt), F.col("_facts").alias(cold))
    out = rows.join(often, key, "left").withColumn(salt, F.when(F.col(hot).isNull(), 0).otherwise(F.pmod(F.xxhash64(by), F.lit(1 << 20)) + 1))
    out = out.join(rest, [key, salt], "left")
    return out.select(*rows.columns, *(F.coalesce(F.col(hot)[c], F.col(cold)[c]).alias(c) for c in names))
