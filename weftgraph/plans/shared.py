"""Helpers that several operators use: materialising, null-safe and salted joins."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local master may leave it unset and gets a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="weftgraph-")
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext.getCheckpointDir()
    return path


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    It cuts the lineage like checkpoint() does, survives lost executors, and keeps
    column pruning for whoever reads it next.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftgraph-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where null equals null; the right side's keys are dropped."""
    renamed = right.select(*[F.col(c).alias(f"__r_{c}" if c in keys else c) for c in right.columns])
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys])
    out = left.join(renamed, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"__r_{k}" for k in keys])


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], spread: list[str], salts: int = 16, how: str = "inner") -> DataFrame:
    """Join a large side with hot ``keys`` to a side that has each key once.

    The left rows of a key are dealt over ``salts`` tasks by ``spread``; the right side,
    one row for each key, is copied that often.
    """
    salted = left.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(c) for c in spread]), F.lit(salts)).cast("int"))
    copies = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return null_safe_join(salted, copies, [*keys, "__salt"], how).drop("__salt")
