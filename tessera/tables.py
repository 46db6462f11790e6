"""Access to the input tables (one parquet file or folder per table)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy parquet scan; Catalyst prunes columns and pushes filters into it."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def size_in_bytes(setting: str) -> int:
    """A size as Spark's settings write it: ``134217728``, ``134217728b``, ``128m``, ``128MB``, ``1g``."""
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)b?", setting.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def estimated_size(df: DataFrame) -> int:
    """The planner's estimate in bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_limit(spark: SparkSession) -> int:
    """The size up to which the planner broadcasts a join's side; -1 if never."""
    setting = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    return -1 if setting.strip().startswith("-") else size_in_bytes(setting)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give CPU-heavy row work (regex chains, array functions) a partition per core when the
    planner's size estimate is below one full split per core; a larger input already arrives
    in enough splits and is not shuffled. Changes no result; deterministic under retries."""
    spark = df.sparkSession
    split = size_in_bytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    cores = spark.sparkContext.defaultParallelism
    if estimated_size(df) < cores * split:
        return df.repartition(cores, F.col(key))
    return df
