"""Sinks: split tables, values, curves, manifests, CSV maps, matrices, labelled text.

Output folders live under the cluster's shared ``spark.checkpoint.dir`` unless a
path is given, never in a machine-local temporary folder.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def run_dir(spark: SparkSession, name: str) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tessera-runs/{name}"


def write_splits(df: DataFrame, path: str, split_col: str = "split") -> None:
    """One folder per split value (partition pruning on read)."""
    df.write.mode("overwrite").partitionBy(split_col).parquet(path)


def write_values(values: DataFrame, path: str) -> None:
    values.write.mode("overwrite").parquet(path)


CURVE_SCHEMA = "mode string, bin int, n_rows long, valid_metric double, test_metric double"


def write_curve(curve: DataFrame, path: str) -> None:
    """A value curve (a row per mode and bin) as CSV with a title line."""
    curve.select("mode", "bin", "n_rows", "valid_metric", "test_metric").write.mode("overwrite").option("header", True).csv(path)


def read_curve(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CURVE_SCHEMA).option("header", True).csv(path)


def write_ids(rows: DataFrame, order, path: str, key: str = "row_id") -> None:
    """Row ids, one per line, in the given order (lowest-valued rows, noisy rows)."""
    rows.orderBy(*order).select(F.col(key).cast("string")).write.mode("overwrite").text(path)


def write_manifest(spark: SparkSession, path: str, entries: dict) -> None:
    """A one-row JSON table naming the stored artefacts of a run."""
    spark.createDataFrame([(json.dumps(entries, sort_keys=True),)], "manifest string") \
        .coalesce(1).write.mode("overwrite").text(path)


def write_map_csv(df: DataFrame, path: str) -> None:
    """Key/value table as CSV with every field quoted and quotes doubled."""
    (df.write.mode("overwrite").option("header", True).option("quoteAll", True)
     .option("escape", '"').csv(path))


def write_matrix(df: DataFrame, cols, path: str, mode: str = "overwrite") -> None:
    """One line per row: the listed numeric columns joined by commas (a vector when
    one column is given). ``mode`` is a Spark save mode (overwrite / append)."""
    line = F.concat_ws(",", *[F.col(c).cast("string") for c in cols]).alias("value")
    df.select(line).write.mode(mode).text(path)


def write_predictions(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_label_text(df: DataFrame, path: str, split_col: str = "split") -> None:
    """``label<TAB>text`` lines, one folder per split."""
    (df.select(split_col, "label", "text").write.mode("overwrite").partitionBy(split_col)
     .option("sep", "\t").option("quote", "").csv(path))
