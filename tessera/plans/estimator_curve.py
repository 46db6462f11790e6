"""The removal curve with any Spark ML estimator as its evaluation model.

The ranked rows are stored once with both of their bins; each of the 2 x ``bins`` fits reads the
rows of its bin and beyond. Fits are independent: ``parallel`` threads submit them in pools of
the fair scheduler (where the cluster has it switched on), so the stages of one fill the gaps
of the others. A finished fit leaves one row in the run's folder, and a run that is started
again with the same folder does only what is missing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators.ranking import bin_of_rank
from ..session import ensure_checkpoint_dir, stored
from . import valuation as VA

FIT_SCHEMA = "mode string, bin int, n_rows long, valid_metric double, test_metric double"


def _done(spark, folder: str) -> set[str]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/fits/*/_SUCCESS")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {f.getPath().getParent().getName() for f in fs.globStatus(path) or []}


def estimator_curve(data: VA.TaskData, values: DataFrame, estimator: Callable[[], Estimator], perf: str = "accuracy",
                    bins: int = R.NUM_BINS, parallel: int = 4, folder: str | None = None) -> DataFrame:
    """For each bin b and mode low/high, drop the floor(b * n / bins) lowest (highest) valued
    rows, fit ``estimator()`` (on ``features`` and ``y``, with probabilities) on the rest and
    score it on valid and test. A subset left with one class is skipped (metric 0).

    ``folder`` (shared, new by default) belongs to one run: the same data, values and estimator."""
    if perf not in VA.CLASS_METRICS:
        raise ValueError(f"unknown metric {perf}")
    spark = data.train.sparkSession
    folder = folder or f"{ensure_checkpoint_dir(spark).rstrip('/')}/curve-{uuid.uuid4().hex}"
    train = data.train.filter(F.col("y").isNotNull())
    ranked = VA.ranked_values(train, values)
    n = ranked.count()
    rows = ranked.select("row_id", *[bin_of_rank(F.col(rank), n, bins).alias(f"b_{mode}") for mode, rank in VA.MODES])
    rows = rows.join(train.select("row_id", F.col("y").cast("double").alias("y"), "features"), "row_id")
    rows = stored(rows.repartitionByRange(F.col("b_low")).sortWithinPartitions("b_low"), "curve-rows")
    evals = stored(data.valid.withColumn("part", F.lit("valid")).unionByName(data.test.withColumn("part", F.lit("test"))), "curve-evals")
    done = _done(spark, folder)

    def one(mode: str, b: int) -> None:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"curve-{(b + (mode == 'high') * bins) % parallel}")
        left = rows.filter(F.col(f"b_{mode}") >= b)
        count = left.agg(F.count(F.lit(1)).alias("n"), F.collect_set("y").alias("y")).first()  # a few classes
        have, got = sorted(int(y) for y in count["y"]), {"valid": 0.0, "test": 0.0}
        if len(have) > 1:
            # a class without rows would leave a hole in the labels: the estimator gets them
            # numbered without it, and its probability is zero
            place = F.array_position(F.array(*[F.lit(float(y)) for y in have]), F.col("y")) - 1
            scored = VA.predict(estimator().fit(left.select(place.cast("double").alias("y"), "features")), evals)
            at = {y: i for i, y in enumerate(have)}
            scored = scored.withColumn("p", F.array(*[F.col("p")[at[y]] if y in at else F.lit(0.0) for y in range(data.k)]))
            got = {r["part"]: r[perf] for r in VA.metric_table(scored, perf, data.k, ["part"]).collect()}
        out = spark.createDataFrame([(mode, b, count["n"], got.get("valid"), got.get("test"))], FIT_SCHEMA)
        out.coalesce(1).write.mode("overwrite").parquet(f"{folder}/fits/{mode}-{b}")

    jobs = [(mode, b) for mode, _ in VA.MODES for b in range(bins) if f"{mode}-{b}" not in done]
    with ThreadPoolExecutor(parallel) as pool:
        futures = [pool.submit(inheritable_thread_target(spark)(one), *job) for job in jobs]
        for f in futures:
            f.result()
    return spark.read.schema(FIT_SCHEMA).parquet(*[f"{folder}/fits/{mode}-{b}" for mode, _ in VA.MODES for b in range(bins)])
