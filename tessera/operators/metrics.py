"""Classification and regression metrics as aggregates over scored DataFrames.

Inputs are long/array columns: ``y`` (int label), ``p`` (array<double> class
probabilities) or ``pred`` (double) for regression. All metrics are computed by
grouped aggregation (partial aggregation before the shuffle); the exact ROC-AUC
aggregates to one row per distinct score and uses a distributed prefix sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import argmax_index, prefix_sum


def _by(by):
    return [] if by is None else ([by] if isinstance(by, str) else list(by))


def accuracy(df: DataFrame, y: str = "y", p: str = "p", by=None) -> DataFrame:
    return df.groupBy(*_by(by)).agg(
        F.avg((argmax_index(F.col(p)) == F.col(y)).cast("double")).alias("accuracy"))


def neg_log_loss(df: DataFrame, y: str = "y", p: str = "p", by=None, eps: float = 1e-15) -> DataFrame:
    py = F.element_at(F.col(p), F.col(y) + 1)
    clipped = F.least(F.greatest(py, F.lit(eps)), F.lit(1 - eps))
    return df.groupBy(*_by(by)).agg(F.avg(F.log(clipped)).alias("neg_log_loss"))


def rmspe(df: DataFrame, y: str = "y", pred: str = "pred", by=None) -> DataFrame:
    """Root mean square percentage error. A row with y = 0 counts 0 if it is predicted
    exactly and makes the result infinite otherwise (division by zero, not left out)."""
    d = F.col(y) - F.col(pred)
    r = F.when(F.col(y) == 0, F.when(d == 0, F.lit(0.0)).otherwise(F.lit(float("inf")))).otherwise(F.try_divide(d, F.col(y)))
    return df.groupBy(*_by(by)).agg(F.sqrt(F.avg(r * r)).alias("rmspe"))


def mae_mse(df: DataFrame, y: str = "y", pred: str = "pred", by=None) -> DataFrame:
    d = F.col(y) - F.col(pred)
    return df.groupBy(*_by(by)).agg(F.avg(F.abs(d)).alias("mae"), F.avg(d * d).alias("mse"))


def auc_by_class(df: DataFrame, y: str = "y", score: str = "s", by=None, cls: str = "k") -> DataFrame:
    """Exact one-vs-rest ROC-AUC per (group, class) with ties counted one half.

    ``df`` has one row per (example, class): label ``y`` is 1 for the positive class.
    """
    g = _by(by) + [cls]
    counts = (df.groupBy(*g, score).agg(F.sum(F.col(y)).alias("pos"),
                                         F.sum(1 - F.col(y)).alias("neg")))
    cum = prefix_sum(counts, g, score, ["neg"])
    return (cum.groupBy(*g).agg(
        (F.sum(F.col("pos") * (F.col("neg_before") + 0.5 * F.col("neg")))
         / (F.sum("pos") * F.sum("neg"))).alias("auc"),
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg")))


def auc(df: DataFrame, y: str = "y", p: str = "p", k: int = 2, by=None) -> DataFrame:
    """Binary AUC on the score of class 1 when k == 2, macro one-vs-rest otherwise."""
    if k == 2:
        long = df.select(*_by(by), F.lit(1).alias("k"), (F.col(y) == 1).cast("long").alias("yy"),
                         F.element_at(F.col(p), 2).alias("s"))
    else:
        long = df.select(*_by(by), F.posexplode(F.col(p)).alias("k", "s"), F.col(y).alias("_y"))
        long = long.select(*_by(by), "k", "s", (F.col("_y") == F.col("k")).cast("long").alias("yy"))
    per = auc_by_class(long, "yy", "s", by, "k")
    return per.groupBy(*_by(by)).agg(F.avg("auc").alias("auc"))
