"""Least squares whose fit is a sum over rows: the Gram matrix of the inputs.

Tasks add up X'X, X'y and the rows per group; Spark adds the tasks' sums block by block, and
the driver solves one small system per model. As the sums of nested row subsets are suffix
sums over groups, all models of a removal curve come from one pass. Sizes follow from the
number of inputs and groups, never from the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .additive import suffix_sums
from .network import solve

BLOCK = 4096


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of equal length with a one as their last column."""
    x = column.flatten().to_numpy().reshape(len(column), -1)
    return np.column_stack([x, np.ones(len(x))])


def gram_statistics(rows: DataFrame, d: int, groups: int = 1, group: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(gram (groups, d+1, d+1), moment (groups, d+1), rows (groups,))`` of ``rows(x array of
    d doubles, y[, group])``; the last input is one. Rows with a null target are left out."""
    m = d + 1
    size = m * m + m + 1

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            a, y, g = _matrix(b.column("x")), b.column("y").to_numpy(zero_copy_only=False), b.column("g").to_numpy()
            for k in np.unique(g).tolist():
                on = g == k
                part = np.concatenate([(a[on].T @ a[on]).ravel(), a[on].T @ y[on], [on.sum()]])
                total[k] = total[k] + part if k in total else part
        for k, s in sorted(total.items()):
            cut = [s[i:i + BLOCK] for i in range(0, size, BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(cut), pa.int32()), pa.array(range(len(cut)), pa.int32()),
                                              pa.array(cut, pa.list_(pa.float64()))], names=["g", "block", "part"])
    g = F.col(group).cast("int") if group else F.lit(0)
    parts = (rows.filter(F.col("y").isNotNull()).select("x", F.col("y").cast("double").alias("y"), g.alias("g"))
             .mapInArrow(run, "g int, block int, part array<double>"))
    out = np.zeros((groups, size))
    for r in parts.groupBy("g", "block").agg(Summarizer.sum(array_to_vector("part")).alias("s")).collect():  # groups x size numbers
        s = r["s"].toArray()
        out[r["g"], r["block"] * BLOCK:r["block"] * BLOCK + len(s)] = s
    return out[:, :m * m].reshape(groups, m, m), out[:, m * m:m * m + m], out[:, -1]


@dataclass
class LinearModels:
    """``m`` models: coefficients (m, d + 1), the intercept last; models without rows are nan."""
    theta: np.ndarray
    rows: np.ndarray

    @classmethod
    def of(cls, gram: np.ndarray, moment: np.ndarray, rows: np.ndarray, penalty: float = 1.0) -> LinearModels:
        theta = [solve(g, m, penalty) if n > 0 else np.full(len(m), np.nan) for g, m, n in zip(gram, moment, rows, strict=True)]
        return cls(np.array(theta), rows)

    @classmethod
    def nested(cls, statistics, penalty: float = 1.0) -> LinearModels:
        """The models of groups b, b + 1, ... for every b."""
        return cls.of(*map(suffix_sums, statistics), penalty)


def linear_predict(rows: DataFrame, models: LinearModels, x: str = "x") -> DataFrame:
    """``rows`` once per model with ``model`` and ``pred`` (null for a model without rows)."""
    theta = models.theta
    d = theta.shape[1] - 1
    number = lambda v: F.lit(None if np.isnan(v) else float(v)).cast("double")
    per = F.array(*[F.struct(F.lit(k).alias("model"), F.array(*[number(v) for v in t[:d]]).alias("w"), number(t[d]).alias("b"))
                    for k, t in enumerate(theta)])
    out = rows.withColumn("_m", F.explode(per))
    score = F.aggregate(F.zip_with(x, F.col("_m.w"), lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v) + F.col("_m.b")
    return out.withColumn("model", F.col("_m.model")).withColumn("pred", score).drop("_m")
