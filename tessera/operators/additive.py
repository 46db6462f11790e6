"""Predictors whose fit is a sum over rows: multinomial naive Bayes over term counts and
group means for regression.

Because the sufficient statistics add up, the models of all nested row subsets (a removal
curve drops 0, 1, 2, ... bins of rows) come from one pass: statistics are counted once per
bin, and suffix sums over the bins give every model. Statistics are bounded by parameters
(bins x classes x terms), never by rows. Scoring evaluates all models in one job.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import list_parts, parted_by_repeats

NEVER = -1e300  # log probability of a class without a row
SCORE_ROWS = 512


@dataclass
class NaiveBayes:
    """``m`` models: log priors (m, k) and log term probabilities (m, k, d)."""
    prior: np.ndarray
    term: np.ndarray
    rows: np.ndarray     # rows of each model
    classes: np.ndarray  # classes that have a row, of each model

    @classmethod
    def of(cls, n: np.ndarray, c: np.ndarray, smoothing: float = 1.0) -> NaiveBayes:
        """From class counts (m, k) and class-term counts (m, k, d). A class without a
        row is never predicted."""
        present = (n > 0).sum(1)
        with np.errstate(divide="ignore"):
            prior = np.log((n + smoothing) / (n.sum(1) + smoothing * present)[:, None])
        prior = np.where(n > 0, prior, NEVER)
        term = np.log((c + smoothing) / (c.sum(2) + smoothing * c.shape[2])[:, :, None])
        return cls(prior, term, n.sum(1), present)


def count_lists(bow: DataFrame) -> DataFrame:
    """``(row_id, j, n)``: term ids and counts of a row as lists, one row per row_id. ``bow`` has this
    form already, or a row per term ``(row_id, word_id, n)``."""
    if "word_id" not in bow.columns:
        return bow
    each = bow.groupBy("row_id").agg(F.collect_list(F.struct(F.col("word_id").cast("int").alias("j"), F.col("n").cast("double").alias("n"))).alias("x"))
    return each.select("row_id", F.col("x.j").alias("j"), F.col("x.n").alias("n"))


def one_row_each(lists: DataFrame) -> DataFrame:
    """``lists (row_id, j, n)`` with the terms of rows that share a row_id in one row."""
    once, again = parted_by_repeats(lists, "row_id")
    if again is None:
        return once
    gathered = again.groupBy("row_id").agg(F.collect_list(F.struct("j", "n")).alias("x"))
    return once.unionByName(gathered.select("row_id", F.flatten("x.j").alias("j"), F.flatten("x.n").alias("n")))


def nb_statistics(rows: DataFrame, bow: DataFrame, k: int, d: int, groups: int = 1,
                  group: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Class counts (groups, k) and class-term counts (groups, k, d) of ``rows(row_id, y
    [, group])`` over the counts ``bow`` (see :func:`count_lists`). Terms are added up inside the
    tasks; a task returns at most one row per group, class and term."""
    g = F.col(group).cast("int") if group else F.lit(0)
    rows = rows.select("row_id", F.col("y").cast("int").alias("y"), g.alias("g")).filter(F.col("y").isNotNull())
    n, c = np.zeros((groups, k)), np.zeros((groups, k, d))
    for r in rows.groupBy("g", "y").agg(F.count(F.lit(1)).alias("n")).collect():  # groups x k rows
        n[r["g"], r["y"]] = r["n"]

    def run(batches):
        total = None
        for batch in batches:
            for b in list_parts(batch, 2):
                at = np.repeat((b.column(0).to_numpy().astype(np.int64) * k + b.column(1).to_numpy()) * d, b.column(2).value_lengths().to_numpy())
                part = np.bincount(at + b.column(2).flatten().to_numpy(), b.column(3).flatten().to_numpy(), groups * k * d)
                total = part if total is None else total + part
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])
    each = rows.join(count_lists(bow), "row_id").select("g", "y", "j", "n").mapInArrow(run, "at long, n double")
    counts = each.groupBy("at").agg(F.sum("n").alias("n")).toPandas()  # groups x k x d rows at most
    c.ravel()[counts["at"].to_numpy(np.int64)] = counts["n"].to_numpy(float)
    return n, c


def suffix_sums(x: np.ndarray) -> np.ndarray:
    """Statistics of groups b, b+1, ... for every b."""
    return np.cumsum(x[::-1], axis=0)[::-1]


def nb_predict(rows: DataFrame, bow: DataFrame, models: NaiveBayes) -> DataFrame:
    """``rows`` once per model with ``model`` and class probabilities ``p``. All models score a
    row's counts ``bow`` (see :func:`count_lists`) where they lie; no term is shuffled."""
    m, k = models.prior.shape
    term = np.ascontiguousarray(models.term.reshape(m * k, -1).T)  # d rows of m * k numbers
    d, lists = len(term), count_lists(bow)
    shared = rows.sparkSession.sparkContext.broadcast(term)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SCORE_ROWS):
                b = batch.slice(at, SCORE_ROWS)
                row = np.repeat(np.arange(b.num_rows), b.column(1).value_lengths().to_numpy())
                n = np.bincount(row * d + b.column(1).flatten().to_numpy(), b.column(2).flatten().to_numpy(), b.num_rows * d)
                s = n.reshape(b.num_rows, d) @ shared.value
                ends = pa.array(np.arange(0, s.size + 1, m * k, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(s.ravel()))], names=["row_id", "s"])
    kind = lists.schema["row_id"].dataType.simpleString()
    score = lists.select("row_id", "j", "n").mapInArrow(run, f"row_id {kind}, s array<double>")
    prior = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in models.prior])
    out = rows.join(score, "row_id", "left")
    out = out.select(*rows.columns, "s", F.posexplode(prior).alias("model", "_pi"))
    raw = F.when(F.col("s").isNull(), F.col("_pi")).otherwise(
        F.zip_with("_pi", F.slice("s", F.col("model") * k + 1, F.lit(k)), lambda a, b: a + b))
    out = out.withColumn("_raw", raw).withColumn("_e", F.transform("_raw", lambda x: F.exp(x - F.array_max("_raw"))))
    total = F.aggregate("_e", F.lit(0.0), lambda a, x: a + x)
    out = out.withColumn("_t", total)
    return out.select(*rows.columns, "model", F.transform("_e", lambda x: x / F.col("_t")).alias("p"))


@dataclass
class GroupMeans:
    """``m`` models: mean target per group value, else the mean of all rows. (Least
    squares on the one-hot group columns gives the same numbers.)"""
    values: list
    means: np.ndarray    # (m, values)
    overall: np.ndarray  # (m,)
    rows: np.ndarray

    @classmethod
    def of(cls, values: list, n: np.ndarray, s: np.ndarray) -> GroupMeans:
        rows, total = n.sum(1), s.sum(1)
        overall = np.divide(total, rows, out=np.full_like(total, np.nan), where=rows > 0)
        means = np.divide(s, n, out=np.repeat(overall[:, None], n.shape[1], 1), where=n > 0)
        return cls(values, means, overall, rows)


def mean_statistics(rows: DataFrame, column: str, values: list, groups: int = 1, group: str | None = None):
    """Row counts and target sums (groups, values) of ``rows(y, column[, group])`` for the
    listed values of ``column``."""
    g = F.col(group).cast("int") if group else F.lit(0)
    at = {v: i for i, v in enumerate(values)}
    n, s = np.zeros((groups, len(values))), np.zeros((groups, len(values)))
    for r in (rows.filter(F.col(column).isin(values)).groupBy(g.alias("g"), F.col(column).alias("v"))
              .agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s")).collect()):  # groups x values rows
        n[r["g"], at[r["v"]]], s[r["g"], at[r["v"]]] = r["n"], r["s"]
    return n, s


def mean_predict(rows: DataFrame, column: str, models: GroupMeans) -> DataFrame:
    """``rows`` once per model with ``model`` and ``pred``."""
    number = lambda x: F.lit(None if np.isnan(x) else float(x)).cast("double")  # noqa: E731  a model without rows predicts null
    per = [F.array(*[number(x) for x in row]) for row in np.column_stack([models.means, models.overall])]
    known = F.array_position(F.array(*[F.lit(v) for v in models.values]), F.col(column))
    place = F.when(known > 0, known).otherwise(len(models.values) + 1).cast("int")
    out = rows.select("*", place.alias("_at"), F.posexplode(F.array(*per)).alias("model", "_m"))
    return out.withColumn("pred", F.element_at("_m", F.col("_at"))).drop("_at", "_m")


def class_of(p: Column) -> Column:
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")
