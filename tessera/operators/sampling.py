"""Reproducible splits, samples and label noise, keyed by (seed, row id).

Exact-count operators (``int(n * rate)`` noisy rows, first ``k`` rows of a
shuffle) use the distributed global rank; rate-based ones are a per-row
comparison with a hash uniform and need no shuffle at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import uniform
from .ranking import global_rank


def shuffle_rank(df: DataFrame, seed: int, key: str = "row_id", out: str = "srank") -> DataFrame:
    """Position of each row in a seeded shuffle (ties in the hash broken by id)."""
    return global_rank(df.withColumn("_u", uniform(seed, key)), [F.col("_u"), F.col(key)], out=out).drop("_u")


def corrupt_label(df: DataFrame, rate: float, seed: int = 42, key: str = "row_id", y: str = "y",
                  classes=None, max_classes: int = 10_000) -> DataFrame:
    """Exactly ``int(n * rate)`` rows get a uniformly drawn *other* observed class, n being
    the rows with a label.

    Adds ``y_clean`` (original), ``is_noisy``; ``y`` holds the possibly flipped label. Rows
    without a label are returned unchanged, and so are all rows when there is no other
    class. Give narrow rows (key and label): all rows pass a range sort. ``classes`` is the
    caller's list; by default the observed classes, ``max_classes`` at most.
    """
    if classes is None:
        found = df.select(y).filter(F.col(y).isNotNull()).distinct().limit(max_classes + 1).collect()
        if len(found) > max_classes:
            raise ValueError(f"{y} has more than {max_classes} values; give the list of classes")
        classes = sorted(r[0] for r in found)
    same = df.withColumn("y_clean", F.col(y)).withColumn("is_noisy", F.lit(False)).withColumn(y, F.col(y).cast("int"))
    if len(classes) < 2:
        return same
    labelled = df.filter(F.col(y).isNotNull())
    n_noisy = int(labelled.count() * rate)
    ranked = shuffle_rank(labelled, seed, key)
    cls = F.array(*[F.lit(c) for c in classes])
    others = F.array_except(cls, F.array(F.col(y)))
    pick = F.floor(uniform(seed + 1, key) * F.size(others)).cast("int")
    noisy = F.col("srank") < n_noisy
    out = (ranked.withColumn("y_clean", F.col(y))
           .withColumn("is_noisy", noisy)
           .withColumn(y, F.when(noisy, F.element_at(others, pick + 1)).otherwise(F.col(y)).cast("int"))
           .drop("srank"))
    return out.unionByName(same.filter(F.col(y).isNull()))


def split_rates(u: Column, rates) -> Column:
    """Part index by cumulative rates; rows past the last cumulative rate get null
    (dropped by the caller), so the rates are not re-normalised."""
    expr = None
    acc = 0.0
    for i, r in enumerate(rates):
        acc += r
        expr = (F.when(u < acc, F.lit(i)) if expr is None else expr.when(u < acc, F.lit(i)))
    return expr


def bernoulli_select(df: DataFrame, prob: str, seed: int, key: str = "row_id") -> DataFrame:
    """Keep each row with its own probability; if nothing is kept, redraw every row
    with probability 0.5 (second seed)."""
    first = df.withColumn("keep", uniform(seed, key) < F.col(prob))
    if first.filter("keep").limit(1).count() == 0:
        return df.withColumn("keep", uniform(seed + 1, key) < F.lit(0.5))
    return first
