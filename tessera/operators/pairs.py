"""Pair tables and the similarity join.

``fuzzy_join`` finds every pair of distinct strings with
``1 - levenshtein / max(len) >= t`` exactly, without comparing all pairs: the
shorter string of a qualifying pair is cut into tau+1 (here tau+2) segments, and
by the pigeonhole principle one segment must occur unchanged in the longer
string within +-tau positions of its own offset. Segments and positioned
substrings meet in an equi-join; only those candidates are verified with
``levenshtein``. Work is linear in the number of distinct strings times a factor
that depends on their length and on t, so it suits names, titles and lines.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import edit_dist
from .tokens import salted_join


def consecutive_pairs(df: DataFrame, group: str, order: str, cols) -> DataFrame:
    """Row t joined to row t+1 of the same group (equi-join on (group, order+1),
    so a long group is spread over many tasks, unlike a window over the group)."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    a = df.select(group, order, *[F.col(c).alias(f"{c}_a") for c in cols])
    b = df.select(F.col(group).alias("_g"), (F.col(order) - 1).alias("_o"), *[F.col(c).alias(f"{c}_b") for c in cols])
    return a.join(b, (a[group] == b["_g"]) & (a[order] == b["_o"])).drop("_g", "_o")


def _layout(length, k):
    """Start and length of segment i of a string of ``length`` cut into ``k`` parts
    (shorter parts first)."""
    base = F.floor(length / k).cast("int")
    n_long = (length % k).cast("int")
    first_long = k - n_long

    def start(i):
        return i * base + F.greatest(F.lit(0), i - first_long)

    def seglen(i):
        return base + F.when(i >= first_long, 1).otherwise(0)
    return start, seglen


def fuzzy_join(strings: DataFrame, col: str, threshold: float) -> DataFrame:
    """All unordered pairs (left < right) of distinct values of ``col`` with edit
    similarity >= threshold (0.5 < threshold <= 1), with the similarity."""
    t = Fraction(threshold).limit_denominator(10_000)
    if t <= Fraction(1, 2):
        raise ValueError("threshold must be above 0.5 for the segment filter to be exact")
    num, den = t.numerator, t.denominator
    s = strings.select(F.col(col).alias("s")).filter(F.col("s").isNotNull()).distinct() \
        .withColumn("l", F.length("s"))
    if t == 1:
        return s.limit(0).select(F.col("s").alias("left"), F.col("s").alias("right"), F.lit(1.0).alias("sim"))

    def tau(length):
        return F.floor(length * (den - num) / num).cast("int")

    # r side: each string cut into k = min(tau + 2, len) segments
    r = s.filter(F.col("l") > 0).withColumn("k", F.least(tau(F.col("l")) + 2, F.col("l")))
    r = r.select("s", "l", "k", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i"))
    start, seglen = _layout(F.col("l"), F.col("k"))
    r = r.select(F.col("s").alias("r"), F.col("l").alias("lr"), "i",
                 F.substring("s", start(F.col("i")) + 1, seglen(F.col("i"))).alias("seg"))

    # s side: for every admissible shorter length lr, positioned substrings that could
    # hold segment i of such a string
    lo = F.greatest(F.lit(1), F.ceil(F.col("l") * num / den).cast("int"))
    q = s.filter(F.col("l") > 0).select("s", "l", F.explode(F.sequence(lo, F.col("l"))).alias("lr"))
    q = q.withColumn("tau", tau(F.col("lr"))).withColumn("k", F.least(F.col("tau") + 2, F.col("lr")))
    q = q.select("s", "l", "lr", "tau", "k", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i"))
    start, seglen = _layout(F.col("lr"), F.col("k"))
    q = q.withColumn("p0", start(F.col("i"))).withColumn("ln", seglen(F.col("i")))
    q = q.withColumn("a", F.greatest(F.lit(0), F.col("p0") - F.col("tau"))) \
         .withColumn("b", F.least(F.col("l") - F.col("ln"), F.col("p0") + F.col("tau"))) \
         .filter(F.col("a") <= F.col("b"))
    q = q.select("s", "lr", "i", F.explode(F.sequence("a", "b")).alias("p"), "ln")
    q = q.select("s", "lr", "i", F.substring("s", F.col("p") + 1, F.col("ln")).alias("seg"))

    # short common segments are hot keys: the longer strings' rows are salted
    cand = (salted_join(q, r, ["seg", "i", "lr"], "inner", "s", salts=8).filter(F.col("r") != F.col("s"))
            .select(F.least("r", "s").alias("left"), F.greatest("r", "s").alias("right")).distinct())
    sim = F.lit(1.0) - edit_dist(F.col("left"), F.col("right"))
    return cand.withColumn("sim", sim).filter(F.col("sim") >= F.lit(float(threshold)))
