"""Projections, casts, recodes, null handling, one-hot and scaling.

Scalers compute their statistics as one global aggregate (a single row reaches the
driver) and apply them as literals, so the apply step is a narrow projection with
no join and no shuffle.
"""

from __future__ import annotations

from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .ranking import global_rank
from .tokens import salted_join


def recode_map(col, mapping: dict) -> Column:
    """Dictionary recode; values missing from the map become null."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return m[F.col(col) if isinstance(col, str) else col]


def replace_values(col, values, new) -> Column:
    """Set-to-constant replacement of the listed values; others pass through."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.isin(list(values)), F.lit(new)).otherwise(c)


def binarize(col, threshold: float = 0.0) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return (c > threshold).cast("int")


def shift_label(col) -> Column:
    """Drop the first character, read an int, subtract one."""
    c = F.col(col) if isinstance(col, str) else col
    return (F.substring(c, F.lit(2), F.length(c)).try_cast("int") - 1).cast("int")


def first_char_label(col) -> Column:
    """First character as int, minus one ('1-URGENT' -> 0)."""
    c = F.col(col) if isinstance(col, str) else col
    return (F.substring(c, 1, 1).try_cast("int") - 1).cast("int")


def one_hot(df: DataFrame, col: str, categories, prefix: str | None = None) -> DataFrame:
    """A 0/1 int column ``{prefix}_{value}`` per listed category (null and unlisted values
    are all zero); other columns pass through. The caller lists the categories, since they
    become columns; for an open set use a hashed or indexed vector column instead."""
    prefix = prefix or col
    cols = [F.coalesce((F.col(col) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{prefix}_{v}") for v in categories]
    return df.select(*[c for c in df.columns if c != col], *cols)


def minmax_scale(df: DataFrame, cols, fit_on: DataFrame | None = None) -> DataFrame:
    """(x - min) / (max - min); a constant column maps to 0 (zero-range guard)."""
    stats = (fit_on or df).agg(*[F.min(c).alias(f"mn_{c}") for c in cols],
                               *[F.max(c).alias(f"mx_{c}") for c in cols]).first()
    out = df
    for c in cols:
        mn, mx = stats[f"mn_{c}"], stats[f"mx_{c}"]
        rng = (mx - mn) if mn is not None and mx is not None else 0.0
        out = out.withColumn(c, F.lit(0.0) if not rng else (F.col(c) - F.lit(mn)) / F.lit(rng))
    return out


def standard_scale(df: DataFrame, cols, fit_on: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population std; a constant column maps to 0."""
    stats = (fit_on or df).agg(*[F.avg(c).alias(f"mu_{c}") for c in cols],
                               *[F.stddev_pop(c).alias(f"sd_{c}") for c in cols]).first()
    out = df
    for c in cols:
        mu, sd = stats[f"mu_{c}"], stats[f"sd_{c}"]
        out = out.withColumn(c, F.lit(0.0) if not sd else (F.col(c) - F.lit(mu)) / F.lit(sd))
    return out


def category_index(df: DataFrame, cols) -> DataFrame:
    """``(column, value, index)``: the distinct non-null values of all columns, numbered from 0 in
    the order of the columns and, inside one, of the values as text. The numbering is a
    distributed rank; no list of categories reaches the driver."""
    each = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("place"), F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                                         for k, c in enumerate(cols)])).alias("x")).select("x.*").filter(F.col("value").isNotNull())
    return global_rank(each.distinct(), ["place", "value"], out="index").select("column", "value", "index")


def one_hot_indices(df: DataFrame, key: str, cols, index: DataFrame) -> DataFrame:
    """``(key, indices)`` of every row of ``df``: the sorted places of its ones. Values that the
    index doesn't hold, and nulls, have none. A frequent value's rows are dealt over salts."""
    each = df.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])).alias("x"))
    found = salted_join(each.select(key, "x.column", "x.value"), index, ["column", "value"], "left", key)
    return found.groupBy(key).agg(F.array_sort(F.array_compact(F.collect_list("index"))).alias("indices"))


def sparse_one_hot(df: DataFrame, key: str, cols, index: DataFrame | None = None) -> DataFrame:
    """``(key, features)``: one-hot codes of all columns as one sparse vector; its length is the
    number of categories of ``index`` (built from ``df`` by default)."""
    index = stored(category_index(df, cols) if index is None else index, "categories")
    size = index.count()

    # Spark has no built-in that makes a sparse vector of an array
    vector = F.udf(lambda i: Vectors.sparse(size, i, [1.0] * len(i)), VectorUDT())
    return one_hot_indices(df, key, cols, index).select(key, vector("indices").alias("features"))


def label_one_hot(y, k: int) -> Column:
    c = F.col(y) if isinstance(y, str) else y
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i == c).cast("double"))


def safe_divide(x, y, default: float = 0.0) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    y = F.col(y) if isinstance(y, str) else y
    return F.coalesce(F.try_divide(x.cast("double"), y), F.lit(default))


def binary_string(x) -> Column:
    """Binary digits of a non-negative integer; 0 gives the empty string."""
    c = F.col(x) if isinstance(x, str) else x
    return F.when(c == 0, F.lit("")).otherwise(F.bin(c))


def clip_prob(p, eps: float = 1e-15) -> Column:
    c = F.col(p) if isinstance(p, str) else p
    return F.least(F.greatest(c, F.lit(eps)), F.lit(1.0 - eps))


def logit(p) -> Column:
    c = clip_prob(p)
    return F.log(c / (F.lit(1.0) - c))


def logistic(y) -> Column:
    c = F.col(y) if isinstance(y, str) else y
    return F.exp(c) / (F.lit(1.0) + F.exp(c))
