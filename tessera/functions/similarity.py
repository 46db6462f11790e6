"""Pair similarity functions as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def edit_dist(a, b) -> Column:
    """Levenshtein distance over the longer length (code points); two empty strings -> 0."""
    a, b = _c(a), _c(b)
    m = F.greatest(F.length(a), F.length(b))
    return F.when(m == 0, F.lit(0.0)).otherwise(F.levenshtein(a, b) / m)


def str_match(a, b, threshold: float = 1.0) -> Column:
    """Exact equality at threshold 1, else 1 - edit_dist >= threshold."""
    if float(threshold) == 1.0:
        return _c(a) == _c(b)
    return (F.lit(1.0) - edit_dist(a, b)) >= F.lit(threshold)


def jaccard(a_tokens, b_tokens) -> Column:
    a, b = F.array_distinct(_c(a_tokens)), F.array_distinct(_c(b_tokens))
    u = F.size(F.array_union(a, b))
    return F.when(u == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / u)


def dice(a_tokens, b_tokens) -> Column:
    a, b = F.array_distinct(_c(a_tokens)), F.array_distinct(_c(b_tokens))
    s = F.size(a) + F.size(b)
    return F.when(s == 0, F.lit(0.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / s)


def cosine(u, v) -> Column:
    """Cosine of two numeric arrays; 0 for a zero vector, -1 for missing or unequal sizes."""
    u, v = _c(u), _c(v)
    dot = F.aggregate(F.zip_with(u, v, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    nu = F.sqrt(F.aggregate(u, F.lit(0.0), lambda acc, x: acc + x * x))
    nv = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    ok = u.isNotNull() & v.isNotNull() & (F.size(u) == F.size(v))
    return (F.when(~ok, F.lit(-1.0)).when((nu == 0) | (nv == 0), F.lit(0.0))
            .otherwise(dot / (nu * nv)))


def gram_text(text) -> Column:
    """The lower-cased text with its whitespace runs collapsed, of which n-grams are taken."""
    return F.regexp_replace(F.lower(_c(text)), r"\s\s+", " ")


def char_ngrams(text, n_min: int = 1, n_max: int = 3) -> Column:
    """Character n-grams of a lower-cased text whose whitespace runs are collapsed."""
    t = gram_text(text)
    L = F.length(t)
    parts = [F.when(L >= n, F.transform(F.sequence(F.lit(0), L - n), lambda i: F.substring(t, i + 1, n)))
             .otherwise(F.array().cast("array<string>")) for n in range(n_min, n_max + 1)]
    return F.concat(*parts)
