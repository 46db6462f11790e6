"""Registry of named queries: each is ``fn(spark, sf_dir) -> DataFrame`` plus, when the
result is expressible in SQL, an equivalent DuckDB statement over the same tables."""

from __future__ import annotations

import re
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        if key in QUERIES:
            raise KeyError(f"duplicate query {key}")
        QUERIES[key] = fn
        if sql is not None:
            # DuckDB's round() can return -0.0 where Spark's returns 0.0; adding 0.0
            # maps -0.0 to 0.0 and leaves every other value unchanged.
            ORACLE[key] = re.sub(r"\bround\(", "0.0 + round(", sql.strip())
        return fn
    return deco


def load_all():
    """Import every catalogue module (they register on import)."""
    from . import cat_graph, cat_io, cat_linear, cat_pairs, cat_report, cat_stream, cat_tabular, cat_text, cat_values, cat_vocab  # noqa: F401
    return QUERIES, ORACLE
