"""Row-keyed pseudo-random numbers.

Every random operator is keyed by (seed, row id), so results do not depend on how
rows are partitioned, how many executors run, or on task retries.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def uniform(seed, row_id) -> Column:
    """u(seed, id) in [0, 1): first 32 bits of md5('seed:id') divided by 2^32.

    The same number is produced by SQL engines that have ``md5`` (see
    :func:`uniform_sql`), which is what the oracle checks rely on.
    """
    seed_c = seed if isinstance(seed, Column) else F.lit(str(seed))
    key = F.concat(seed_c.cast("string"), F.lit(":"), _col(row_id).cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint").cast("double") / F.lit(TWO_32)


def uniform_sql(seed, row_id_sql: str) -> str:
    """DuckDB / ANSI form of :func:`uniform`."""
    return (f"(CAST(('0x' || substr(md5(CAST({seed} AS VARCHAR) || ':' || CAST({row_id_sql} AS VARCHAR)), 1, 8))"
            f" AS BIGINT) / {TWO_32})")
