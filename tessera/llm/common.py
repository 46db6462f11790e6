"""Helpers shared by the corpus operators: tables in the shared folder, hot-key salts,
byte-bounded Arrow slices and the white-space alphabet of the contracts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: White space of every contract here: [\x20\x09-\x0D] (what ``bytes.split`` and
#: ``bytes.strip`` use).
WS = " \t\n\x0b\x0c\r"
WS_CLASS = r"[ \t\n\x0B\f\r]"

_SCRATCH: dict[str, list[str]] = {}


def col(name: str) -> Column:
    """A column by its exact name (dots and blanks included)."""
    return F.col("`" + name.replace("`", "``") + "`")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/tessera-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, tag: str, **options) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it
    back. A lost executor recomputes nothing that is already written."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_paths(spark: SparkSession) -> list[str]:
    """Scratch tables this application has written and not deleted, oldest first."""
    return list(_SCRATCH.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, paths=None) -> None:
    """Delete these scratch tables (all by default). Call it only when every result that
    reads them has been written elsewhere."""
    own = _SCRATCH.get(spark.sparkContext.applicationId, [])
    for path in list(own if paths is None else paths):
        if path in own:
            own.remove(path)
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def join_side(df: DataFrame, row_bytes: int, bound: int = 64 << 20) -> DataFrame:
    """The smaller side of a join: broadcast if its counted rows of ``row_bytes`` stay below
    ``bound``, else a sort-merge join. (The planner alone would go by the size of the
    compressed files.) ``df`` is a written table, so counting it is cheap."""
    return F.broadcast(df) if df.count() * row_bytes <= bound else df.hint("merge")


def words(text: Column) -> Column:
    """Maximal runs of non-white-space as an array; null and empty give no word."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, WS_CLASS + "+"))


def slices(batches: Iterator[pa.RecordBatch], limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each piece holds about ``limit`` bytes (one row at
    least): arrays built from a piece stay bounded however long the texts are."""
    for b in batches:
        if not b.num_rows:
            continue
        step = max(1, int(b.num_rows * limit / max(b.nbytes, 1)))
        for i in range(0, b.num_rows, step):
            yield from _halved(b.slice(i, step), 2 * limit)


def _halved(b: pa.RecordBatch, limit: int) -> Iterator[pa.RecordBatch]:
    if b.num_rows <= 1 or b.nbytes <= limit:
        yield b
    else:
        h = b.num_rows // 2
        yield from _halved(b.slice(0, h), limit)
        yield from _halved(b.slice(h), limit)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]
