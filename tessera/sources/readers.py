"""Sources: delimited text with hand-named columns, multi-file reads with the file
as a column, TAB and multi-character separators, vocabularies and word vectors
(line number = id), line-aligned files, matrices and stored split tables.

Line numbers come from line counts per file split and places inside a split, so no file is
pulled through one task and no line is sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_tabular(spark: SparkSession, path: str, schema: str, skip_first_line: bool = False) -> DataFrame:
    """Headerless CSV with hand-named columns; optionally skip each file's first line."""
    return spark.read.schema(schema).option("header", skip_first_line).csv(path)


def read_many(spark: SparkSession, paths, schema: str, source_pattern: str | None = None) -> DataFrame:
    """Union of many CSV files (list or glob); ``source`` = the file path, or the
    first group of ``source_pattern`` matched against it."""
    df = spark.read.schema(schema).option("header", False).csv(paths)
    src = F.col("_metadata.file_path")
    if source_pattern:
        src = F.regexp_extract(src, source_pattern, 1)
    return df.withColumn("source", src)


def read_tsv_text(spark: SparkSession, path: str, schema: str = "label int, text_all string") -> DataFrame:
    """TAB-separated label/text, quoting off."""
    return spark.read.schema(schema).option("sep", "\t").option("quote", "").csv(path)


def read_multisep(spark: SparkSession, path: str, schema: str, sep: str = '","') -> DataFrame:
    """Multi-character separator, quoting off (outer quotes stay on the first and
    last fields)."""
    return spark.read.schema(schema).option("sep", sep).option("quote", "").csv(path)


def numbered_lines(spark: SparkSession, path: str, first: int = 1) -> DataFrame:
    """``(line, value)``: every line of a text file or folder with its number, in the order of the
    part files' names. Lines are counted per file split; a line's number is the lines of all
    splits before plus its place inside its own, which the task counts as it reads. Lines are
    neither sorted nor shuffled."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    sizes = raw.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_file", "_start", F.coalesce(before, F.lit(0)).alias("_before"))  # a row per file split

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, at = None, 0  # the open split and its lines so far
        for b in batches:
            if not b.num_rows:
                continue
            file, start = b.column(1).dictionary_encode(), b.column(2).to_numpy()
            same = (file.indices.to_numpy()[1:] == file.indices.to_numpy()[:-1]) & (start[1:] == start[:-1])
            begins = np.concatenate(([0], np.flatnonzero(~same) + 1))
            n = np.arange(b.num_rows) - np.repeat(begins, np.diff(np.append(begins, b.num_rows)))
            if (b.column(1)[0].as_py(), start[0]) == split:
                n[:begins[1] if len(begins) > 1 else None] += at
            split, at = (b.column(1)[-1].as_py(), start[-1]), int(n[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n)], names=["value", "_file", "_start", "_at"])
    numbered = raw.mapInArrow(place, "value string, _file string, _start long, _at long").join(F.broadcast(offsets), ["_file", "_start"])
    return numbered.select((F.col("_before") + F.col("_at") + first).cast("bigint").alias("line"), "value")


def read_vocab(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Vocabulary file: one word per line (id = line number from 1), or ``word\\tid``.
    Only the first TAB field is the word."""
    lines = numbered_lines(spark, path)
    parts = F.split("value", "\t")
    if with_ids:
        return lines.select(parts[0].alias("word"), parts[1].cast("int").alias("word_id"))
    return lines.select(parts[0].alias("word"), F.col("line").cast("int").alias("word_id"))


def read_word_vectors(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """``word f1 ... fd`` lines (an optional first line ``n d``) -> (word, vec array<float>)."""
    lines = numbered_lines(spark, path) if header else spark.read.text(path).withColumn("line", F.lit(2))
    if header:
        lines = lines.filter(F.col("line") > 1)
    toks = F.split(F.col("value"), " ")
    return lines.select(toks[0].alias("word"),
                        F.transform(F.slice(toks, F.lit(2), F.greatest(F.size(toks) - 1, F.lit(0))), lambda x: x.cast("float")).alias("vec"))


def read_aligned(spark: SparkSession, paths: dict) -> DataFrame:
    """Line-aligned files joined on line number: ``{name: path}`` -> (line, name...)."""
    out = None
    for name, path in paths.items():
        t = numbered_lines(spark, path).withColumnRenamed("value", name)
        out = t if out is None else out.join(t, "line")
    return out


def read_matrix(spark: SparkSession, path: str, element: str = "double") -> DataFrame:
    """Comma-separated numeric rows -> (line, values array<element>)."""
    lines = numbered_lines(spark, path, first=0)
    return lines.select("line", F.transform(F.split("value", ","), lambda x: x.cast(element)).alias("values"))


def read_vector(spark: SparkSession, path: str, element: str = "double") -> DataFrame:
    """One value per line -> (line, value)."""
    return numbered_lines(spark, path, first=0).select("line", F.col("value").cast(element).alias("value"))


def read_splits(spark: SparkSession, path: str, splits=None) -> DataFrame:
    """Stored split table (partitioned by ``split``); a split filter prunes folders."""
    df = spark.read.parquet(path)
    return df.filter(F.col("split").isin(list(splits))) if splits else df
