"""Distinct character n-grams (1 to 3 code points) of text columns, taken in their row.

A gram is one number: its code points in 21 bits each, plus one, so that grams of different lengths
differ. No gram leaves its row but for the counts by gram that a task adds up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as ST

MOST = 3
PART_CHARS = 1 << 18
COUNTED = 1 << 20  # distinct grams that a task holds before it hands on their counts


def _numbers(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of every text: ``(text, gram)``, in this order."""
    size = np.array([len(x) for x in texts], np.int64)
    code = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64) + 1
    of = np.repeat(np.arange(len(texts)), size)
    gram, own, grams = np.zeros(len(code), np.int64), of, []
    for k in range(MOST):
        gram = (gram[:len(code) - k] << 21) | code[k:] if k else code
        same = own[:len(code) - k] == of[k:]
        grams.append((own[:len(code) - k][same], gram[same]))
    text, gram = (np.concatenate(x) for x in zip(*grams, strict=True))
    order = np.lexsort((gram, text))
    text, gram = text[order], gram[order]
    first = np.ones(len(gram), bool)
    first[1:] = (text[1:] != text[:-1]) | (gram[1:] != gram[:-1])
    return text[first], gram[first]


def _text(gram: int) -> str:
    out = ""
    while gram:
        out = chr((gram & 0x1FFFFF) - 1) + out
        gram >>= 21
    return out


def _number(gram: str) -> int:
    out = 0
    for c in gram:
        out = (out << 21) | (ord(c) + 1)
    return out


def _parts(batch: pa.RecordBatch, columns):
    """Slices of some characters, or one row: ``(slice, texts of all columns)``; null is empty."""
    texts = [[x or "" for x in batch.column(c).to_pylist()] for c in columns]
    ends, i = np.cumsum([sum(map(len, x)) for x in zip(*texts, strict=True)]), 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PART_CHARS, "right")))
        yield batch.slice(i, j - i), [x for t in texts for x in t[i:j]]
        i = j


def frequencies(df: DataFrame, columns) -> DataFrame:
    """``(gram, df)``: in how many texts of ``columns`` a gram occurs, partial counts by task."""
    def handed_on(gram, count):
        return pa.RecordBatch.from_arrays([pa.array([_text(int(g)) for g in gram], pa.string()), pa.array(count)], names=["gram", "df"])

    def run(batches):
        gram, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for _, texts in _parts(batch, range(len(columns))):
                new, n = np.unique(_numbers(texts)[1], return_counts=True)
                both, at = np.unique(np.concatenate([gram, new]), return_inverse=True)
                gram, count = both, np.bincount(at, np.concatenate([count, n]), len(both)).astype(np.int64)
                if len(gram) > COUNTED:
                    yield handed_on(gram, count)
                    gram, count = gram[:0], count[:0]
        yield handed_on(gram, count)
    return df.select(*columns).mapInArrow(run, "gram string, df long")


def held(df: DataFrame, columns, places: dict[str, int], key: str = "pair") -> DataFrame:
    """``(key, gram_id, c)``: in how many of a row's texts each gram of ``places`` occurs, if in any."""
    known = sorted((_number(g), i) for g, i in places.items())
    grams, ids = np.array([g for g, _ in known], np.int64), np.array([i for _, i in known], np.int64)

    def run(batches):
        for batch in batches:
            for b, texts in _parts(batch, range(1, len(columns) + 1)):
                text, gram = _numbers(texts)
                at = np.minimum(np.searchsorted(grams, gram), max(len(grams) - 1, 0))
                ok = grams[at] == gram if len(grams) else np.zeros(len(gram), bool)
                found, c = np.unique((text[ok] % b.num_rows) * max(len(grams), 1) + at[ok], return_counts=True)
                row, place = found // max(len(grams), 1), found % max(len(grams), 1)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(ids[place].astype(np.int32)), pa.array(c.astype(np.int64))],
                                                 names=[key, "gram_id", "c"])
    schema = ST.StructType([df.schema[key], ST.StructField("gram_id", ST.IntegerType()), ST.StructField("c", ST.LongType())])
    return df.select(key, *columns).mapInArrow(run, schema)
