"""A small table of awkward documents, shared by the operator tests."""

import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use inside
    *[T.StructField(n, T.StringType()) for n in ("row", "rid", "fp", "key", "n_words", "host", "size", "kept_text", "i", "t")]])


def sentence(rng, n, vocab=400):
    return " ".join(f"w{int(rng.paretovariate(0.6)) % vocab}" for _ in range(n))


def awkward_rows():
    rng = random.Random(5)
    texts = [None, "", " ", "\n", "a", "ß", "x y", "\x0b\x0c\t", "İstanbul ÀÉ  Z q", "<|im_end|> # $ % <p>|", "\n\n\n", "one two\nONE TWO \n one two"]
    common = ["Shared  line of many documents", "\tall rights reserved "]
    for k in range(40):
        body = sentence(rng, rng.randint(3, 160))
        if k % 3 == 0:
            body += "\n" + common[k % 2] + "\n" + sentence(rng, 5)
        texts.append(body)
    texts.append(sentence(rng, 30_000))                       # very long
    texts.append("same words again " * 500)                   # repeats only
    texts += [texts[20]] * 25                                 # copies
    texts += [texts[21] + " x", texts[21] + " y z"]           # near copies
    rows = []
    for i, t in enumerate(texts):
        src = [None, "hot", "hot", "b", "", "é"][i % 6]
        rows.append((i * 3 - 5, t, ["en", "de", None, "fr"][i % 4], src, None if t is None else len(t), *["clash"] * 10))
    rows.append(rows[30])                                     # a repeated row
    rows.append((None, "a row without an id " * 20, "en", "b", 5, *[None] * 10))
    return rows


@pytest.fixture(scope="session")
def rows():
    return awkward_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
