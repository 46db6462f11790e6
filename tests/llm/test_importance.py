import hashlib
import math
import random
import re
import zlib

import pytest

from tessera.llm import importance as I
from tessera.llm.queries import QUERIES
from tests.llm.conftest import SCHEMA

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def features(w):
    return [zlib.crc32(x.encode()) % 10000 for x in w + [" ".join(p) for p in zip(w, w[1:], strict=False)]]


def brute(rows, targets):
    s, t = [0] * 10000, [0] * 10000
    for total, some in ((s, [r[1] for r in rows]), (t, targets)):
        for text in some:
            for b in features(words(text)):
                total[b] += 1
    gain = [math.floor(1000 * math.log((float(t[b]) + 1) * (float(sum(s)) + 10000) / ((float(s[b]) + 1) * (float(sum(t)) + 10000)))) for b in range(10000)]
    out = []
    for d, text, *_ in rows:
        w = words(text)
        f = features(w)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(able[:25 * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.fixture(scope="module")
def targets():
    rng = random.Random(2)
    return ["", None, "w1 w2 w3", "Ünïcode W1-w2 É", *[" ".join(f"w{rng.randrange(90)}" for _ in range(rng.randint(1, 60))) for _ in range(20)]]


def test_query_against_brute_force(spark, rows, targets, tmp_path):
    rng = random.Random(4)
    more = [(90_000 + i, "".join(rng.choice("aB0 é-\t\n9zZ[`{\x7f") for _ in range(rng.randint(0, 300))), "en", "b", 1, *["x"] * 10) for i in range(80)]
    spark.createDataFrame(rows + more, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(targets)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(map(tuple, QUERIES["op13_importance_resampling"](spark, str(tmp_path)).collect()), key=repr)
    want = brute(rows + more, targets)
    assert got == want and sum(r[4] is not None for r in want) > 10


@pytest.mark.parametrize("n_words,n_pairs", [(0, 0), (1, 1), (5, 3), (1000, 1000)])
def test_head_changes_no_bucket(rows, n_words, n_pairs):
    import numpy as np
    docs = [I.split_words((r[1] or "").encode()) for r in rows]
    some = sorted({w for d in docs for w in d})[:n_words]
    pairs = sorted({b" ".join(p) for d in docs for p in zip(d, d[1:], strict=False)})[:n_pairs]
    word, pair, size = I.Head.of(some, pairs, 10_000).features(docs)
    at = 0
    for r, n in zip(rows, size.tolist(), strict=True):
        got = [*word[at:at + n], *pair[at:at + max(0, n - 1)]]
        assert got == features(words(r[1]))
        assert not n or pair[at + n - 1] == -1
        at += n
    assert at == len(word) and isinstance(word, np.ndarray)


def test_head_holds_every_frequent_feature(spark):
    texts = ["often seen " * 30, *[f"rare{i} word{i}" for i in range(50)]]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    head = I.head_vocabulary(df, share=8)
    assert {b"often", b"seen"} <= set(head.words) and len(head.pairs) >= 2
    bounded = I.head_vocabulary(df, words=1, pairs=0, share=10**6)
    assert len(bounded.words) == 1 and len(bounded.pairs) == 0


def test_empty(spark, empty, docs):
    goal = spark.createDataFrame([], "text string")
    assert I.resample(empty, goal).count() == 0
    got = I.resample(docs, goal)
    assert got.count() == docs.count() and got.filter("rank IS NOT NULL").count() > 0
