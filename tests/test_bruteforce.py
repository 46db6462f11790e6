"""Queries without a SQL oracle, checked against plain-Python brute force."""

import random

from pyspark.sql import functions as F

from tests.conftest import SMALL
from tessera.operators.pairs import fuzzy_join


def levenshtein(a, b):
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return prev[-1]


def _pairs(spark):
    c = spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "text").collect()
    by = {(r.conv_id, r.turn): r.text for r in c}
    return {(k[0], k[1]): (v, by[(k[0], k[1] + 1)]) for k, v in by.items() if (k[0], k[1] + 1) in by}


def test_edit_dist_and_match(spark, queries):
    q, _ = queries
    pairs = _pairs(spark)
    got = {(r.conv_id, r.turn): r.dist for r in q["edit_dist"](spark, SMALL).collect()}
    assert set(got) == set(pairs)
    for k, (a, b) in pairs.items():
        m = max(len(a), len(b))
        assert abs(got[k] - (round(levenshtein(a, b) / m, 6) if m else 0.0)) < 1e-9
    sm = {(r.conv_id, r.turn): (r.exact, r.match_03) for r in q["str_match"](spark, SMALL).collect()}
    for k, (a, b) in pairs.items():
        m = max(len(a), len(b))
        assert sm[k] == (a == b, (1.0 - (levenshtein(a, b) / m if m else 0.0)) >= 0.3)


def test_fuzzy_join_exact_on_near_copies(spark):
    rng = random.Random(3)
    alphabet = "abcdefgh "
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 30))) for _ in range(60)]
    words = set(base)
    for s in base:  # near copies with 1-3 random edits
        for _ in range(3):
            t = list(s)
            for _ in range(rng.randint(1, 3)):
                op = rng.random()
                pos = rng.randrange(len(t) + 1)
                if op < 0.33 and t:
                    del t[min(pos, len(t) - 1)]
                elif op < 0.66:
                    t.insert(pos, rng.choice(alphabet))
                elif t:
                    t[min(pos, len(t) - 1)] = rng.choice(alphabet)
            words.add("".join(t))
    words = sorted(w for w in words if w)
    for th in (0.6, 0.75, 0.9):
        exp = set()
        for i, a in enumerate(words):
            for b in words[i + 1:]:
                if 1.0 - levenshtein(a, b) / max(len(a), len(b)) >= th:
                    exp.add((min(a, b), max(a, b)))
        df = spark.createDataFrame([(w,) for w in words], "s string")
        got = {(r.left, r.right) for r in fuzzy_join(df, "s", th).collect()}
        assert got == exp, th


def test_graph_pool_rows(spark, queries):
    q, _ = queries
    g = q["graph_pool"](spark, SMALL)
    docs = g.select("doc_id").distinct().count()
    assert g.count() == docs * 64
    assert g.filter(F.isnan("v") | F.col("v").isNull()).count() == 0


def test_sizes_of_settings():
    from tessera.tables import size_in_bytes
    assert [size_in_bytes(x) for x in ("134217728", "5b", "16m", "128MB", "1g", "2k", "64kb")] == [134217728, 5, 16 << 20, 128 << 20, 1 << 30, 2048, 65536]
