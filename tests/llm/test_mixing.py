import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes):
    """Water-filling by repeated sharing, as the contract words it."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: i % 3 + 1 for i, s in enumerate(order)}
    left, free, out = float(sum(sizes.values())), set(order), {}
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


def brute(rows, seed=8):
    by = defaultdict(list)
    for r in rows:
        h = int(hashlib.md5(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:13], 16)
        by[r[3]].append((h, r[0], len(WORD.findall(r[1] or ""))))
    sizes = {s: sum(x[2] for x in v) for s, v in by.items()}
    target, out = brute_targets(sizes), []
    for s, v in by.items():
        before = 0
        for _, i, n in sorted(v, key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2])):
            times = sum(e * sizes[s] + before + n / 2 <= target[s] * (1 + 1e-12) for e in range(3))
            out.append((i, n, sizes[s], round(target[s], 6), n * times))
            before += n
    return sorted(out, key=repr)


def test_against_brute_force(docs, rows):
    got = M.mix(docs, n_shards=5).collect()
    assert sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in got), key=repr) == brute(rows)
    again = M.mix(docs, n_shards=5).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_caps_and_totals(spark):
    rows = [(i, "w " * (1 + i % 7), "big") for i in range(400)] + [(1000, "a b c", "tiny"), (1001, "", "none"), (1002, "x y", None)]
    got = M.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by = defaultdict(int)
    for r in got:
        by[r.target, r.source_size] += r.taken
        assert r.taken <= 3 * r.size and r.target <= 3 * r.source_size
    total = sum(r.size for r in got)
    assert abs(sum(t for t, _ in by) - total) < 1e-6
    assert all(abs(v - t) <= 7 for (t, _), v in by.items())


@pytest.mark.parametrize("n_shards", [1, 2, 7, 16])
def test_splitting_tree_is_exact(spark, n_shards):
    quota = {"a": 1000, "b": 37, "c": 1, "d": 400}
    total = sum(quota.values())
    runs = M.split_quotas(spark.createDataFrame(list(quota.items()), "key string, quota long"), total, n_shards).collect()
    for k, q in quota.items():
        at = 0
        for r in sorted((r for r in runs if r.key == k), key=lambda r: r.shard):  # disjoint and whole
            assert r.lo == at
            at = r.hi
        assert at == q
    held = Counter()
    for r in runs:
        held[r.shard] += r.hi - r.lo
    assert [held[s] for s in range(n_shards)] == [total * (s + 1) // n_shards - total * s // n_shards for s in range(n_shards)]


def test_splits_follow_the_hypergeometric_mean(spark):
    q = spark.createDataFrame([("a", 600), ("b", 200)], "key string, quota long")
    got = []
    for seed in range(12):
        got += [r.hi - r.lo for r in M.split_quotas(q, 800, 4, seed).collect() if r.key == "a"]
    assert abs(sum(got) / len(got) - 150) < 1e-9 and len(set(got)) > 3 and max(abs(x - 150) for x in got) < 40


def test_mixed_documents(docs):
    out = M.mixed_documents(docs, n_shards=3)
    assert out.columns == docs.columns
    want = Counter()
    for r in M.mix(docs, n_shards=3).collect():
        want[r.doc_id] += len(r.draws)
    assert Counter(r.doc_id for r in out.collect()) == +want
    loose = M.mixed_documents(docs, n_shards=3, ordered=False)
    assert sorted(map(repr, loose.collect())) == sorted(map(repr, out.collect()))


def test_empty(empty):
    assert M.mix(empty).count() == 0 and M.mixed_documents(empty).count() == 0


def test_blocks_cut_a_hot_source(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lit("hot").alias("source"))
    most = M.sized(df).groupBy("key", "bin").count().agg(F.max("count")).first()[0]
    assert most < 40
