import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import simhash as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fp(text):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius=3):
    """Smallest index reachable over links, for every index."""
    a = np.array(fps, np.uint64)
    root = np.arange(len(a))
    while True:
        new = np.array([root[np.bitwise_count(a ^ x) <= radius].min() for x in a])
        new = np.minimum(new, root[new])
        if (new == root).all():
            return root
        root = new


def test_against_brute_force(docs, rows):
    got = sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in S.near_duplicates(docs).collect()), key=repr)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0]))
    fps = [brute_fp(rows[i][1]) for i in order]
    comp = brute_components(fps)
    want = sorted(((rows[i][0], fp, rows[order[c]][0]) for i, fp, c in zip(order, fps, comp, strict=True)), key=repr)
    assert got == want


@pytest.mark.parametrize("seed", [0, 1])
def test_links_of_planted_chains(spark, seed, monkeypatch):
    """Chains of close fingerprints, one crowded cluster, and tiles of several pieces."""
    monkeypatch.setattr(S, "TILE", 16)
    rng = random.Random(seed)
    fps = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            fps.add(x)
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
    center = rng.getrandbits(64)
    fps |= {center ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20)}
    fps = sorted(fps)
    df = spark.createDataFrame([(x - 2**64 if x >> 63 else x,) for x in fps], "fp long")
    comp = {r.node: r.root for r in S.components(S.links(df)).collect()}
    labels = [comp.get(x - 2**64 if x >> 63 else x, x - 2**64 if x >> 63 else x) for x in fps]
    want = brute_components(fps)
    groups = {}
    for lab, w in zip(labels, want, strict=True):
        groups.setdefault(lab, set()).add(int(w))
    assert all(len(v) == 1 for v in groups.values()) and len(groups) == len(set(want.tolist()))


@pytest.mark.parametrize("bound", [S.BROADCAST_BYTES, -1])
def test_one_of_each_group_stays(docs, bound):
    kept = S.keep_one(docs, broadcast_bytes=bound)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    want = {r.component_id for r in S.near_duplicates(docs).filter("doc_id IS NOT NULL").collect()}
    assert sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == 1


def test_components_of_a_long_path(spark):
    n = 300
    edges = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {(r.node, r.root) for r in S.components(edges).collect()} == {(i, 0) for i in range(1, n + 1)}


def test_empty(empty):
    assert S.near_duplicates(empty).count() == 0 and S.keep_one(empty).count() == 0


def test_rows_not_ids_are_kept(spark):
    """One row of each group stays, whatever ids the rows share."""
    a, b, c = ("alpha beta gamma delta " * 9, "one two three four five " * 9, "red green blue " * 9)
    rows = [(7, a, "x"), (7, b, "y"), (3, a, "z"), (None, b, "u"), (None, c, "v"), (None, c, "v"), (5, c + "tail", "w"), (9, a, "x"), (9, a, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, h1 string").repartition(3)
    for bound in (S.BROADCAST_BYTES, -1):
        kept = sorted(((r.doc_id, r.text) for r in S.keep_one(df, broadcast_bytes=bound).collect()), key=repr)
        fps = [brute_fp(t) for _, t, _ in rows]
        comp = brute_components(fps)
        want = {}
        for (i, t, _), k in zip(rows, comp.tolist(), strict=True):
            want[k] = min(want.get(k, (2, 0, "")), (i is None, i or 0, t))
        assert kept == sorted(((None if none else i, t) for none, i, t in want.values()), key=repr)
        assert (7, b) in kept and (3, a) in kept


def test_a_crowded_tile_is_compared_in_groups(spark, monkeypatch):
    """Hundreds of fingerprints with the same bit counts, in pieces of four: no link is lost."""
    monkeypatch.setattr(S, "TILE", 4)
    rng = random.Random(2)
    fps = sorted({sum(1 << (16 * p + b) for p in range(4) for b in rng.sample(range(16), 8)) for _ in range(150)})
    for x in fps[:60]:
        part, bits = rng.randrange(4), []
        on = [b for b in range(16) if x >> (16 * part + b) & 1]
        off = [b for b in range(16) if b not in on]
        bits = [rng.choice(on), rng.choice(off)]
        fps.append(x ^ sum(1 << (16 * part + b) for b in bits))
    fps = sorted(set(fps))
    signed = lambda x: x - 2**64 if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    comp = {r.node: r.root for r in S.components(S.links(df)).collect()}
    groups = {}
    for x, w in zip(fps, brute_components(fps).tolist(), strict=True):
        groups.setdefault(comp.get(signed(x), signed(x)), set()).add(w)
    assert all(len(v) == 1 for v in groups.values()) and len(groups) == len(set(brute_components(fps).tolist()))
