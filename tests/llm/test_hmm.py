import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import hmm as H
from tessera.llm.common import written

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def toks(t):
    return WORD.findall((t or "").translate(LOWER)) + ["\n"]


def is_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def model(k=3, symbols=5, seed=0):
    rng = np.random.default_rng(seed)
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    return H.Model(norm(rng.random(k), 0), norm(rng.random((k, k)), 1), norm(rng.random((symbols, k)), 0))


def paths(seq, m):
    """Likelihood and expected counts by summing over all state paths."""
    k = len(m.start)
    total, start, move, emit = 0.0, np.zeros(k), np.zeros((k, k)), np.zeros_like(m.emit)
    for path in itertools.product(range(k), repeat=len(seq)):
        p = m.start[path[0]] * m.emit[seq[0], path[0]]
        for a, b, x in zip(path, path[1:], seq[1:], strict=False):
            p *= m.move[a, b] * m.emit[x, b]
        total += p
        start[path[0]] += p
        for a, b in itertools.pairwise(path):
            move[a, b] += p
        for s, x in zip(path, seq, strict=True):
            emit[x, s] += p
    return total, start / total, move / total, emit / total


def test_forward_and_counts_against_all_paths():
    m = model()
    rng = np.random.default_rng(1)
    seqs = [rng.integers(0, 5, n).astype(np.uint16) for n in (1, 4, 6, 2, 6)]
    want = [paths(s.tolist(), m) for s in seqs]
    assert np.allclose(H.log_likelihood(seqs, m), [math.log(w[0]) for w in want])
    start, move, emit, ll = H.expected_counts(seqs, m)
    assert np.allclose(start, sum(w[1] for w in want), atol=1e-4)
    assert np.allclose(move, sum(w[2] for w in want), atol=1e-4)
    assert np.allclose(emit, sum(w[3] for w in want), atol=1e-4)
    assert math.isclose(ll, sum(math.log(w[0]) for w in want), rel_tol=1e-5)


def test_long_sequence_does_not_underflow():
    m = model(symbols=2000)
    seq = np.random.default_rng(2).integers(0, 2000, 50_000).astype(np.uint16)
    assert np.isfinite(H.log_likelihood([seq, seq[:1]], m)).all()


@pytest.mark.parametrize("head", [H.HEAD, 20, 0])
def test_base_against_brute_force(docs, rows, head):
    """All three word sources (own symbol, broadcast, joined) give the same base."""
    got = H.score(docs, iterations=1, head=head).collect()
    c = Counter(x for r in rows if not is_out(r[0]) for x in toks(r[1]))
    n, v = sum(c.values()), len(c)
    want = []
    for r in rows:
        t = toks(r[1])
        want.append((r[0], is_out(r[0]), len(t), sum(c[x] > 0 for x in t), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t)))
    key = lambda x: (x[0] is None, x[0] or 0, x[2])
    have = [(g.doc_id, g.held_out, g.n_tokens, g.n_known, g.train_tokens, g.base_score) for g in got]
    for a, b in zip(sorted(have, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9)
    assert all(math.isfinite(g.score) and g.score < 0 for g in got)


@pytest.mark.parametrize("head", [H.HEAD, 20, 0])
def test_emissions_are_a_distribution(spark, docs, head):
    """In every state the broadcast tokens, the joined ones, the rare ones and one unseen token of
    each bucket sum to 1."""
    src = docs.select("doc_id", F.lit(False).alias("held_out"), F.monotonically_increasing_id().alias("rid"), "text")
    counts = written(H.word_counts(docs.select("text")), "t")
    v, rest = H.vocabulary(counts, head)
    assert v.total == counts.agg(F.sum("c")).first()[0] and v.distinct == counts.count() and len(v.words) <= head
    enc = written(H.encode(src, spark.sparkContext.broadcast(v), "bigint"), "t")
    m, _, expected, of_bucket = H.baum_welch(enc, v, states=3, iterations=2)
    table, scoring = H.tail_table(rest, expected, m, of_bucket, v)
    assert np.allclose(m.emit.sum(0), 1)
    rows = table.collect()
    assert {r.word for r in rows} == {r.word for r in counts.collect()} - {w.decode() for w in v.words}
    assert all((r.e is not None) == (r.c >= H.MIN_COUNT) for r in rows)
    joined = sum((H.unpacked(np.frombuffer(r.e, "<u2")) for r in rows if r.e is not None), np.zeros(3))
    assert np.allclose(scoring.emit.sum(0) + joined, 1, atol=5e-4)  # of 16-bit emissions
    z = 10 ** v.ready().log_z  # rare tokens and one unseen token of a bucket share its symbol
    rare = Counter()
    for r in rows:
        if r.e is None:
            rare[H.bucket(r.word.encode())] += r.c + 0.5
    assert all(math.isclose(s + 0.5, z[b]) for b, s in rare.items())


def test_counts_behind_buckets_are_the_buckets_counts(spark, docs):
    src = docs.select("doc_id", F.lit(False).alias("held_out"), F.monotonically_increasing_id().alias("rid"), "text")
    counts = written(H.word_counts(docs.select("text")), "t")
    v, _ = H.vocabulary(counts, 10)
    enc = written(H.encode(src, spark.sparkContext.broadcast(v), "bigint"), "t")
    _, _, expected, of_bucket = H.baum_welch(enc, v, states=2, iterations=1)
    have, c = np.zeros((H.BUCKETS, 2)), {r.word: r.c for r in counts.collect()}
    for r in expected.collect():
        have[H.bucket(r.word.encode())] += (r.s0, r.s1)
        assert math.isclose(r.s0 + r.s1, c[r.word], rel_tol=2e-3)
    assert np.allclose(have, of_bucket, rtol=2e-3, atol=1e-2)


def test_bucket_is_sparks_hash(spark):
    words = ["a", "né", "x" * 50, "\n"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r.w: r.b for r in df.select("w", F.pmod(F.xxhash64("w"), F.lit(H.BUCKETS)).alias("b")).collect()}
    assert got == {w: H.bucket(w.encode()) for w in words}


def test_training_likelihood_rises_and_beats_the_base(spark):
    """Documents of two vocabularies: states must learn to tell them apart."""
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(f"{'ab'[i % 2]}{int(x)}" for x in rng.zipf(1.5, 120) % 40)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = written(H.word_counts(docs.select("text")), "t")
    v, _ = H.vocabulary(counts)
    src = docs.select("doc_id", F.lit(False).alias("held_out"), F.col("doc_id").alias("rid"), "text")
    enc = written(H.encode(src, spark.sparkContext.broadcast(v), "bigint"), "t")
    _, trace, *_ = H.baum_welch(enc, v, states=4, iterations=6)
    assert all(b > a for a, b in itertools.pairwise(trace))
    out = [r for r in H.score(docs).collect() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) + 0.2 * sum(r.n_tokens for r in out)


def test_emissions_grow_with_the_vocabulary(spark):
    """Two topics with 40 frequent and 20,000 other words each: what topic one of the others
    is of can be learned only if it has emissions of its own."""
    rng = np.random.default_rng(0)
    rows = []
    for k in (0, 1):
        other = rng.permuted(np.tile(np.arange(100, 20_100), (20, 1)), axis=1).reshape(-1, 200)
        rows += [(2 * i + k, " ".join(f"{'ab'[k]}{x}" for x in rng.permutation(np.concatenate([d, rng.zipf(1.5, 200) % 40])))) for i, d in enumerate(other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = [r for r in H.score(docs).collect() if r.held_out]
    assert sum(r.score - r.base_score for r in out) > 0.25 * sum(r.n_tokens for r in out)


def test_joined_emissions_keep_the_gain(spark):
    """Emissions learned behind the buckets, in the last step only, give most of what broadcast
    ones give over the base, and the base does not depend on where they are kept."""
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(f"{'ab'[i % 2]}{int(x)}" for x in rng.zipf(1.3, 100) % 60)) for i in range(300)]
    docs = spark.createDataFrame([*rows, (None, None), (1001, "")], "doc_id long, text string").repartition(3)
    key = lambda r: (r.doc_id is None, r.doc_id)
    want, *others = (sorted(H.score(docs, states=3, head=head).collect(), key=key) for head in (H.HEAD, 20, 0))
    gain = lambda rows: sum(r.score - r.base_score for r in rows if r.held_out)
    assert gain(want) > 0.1 * sum(r.n_tokens for r in want if r.held_out)
    for got in others:
        assert [(a.doc_id, a.n_tokens, a.n_known) for a in got] == [(a.doc_id, a.n_tokens, a.n_known) for a in want]
        assert all(math.isclose(a.base_score, b.base_score, rel_tol=1e-9) for a, b in zip(got, want, strict=True))
        assert gain(got) > 0.8 * gain(want)


def test_empty(empty):
    assert H.score(empty).count() == 0
