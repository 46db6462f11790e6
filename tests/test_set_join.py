"""Set-similarity join, wide one-hot, fitted pooling, pluggable curve and streams."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import NaiveBayes
from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.operators import pooling as PL
from tessera.operators import recode as RC
from tessera.operators import set_join as SJ
from tessera.plans import valuation as VA
from tessera.plans.estimator_curve import estimator_curve
from tessera.streaming import valuing as SV
from tests.conftest import SMALL


def brute_pairs(rows, t):
    sets = {}
    for i, s in rows:
        s = frozenset(x for x in s or () if x is not None)
        if s:
            sets[s] = min(sets.get(s, i), i)
    out, items = set(), [(i, s) for s, i in sets.items()]
    for a, x in items:
        for b, y in items:
            if a < b and len(x & y) / len(x | y) >= t:
                out.add((a, b, round(len(x & y) / len(x | y), 9)))
    return sets, out


@pytest.mark.parametrize("t,head", [(0.3, 1 << 16), (0.5, 3), (0.8, 1 << 16), (0.8, 0), (1.0, 5)])
def test_similar_sets_against_brute_force(spark, monkeypatch, t, head):
    order = SJ.prefixes
    monkeypatch.setattr(SJ, "prefixes", lambda sets, threshold: order(sets, threshold, head))
    rng = random.Random(int(t * 10))
    rows = [(0, None), (1, []), (2, [None]), (3, ["a", "a", None]), (4, ["a"])]
    for i in range(5, 150):
        base = [f"w{int(rng.paretovariate(0.8)) % 40}" for _ in range(rng.randint(1, 14))]
        rows.append((i, base))
        rows.append((1000 + i, base + [f"x{rng.randrange(30)}"] * rng.randint(0, 2)))
    df = spark.createDataFrame(rows, "id long, tokens array<string>").repartition(3)
    sets, want = brute_pairs(rows, t)
    members, pairs = SJ.similar_sets(df, t)
    assert {(r.a_id, r.b_id, round(r.similarity, 9)) for r in pairs.collect()} == want
    got = {r.id: r.class_id for r in members.collect()}
    assert got == {i: sets[k] for i, s in rows if (k := frozenset(x for x in s or () if x is not None))}


def test_join_without_all_pairs(spark):
    """Thousands of sets that share their frequent tokens only: few candidates."""
    rows = [(i, ["the", "of", "and", f"r{i}", f"s{i}", f"t{i}"]) for i in range(2000)]
    of = SJ.classes(spark.createDataFrame(rows, "id long, tokens array<string>"))[1]
    assert SJ.candidates(SJ.prefixes(of, 0.8, most=2), 0.8).count() == 0
    assert SJ.candidates(SJ.prefixes(of, 0.8), 0.8).count() == 0
    with pytest.raises(ValueError):
        SJ.similar_sets(of, 0.0)
    assert SJ.similar_sets(spark.createDataFrame([], "id long, tokens array<string>"), 0.5)[1].count() == 0


def test_sets_that_share_a_token_are_not_stored_as_pairs(spark):
    """Sets that share one token of many are compared where they meet; no pair of them leaves."""
    rows = [(i, ["aaa"] + [f"r{i}x{k}" for k in range(20)]) for i in range(400)]
    of = SJ.classes(spark.createDataFrame(rows, "id long, tokens array<string>").repartition(3))[1]
    assert SJ.candidates(SJ.prefixes(of, 0.7, most=0), 0.7).count() < 40  # 79,800 before


def test_large_sets_crowds_and_hot_tokens_against_brute_force(spark, monkeypatch):
    """Bitmaps longer than a bucket's, groups of near copies over several blocks and buckets, and
    frequent tokens in prefixes, with ids that are no numbers."""
    monkeypatch.setattr(SJ, "BLOCK", 3000)
    monkeypatch.setattr(SJ, "LINKS", 50)
    monkeypatch.setattr(SJ, "BUCKET", 1000)
    rng = random.Random(5)
    bases = [[f"w{rng.randrange(4000)}" for _ in range(n)] for n in (3, 40, 90, 400, 900, 2500)]
    rows = []
    for i in range(180):
        base = bases[i % 6]
        own = [w for w in base if rng.random() > 0.12] + [f"u{i}_{k}" for k in range(rng.randrange(1 + len(base) // 10))]
        rows.append((f"d{i:03}", own))
    rows += [("z", None), ("y", list(reversed(rows[7][1])))]
    df = spark.createDataFrame(rows, "id string, tokens array<string>").repartition(4)
    sets, want = brute_pairs(rows, 0.7)
    members, pairs = SJ.similar_sets(df, 0.7)
    assert {(r.a_id, r.b_id, round(r.similarity, 9)) for r in pairs.collect()} == want and len(want) > 300
    assert {r.id: r.class_id for r in members.collect()} == {i: sets[frozenset(s)] for i, s in rows if s}


def test_sparse_one_hot(spark):
    rows = [(1, "x", 10), (2, None, 20), (3, "y", None), (4, "x", 20)]
    df = spark.createDataFrame(rows, "id long, a string, b int")
    got = {r.id: (r.features.size, r.features.indices.tolist()) for r in RC.sparse_one_hot(df, "id", ["a", "b"]).collect()}
    assert got == {1: (4, [0, 2]), 2: (4, [3]), 3: (4, [1]), 4: (4, [0, 3])}
    index = RC.category_index(df.filter("id < 3"), ["a", "b"])
    other = {r.id: r.indices for r in RC.one_hot_indices(df, "id", ["a", "b"], index).collect()}
    assert other == {1: [0, 1], 2: [2], 3: [], 4: [0, 2]}


def test_pooling_gradient_is_the_finite_difference():
    rng = np.random.default_rng(0)
    net = PL.Pooling(4, 3)
    theta = net.initial(1)
    sizes, states, y = np.array([3, 0, 5, 1]), rng.normal(size=(9, 4)), np.array([0, 2, 1, 1])
    got, want = net.gradient(theta, states, sizes, y), np.zeros_like(theta)
    for i in range(len(theta)):
        e = np.zeros_like(theta)
        e[i] = 1e-6
        want[i] = (net.gradient(theta + e, states, sizes, y)[1] - net.gradient(theta - e, states, sizes, y)[1]) / 2e-6
    assert got[0] == 4 and np.allclose(got[3:], want, atol=1e-6)


def small_graph(spark):
    rng = np.random.default_rng(1)
    toks = [(d, i, int(x)) for d in range(30) for i, x in enumerate(rng.integers(0, 6, 12) + 6 * (d % 2))]
    enc = spark.createDataFrame(toks, "doc_id long, tpos int, node int")
    seq = G.sequences(enc)
    adj = G.normalized(G.edges(seq, 2), seq).cache()
    vec = {n: rng.normal(size=5).tolist() for n in range(12)}
    h = spark.createDataFrame([(n, v) for n, v in vec.items()], "node int, vec array<double>")
    return adj, G.nodes(seq).join(h, "node").select("doc_id", "node", "vec").cache()


def test_fitted_pooling_learns_and_depths_agree(spark):
    adj, h = small_graph(spark)
    states = PL.packed_states(G.propagate(adj, h, 1)).cache()
    labels = spark.createDataFrame([(d, d % 2) for d in range(30)], "doc_id long, y int")
    net = PL.Pooling(5, 2)
    theta, trace = PL.fit(states.join(labels, "doc_id"), net, epochs=40, rate=0.1)
    assert trace[-1][0] < 0.3 < trace[0][0] and trace[-1][1] > 0.95
    mine = {r.doc_id: r.vec for r in PL.vectors(states, net, theta).collect()}
    theirs = {r.doc_id: r.vec for r in G.attention_pool(adj, h, 1, *net.attention(theta)).collect()}
    assert all(np.allclose(mine[d], theirs[d], atol=1e-4) for d in theirs) and len(mine) == 30
    both = G.attention_pool_depths(adj, h, [0, 1, 3], *net.attention(theta)).collect()
    for depth in (0, 1, 3):
        want = {r.doc_id: r.vec for r in G.attention_pool(adj, h, depth, *net.attention(theta)).collect()}
        got = {r.doc_id: r.vec for r in both if r.depth == depth}
        assert all(np.allclose(got[d], want[d]) for d in want) and len(got) == len(want) == 30


def test_a_curve_goes_on_where_it_stopped(spark, tmp_path):
    from tests.test_valuer_loop import classes
    data = classes(spark, 60)
    values = data.train.select("row_id", (F.col("row_id") % 7).cast("double").alias("data_value"))
    fits = []

    def broken():
        fits.append(1)
        if len(fits) == 4:
            raise InterruptedError
        return NaiveBayes(featuresCol="features", labelCol="y")
    with pytest.raises(InterruptedError):
        estimator_curve(data, values, broken, bins=3, parallel=1, folder=str(tmp_path))
    missing = 6 - (len(fits) - 1)
    fits.clear()

    def counted():
        fits.append(1)
        return NaiveBayes(featuresCol="features", labelCol="y")
    curve = estimator_curve(data, values, counted, bins=3, folder=str(tmp_path)).collect()
    assert len(curve) == 6 and len(fits) == missing >= 1
    left = {(r.mode, r.bin): r.n_rows for r in curve}
    assert left["low", 0] == left["high", 0] == 60 and left["low", 2] == 20
    whole = VA.metric(VA.predict(VA.fit(data.train, kind="naive_bayes"), data.valid), "accuracy", 2)
    assert next(r.valid_metric for r in curve if r.bin == 0) == pytest.approx(whole)


def test_streamed_values_are_the_trainers(spark, tmp_path):
    data = VA.lang_features(spark, SMALL)
    tr = VA.ValuerTrainer(data, predictor="logistic", predictor_iter=5).train(1)
    SV.release_of(tr, data.words, tr.reference).publish(spark, f"{tmp_path}/v")
    release = SV.Release.read(spark, f"{tmp_path}/v")
    text = spark.read.parquet(f"{SMALL}/documents.parquet").select(F.col("doc_id").alias("row_id"), "text")
    rows = data.train.select("row_id", "y").join(text, "row_id")
    got = {r.row_id: r.data_value for r in SV.value_rows(rows, release).collect()}
    want = {r.row_id: r.data_value for r in tr.values().collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_replayed_batches_and_versions(spark, tmp_path):
    words = spark.createDataFrame([("alpha", 1), ("beta", 2)], "word string, word_id int")
    assert [SV.publish_vocabulary(words, f"{tmp_path}/vocab"), SV.publish_vocabulary(words.filter("word_id = 1"), f"{tmp_path}/vocab")] == [1, 2]
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, ""), (3, None)], "doc_id long, text string")
    folder = f"{tmp_path}/in"
    docs.coalesce(1).write.parquet(folder)
    vocab = SV.read_vocabulary(spark, f"{tmp_path}/vocab", 1)
    stream = lambda: spark.readStream.schema(docs.schema).parquet(folder)
    for ckpt in ("one", "two"):  # the second run replays batch 0 after its progress was lost
        SV.by_batch(stream(), lambda d: SV.encode_documents(d, vocab), f"{tmp_path}/out", f"{tmp_path}/{ckpt}")
    got = {r.doc_id: r.ids for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {1: [1, 2, 0], 2: [], 3: []} and spark.read.parquet(f"{tmp_path}/out").count() == 3


def test_lines_are_numbered_across_splits_and_files(spark, tmp_path):
    """Small splits, several in a task, empty files and batches that end inside a split."""
    from tessera.sources.readers import numbered_lines
    want = []
    for k, n in enumerate((7, 0, 300, 1, 90)):
        lines = [f"{k} line {i} " + "x" * (i % 13) for i in range(n)]
        (tmp_path / f"part-{k:05}").write_text("".join(x + "\n" for x in lines))
        want += lines
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        for k, v in zip(keep, ("700", "10", "16"), strict=True):
            spark.conf.set(k, v)
        got = sorted((r.line, r.value) for r in numbered_lines(spark, str(tmp_path)).collect())
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert got == list(enumerate(want, 1))


def test_adjacency_of_sequences_is_that_of_edges(spark, monkeypatch):
    monkeypatch.setattr(G, "PART_TOKENS", 20)
    rng = np.random.default_rng(4)
    toks = [(d, i, int(x)) for d in range(25) for i, x in enumerate(rng.integers(0, 5, rng.integers(1, 30)))] + [(99, 0, 7), (98, 0, 3), (98, 1, 3)]
    seq = G.sequences(spark.createDataFrame(toks, "doc_id long, tpos int, node int"))
    for window in (1, 4):
        want = {(r.doc_id, r.src, r.dst): r.w for r in G.normalized(G.edges(seq, window), seq).collect()}
        got = {(r.doc_id, r.src, r.dst): r.w for r in G.normalized_adjacency(seq, window).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_a_table_of_part_files_is_streamed(spark, tmp_path):
    from tessera.streaming.scoring import document_stream
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(40)
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    vocab = spark.createDataFrame([("the", 1)], "word string, word_id int")
    SV.by_batch(document_stream(spark, str(tmp_path)), lambda d: SV.encode_documents(d, vocab), f"{tmp_path}/out", f"{tmp_path}/ckpt")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 40
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    SV.by_batch(document_stream(spark, f"{tmp_path}/none"), lambda d: SV.encode_documents(d, vocab), f"{tmp_path}/none/out", f"{tmp_path}/ckpt2")
    assert spark.read.parquet(f"{tmp_path}/none/out").count() == 0
