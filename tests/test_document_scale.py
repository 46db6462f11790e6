"""Document graphs and the cleaning plan at size: the same rows with fewer passes."""

from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import tokens as TK

ODD = ["", None, " ", "a", "@@", "@@. b", "a.b. c", "É! é? İx. K Σσ", "can't \"won't\". it's\\n they'll (go), he'd?! ok", "a.\n\nb.\tc\x0bd\r\ne",
       "x\x01y. \x01 z", "...  . ! ?", "a.'  b. \" . c", " lead. trail. ", "we've I'm n't 's", "a" + " " * 300 + ". b", "\n", ".\n", "q?   r"]


@pytest.mark.parametrize("collapse", [True, False])
def test_words_of_sentences_by_whole_texts(spark, monkeypatch, collapse):
    monkeypatch.setattr(TK, "TEXT_BYTES", 50)
    texts = ODD + ["".join(x) for x in product(["a", ".", " ", "'", "\n", "\x01", "é"], repeat=4)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3, "doc_id")
    plain = F.transform(T.split_sentences(T.clean_simple("text", collapse)), lambda s: T.split_ws(T.clean_str(s)))
    want = {r.doc_id: r for r in df.select("doc_id", plain.alias("t"), T.split_ws(T.clean_str("text")).alias("w")).collect()}
    got = {r.doc_id: r.t for r in TK.sentence_lists(df, "doc_id", "text", collapse).collect()}
    assert len(got) == len(texts)
    for k, x in enumerate(texts):
        assert got[k] == want[k].t, x
        assert x is None or [w.decode() for w in TK.short_words(x.encode())] == want[k].w, x
    counts = Counter(w for r in want.values() for w in r.w or ())
    assert {r.word: r.n for r in TK.short_word_freq(df).collect()} == counts


def test_words_of_lists_are_counted_in_their_batch(spark):
    df = spark.createDataFrame([(["a", "b", "a"],), (None,), ([],), (["b"],)], "t array<string>")
    assert {r.word: r.n for r in TK.list_freq(df, "t").collect()} == {"a": 2, "b": 2}
    df = spark.createDataFrame([([["a"], [], ["b", "a"]],), (None,)], "t array<array<string>>")
    assert {r.word: r.n for r in TK.list_freq(df, "t").collect()} == {"a": 2, "b": 1}


def test_ranks_are_read_from_a_table(spark):
    from tessera.operators.ranking import global_rank
    df = spark.createDataFrame([(f"w{i:03d}",) for i in range(300)], "word string")
    ranked = global_rank(df, ["word"], num_partitions=7)
    assert [r["rank"] for r in ranked.orderBy("word").collect()] == list(range(300))
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" in plan and "ExistingRDD" not in plan


@pytest.mark.parametrize("most", [1 << 19, 3])
def test_pooling_is_fitted_without_states(spark, monkeypatch, most):
    """The same weights as from stored states; no pass runs its tasks one after another."""
    from tessera.operators import graph as G
    from tessera.operators import pooling as PL
    monkeypatch.setattr(PL, "FIT_VECTORS", most)
    monkeypatch.setattr(PL, "FIT_TOKENS", 20)
    rng = np.random.default_rng(3)
    docs = [(d, [int(x) for x in rng.integers(0, 9, rng.integers(1, 14))], int(d % 3)) for d in range(30)] + [(30, [], 1), (31, [4, 4], None)]
    seq = spark.createDataFrame(docs, "doc_id long, ids array<int>, y int").repartition(4, "doc_id")
    rest, vec = rng.normal(size=4), {n: rng.normal(size=4).astype("f4").tolist() for n in (0, 1, 3, 4, 6)}
    inputs = G.Inputs(seq, spark.createDataFrame(list(vec.items()), "node int, vec array<float>"), rest)
    for hops in (1, 2):
        net = PL.Pooling(4, 3)
        states = G.state_rows(inputs, 2, hops)
        theta, trace = PL.fit(states, net, 6)
        if most > 3:
            monkeypatch.setattr(G, "state_rows", None)
        got, mine = PL.fit_sequences(inputs, 2, hops, net, 6)
        monkeypatch.undo()
        monkeypatch.setattr(PL, "FIT_VECTORS", most)
        assert np.allclose(got, theta, atol=1e-4) and np.allclose(mine, trace, atol=1e-5)
    monkeypatch.setattr(type(seq), "toLocalIterator", None)
    assert PL.pass_gradient(states.filter("y is not null"), net, theta)[0] == 31
    assert PL.pass_gradient(states.filter("doc_id < 0"), net, theta) is None


@pytest.mark.parametrize("kind,layers,d", [("logistic", None, 40), ("mlp", [40, 5, 3], 40), ("mlp", [3, 5, 3], 3)])
def test_rewards_read_packed_rows(spark, monkeypatch, kind, layers, d):
    """The metric of an iteration is that of the lists, and makes no dense row per document."""
    from tessera.operators import network as NW
    from tessera.operators import valuer as VL
    from tessera.plans import valuation as VA
    monkeypatch.setattr(VL, "PACK_ROWS", 7)
    rng = np.random.default_rng(1)
    net = VA.in_loop(kind, 3, d, layers, 0, 0.1, 5)
    theta = rng.normal(size=net.size() - 2)
    rows = [(int(rng.integers(0, 3)), sorted(rng.choice(d, min(d, int(rng.integers(0, 5))), replace=False).tolist())) for _ in range(60)]
    rows = [(i, y, j, [float(x) for x in rng.integers(1, 9, len(j))]) for i, (y, j) in enumerate(rows)]
    df = spark.createDataFrame(rows, "row_id long, y int, j array<int>, n array<double>").repartition(3, "row_id")
    packed = df.select("y", "j", "n").mapInArrow(VL.pack_function(), VL.PACKED).cache()
    for perf in NW.ADDITIVE:
        if perf in VA.CLASS_METRICS:
            want = VA.add_up(df, VL.metric_function(net, theta, 3, d, perf))
            with monkeypatch.context() as m:
                m.setattr(VL, "rows_of", None)
                got = VA.add_up(packed, VL.packed_metric_function(net, theta, perf))
            assert got[0] == 60 and np.allclose(got, want)
