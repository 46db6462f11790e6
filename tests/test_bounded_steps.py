"""Steps that grow no faster than their input: nothing whole in the driver, no copies of word
tables, sums and encodings in the document's row. Rows that share an id are counted together."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import tokens as TK
from tessera.operators import vocab as V
from tests.test_row_local import exchanges


def test_a_broadcast_side_is_not_repeated_per_salt(spark, tmp_path):
    """A stored table that looks small to the planner would go through the driver once per salt."""
    spark.range(3000).select(F.col("id").cast("string").alias("word"), F.col("id").alias("word_id")).write.parquet(f"{tmp_path}/v")
    right = spark.read.parquet(f"{tmp_path}/v")
    left = spark.createDataFrame([(1, "7"), (2, "x"), (3, "2999")], "doc_id long, word string")
    plan = TK.salted_join(left, right, "word", "left", "doc_id")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "Generate" not in text
    assert {(r.doc_id, r.word_id) for r in plan.collect()} == {(1, 7), (2, None), (3, 2999)}
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        salted = TK.salted_join(left, right, "word", "left", "doc_id")
        assert "Generate" in salted._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, salted.collect())) == sorted(map(tuple, plan.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)


def test_streamed_documents_are_encoded_in_their_row(spark, monkeypatch, tmp_path):
    from tessera.streaming import valuing as SV
    monkeypatch.setattr(TK, "LOOKUP_ROWS", 2)  # several passes over the vocabulary
    vocab = spark.createDataFrame([("alpha", 1), ("beta", 2), ("delta", 3), ("eps", 4), ("zeta", 5)], "word string, word_id int")
    rows = [(1, "beta alpha nn beta"), (2, ""), (3, None), (4, "zeta")]
    once = SV.encode_documents(spark.createDataFrame(rows, "doc_id long, text string"), vocab)
    assert exchanges(once) == 0
    assert {r.doc_id: r.ids for r in once.collect()} == {1: [2, 1, 0, 2], 2: [], 3: [], 4: [5]}
    rows += [(1, "alpha eps"), (None, "alpha"), (None, "beta"), (3, "delta")]
    got = [(r.doc_id, r.ids) for r in SV.encode_documents(spark.createDataFrame(rows, "doc_id long, text string"), vocab).collect()]
    assert sorted(got, key=str) == sorted([(1, [1, 2, 1, 4, 0, 2]), (2, []), (3, [3]), (4, [5]), (None, [])], key=str)


def test_mean_vectors_move_no_token(spark, monkeypatch):
    monkeypatch.setattr(V, "VECTOR_ROWS", 2)  # several passes over the vectors
    monkeypatch.setattr(V, "VECTOR_TOKENS", 5)
    rng = np.random.default_rng(3)
    vec = [(f"w{i}", i, rng.normal(size=4).tolist()) for i in range(9)] + [("w3", 3, [1.0, 2.0, 3.0, 4.0]), ("w8", 8, None)]
    vectors = spark.createDataFrame(vec, "word string, vec_id long, vec array<double>")
    rows = [(i, [f"w{int(x)}" for x in rng.integers(0, 14, i)]) for i in range(12)] + [(50, None)]
    repeated = rows + [(3, ["w1", "w3"]), (3, []), (None, ["w1"]), (None, ["w2"])]

    def plain(rows):
        by, out = {}, []
        for d, t in rows:
            by.setdefault(d, []).extend(np.array(v) for w in t or () for x, _, v in vec if x == w and v is not None)
        for d, _ in rows:
            out.append((d, np.mean(by[d], 0) if d is not None and by[d] else np.zeros(4)))
        return sorted(out, key=lambda x: str(x[0]))
    for data in (rows, repeated):
        df = V.mean_vectors(spark.createDataFrame(data, "doc_id long, t array<string>"), vectors, 4)
        if data is rows:
            assert exchanges(df) == 0
        got = sorted(((r.doc_id, r.vec) for r in df.collect()), key=lambda x: str(x[0]))
        want = plain(data)
        assert [d for d, _ in got] == [d for d, _ in want] and all(np.allclose(a, b) for (_, a), (_, b) in zip(got, want, strict=True))


def test_document_frequencies_of_lists(spark):
    rows = [(1, ["a", "a", "b"]), (2, ["a"]), (3, []), (4, None)]
    for data in (rows, rows + [(1, ["a", "c"]), (2, ["a"]), (None, ["c"]), (None, ["c"])]):
        df = spark.createDataFrame(data, "doc_id long, t array<string>")
        want = {r.word: r.df for r in V.doc_freq(df.select("doc_id", F.explode("t").alias("word"))).collect()}
        assert {r.word: r.df for r in V.list_doc_freq(df).collect()} == want


def test_models_count_and_score_in_the_row(spark, monkeypatch):
    from tessera.operators import additive as AD
    monkeypatch.setattr(AD, "SCORE_ROWS", 3)
    rng = np.random.default_rng(5)
    k, d, groups = 3, 7, 4
    lists = [(i, sorted(rng.choice(d, rng.integers(0, d), replace=False).tolist())) for i in range(40)]
    lists = [(i, j, [float(x) for x in rng.integers(1, 5, len(j))]) for i, j in lists] + [(7, [0, 2], [1.0, 4.0]), (None, [1], [1.0])]
    bow = AD.one_row_each(spark.createDataFrame(lists, "row_id long, j array<int>, n array<double>"))
    rows = [(i, int(rng.integers(0, k)), int(rng.integers(0, groups))) for i in range(45)] + [(3, 1, 2), (None, 0, 0)]
    df = spark.createDataFrame(rows, "row_id long, y int, b int")
    n, c = AD.nb_statistics(df, bow, k, d, groups, "b")
    want_n, want_c = np.zeros((groups, k)), np.zeros((groups, k, d))
    for i, y, b in rows:
        want_n[b, y] += 1
        for r, j, m in lists:
            if i is not None and r == i:
                np.add.at(want_c[b, y], j, m)
    assert np.array_equal(n, want_n) and np.array_equal(c, want_c)
    long = spark.createDataFrame([(i, w, int(x)) for i, j, m in lists for w, x in zip(j, m, strict=True)], "row_id long, word_id int, n long")
    assert np.array_equal(AD.nb_statistics(df, long, k, d, groups, "b")[1], want_c)
    models = AD.NaiveBayes.of(n, c)
    got = AD.nb_predict(df.select("row_id", "y"), bow, models).collect()
    assert len(got) == len(rows) * groups
    for r in got:
        counts = np.zeros(d)
        for i, j, m in lists:
            if i is not None and r.row_id == i:
                np.add.at(counts, j, m)
        raw = models.prior[r.model] + models.term[r.model] @ counts
        e = np.exp(raw - raw.max())
        assert np.allclose(r.p, e / e.sum())


def test_bags_of_words_are_counted_in_their_row(spark):
    vocab = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "word string, word_id int")
    rows = [(1, ["a", "b", "a", "x"]), (2, []), (3, None), (4, ["x"])]
    once = V.list_bow(spark.createDataFrame(rows, "doc_id long, t array<string>"), vocab)
    assert exchanges(once) == 0
    assert sorted(map(tuple, once.collect())) == [(1, 0, 2, 3), (1, 1, 1, 3)]
    df = spark.createDataFrame(rows + [(1, ["a", "c"]), (None, ["a"]), (None, ["b"])], "doc_id long, t array<string>")
    toks = df.select("doc_id", F.explode("t").alias("word"))
    old, new = V.bow(toks, vocab), V.list_bow(df, vocab)
    assert sorted(map(tuple, old.collect()), key=str) == sorted(map(tuple, new.drop("total").collect()), key=str)
    a, b = V.row_normalize(old), V.row_normalize(new, total="total")
    cols = ["doc_id", "word_id", "n", "v"]
    assert sorted(map(tuple, a.select(cols).collect())) == sorted(map(tuple, b.select(cols).collect()))


def test_padding_is_one_string(spark):
    df = spark.createDataFrame([([1, 22],), ([],), ([1, 2, 3, 4, 5],)], "ids array<int>")
    for length in (1, 2, 4):
        got = df.select(V.padded_text("ids", length).alias("a"), F.array_join(V.padded("ids", length).cast("array<string>"), " ").alias("b")).collect()
        assert all(r.a == r.b for r in got)


def test_char_grams_are_taken_in_their_row(spark, monkeypatch):
    from tessera.functions import similarity as S
    from tessera.operators import char_grams as CG
    monkeypatch.setattr(CG, "PART_CHARS", 7)
    monkeypatch.setattr(CG, "COUNTED", 5)
    rows = [(1, "Abc  ab", "abd"), (2, "", None), (3, "\U0001F600ä\u0000x", "ä\U0001F600"), (4, "aaaa", "a"), (5, "long  " * 9, "x")]
    df = spark.createDataFrame(rows, "pair long, a string, b string")
    each = df.select("pair", F.explode(F.array(F.struct(F.array_distinct(S.char_ngrams("a")).alias("g")),
                                               F.struct(F.array_distinct(S.char_ngrams("b")).alias("g")))).alias("x")).select("pair", F.explode("x.g").alias("gram"))
    want = {r.gram: r.n for r in each.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()}
    p = df.select("pair", S.gram_text("a").alias("a"), S.gram_text("b").alias("b"))
    assert {r.gram: r.n for r in CG.frequencies(p, ["a", "b"]).groupBy("gram").agg(F.sum("df").alias("n")).collect()} == want
    places = {g: i for i, g in enumerate(sorted(want)[::2])}
    held = CG.held(p, ["a", "b"], places)
    assert exchanges(held) == 0
    by = {(r.pair, r.gram): r.n for r in each.groupBy("pair", "gram").agg(F.count(F.lit(1)).alias("n")).collect() if r.gram in places}
    assert {(r.pair, r.gram_id): r.c for r in held.collect()} == {(k, places[g]): n for (k, g), n in by.items()}
    assert CG.held(p, ["a", "b"], {}).count() == 0
