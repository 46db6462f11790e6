"""Closed-form predictors, removal curves, regression valuation and robust labels."""

import math

import numpy as np
import pytest
from pyspark.ml.classification import NaiveBayes as SparkNaiveBayes
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tests.conftest import MID, SMALL
from tessera.operators import additive as AD
from tessera.operators import metrics as MT
from tessera.operators import tokens as TK
from tessera.operators import valuer as VL
from tessera.operators import vocab as V
from tessera.operators.sampling import corrupt_label
from tessera.plans import tasks
from tessera.plans import valuation as VA


@pytest.fixture(scope="module")
def data(spark):
    return VA.lang_features(spark, MID)


def test_naive_bayes_is_sparks(spark):
    rng = np.random.default_rng(0)
    rows = [(i, int(i % 3), [int(x) for x in rng.poisson(1 + (i % 3 == np.arange(6) % 3), 6)]) for i in range(60)]
    bow = spark.createDataFrame([(i, j, c) for i, _, v in rows for j, c in enumerate(v) if c], "row_id long, word_id int, n long")
    labels = spark.createDataFrame([(i, y) for i, y, _ in rows], "row_id long, y int")
    mine = AD.nb_predict(labels, bow, AD.NaiveBayes.of(*AD.nb_statistics(labels, bow, 3, 6))).collect()
    vecs = spark.createDataFrame([(i, float(y), Vectors.dense(v)) for i, y, v in rows], ["row_id", "y", "features"])
    theirs = SparkNaiveBayes(labelCol="y").fit(vecs).transform(vecs).collect()
    ref = {r.row_id: r.probability.toArray() for r in theirs}
    assert all(np.allclose(r.p, ref[r.row_id], atol=1e-9) for r in mine) and len(mine) == 60


def test_a_missing_class_is_never_predicted(spark):
    bow = spark.createDataFrame([(1, 0, 2), (2, 1, 1), (3, 0, 1)], "row_id long, word_id int, n long")
    train = spark.createDataFrame([(1, 0), (2, 2)], "row_id long, y int")
    out = AD.nb_predict(spark.createDataFrame([(3, 0), (4, 0)], "row_id long, y int"), bow, AD.NaiveBayes.of(*AD.nb_statistics(train, bow, 3, 2)))
    got = {r.row_id: r.p for r in out.collect()}
    assert got[3][1] == 0 and got[3][0] > got[3][2] and math.isclose(got[4][0], got[4][2])


def test_one_pass_curve_equals_refits(data):
    values = VA.simple_values(data)
    curve = {(r.mode, r.bin): r for r in VA.remove_high_low(data, values, bins=5).collect()}
    ranked = VA.ranked_values(data.train, values)
    n = ranked.count()
    assert len(curve) == 10
    for mode, rank in VA.MODES:
        for b in (0, 2, 4):
            kept = ranked.filter(F.col(rank) >= int(b * n / 5)).select("row_id", "y")
            m = VA.nb_fit(kept, data)
            for part, rows in (("valid", data.valid), ("test", data.test)):
                acc = VA.metric(VA.nb_scores(VA.labelled(rows), data, m))
                assert math.isclose(acc, curve[mode, b][f"{part}_metric"])
            assert curve[mode, b].n_rows == kept.count()


@pytest.mark.parametrize("perf", ["accuracy", "auc", "log_loss"])
def test_curve_metrics(data, perf):
    rows = VA.remove_high_low(data, VA.simple_values(data), perf=perf, bins=3).collect()
    assert len(rows) == 6 and all(r.valid_metric is not None for r in rows)


def test_unknown_metrics_raise(data):
    for call in (lambda: VA.remove_high_low(data, None, perf="rmspe"), lambda: VA.metric(None, "f1"),
                 lambda: VA.ValuerTrainer(data, perf="f1"), lambda: VA.regression_curve(None, None, None, "g", [], perf="accuracy")):
        with pytest.raises(ValueError, match="unknown metric"):
            call()


def test_gain_is_reversed_for_errors():
    assert VA.gain(0.9, 0.8, "accuracy") > 0 and VA.gain(0.9, 0.8, "mae") < 0


def test_group_means_and_regression_values(spark):
    rows = spark.createDataFrame([(1, 10.0, 1), (2, 30.0, 1), (3, 5.0, 2), (4, 0.0, 2)], "row_id long, y double, g int")
    m = AD.GroupMeans.of([1, 2, 3], *AD.mean_statistics(rows, "g", [1, 2, 3]))
    other = spark.createDataFrame([(9, 1.0, 3), (8, 1.0, 1), (7, 1.0, None)], "row_id long, y double, g int")
    got = {r.row_id: r.pred for r in AD.mean_predict(other, "g", m).collect()}
    assert got == {9: 11.25, 8: 20.0, 7: 11.25}
    v = {r.row_id: r.data_value for r in VA.regression_values(rows, rows, "g", [1, 2]).collect()}
    assert v[1] == 0.5 and v[4] == 0.0  # y = 0: the difference is undefined


def test_rmspe_at_zero(spark):
    df = lambda x: spark.createDataFrame(x, "y double, pred double")
    assert MT.rmspe(df([(0.0, 5.0), (2.0, 2.0)])).first()["rmspe"] == math.inf
    assert MT.rmspe(df([(0.0, 0.0), (2.0, 3.0)])).first()["rmspe"] == math.sqrt(0.125)


def test_null_and_single_labels(spark):
    df = spark.createDataFrame([(i, None if i % 10 == 0 else i % 3) for i in range(100)], "row_id long, y int")
    out = corrupt_label(df, 0.2).collect()
    assert len(out) == 100 and sum(r.is_noisy for r in out) == 18
    assert all(r.y is None and not r.is_noisy for r in out if r.row_id % 10 == 0)
    one = corrupt_label(spark.createDataFrame([(i, 1) for i in range(10)], "row_id long, y int"), 0.5).collect()
    assert all(r.y == 1 and not r.is_noisy for r in one)
    assert corrupt_label(df.limit(0), 0.5).count() == 0


def test_unlisted_languages_leave_the_task(spark, tmp_path):
    spark.createDataFrame([(1, "a", "en"), (2, "b", "xx"), (3, "c", None)], "doc_id long, text string, lang string").write.parquet(
        f"{tmp_path}/documents.parquet")
    assert [(r.row_id, r.y) for r in tasks.lang_task(spark, str(tmp_path)).collect()] == [(1, 0)]


def test_no_text_below_the_label_noise_sort(spark):
    nz = tasks.noisy_train(spark, SMALL)
    assert nz.columns == ["row_id", "y", "y_clean", "is_noisy"]
    narrow = tasks.lang_task(spark, SMALL).filter("split = 'train'").select("row_id", "y")
    plan = narrow._jdf.queryExecution().executedPlan().toString()  # what the sort is given
    assert "text" not in plan.split("ReadSchema")[1]


def test_vectors_stay_sparse_until_the_pass(data):
    tr = VA.ValuerTrainer(data)
    tr.prepare()
    row = tr.train_in.first()
    assert "SparseVector" in type(row["x"]).__name__ and abs(row["x"].toArray().sum() - 1) < 1e-9
    import pandas as pd
    got = VL.dense(pd.Series([[0, 2], []]), pd.Series([[1.0, 5.0], []]), 3)
    assert got.tolist() == [[1.0, 0.0, 5.0], [0.0, 0.0, 0.0]]


@pytest.mark.parametrize("kind,layers", [("naive_bayes", None), ("mlp", [800, 8, 4])])
def test_valuer_with_other_predictors(data, kind, layers):
    if layers:
        layers = [data.d, *layers[1:]]
    tr = VA.ValuerTrainer(data, predictor=kind, layers=layers, predictor_iter=5).train(2)
    assert len(tr.history) == 2 and tr.values().count() == data.train.count()


def test_counted_fit_of_the_pass_is_the_models_fit(data):
    """With naive Bayes in the loop the pass's own counts give the selected rows' model."""
    tr = VA.ValuerTrainer(data)
    tr.prepare()
    out = tr._pass(tr.train_in, 3).collect()
    stats = sum(np.array(r.stats) for r in out if r.row_id < 0)
    chosen = data.train.sparkSession.createDataFrame([(r.row_id,) for r in out if r.row_id >= 0 and r.s > 0], "row_id long")
    n, c = AD.nb_statistics(tr.train_in.join(chosen, "row_id").select("row_id", "y"), data.bow, data.k, data.d)
    assert np.allclose(stats, np.concatenate([n[0], c[0].ravel()]))


def test_salted_join_is_the_join(spark):
    left = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the").otherwise(F.concat(F.lit("w"), F.col("id") % 50)).alias("word"))
    right = spark.createDataFrame([("the", 1), ("w1", 2), ("w7", 3)], "word string, k int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = TK.salted_join(left, right, "word", how, "doc_id")
        b = left.join(right, "word", how)
        assert sorted(map(tuple, a.select(b.columns).collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_nested_and_padded_ids(spark):
    enc = spark.createDataFrame([(1, 1, 0, 5), (1, 0, 1, 3), (1, 0, 0, 2), (2, 4, 0, 0)], "doc_id long, sent int, pos int, word_id int")
    got = {r.doc_id: r.ids for r in V.nested_ids(enc).collect()}
    assert got == {1: [[2, 3], [5]], 2: [[0]]}
    row = spark.range(1).select(V.printed(F.array(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3)))).alias("p"),
                                V.padded(F.array(F.lit(7)), 3).alias("a"), V.padded(F.array(*map(F.lit, range(9))), 3).alias("b")).first()
    assert (row.p, row.a, row.b) == ("[[1, 2], [3]]", [7, 0, 0], [0, 1, 2])


def test_one_long_document_is_cut_before_it_is_numbered(spark):
    """Two million tokens in one document: only the kept sentences reach the window."""
    from tessera.plans.documents import clean_document
    sent = " ".join(f"word{i}" for i in range(20)) + ". "
    docs = spark.createDataFrame([(1, sent * 100_000), (2, sent * 3)], "doc_id long, text string")
    cc = clean_document(docs, top=1000, max_words=2000)
    per = {r.doc_id: r.n for r in cc.tokens.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert cc.raw_tokens.count() == 20 * 100_003
    assert all(n <= 2000 + 20 for n in per.values())


def test_a_cluster_needs_a_shared_folder():
    from tessera.session import is_local
    assert is_local("local[8]") and is_local("local") and not is_local("local-cluster[3,2,1024]") and not is_local("spark://x:7077")


@pytest.mark.parametrize("key", ["train_valuer", "value_rows", "predict_final"])
def test_registered_valuer_runs_the_recipes_iterations(monkeypatch, key):
    from tessera.plans.registry import load_all
    asked = []

    def train(self, iterations):
        asked.append(iterations)
        raise InterruptedError
    monkeypatch.setattr(VA, "lang_features", lambda *_: VA.TaskData(None, None, None, k=2, d=3, bow=None))
    monkeypatch.setattr(VA.ValuerTrainer, "train", train)
    with pytest.raises(InterruptedError):
        load_all()[0][key](None, SMALL)
    assert asked == [400]


def test_graph_values_come_from_a_valuer_on_graph_vectors(spark, monkeypatch):
    from tessera.plans.registry import load_all
    seen, step = [], VA.ValuerTrainer.step

    def kept(self, it):
        seen.append((self.predictor, self.data.d))
        return step(self, it)
    monkeypatch.setattr(VA.ValuerTrainer, "step", kept)
    v = load_all()[0]["graph_values"](spark, SMALL, iterations=1).collect()
    assert seen == [("mlp", VA.GRAPH_DIM)]
    assert v and all(0 < r.data_value < 1 for r in v) and len({r.row_id for r in v}) == len(v)
