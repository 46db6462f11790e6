"""The valuer's loop: predictors as sums, passes, drawn batches, stored state, regression."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tessera.operators import least_squares as LS
from tessera.operators import network as NW
from tessera.operators import valuer as VL
from tessera.plans import valuation as VA


def numeric(f, theta, eps=1e-6):
    out = np.zeros_like(theta)
    for i in range(len(theta)):
        e = np.zeros_like(theta)
        e[i] = eps
        out[i] = (f(theta + e) - f(theta - e)) / (2 * eps)
    return out


@pytest.mark.parametrize("layers", [[4, 3], [4, 5, 3]])
def test_network_gradient(layers):
    rng = np.random.default_rng(0)
    net = NW.Network(layers, seed=1)
    theta = net.initial() + 0.1 * rng.normal(size=net.size() - 2)
    x, y, w = rng.normal(size=(9, 4)), rng.integers(0, 3, 9), rng.integers(0, 2, 9).astype(float)
    got = net.partial(theta, x, x, y, w)
    assert len(got) == net.size() and got[0] == w.sum()
    assert np.allclose(got[2:], numeric(lambda t: net.partial(t, x, x, y, w)[1], theta), atol=1e-6)


def test_valuer_gradient():
    rng = np.random.default_rng(0)
    p = VL.init_params(3, 1, 4, 3, 0)
    x, y, diff, s = rng.random((6, 3)), rng.random((6, 1)), rng.random((6, 1)), rng.integers(0, 2, 6).astype(float)

    def ll(theta):
        v, _ = VL.forward(VL.unflatten(theta, p), x, y, diff)
        return float((s * np.log(v) + (1 - s) * np.log(1 - v)).sum())
    v, cache = VL.forward(p, x, y, diff)
    assert np.allclose(VL.flatten(VL.backward(p, cache, s - v)), numeric(ll, VL.flatten(p)), atol=1e-5)


def test_ridge_is_least_squares():
    rng = np.random.default_rng(1)
    x, y, w = rng.normal(size=(30, 4)), rng.normal(size=30), rng.integers(0, 2, 30).astype(float)
    net = NW.Ridge(4, penalty=2.0)
    theta = net.fit(net.partial(None, x, x, y, w))
    a = np.column_stack([x, np.ones(30)])[w > 0]
    want = np.linalg.solve(a.T @ a + np.diag([2.0] * 4 + [0.0]), a.T @ y[w > 0])
    assert np.allclose(theta, want) and np.allclose(net.predict(theta, x, x), np.column_stack([x, np.ones(30)]) @ want)


def test_metric_parts():
    y, p = np.array([0, 1, 1]), np.array([[0.9, 0.1], [0.6, 0.4], [0.0, 1.0]])
    assert NW.metric_parts("accuracy", y, p) == 2
    assert np.isclose(NW.metric_parts("log_loss", y, p), np.log([0.9, 0.4, 1 - 1e-15]).sum())
    y, q = np.array([2.0, 0.0, 4.0]), np.array([1.0, 0.0, 4.0])
    assert NW.metric_parts("rmspe", y, q) == 0.25 and NW.metric_parts("mae", y, q) == 1 and NW.metric_parts("mse", y, q) == 1
    assert NW.metric_parts("rmspe", np.array([0.0]), np.array([1.0])) == np.inf


def classes(spark, n=240, noise=0.25):
    """Two inputs tell the classes apart; every fourth training label is wrong."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(2 * n):
        y = i % 2
        bad = i < n and rng.random() < noise
        x = [max(0.0, rng.normal(3 - 2 * y, 0.6)), max(0.0, rng.normal(1 + 2 * y, 0.6)), rng.random()]
        rows.append((i, int(y ^ bad), Vectors.dense(x), bool(bad), i < n))
    df = spark.createDataFrame(rows, ["row_id", "y", "features", "bad", "train"])
    df = df.withColumn("y", F.col("y").cast("int"))
    train, valid = df.filter("train").drop("train"), df.filter("NOT train").select("row_id", "y", "features")
    return VA.TaskData(train, valid, valid, 2, 3, None)


def test_values_find_wrong_labels(spark):
    data = classes(spark)
    tr = VA.ValuerTrainer(data, hidden=16, comb=4, predictor="logistic", moving_baseline=0.9, perf="log_loss").train(40)
    v = tr.values().join(data.train.select("row_id", "bad"), "row_id").groupBy("bad").agg(F.avg("data_value").alias("v")).collect()
    mean = {r.bad: r.v for r in v}
    assert mean[False] > mean[True] and len(tr.history) == 40


def test_a_step_is_a_handful_of_jobs(spark):
    tr = VA.ValuerTrainer(classes(spark), predictor="logistic")
    tr.prepare()
    sc = spark.sparkContext
    sc.setJobGroup("valuer-step", "one step")
    tr.step(0)
    jobs = sc.statusTracker().getJobIdsForGroup("valuer-step")
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(jobs) <= 6


@pytest.mark.parametrize("kind,layers", [("logistic", None), ("mlp", [3, 4, 2]), ("naive_bayes", None)])
def test_batches_are_drawn_once_per_window(spark, kind, layers):
    data = classes(spark)
    tr = VA.ValuerTrainer(data, batch_size=40, predictor=kind, layers=layers, predictor_iter=3).train(2)
    assert tr.n == 240 and tr._window[0] == 0 and len(tr.history) == 2
    sizes = [tr._batch(t).count() for t in range(12)]
    assert 15 < np.mean(sizes) < 70 and len(set(sizes)) > 1
    ids = [{r.row_id for r in tr._batch(t).select("row_id").collect()} for t in (3, 4)]
    assert ids[0] != ids[1] and tr._batch(VA.WINDOW - 1).columns == tr._rows.columns


def test_training_goes_on_from_stored_state(spark, monkeypatch):
    data = classes(spark)
    make = lambda seed=7: VA.ValuerTrainer(data, hidden=8, comb=3, predictor="logistic", moving_baseline=0.9, seed=seed, resume=True)
    whole = VA.ValuerTrainer(data, hidden=8, comb=3, predictor="logistic", moving_baseline=0.9, seed=7).train(5)
    first = make().train(3)
    steps = []
    step = VA.ValuerTrainer.step
    monkeypatch.setattr(VA.ValuerTrainer, "step", lambda self, it: (steps.append(it), step(self, it))[1])
    second = make().train(5)
    assert steps == [3, 4] and [h[0] for h in second.history] == [0, 1, 2, 3, 4]
    assert np.allclose(second.theta, whole.theta, atol=1e-9) and first.history == [tuple(h) for h in second.history[:3]]
    steps.clear()
    make().train(5)
    assert steps == []
    make().train(4)      # a state past the wanted length is not taken
    assert steps == [3]
    steps.clear()
    other = VA.TaskData(data.train.filter("row_id <> 3"), data.valid, data.test, 2, 3, None)
    VA.ValuerTrainer(other, hidden=8, comb=3, predictor="logistic", moving_baseline=0.9, seed=7, resume=True).train(1)
    assert steps == [0]  # other rows, other state


def test_no_row_selected_and_empty_batches(spark, monkeypatch):
    data = classes(spark, 60)
    tr = VA.ValuerTrainer(data, predictor="logistic")
    tr.prepare()
    tr.theta = VL.flatten({**tr.params, "b4": np.array([-1e4])})  # every value is zero
    assert np.isfinite(tr.step(0)) and len(tr.history) == 1
    few = VA.ValuerTrainer(data, predictor="logistic", batch_size=1).train(3)
    assert len(few.history) == 3


def prices(spark, n=300):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(2 * n):
        x = rng.random(3)
        y = 100 * (1 + 2 * x[0] + x[1])
        bad = i < n and i % 4 == 0
        rows.append((i, float(y * (4 if bad else 1)), Vectors.dense(x.tolist()), bool(bad), i < n))
    df = spark.createDataFrame(rows, ["row_id", "y", "features", "bad", "train"])
    train, valid = df.filter("train").drop("train"), df.filter("NOT train").select("row_id", "y", "features")
    return VA.TaskData(train, valid, valid, 1, 3, None)


@pytest.mark.parametrize("perf", ["rmspe", "mae", "mse"])
def test_regression_valuer(spark, perf):
    data = prices(spark)
    tr = VA.ValuerTrainer(data, hidden=16, comb=4, perf=perf, moving_baseline=0.9).train(30)
    v = tr.values().join(data.train.select("row_id", "bad"), "row_id").groupBy("bad").agg(F.avg("data_value").alias("v")).collect()
    mean = {r.bad: r.v for r in v}
    assert 0 < mean[True] < mean[False] < 1
    scored = LS.linear_predict(data.valid.select("y", VA.vector_to_array("features").alias("x")), LS.LinearModels(tr.base[None], np.ones(1)))
    scored = scored.withColumn("pred", F.col("pred") * tr.scale)
    assert np.isclose(VA.metric(scored, perf), tr.base_metric)


def test_predictors_must_fit_the_task(spark):
    data = prices(spark, 10)
    for call in (lambda: VA.ValuerTrainer(data, predictor="logistic"), lambda: VA.ValuerTrainer(classes(spark, 10), predictor="linear"),
                 lambda: VA.ValuerTrainer(data, perf="accuracy"), lambda: VA.ValuerTrainer(classes(spark, 10), predictor="mlp")):
        with pytest.raises(ValueError):
            call()


def test_gram_of_groups_and_nested_models(spark):
    rng = np.random.default_rng(2)
    x, y, g = rng.normal(size=(80, 3)), rng.normal(size=80), rng.integers(0, 4, 80)
    df = spark.createDataFrame([(a.tolist(), float(b), int(c)) for a, b, c in zip(x, y, g, strict=True)] + [([1.0, 1.0, 1.0], None, 0)],
                               "x array<double>, y double, g int").repartition(3)
    stats = LS.gram_statistics(df, 3, 5, "g")
    models = LS.LinearModels.nested(stats)
    a = np.column_stack([x, np.ones(80)])
    for b in range(4):
        on = g >= b
        want = np.linalg.solve(a[on].T @ a[on] + np.diag([1.0, 1, 1, 0]), a[on].T @ y[on])
        assert models.rows[b] == on.sum() and np.allclose(models.theta[b], want)
    assert models.rows[4] == 0 and np.isnan(models.theta[4]).all()
    got = LS.linear_predict(df.filter("y IS NOT NULL"), models).filter("model = 1").collect()
    assert np.allclose([r.pred for r in got], [np.append(r.x, 1) @ models.theta[1] for r in got])
    assert LS.linear_predict(df, models).filter("model = 4 AND pred IS NOT NULL").count() == 0


def test_sums_in_blocks_are_the_sums(spark, monkeypatch):
    monkeypatch.setattr(VL, "BLOCK", 7)
    data = classes(spark, 50)
    tr = VA.ValuerTrainer(data, predictor="logistic")
    tr.prepare()
    fn = VL.selection_function(tr.theta, tr.params, 2, 3, 1, 1, tr.net, tr.base, True)
    assert np.allclose(VA.add_up(tr._rows.repartition(4), fn), VA.add_up(tr._rows.repartition(4), fn, many=True))
