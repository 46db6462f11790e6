"""Valuation plans: task features, predictors, the REINFORCE valuer, row values,
removal curves and the text classifier.

Closed-form predictors (:mod:`tessera.operators.additive`) give the reports and the
removal curves: all models of a curve come from one pass over the training rows. The
valuer and the predictor in its loop (:mod:`tessera.operators.network`) run inside tasks with
their parameters in the closure; the only values that reach the driver are metrics, counts
and parameter-sized sums.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass, replace

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes
from pyspark.ml.feature import (CountVectorizer, CountVectorizerModel, Normalizer, RegexTokenizer, SQLTransformer,
                                VectorAssembler)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..functions.hashing import uniform
from ..operators import additive as AD
from ..operators import least_squares as LS
from ..operators import metrics as MT
from ..operators import network as NW
from ..operators import valuer as VL
from ..operators import vocab as V
from ..operators.ranking import argmax_index, bin_of_rank, global_rank
from ..session import cut_lineage, ensure_checkpoint_dir, stored
from ..tables import spread, table
from .tasks import K_LANG, SEED, lang_rows, lang_task, noisy_train

VOCAB_SIZE = 800  # the run recipe's feature count; every entry point takes it as an argument


@dataclass
class TaskData:
    train: DataFrame   # row_id, y, y_clean, is_noisy, features
    valid: DataFrame   # row_id, y, features
    test: DataFrame    # row_id, y, features (includes the valid rows, as the original does)
    k: int
    d: int
    bow: DataFrame | None  # row_id, j, n: the same counts as lists, one row per row_id
    d_valuer: int | None = None  # inputs of the valuer, if ``train`` has ``valuer_features`` of their own
    words: list | None = None    # the vocabulary, in the order of the inputs


def lang_features(spark, sf_dir, vocab_size: int = VOCAB_SIZE, noise: float = 0.2,
                  test_includes_valid: bool = True) -> TaskData:
    """Bag-of-words features (the vocab_size most frequent words of all documents)
    for the lang task, with planted noise on the training split."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc_id")
    # tokenised once: the vocabulary and the counts read the stored tokens
    docs = stored(docs.select("doc_id", "lang", T.tokenize_en("text").alias("tokens")), "tokens")
    vocab = V.build_vocab(docs.select(F.explode("tokens").alias("word")), vocab_size)
    words = [r["word"] for r in vocab.orderBy("word_id").select("word").collect()]  # <= vocab_size words
    cvm = CountVectorizerModel.from_vocabulary(words, inputCol="tokens", outputCol="features")
    feats = stored(cvm.transform(lang_rows(docs, "tokens")).select("row_id", "y", "split", "features"), "features")
    nz = noisy_train(spark, sf_dir, noise)
    train = nz.join(feats.select("row_id", "features"), "row_id")
    return replace(_task_data(train, feats, len(words), test_includes_valid), words=words, bow=counts_of(feats))


def _task_data(train: DataFrame, feats: DataFrame, d: int, test_includes_valid: bool) -> TaskData:
    valid = feats.filter(F.col("split") == "valid").select("row_id", "y", "features")
    test_parts = ["valid", "test"] if test_includes_valid else ["test"]
    test = feats.filter(F.col("split").isin(test_parts)).select("row_id", "y", "features")
    return TaskData(train, valid, test, K_LANG, d, None)


def sparse_parts(vector: str = "features"):
    """A vector column as two array columns ``(indices, values)``; a dense vector has all
    indices."""
    u = F.unwrap_udt(vector)
    return F.coalesce(u["indices"], F.sequence(F.lit(0), F.size(u["values"]) - 1)), u["values"]


def counts_of(feats: DataFrame) -> DataFrame:
    """Sparse count vectors as lists ``(row_id, j, n)``, one row per row_id."""
    j, n = sparse_parts()
    return AD.one_row_each(feats.select("row_id", j.alias("j"), n.alias("n")))


PREDICTOR = "naive_bayes"


def make_estimator(kind: str | None = None, max_iter: int = 30, reg: float = 0.01, layers=None):
    """Predictor of the valuation loop: ``naive_bayes`` (one aggregation job per fit),
    ``logistic`` (iterative) or ``mlp`` (``layers`` = sizes from inputs to classes)."""
    kind = kind or PREDICTOR
    if kind == "naive_bayes":
        return NaiveBayes(featuresCol="features", labelCol="y", smoothing=1.0, modelType="multinomial")
    if kind == "logistic":
        return LogisticRegression(featuresCol="features", labelCol="y", maxIter=max_iter, regParam=reg,
                                  family="multinomial")
    if kind == "mlp":
        if not layers:
            raise ValueError("mlp needs its layer sizes")
        return MultilayerPerceptronClassifier(featuresCol="features", labelCol="y", layers=list(layers), maxIter=max_iter,
                                              seed=SEED)
    raise ValueError(kind)


def fit(df: DataFrame, weight: str | None = None, max_iter: int = 30, reg: float = 0.01, kind: str | None = None,
        layers=None):
    est = make_estimator(kind, max_iter, reg, layers)
    if weight:
        est = est.setWeightCol(weight)
    return est.fit(df.filter(F.col("y").isNotNull()).withColumn("y", F.col("y").cast("double")))


def predict(model, df: DataFrame) -> DataFrame:
    """Adds ``p`` (class probabilities) and ``pred`` (arg-max)."""
    out = model.transform(df).withColumn("p", vector_to_array("probability"))
    return out.drop("rawPrediction", "probability", "prediction").withColumn("pred", argmax_index(F.col("p")))


CLASS_METRICS = {"accuracy": lambda df, k, by: MT.accuracy(df, by=by), "auc": lambda df, k, by: MT.auc(df, k=k, by=by),
                 "log_loss": lambda df, k, by: MT.neg_log_loss(df, by=by).withColumnRenamed("neg_log_loss", "log_loss")}
REGRESSION_METRICS = {"rmspe": lambda df, by: MT.rmspe(df, by=by), "mae": lambda df, by: MT.mae_mse(df, by=by).drop("mse"),
                      "mse": lambda df, by: MT.mae_mse(df, by=by).drop("mae")}


def metric_table(scored: DataFrame, perf: str, k: int = K_LANG, by=()) -> DataFrame:
    """``(by..., <perf>)``. Class metrics need ``y, p``, regression metrics ``y, pred``;
    log_loss is the mean log probability (greater is better)."""
    if perf in CLASS_METRICS:
        return CLASS_METRICS[perf](scored, k, list(by))
    if perf in REGRESSION_METRICS:
        return REGRESSION_METRICS[perf](scored, list(by))
    raise ValueError(f"unknown metric {perf}")


def smaller_is_better(perf: str) -> bool:
    if perf not in CLASS_METRICS and perf not in REGRESSION_METRICS:
        raise ValueError(f"unknown metric {perf}")
    return perf in REGRESSION_METRICS


def metric(scored: DataFrame, perf: str = "accuracy", k: int = K_LANG) -> float:
    return float(metric_table(scored, perf, k).first()[perf])


def gain(value: float, base: float, perf: str) -> float:
    """Improvement over the baseline, positive when better."""
    return base - value if smaller_is_better(perf) else value - base


def prediction_diff(y: F.Column, k: int) -> F.Column:
    """Per class |one-hot label - p|."""
    onehot = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i == y).cast("double"))
    return F.zip_with(onehot, F.col("p"), lambda a, b: F.abs(a - b))


TASK_ROWS = 512      # rows of one task of a training pass
TASKS = 64           # a batch has no more tasks than this
ONE_TASK = 4096      # a batch of up to so many rows is one task, with all epochs of the predictor
REWARD_ROWS = 8192   # packed validation rows of one task
WINDOW = 50          # iterations whose batches are drawn in one scan
SAVE_EVERY = 50


class ValuerTrainer:
    """REINFORCE data valuation with a predictor in the loop.

    One iteration is a handful of small jobs: one pass over the batch values and selects its
    rows and adds up the valuer's gradients and the predictor's sums; a predictor trained by
    gradients then takes ``epochs - 1`` more passes, starting every time from its fit to all
    rows (``naive_bayes`` and ``linear`` are solved from the sums of the first pass); a batch of
    ``ONE_TASK`` rows or fewer is one task, which makes these passes itself, in one job. One job
    over the validation rows gives the reward. Selections are drawn by row-keyed hashes, so a
    repeated task selects the same rows.

    ``batch_size`` rows in expectation make a batch. While it is below the number of rows,
    the batches of ``WINDOW`` iterations are drawn in one scan and stored by iteration, so an
    iteration never reads the whole training table.

    With ``resume`` the valuer's parameters, moments and history are stored below the shared
    checkpoint folder every ``SAVE_EVERY`` iterations, under a name made from the settings and
    a digest of both input tables; a later run on the same data goes on from the latest state.

    ``predictor``: ``logistic``, ``mlp`` (``layers``), ``naive_bayes`` or, for regression
    (``data.k`` is 1), ``linear`` (ridge regression)."""

    def __init__(self, data: TaskData, hidden: int = 100, comb: int = 10, batch_size: int = 2000,
                 lr: float = 0.01, seed: int = SEED, perf: str | None = None, predictor_iter: int = 30,
                 predictor: str | None = None, layers=None, moving_baseline: float | None = None,
                 epochs: int = 5, inner_lr: float = 0.1, resume: bool = False):
        """``predictor_iter``: passes of the fit to all rows. ``moving_baseline`` (e.g. 0.9)
        subtracts an exponential moving average of past rewards (variance reduction); None
        keeps the fixed baseline metric."""
        regression = data.k == 1
        perf = perf or ("rmspe" if regression else "accuracy")
        if perf not in (REGRESSION_METRICS if regression else CLASS_METRICS):
            raise ValueError(f"unknown metric {perf}")
        self.data, self.seed, self.perf, self.predictor_iter, self.layers = data, seed, perf, predictor_iter, layers
        self.kind = predictor or ("linear" if regression else PREDICTOR)
        if (self.kind == "linear") != regression:
            raise ValueError(f"{self.kind} does not fit the task")
        self.predictor, self.moving_baseline, self._avg_reward = self.kind, moving_baseline, None
        self.net = in_loop(self.kind, data.k, data.d, layers, seed, inner_lr, epochs)
        self.params = VL.init_params(data.d_valuer or data.d, data.k, hidden, comb, seed)
        self.theta = VL.flatten(self.params)
        self.adam = VL.Adam(lr)
        self.batch_size = batch_size
        self.history = []
        self.resume = resume
        self._settings = (hidden, comb, batch_size, lr, seed, perf, predictor_iter, self.kind, layers, moving_baseline, epochs, inner_lr, data.k, data.d, data.d_valuer)
        self._prepared, self._window, self._folder = False, None, None

    # -- inputs ---------------------------------------------------------------
    def _columns(self, df: DataFrame, *names) -> DataFrame:
        """``names`` with the predictor's inputs (j, n) and, where there is an ``x``, the
        valuer's (i, v)."""
        j, n = sparse_parts()
        out = [*names, j.alias("j"), n.alias("n")]
        if "x" in df.columns:
            i, v = sparse_parts("x")
            out += [i.alias("i"), v.alias("v")]
        return df.select(*out)

    def prepare(self):
        d = self.data
        source = "valuer_features" if d.d_valuer else "features"
        unit = Normalizer(p=1.0, inputCol=source, outputCol="x")  # rows sum to 1 (counts) in absolute terms
        train, valid = (x.filter(F.col("y").isNotNull()) for x in (d.train, d.valid))
        self.scale = 1.0
        if d.k == 1:  # targets around one, as the network's inputs are
            self.scale = float(train.agg(F.avg(F.abs("y")).alias("m")).first()["m"] or 1.0) or 1.0
            train, valid = (x.withColumn("y", F.col("y") / self.scale) for x in (train, valid))
        self.valid = stored(valid.select("row_id", "y", "features"), "valuer-valid")
        if d.k == 1:
            got = self.net.fit(self._sum(self._columns(self.valid, "row_id", "y"), None, None, False))
            scored = train.withColumn("diff", F.array(F.coalesce(relative_diff(F.col("y"), linear_score(got)), F.lit(1.0))))
        else:
            self.reference = self._fit(self.valid)
            scored = predict(self.reference, train).withColumn("diff", prediction_diff(F.col("y"), d.k))
        # reused by every iteration: one materialisation; vectors stay sparse and are made dense
        # a batch at a time inside the pass
        self.train_in = stored(unit.transform(scored).select("row_id", "y", "features", "x", "diff"), "valuer-train")
        self.n = self.train_in.count()
        self._rows = self._columns(self.train_in, "row_id", "y", "diff")
        self._one_task = isinstance(self.net, NW.Network) and min(self.batch_size, self.n) <= ONE_TASK
        if self.batch_size >= self.n:
            self._rows = stored(self._rows.repartition(self._pieces(self.n), "row_id"), "valuer-batch")
        self._valid = self._columns(self.valid, "row_id", "y")
        n_valid = self.valid.count()
        if n_valid <= TASKS * TASK_ROWS:
            self._valid = stored(self._valid.repartition(max(1, -(-n_valid // TASK_ROWS)), "row_id"), "valuer-valid-rows")
        self._packed = None
        if self.perf in NW.ADDITIVE and isinstance(self.net, NW.Network):  # every iteration reads all of them
            packed = self._columns(self.valid, "row_id", "y")
            if n_valid <= TASKS * REWARD_ROWS:
                packed = packed.repartition(max(1, -(-n_valid // REWARD_ROWS)), "row_id")
            self._packed = stored(packed.select("y", "j", "n").mapInArrow(VL.pack_function(), VL.PACKED), "valuer-valid-packed")
        self.base = self._fit_all()
        self.base_metric = self._metric(self.base)
        self._prepared = True

    def _pieces(self, rows: int) -> int:
        """Tasks of a batch of ``rows`` rows."""
        return 1 if self._one_task else max(1, min(TASKS, -(-rows // TASK_ROWS)))

    def _fit(self, df: DataFrame):
        return fit(df, max_iter=self.predictor_iter, kind=self.kind, layers=self.layers)

    def _fit_all(self) -> np.ndarray:
        """The predictor fitted on all rows, from its initial parameters."""
        if self.net.closed:
            return self.net.fit(self._sum(self._rows, None, None, False))
        theta, adam = self.net.initial(), VL.Adam(self.net.rate)
        for _ in range(self.predictor_iter):
            theta = self.net.step(theta, self._sum(self._rows, None, theta, False), adam)
        return theta

    def _sum(self, df: DataFrame, it: int | None, theta, with_grad: bool, half: bool = False, head: bool = False):
        """The task sums of one pass over ``df``; without ``head`` only the predictor's."""
        fn = VL.selection_function(None if it is None else self.theta, self.params, self.data.k, self.data.d, it or 0, self.seed, self.net, theta, with_grad, half)
        total = add_up(df, fn, many=it is None)
        if total is None:
            total = np.zeros(3 + (2 * len(self.theta) if with_grad else 0) + self.net.size())
        return total if head else total[-self.net.size():]

    def _metric(self, theta) -> float:
        if self.perf not in NW.ADDITIVE:
            scored = self._valid.mapInArrow(VL.score_function(self.net, theta, self.data.d), "row_id long, y int, p array<double>")
            return metric(scored, self.perf, self.data.k)
        if self._packed is not None:
            total = add_up(self._packed, VL.packed_metric_function(self.net, theta, self.perf))  # two numbers a task
        else:
            total = add_up(self._valid, VL.metric_function(self.net, theta, self.data.k, self.data.d, self.perf))
        value = NW.metric_of(self.perf, float(total[1]), float(total[0])) if total is not None else float("nan")
        return value * self.scale ** {"mae": 1, "mse": 2}.get(self.perf, 0)

    def _pass(self, df: DataFrame, it: int, with_grad: bool = True) -> DataFrame:
        """The valuer over ``df``: values and selections per row, sums per task."""
        fn = VL.pass_function(self.theta, self.params, self.data.k, self.data.d, it, self.seed, with_grad)
        return self._columns(df, "row_id", "y", "diff").mapInPandas(fn, VL.PASS_SCHEMA)

    def _batch(self, it: int) -> DataFrame:
        """The rows of iteration ``it``: all, or about ``batch_size`` by hash."""
        if self.batch_size >= self.n:
            return self._rows
        first = it - it % WINDOW
        if self._window is None or self._window[0] != first:
            share = F.lit(self.batch_size / self.n)
            drawn = F.array_compact(F.array(*[F.when(uniform(self.seed + t, "row_id") < share, F.lit(t)) for t in range(first, first + WINDOW)]))
            pieces = self._pieces(self.batch_size)
            rows = self._rows.withColumn("it", F.explode(drawn)).withColumn("piece", F.pmod(F.xxhash64("row_id"), F.lit(pieces)))
            folder = f"{ensure_checkpoint_dir(rows.sparkSession).rstrip('/')}/valuer-batches-{uuid.uuid4().hex}"
            rows.repartition(WINDOW * pieces, "it", "piece").drop("piece").write.partitionBy("it").parquet(folder)
            self._window = first, folder, self._rows.schema
        _, folder, schema = self._window
        spark = self._rows.sparkSession
        try:
            return spark.read.schema(schema).parquet(f"{folder}/it={it}")
        except AnalysisException:  # no row was drawn
            return spark.createDataFrame([], schema)

    # -- the loop ---------------------------------------------------------------
    def _one_pass(self, it: int):
        """What :meth:`_passes` gives, by one job with one task."""
        fn = VL.loop_function(self.theta, self.params, self.data.k, self.data.d, it, self.seed, self.net, self.base)
        got = add_up(self._batch(it).coalesce(1), fn)
        return None if got is None else (got, got[-len(self.base):])

    def _passes(self, it: int):
        """Rows, summed values, selected rows and the valuer's gradients of the batch, and the
        parameters of the predictor trained on its selected rows; None if it is empty."""
        src = self._batch(it)
        theta, adam = (None, None) if self.net.closed else (self.base, VL.Adam(self.net.rate))
        got, half = self._sum(src, it, theta, True, head=True), False
        if not got[0]:
            return None
        if not got[2]:  # nothing selected: redraw every row with probability one half
            half = True
            got = self._sum(src, it + VL.REDRAWN, theta, True, half, head=True)
        if got[2] and self.net.closed:
            theta = self.net.fit(got[-self.net.size():])
        elif got[2]:
            theta = self.net.step(theta, got[-self.net.size():], adam)
            for _ in range(self.net.epochs - 1):
                theta = self.net.step(theta, self._sum(src, it + VL.REDRAWN * half, theta, False, half), adam)
        return got, theta

    def step(self, it: int):
        if not self._prepared:
            self.prepare()
        g, got = len(self.theta), self._one_pass(it) if self._one_task else self._passes(it)
        if got is None:  # an empty batch teaches nothing
            self.history.append((it, 0.0, float("nan")))
            return 0.0
        got, theta = got
        n, mean_v = got[0], got[1] / got[0]
        reward = gain(self._metric(theta), self.base_metric, self.perf) if got[2] else 0.0
        reward = reward if np.isfinite(reward) else 0.0
        signal = reward
        if self.moving_baseline is not None:
            if self._avg_reward is None:
                self._avg_reward = reward
            signal = reward - self._avg_reward
            self._avg_reward = self.moving_baseline * self._avg_reward + (1 - self.moving_baseline) * reward
        grad = VL.loss_gradient(got[3:3 + g], got[3 + g:3 + 2 * g], signal, mean_v, n)
        self.theta = self.adam.step(self.theta, grad)
        self.history.append((it, reward, mean_v))
        return reward

    def train(self, iterations: int):
        at = self._take_up(iterations) if self.resume else 0
        for it in range(at, iterations):
            self.step(it)
            if self.resume and ((it + 1) % SAVE_EVERY == 0 or it + 1 == iterations):
                self._save(it + 1)
        return self

    def values(self) -> DataFrame:
        """(row_id, data_value) for every labelled training row (one forward pass)."""
        if not self._prepared:
            self.prepare()
        out = self._pass(self.train_in, -1, with_grad=False)
        return out.filter(F.col("row_id") >= 0).select("row_id", F.col("v").alias("data_value"))

    # -- stored state -------------------------------------------------------------
    def _state_folder(self) -> str:
        """A name that changes with the settings and with any row of the inputs."""
        if self._folder is None:
            digest = [repr(self._settings)]
            rounded = lambda c: F.transform(c, lambda x: F.round(x, 6))  # noqa: E731  sums of floats may differ in their last digits
            for df in (self._columns(self.train_in, "row_id", "y", "diff"), self._columns(self.valid, "row_id", "y")):
                parts = ["row_id", F.round("y", 6), "j", rounded("n"), *([rounded("diff"), "i", rounded("v")] if "diff" in df.columns else [])]
                digest.append(repr(tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*parts).cast("decimal(38,0)"))).first())))
            base = ensure_checkpoint_dir(self.train_in.sparkSession).rstrip("/")
            self._folder = f"{base}/valuer-state/{hashlib.md5(repr(digest).encode()).hexdigest()}"
        return self._folder

    def _save(self, iterations: int) -> None:
        spark = self.train_in.sparkSession
        row = (iterations, self.theta.tolist(), self.adam.m.tolist(), self.adam.v.tolist(), self.adam.t, self._avg_reward,
               [(int(i), float(r), float(m)) for i, r, m in self.history])
        spark.createDataFrame([row], STATE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{self._state_folder()}/{iterations:08d}")

    def _take_up(self, iterations: int) -> int:
        """Take up the latest stored state that is not past ``iterations``."""
        if not self._prepared:
            self.prepare()
        spark = self.train_in.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self._state_folder()}/*/_SUCCESS")
        found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
        done = [k for k in (int(f.getPath().getParent().getName()) for f in found) if k <= iterations]
        if not done:
            return 0
        r = spark.read.schema(STATE_SCHEMA).parquet(f"{self._state_folder()}/{max(done):08d}").first()
        self.theta, self.adam.m, self.adam.v, self.adam.t = np.array(r.theta), np.array(r.m), np.array(r.v), r.t
        self._avg_reward, self.history = r.avg_reward, [tuple(x) for x in r.history]
        return r.iterations


STATE_SCHEMA = ("iterations long, theta array<double>, m array<double>, v array<double>, t long, avg_reward double, "
                "history array<struct<iteration: long, reward: double, mean_value: double>>")


def in_loop(kind: str, k: int, d: int, layers, seed: int, rate: float, epochs: int):
    """The predictor inside the loop, see :mod:`tessera.operators.network`."""
    if kind == "naive_bayes":
        return NW.CountedBayes(k, d)
    if kind == "linear":
        return NW.Ridge(d)
    if kind == "mlp" and not layers:
        raise ValueError("mlp needs its layer sizes")
    if kind not in ("logistic", "mlp"):
        raise ValueError(kind)
    return NW.Network([d, k] if kind == "logistic" else list(layers), seed, rate, epochs)


def add_up(df: DataFrame, fn, many: bool = False) -> np.ndarray | None:
    """The sum of the one row that each task returns. A batch has ``TASKS`` tasks at most, and
    the driver adds up their rows; sums of ``many`` tasks are cut into blocks that Spark adds."""
    if many:
        got = (df.mapInArrow(VL.in_blocks(fn), "block int, part array<double>").groupBy("block")
               .agg(Summarizer.sum(array_to_vector("part")).alias("s")).orderBy("block").collect())  # one total
        return np.concatenate([r["s"].toArray() for r in got]) if got else None
    total = None
    for r in df.mapInArrow(fn, VL.SUMS).collect():
        part = np.frombuffer(r[0], np.float64)
        total = part.copy() if total is None else total + part
    return total


def linear_score(theta: np.ndarray) -> F.Column:
    """A linear model's prediction from a vector column ``features``."""
    weights = F.array(*[F.lit(float(x)) for x in theta[:-1]])
    x = vector_to_array("features")
    return F.aggregate(F.zip_with(x, weights, lambda a, b: a * b), F.lit(float(theta[-1])), lambda a, b: a + b)


def nb_fit(rows: DataFrame, data: TaskData) -> AD.NaiveBayes:
    return AD.NaiveBayes.of(*AD.nb_statistics(rows, data.bow, data.k, data.d))


def nb_scores(rows: DataFrame, data: TaskData, model: AD.NaiveBayes) -> DataFrame:
    """``rows`` (row_id, y, ...) with the class probabilities of one counted model."""
    return AD.nb_predict(rows, data.bow, model).drop("model")


def labelled(df: DataFrame) -> DataFrame:
    return df.select("row_id", "y")


def simple_values(data: TaskData) -> DataFrame:
    """Model-based value without training a valuer: the validation model's
    probability of the observed label (1 - own-class prediction difference), to nine
    digits so that saturated values tie and ties go by row id."""
    s = nb_scores(labelled(data.train), data, nb_fit(labelled(data.valid), data))
    return s.select("row_id", F.round(F.element_at("p", F.col("y") + 1), 9).alias("data_value"))


def ranked_values(train: DataFrame, values: DataFrame) -> DataFrame:
    """Ascending rank (value, row_id) and its exact reverse (value desc, row_id desc) of
    the train columns but ``features``, which stay out of the global sort."""
    r = train.drop("features").join(values, "row_id")
    r = global_rank(r, [F.col("data_value"), F.col("row_id")], out="rank_asc")
    n = r.count()
    return r.withColumn("rank_desc", F.lit(n - 1) - F.col("rank_asc"))


MODES = (("low", "rank_asc"), ("high", "rank_desc"))


def _evaluated(data: TaskData) -> DataFrame:
    return (labelled(data.valid).withColumn("part", F.lit("valid"))
            .unionByName(labelled(data.test).withColumn("part", F.lit("test"))))


def _curve(spark, per_mode, perf: str, bins: int) -> DataFrame:
    """One row per mode and bin from (mode, rows left of every bin, models usable, metric
    table (model, part, <perf>))."""
    out = None
    for mode, left, usable, table_ in per_mode:
        spine = spark.createDataFrame([(mode, b, int(left[b]), bool(usable[b])) for b in range(bins)],
                                      "mode string, bin int, n_rows long, usable boolean")
        wide = table_.groupBy("model").agg(*[F.max(F.when(F.col("part") == x, F.col(perf))).alias(f"{x}_metric")
                                             for x in ("valid", "test")])
        t = spine.join(wide, spine["bin"] == wide["model"], "left")
        t = t.select("mode", "bin", "n_rows", *[F.when(F.col("usable"), F.col(f"{x}_metric")).otherwise(0.0).alias(f"{x}_metric")
                                                for x in ("valid", "test")])  # null: no row to evaluate
        out = t if out is None else out.unionByName(t)
    return out


def remove_high_low(data: TaskData, values: DataFrame, perf: str = "accuracy", bins: int = R.NUM_BINS) -> DataFrame:
    """For each bin b and mode low/high, drop the floor(b*n/bins) lowest (highest)
    valued rows, fit naive Bayes on the rest, and score it on valid and test.

    Counts are taken once per (bin, class, term); suffix sums over the bins give the
    models of all subsets, and one job scores them all: the number of jobs does not depend
    on ``bins``. A subset left with one class is skipped (metric 0)."""
    if perf not in CLASS_METRICS:
        raise ValueError(f"unknown metric {perf}")
    spark = data.train.sparkSession
    ranked = ranked_values(data.train.filter(F.col("y").isNotNull()), values)
    n = ranked.count()
    evals, per_mode = _evaluated(data), []
    for mode, rank in MODES:
        rows = ranked.select("row_id", "y", bin_of_rank(F.col(rank), n, bins).alias("b"))
        counts = AD.nb_statistics(rows, data.bow, data.k, data.d, bins, "b")
        models = AD.NaiveBayes.of(*map(AD.suffix_sums, counts))
        scored = AD.nb_predict(evals, data.bow, models)
        per_mode.append((mode, models.rows, models.classes > 1, metric_table(scored, perf, data.k, ["model", "part"])))
    return _curve(spark, per_mode, perf, bins)


def regression_curve(train: DataFrame, evals: DataFrame, values: DataFrame, column: str, groups: list, perf: str = "rmspe",
                     bins: int = R.NUM_BINS) -> DataFrame:
    """The removal curve of a regression task: group-mean predictor over ``column``,
    metrics rmspe, mae or mse (smaller is better). ``evals``: (row_id, y, column, part)."""
    if perf not in REGRESSION_METRICS:
        raise ValueError(f"unknown metric {perf}")
    ranked = ranked_values(train, values)
    n, per_mode = ranked.count(), []
    for mode, rank in MODES:
        rows = ranked.select("row_id", "y", column, bin_of_rank(F.col(rank), n, bins).alias("b"))
        counts = AD.mean_statistics(rows, column, groups, bins, "b")
        models = AD.GroupMeans.of(groups, *map(AD.suffix_sums, counts))
        scored = AD.mean_predict(evals, column, models)
        per_mode.append((mode, models.rows, models.rows > 0, metric_table(scored, perf, by=["model", "part"])))
    return _curve(train.sparkSession, per_mode, perf, bins)


def linear_curve(train: DataFrame, evals: DataFrame, values: DataFrame, d: int, perf: str = "rmspe", penalty: float = 1.0,
                 bins: int = R.NUM_BINS) -> DataFrame:
    """The removal curve of ridge regression on ``x``: Gram matrices are added up once per bin,
    and their suffix sums give the models of all subsets. ``evals``: (row_id, y, x, part)."""
    if perf not in REGRESSION_METRICS:
        raise ValueError(f"unknown metric {perf}")
    ranked = ranked_values(train.select("row_id", "y"), values).select("row_id", "rank_asc", "rank_desc")
    ranked = stored(ranked.join(train, "row_id"), "ranked-rows")
    n, per_mode = ranked.count(), []
    for mode, rank in MODES:
        rows = ranked.select("x", "y", bin_of_rank(F.col(rank), n, bins).alias("b"))
        models = LS.LinearModels.nested(LS.gram_statistics(rows, d, bins, "b"), penalty)
        scored = LS.linear_predict(evals, models)
        per_mode.append((mode, models.rows, models.rows > 0, metric_table(scored, perf, by=["model", "part"])))
    return _curve(train.sparkSession, per_mode, perf, bins)


def regression_values(train: DataFrame, valid: DataFrame, column: str, groups: list) -> DataFrame:
    """``1 / (1 + |y - p| / |y|)`` with p the validation rows' group mean, to nine digits;
    a row with y = 0 has the value 0."""
    model = AD.GroupMeans.of(groups, *AD.mean_statistics(valid, column, groups))
    s = AD.mean_predict(train, column, model).withColumn("d", relative_diff(F.col("y"), F.col("pred")))
    return s.select("row_id", F.round(F.coalesce(F.lit(1.0) / (F.lit(1.0) + F.col("d")), F.lit(0.0)), 9).alias("data_value"))


def relative_diff(y, p):
    """|y - p| / |y|: the regression form of the prediction difference; null where y = 0."""
    return F.try_divide(F.abs(y - p), F.abs(y))


def learn_with_values(curve: DataFrame, minimize: bool = False) -> DataFrame:
    """Test metric at the bin with the best validation metric (first on ties)."""
    from .cat_report import best_bin_of
    return best_bin_of(curve, minimize=minimize)


def learn_baseline(data: TaskData, perf: str = "accuracy") -> float:
    return metric(nb_scores(labelled(data.test), data, nb_fit(labelled(data.train), data)), perf, data.k)


def two_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``title`` (the first line of the text) and ``description`` (the rest)."""
    first = F.regexp_extract(text, "^([^\\n]*)", 1)
    return df.withColumn("title", first).withColumn("description", F.substring(F.col(text), F.length(first) + 2, F.length(text)))


def text_classifier_pipeline(vocab_size: int = VOCAB_SIZE, max_iter: int = 30) -> Pipeline:
    """Clean text (SQL regex chain) -> tokens -> counts -> logistic regression."""
    return Pipeline(stages=[*_text_stages("text", "features", vocab_size), _classifier(max_iter)])


def two_text_classifier_pipeline(vocab_size: int = VOCAB_SIZE, max_iter: int = 30) -> Pipeline:
    """Title and description each with a cleaner and a vectoriser of its own, joined into one
    feature vector."""
    return Pipeline(stages=[*_text_stages("title", "title_counts", vocab_size), *_text_stages("description", "description_counts", vocab_size),
                            VectorAssembler(inputCols=["title_counts", "description_counts"], outputCol="features"), _classifier(max_iter)])


def _text_stages(text: str, out: str, vocab_size: int) -> list:
    clean = "SELECT *, {} AS {}_clean FROM __THIS__".format(_spark_sql_rules(text, R.CLEAN_STR_RULES), text)
    return [SQLTransformer(statement=clean),
            RegexTokenizer(inputCol=f"{text}_clean", outputCol=f"{text}_tokens", pattern="\\s+", toLowercase=True),
            CountVectorizer(inputCol=f"{text}_tokens", outputCol=out, vocabSize=vocab_size)]


def _classifier(max_iter: int) -> LogisticRegression:
    return LogisticRegression(featuresCol="features", labelCol="label", maxIter=max_iter, regParam=0.01, family="multinomial")


GRAPH_DIM = 64


def graph_features(spark, sf_dir) -> DataFrame:
    """``(row_id, y, split, features)`` of the lang task with pooled document-graph vectors."""
    from .cat_graph import document_vectors
    v = cut_lineage(document_vectors(spark, sf_dir).select(F.col("doc_id").alias("row_id"), array_to_vector("vec").alias("features")))
    return lang_task(spark, sf_dir).select("row_id", "y", "split").join(v, "row_id")


def graph_task(spark, sf_dir, noise: float = 0.2, test_includes_valid: bool = True, epochs: int = 30) -> TaskData:
    """The lang task with planted noise on document-graph vectors (dense; there are no counts):
    the predictor's inputs are one-hop states pooled by weights fitted to the noisy training
    rows, the valuer's are five-hop states."""
    from . import cat_graph as CG
    inputs = CG.graph_inputs(spark, sf_dir)
    noisy = noisy_train(spark, sf_dir, noise)
    labels = noisy.filter(F.col("y").isNotNull()).select(F.col("row_id").alias("doc_id"), "y")
    *_, near = CG.fitted_pooling(spark, sf_dir, labels, K_LANG, epochs, inputs=inputs)
    near = near.select(F.col("doc_id").alias("row_id"), array_to_vector("vec").alias("features"))
    far = CG.depth_vectors(spark, sf_dir, [CG.VALUER_HOPS], inputs=inputs).select(F.col("doc_id").alias("row_id"), array_to_vector("vec").alias("valuer_features"))
    feats = lang_task(spark, sf_dir).select("row_id", "y", "split").join(stored(near.join(far, "row_id"), "graph-vectors"), "row_id")
    train = noisy.join(feats.select("row_id", "features", "valuer_features"), "row_id")
    data = _task_data(train, feats, GRAPH_DIM, test_includes_valid)
    return replace(data, d_valuer=GRAPH_DIM)


def _spark_sql_rules(expr: str, rules) -> str:
    def lit(s):
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    for pattern, repl in rules:
        expr = f"regexp_replace({expr}, {lit(pattern)}, {lit(T._java_repl(repl))})"
    return f"lower(regexp_replace({expr}, '^\\\\s+|\\\\s+$', ''))"
