"""Catalogue: fitted predictors, rewards, the trained valuer, row values, removal
curves, text classifiers and document embeddings (lang task with 20 % planted noise),
and the valuation of a regression task (order prices by nation).

The closed-form predictors have SQL twins; what a trained network returns is checked
by invariants in the tests."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.hashing import uniform, uniform_sql
from ..functions.rules import NUM_BINS
from ..operators import additive as AD
from ..operators import vocab as V
from ..tables import spread, table
from . import cat_graph, cat_vocab  # their statements are used below
from . import valuation as VA
from .cat_report import discovery_table
from .cat_tabular import DOMAIN_SQL, domain_value
from .cat_vocab import _BOW_SQL, _EN_TOKENS_SQL, _VOCAB_SQL
from .estimator_curve import estimator_curve
from .registry import ORACLE, register
from .tasks import LANG_TASK_SQL, NOISE_RATE, lang_task, noisy_train_sql

#: Outer iterations of the registered runs, as the original run recipe sets them (every
#: iteration is a fit of the predictor in the loop); a shorter run passes ``iterations``.
ITERATIONS = 400


# ---------------------------------------------------------------------------
# SQL twin of naive Bayes.
# ---------------------------------------------------------------------------
DATA_SQL = (f"{noisy_train_sql()}, {_EN_TOKENS_SQL}, {_VOCAB_SQL}, {_BOW_SQL},\n"
            "va AS (SELECT row_id, y FROM lang_task WHERE split = 'valid'),\n"
            "te AS (SELECT row_id, y FROM lang_task WHERE split <> 'train'),\n"
            "ev AS (SELECT row_id, y, 'valid' AS part FROM va UNION ALL SELECT row_id, y, 'test' AS part FROM te)")


def nb_sql(x: str, train: str, rows: str) -> str:
    """CTEs ``{x}_p (row_id, c, p)`` and ``{x}_y (row_id, pred)``: a model of ``train``
    applied to ``rows``."""
    return f"""{x}_n AS (SELECT y, count(*) AS n FROM {train} WHERE y IS NOT NULL GROUP BY y),
{x}_c AS (SELECT t.y, b.word_id, sum(b.n) AS n FROM {train} t JOIN bw b ON b.doc_id = t.row_id WHERE t.y IS NOT NULL GROUP BY 1, 2),
{x}_s AS (SELECT y, sum(n) AS s FROM {x}_c GROUP BY y),
{x}_pi AS (SELECT y, ln((n + 1.0) / ((SELECT sum(n) FROM {x}_n) + (SELECT count(*) FROM {x}_n))) AS pi FROM {x}_n),
{x}_th AS (SELECT k.y, v.word_id, ln((coalesce(c.n, 0) + 1.0) / (coalesce(s.s, 0) + (SELECT count(*) FROM voc))) AS th
  FROM {x}_n k CROSS JOIN voc v LEFT JOIN {x}_c c ON c.y = k.y AND c.word_id = v.word_id LEFT JOIN {x}_s s ON s.y = k.y),
{x}_r AS (SELECT e.row_id, k.y AS c, k.pi + coalesce(sum(b.n * t.th), 0) AS raw FROM (SELECT DISTINCT row_id FROM {rows}) e CROSS JOIN {x}_pi k
  LEFT JOIN bw b ON b.doc_id = e.row_id LEFT JOIN {x}_th t ON t.word_id = b.word_id AND t.y = k.y GROUP BY e.row_id, k.y, k.pi),
{x}_e AS (SELECT row_id, c, exp(raw - max(raw) OVER (PARTITION BY row_id)) AS e FROM {x}_r),
{x}_p AS (SELECT row_id, c, e / sum(e) OVER (PARTITION BY row_id) AS p FROM {x}_e),
{x}_y AS (SELECT row_id, arg_max(c, p) AS pred FROM {x}_p GROUP BY row_id)"""


def accuracy_sql(x: str, rows: str) -> str:
    return f"(SELECT avg(CAST(p.pred = r.y AS DOUBLE)) FROM {rows} r JOIN {x}_y p ON p.row_id = r.row_id)"


RANKED_SQL = f"""{nb_sql('v', 'va', 'noisy')},
vals AS (SELECT t.row_id, t.y, t.is_noisy, round(v_p.p, 9) AS data_value FROM noisy t JOIN v_p ON v_p.row_id = t.row_id AND v_p.c = t.y),
rk AS (SELECT row_id, y, is_noisy, row_number() OVER (ORDER BY data_value, row_id) - 1 AS rank_asc, count(*) OVER () AS n FROM vals)"""

CURVE_SQL = f"""{RANKED_SQL},
bn AS (SELECT 'low' AS mode, row_id, y, floor(((rank_asc + 1) * {NUM_BINS} - 1) / n) AS b FROM rk
       UNION ALL SELECT 'high' AS mode, row_id, y, floor(((n - rank_asc) * {NUM_BINS} - 1) / n) AS b FROM rk),
gb AS (SELECT CAST(bin AS INTEGER) AS bin FROM range(0, {NUM_BINS}) t(bin)),
m_n AS (SELECT mode, bin, y, count(*) AS n FROM bn JOIN gb ON b >= bin GROUP BY 1, 2, 3),
m_t AS (SELECT mode, bin, sum(n) AS n, count(*) AS k FROM m_n GROUP BY 1, 2),
m_b AS (SELECT x.mode, x.b, x.y, w.word_id, sum(w.n) AS n FROM bn x JOIN bw w ON w.doc_id = x.row_id GROUP BY 1, 2, 3, 4),
m_c AS (SELECT mode, bin, y, word_id, sum(n) AS n FROM m_b JOIN gb ON b >= bin GROUP BY 1, 2, 3, 4),
m_s AS (SELECT mode, bin, y, sum(n) AS s FROM m_c GROUP BY 1, 2, 3),
m_th AS (SELECT k.mode, k.bin, k.y, v.word_id, ln((coalesce(c.n, 0) + 1.0) / (coalesce(s.s, 0) + (SELECT count(*) FROM voc))) AS th
  FROM m_n k CROSS JOIN voc v LEFT JOIN m_c c ON c.mode = k.mode AND c.bin = k.bin AND c.y = k.y AND c.word_id = v.word_id
  LEFT JOIN m_s s ON s.mode = k.mode AND s.bin = k.bin AND s.y = k.y),
m_w AS (SELECT e.row_id, t.mode, t.bin, t.y AS c, sum(b.n * t.th) AS w FROM (SELECT DISTINCT row_id FROM ev) e
  JOIN bw b ON b.doc_id = e.row_id JOIN m_th t ON t.word_id = b.word_id GROUP BY 1, 2, 3, 4),
m_r AS (SELECT e.row_id, k.mode, k.bin, k.y AS c, ln((k.n + 1.0) / (t.n + t.k)) + coalesce(w.w, 0) AS raw
  FROM (SELECT DISTINCT row_id FROM ev) e CROSS JOIN m_n k JOIN m_t t ON t.mode = k.mode AND t.bin = k.bin
  LEFT JOIN m_w w ON w.row_id = e.row_id AND w.mode = k.mode AND w.bin = k.bin AND w.c = k.y),
m_y AS (SELECT row_id, mode, bin, arg_max(c, raw) AS pred FROM m_r GROUP BY 1, 2, 3),
m_a AS (SELECT y.mode, y.bin, ev.part, avg(CAST(y.pred = ev.y AS DOUBLE)) AS a FROM m_y y JOIN ev ON ev.row_id = y.row_id GROUP BY 1, 2, 3),
cur AS (SELECT t.mode, t.bin, CAST(t.n AS BIGINT) AS n_rows,
  CASE WHEN t.k < 2 THEN 0.0 ELSE max(CASE WHEN a.part = 'valid' THEN a.a END) END AS valid_metric,
  CASE WHEN t.k < 2 THEN 0.0 ELSE max(CASE WHEN a.part = 'test' THEN a.a END) END AS test_metric
  FROM m_t t JOIN m_a a ON a.mode = t.mode AND a.bin = t.bin GROUP BY t.mode, t.bin, t.n, t.k)"""
_CURVE_OUT = ("SELECT mode, bin, n_rows, round(valid_metric, 6) AS valid_metric, round(test_metric, 6) AS test_metric FROM {t}")


def _rounded(curve, digits: int = 6):
    return curve.withColumn("valid_metric", F.round("valid_metric", digits)).withColumn("test_metric", F.round("test_metric", digits))


@register("text_features", sql=f"""WITH {LANG_TASK_SQL}, {_EN_TOKENS_SQL}, {_VOCAB_SQL}, {_BOW_SQL}
SELECT l.row_id, l.y, l.split, b.word_id, b.n FROM lang_task l JOIN bw b ON b.doc_id = l.row_id""")
def text_features(spark, sf_dir, method: str = "bow", vocab_size: int = VA.VOCAB_SIZE):
    """Feature switch for the lang task. 'bow': counts over the ``vocab_size`` most
    frequent words; 'word2vec' / 'tfidf_word2vec': mean word vectors; 'graph': pooled
    document-graph vectors. Long output (row_id, y, split, index, value)."""
    lt = lang_task(spark, sf_dir).select("row_id", "y", "split")
    if method == "bow":
        b = V.list_bow(*cat_vocab._en_lists(spark, sf_dir, vocab_size)).drop("total")
        return lt.join(b.withColumnRenamed("doc_id", "row_id"), "row_id").select("row_id", "y", "split", "word_id", "n")
    if method in ("word2vec", "tfidf_word2vec"):
        v = cat_vocab.document_means(spark, sf_dir, weighted=method == "tfidf_word2vec")
    elif method == "graph":
        v = cat_graph.document_vectors(spark, sf_dir)
    else:
        raise ValueError(method)
    # joined as vectors: a row per dimension would be shuffled 64 times as often
    v = lt.join(v.withColumnRenamed("doc_id", "row_id"), "row_id")
    return v.select("row_id", "y", "split", F.posexplode("vec").alias("dim", "v")).withColumn("v", F.round("v", 6))


def _mode_sql(key: str) -> str:
    return (f"WITH {LANG_TASK_SQL}, f AS ({ORACLE[key]}) SELECT l.row_id, l.y, l.split, f.dim, f.v FROM lang_task l JOIN f ON f.doc_id = l.row_id")


@register("text_features_word2vec", sql=_mode_sql("avg_vector"))
def text_features_word2vec(spark, sf_dir):
    """Mean word vectors of the lang task's texts."""
    return text_features(spark, sf_dir, "word2vec")


@register("text_features_tfidf", sql=_mode_sql("tfidf_vector"))
def text_features_tfidf(spark, sf_dir):
    """Mean word vectors weighted by inverse document frequency."""
    return text_features(spark, sf_dir, "tfidf_word2vec")


@register("text_features_graph", sql=_mode_sql("graph_pool"))
def text_features_graph(spark, sf_dir):
    """Pooled document-graph vectors."""
    return text_features(spark, sf_dir, "graph")


_TWO_TEXTS = ("regexp_extract(text, '^([^\\n]*)', 1)", "substring(text, length(regexp_extract(text, '^([^\\n]*)', 1)) + 2)")


@register("text_features_two", sql=f"""WITH {LANG_TASK_SQL},
two AS (SELECT row_id, y, split, {_TWO_TEXTS[0]} AS title, {_TWO_TEXTS[1]} AS description FROM lang_task),
tk AS (SELECT row_id, 'title' AS part, unnest({T.tokenize_en_sql('title')}) AS word FROM two
       UNION ALL SELECT row_id, 'description' AS part, unnest({T.tokenize_en_sql('description')}) AS word FROM two),
vc AS (SELECT part, word, row_number() OVER (PARTITION BY part ORDER BY n DESC, word) AS r FROM (SELECT part, word, count(*) AS n FROM tk GROUP BY 1, 2)),
vi AS (SELECT part, word, CAST(row_number() OVER (PARTITION BY part ORDER BY word) - 1 AS INTEGER) AS word_id FROM vc WHERE r <= {VA.VOCAB_SIZE})
SELECT t.row_id, l.y, l.split, t.part, vi.word_id, count(*) AS n FROM tk t JOIN vi ON vi.part = t.part AND vi.word = t.word
JOIN lang_task l ON l.row_id = t.row_id GROUP BY ALL""")
def text_features_two(spark, sf_dir, vocab_size: int = VA.VOCAB_SIZE):
    """Separate-column mode: title (first line) and description (the rest) each get a
    vocabulary and counts of their own."""
    lt = lang_task(spark, sf_dir)
    two = VA.two_texts(spread(lt, "row_id"))
    out = None
    from ..operators.tokens import explode_tokens
    for part in ("title", "description"):
        toks = explode_tokens(two.select("row_id", T.tokenize_en(part).alias("t")), "row_id", "t")
        b = V.bow(toks, V.build_vocab(toks, vocab_size), key="row_id").withColumn("part", F.lit(part))
        out = b if out is None else out.unionByName(b)
    return lt.select("row_id", "y", "split").join(out, "row_id").select("row_id", "y", "split", "part", "word_id", "n")


@register("noise_discovery", sql=f"""WITH {DATA_SQL}, {RANKED_SQL},
c AS (SELECT count(*) AS n, count(*) FILTER (WHERE is_noisy) AS nn FROM rk)
SELECT CAST(b AS INTEGER) AS b, round(b / {float(NUM_BINS)}, 6) AS frac,
round((SELECT count(*) FROM rk WHERE is_noisy AND rank_asc < floor(b * c.n / {float(NUM_BINS)})) / c.nn, 6) AS tpr,
round(least(b / {float(NUM_BINS)} / {NOISE_RATE}, 1.0), 6) AS optimal, round(b / {float(NUM_BINS)}, 6) AS random
FROM range(1, {NUM_BINS + 1}) t(b), c""")
def noise_discovery(spark, sf_dir):
    """Flagship report: plant 20 % label noise, fit on the clean validation rows,
    value every training row by the probability of its own label, rank, and report
    the share of noisy rows found in each lowest-value percentile bin."""
    data = VA.lang_features(spark, sf_dir)
    ranked = VA.ranked_values(data.train, VA.simple_values(data))
    return discovery_table(ranked, ranked.count(), NOISE_RATE)


@register("fit_predictor", sql=f"""WITH {DATA_SQL}, {nb_sql('b', 'noisy', 'te')}, {nb_sql('v', 'va', 'te')}
{" UNION ALL ".join(f"SELECT '{name}' AS model, '{part}' AS split, round({accuracy_sql(x, rows)}, 6) AS accuracy"
                    for name, x in (("baseline", "b"), ("validation", "v")) for part, rows in (("valid", "va"), ("test", "te")))}""")
def fit_predictor(spark, sf_dir):
    """Baseline (noisy training rows) and validation model (clean valid rows), each
    scored on valid and test; both models are scored in one job."""
    data = VA.lang_features(spark, sf_dir)
    pairs = [AD.nb_statistics(VA.labelled(x), data.bow, data.k, data.d) for x in (data.train, data.valid)]
    models = AD.NaiveBayes.of(*(np.concatenate(x) for x in zip(*pairs, strict=True)))
    scored = AD.nb_predict(VA._evaluated(data), data.bow, models)
    t = VA.metric_table(scored, "accuracy", data.k, ["model", "part"])
    return t.select(F.element_at(F.array(F.lit("baseline"), F.lit("validation")), F.col("model") + 1).alias("model"),
                    F.col("part").alias("split"), F.round("accuracy", 6).alias("accuracy"))


@register("predict_proba", sql=f"""WITH {DATA_SQL}, {nb_sql('b', 'noisy', 'te')}
SELECT row_id, CAST(c AS INTEGER) AS k, round(p, 6) AS p FROM b_p""")
def predict_proba(spark, sf_dir):
    data = VA.lang_features(spark, sf_dir)
    s = VA.nb_scores(VA.labelled(data.test), data, VA.nb_fit(VA.labelled(data.train), data))
    return s.select("row_id", F.posexplode("p").alias("k", "p")).withColumn("p", F.round("p", 6))


_SUBSETS = {"clean_only": "NOT is_noisy", "noisy_only": "is_noisy", "half": f"{uniform_sql(7, 'row_id')} < 0.5"}


@register("reward", sql=f"""WITH {DATA_SQL}, {nb_sql('b', 'noisy', 'va')},
{", ".join(f"t_{k} AS (SELECT row_id, y FROM noisy WHERE {v}), {nb_sql(k, f't_{k}', 'va')}" for k, v in _SUBSETS.items())},
r AS ({" UNION ALL ".join(f"SELECT '{k}' AS subset, CASE WHEN (SELECT count(*) FROM {k}_n) > 1 THEN {accuracy_sql(k, 'va')} END AS a" for k in _SUBSETS)})
SELECT subset, round(a, 6) AS accuracy, round(a - {accuracy_sql('b', 'va')}, 6) AS reward FROM r""")
def reward(spark, sf_dir):
    """Validation gain of a predictor fitted on a subset over the baseline (all
    noisy rows): clean-only rows, noisy-only rows, a half sample. The four models are
    scored in one job."""
    data = VA.lang_features(spark, sf_dir)
    subsets = {"all": data.train, "clean_only": data.train.filter(~F.col("is_noisy")), "noisy_only": data.train.filter(F.col("is_noisy")),
               "half": data.train.filter(uniform(7, "row_id") < 0.5)}
    pairs = [AD.nb_statistics(VA.labelled(x), data.bow, data.k, data.d) for x in subsets.values()]
    models = AD.NaiveBayes.of(*(np.concatenate(x) for x in zip(*pairs, strict=True)))
    t = VA.metric_table(AD.nb_predict(VA.labelled(data.valid), data.bow, models), "accuracy", data.k, ["model"])
    got = {r["model"]: r["accuracy"] for r in t.collect()}  # four numbers
    rows = []
    for i, name in enumerate(subsets):
        usable = models.classes[i] > 1
        if i:
            rows.append((name, round(got[i], 6) if usable else None,
                         round(VA.gain(got[i], got[0], "accuracy"), 6) if usable else None))
    return spark.createDataFrame(rows, "subset string, accuracy double, reward double")


def _trained(spark, sf_dir, iterations: int):
    """Logistic regression in the loop and a moving reward baseline: naive Bayes in the
    loop is cheaper (its counts come out of the valuer's own pass) but reacts too little to
    20 % noise to give the reward a signal. The three queries below train the same valuer:
    each goes on from the state that a run on the same rows has stored, if there is one."""
    return VA.ValuerTrainer(VA.lang_features(spark, sf_dir), predictor="logistic", perf="log_loss", moving_baseline=0.9, resume=True).train(iterations)


@register("train_valuer")
def train_valuer(spark, sf_dir, iterations: int = ITERATIONS):
    """One row per outer iteration: reward and mean value."""
    tr = _trained(spark, sf_dir, iterations)
    return spark.createDataFrame([(int(i), float(r), float(m)) for i, r, m in tr.history],
                                 "iteration int, reward double, mean_value double")


@register("value_rows")
def value_rows(spark, sf_dir, iterations: int = ITERATIONS):
    return _trained(spark, sf_dir, iterations).values()


@register("valuer_discovery")
def valuer_discovery(spark, sf_dir, iterations: int = ITERATIONS):
    """The discovery table of the trained valuer's values: the share of the noisy rows found
    among the lowest-valued rows."""
    tr = _trained(spark, sf_dir, iterations)
    ranked = VA.ranked_values(tr.data.train, tr.values())
    return discovery_table(ranked, ranked.count(), NOISE_RATE)


@register("predict_final")
def predict_final(spark, sf_dir, iterations: int = ITERATIONS):
    """Predictor fitted with the data values as row weights, applied to the test rows."""
    tr = _trained(spark, sf_dir, iterations)
    data = tr.data
    w = data.train.join(tr.values(), "row_id")
    s = VA.predict(VA.fit(w, weight="data_value"), data.test)
    return s.select("row_id", "y", "pred")


@register("remove_high_low", sql=f"WITH {DATA_SQL}, {CURVE_SQL} {_CURVE_OUT.format(t='cur')}")
def remove_high_low(spark, sf_dir):
    data = VA.lang_features(spark, sf_dir)
    return _rounded(VA.remove_high_low(data, VA.simple_values(data)))


@register("curve_estimator", sql=f"WITH {DATA_SQL}, {CURVE_SQL} {_CURVE_OUT.format(t='cur')}")
def curve_estimator(spark, sf_dir):
    """The removal curve with a Spark ML estimator as the evaluation model: 40 fits, several at a
    time. (With multinomial naive Bayes it is the curve of ``remove_high_low``.)"""
    data = VA.lang_features(spark, sf_dir)
    return _rounded(estimator_curve(data, VA.simple_values(data), lambda: VA.make_estimator("naive_bayes")))


@register("learn_with_values", sql=f"""WITH {DATA_SQL}, {CURVE_SQL}, best AS (SELECT * FROM cur ORDER BY valid_metric DESC,
CASE mode WHEN 'low' THEN 0 ELSE {NUM_BINS} END + bin LIMIT 1) {_CURVE_OUT.format(t='best')}""")
def learn_with_values(spark, sf_dir):
    data = VA.lang_features(spark, sf_dir)
    return _rounded(VA.learn_with_values(VA.remove_high_low(data, VA.simple_values(data))))


@register("learn_baseline", sql=f"WITH {DATA_SQL}, {nb_sql('b', 'noisy', 'te')} SELECT round({accuracy_sql('b', 'te')}, 6) AS test_accuracy")
def learn_baseline(spark, sf_dir):
    data = VA.lang_features(spark, sf_dir)
    return spark.createDataFrame([(round(VA.learn_baseline(data), 6),)], "test_accuracy double")


@register("offline_eval", sql=f"WITH {DATA_SQL}, {CURVE_SQL} {_CURVE_OUT.format(t='cur')}")
def offline_eval(spark, sf_dir):
    """Store values and splits, read them back, compute the removal curve, store it."""
    from dataclasses import replace

    from ..sources import writers as W
    data = VA.lang_features(spark, sf_dir)
    run = W.run_dir(spark, "offline-" + uuid.uuid4().hex[:8])
    W.write_values(VA.simple_values(data), f"{run}/values")
    data.train.drop("features").write.mode("overwrite").parquet(f"{run}/train")
    curve = VA.remove_high_low(replace(data, train=spark.read.parquet(f"{run}/train")), spark.read.parquet(f"{run}/values"))
    W.write_curve(_rounded(curve), f"{run}/curve")
    return W.read_curve(spark, f"{run}/curve")


@register("report_sinks", sql=f"""WITH {DATA_SQL}, {RANKED_SQL},
low AS (SELECT row_id, rank_asc FROM rk WHERE rank_asc < 100), nz AS (SELECT row_id FROM rk WHERE is_noisy)
SELECT 'lowest' AS list, row_id, CAST(rank_asc AS BIGINT) AS place FROM low
UNION ALL SELECT 'noisy' AS list, row_id, row_number() OVER (ORDER BY row_id) - 1 AS place FROM nz""")
def report_sinks(spark, sf_dir, n: int = 100):
    """The ids of the ``n`` lowest-valued rows and of the noisy rows, each written one per
    line in order and read back with their line numbers."""
    from ..sources import readers as RD
    from ..sources import writers as W
    data = VA.lang_features(spark, sf_dir)
    ranked = VA.ranked_values(data.train, VA.simple_values(data))
    run = W.run_dir(spark, "report-" + uuid.uuid4().hex[:8])
    W.write_ids(ranked.filter(F.col("rank_asc") < n), ["rank_asc"], f"{run}/lowest")
    W.write_ids(ranked.filter("is_noisy"), ["row_id"], f"{run}/noisy")
    out = None
    for name in ("lowest", "noisy"):
        ids = RD.read_vector(spark, f"{run}/{name}", "bigint").select(F.lit(name).alias("list"), F.col("value").alias("row_id"),
                                                                     F.col("line").cast("bigint").alias("place"))
        out = ids if out is None else out.unionByName(ids)
    return out


# ---------------------------------------------------------------------------
# Regression: order prices, predicted by the customer's nation.
# ---------------------------------------------------------------------------
GROUP = "c_nationkey"


def _price_task(spark, sf_dir):
    dv = domain_value(spark, sf_dir).select("row_id", "y", GROUP, "split")
    from ..session import cut_lineage
    dv = cut_lineage(dv)  # three uses below
    nations = [r[0] for r in table(spark, sf_dir, "nation").select("n_nationkey").orderBy("n_nationkey").collect()]  # fixed table
    return dv.filter("split = 'source'"), dv.filter("split = 'valid'"), dv.filter("split = 'rest'"), nations


_PRICE_SQL = f"""{DOMAIN_SQL}, src AS (SELECT row_id, y, {GROUP} AS g FROM dv WHERE split = 'source'),
vr AS (SELECT row_id, y, {GROUP} AS g FROM dv WHERE split = 'valid'), tr AS (SELECT row_id, y, {GROUP} AS g FROM dv WHERE split = 'rest'),
vm AS (SELECT g, avg(y) AS m FROM vr GROUP BY g),
pd AS (SELECT s.row_id, s.y, s.g, abs(s.y - coalesce(vm.m, (SELECT avg(y) FROM vr))) / abs(s.y) AS d FROM src s LEFT JOIN vm ON vm.g = s.g)"""


@register("regression_diff", sql=f"WITH {_PRICE_SQL} SELECT row_id, round(d, 6) AS d FROM pd")
def regression_diff(spark, sf_dir):
    """Regression form of the prediction difference: |y - p| / |y|."""
    train, valid, _, nations = _price_task(spark, sf_dir)
    m = AD.GroupMeans.of(nations, *AD.mean_statistics(valid, GROUP, nations))
    s = AD.mean_predict(train, GROUP, m)
    return s.select("row_id", F.round(VA.relative_diff(F.col("y"), F.col("pred")), 6).alias("d"))


_RMSPE = "sqrt(avg(((y - p) / y) * ((y - p) / y)) FILTER (WHERE part = '{}'))"
_MAE = "avg(abs(y - p)) FILTER (WHERE part = '{}')"


def _regression_curve_sql(perf: str) -> str:
    return f"""{_PRICE_SQL},
vl AS (SELECT row_id, y, g, round(coalesce(1 / (1 + d), 0), 9) AS data_value FROM pd),
rk AS (SELECT row_id, y, g, row_number() OVER (ORDER BY data_value, row_id) - 1 AS r, count(*) OVER () AS n FROM vl),
bn AS (SELECT 'low' AS mode, y, g, floor(((r + 1) * {NUM_BINS} - 1) / n) AS b FROM rk UNION ALL
       SELECT 'high' AS mode, y, g, floor(((n - r) * {NUM_BINS} - 1) / n) AS b FROM rk),
gb AS (SELECT CAST(bin AS INTEGER) AS bin FROM range(0, {NUM_BINS}) t(bin)),
mm AS (SELECT mode, bin, g, avg(y) AS m FROM bn JOIN gb ON b >= bin GROUP BY 1, 2, 3),
mo AS (SELECT mode, bin, avg(y) AS m, count(*) AS n FROM bn JOIN gb ON b >= bin GROUP BY 1, 2),
ev AS (SELECT *, 'valid' AS part FROM vr UNION ALL SELECT *, 'test' AS part FROM vr UNION ALL SELECT *, 'test' AS part FROM tr),
pr AS (SELECT o.mode, o.bin, o.n, e.part, e.y, coalesce(mm.m, o.m) AS p FROM ev e CROSS JOIN mo o
       LEFT JOIN mm ON mm.mode = o.mode AND mm.bin = o.bin AND mm.g = e.g),
cur AS (SELECT mode, bin, CAST(n AS BIGINT) AS n_rows, {", ".join(f"{perf.format(x)} AS {x}_metric" for x in ("valid", "test"))}
        FROM pr GROUP BY mode, bin, n)"""


@register("regression_curve", sql=f"WITH {_regression_curve_sql(_RMSPE)} {_CURVE_OUT.format(t='cur')}")
def regression_curve(spark, sf_dir, perf: str = "rmspe"):
    """Removal curve of the regression task (smaller is better)."""
    train, valid, rest, nations = _price_task(spark, sf_dir)
    values = VA.regression_values(train, valid, GROUP, nations)
    evals = (valid.withColumn("part", F.lit("valid")).unionByName(valid.unionByName(rest).withColumn("part", F.lit("test")))
             .select("row_id", "y", GROUP, "part"))  # test rows include the valid rows, as the original does
    return _rounded(VA.regression_curve(train, evals, values, GROUP, nations, perf))


@register("regression_best", sql=f"""WITH {_regression_curve_sql(_MAE)}, best AS (SELECT mode, bin, n_rows, round(valid_metric, 6) AS valid_metric,
round(test_metric, 6) AS test_metric FROM cur) SELECT * FROM best ORDER BY valid_metric, CASE mode WHEN 'low' THEN 0 ELSE {NUM_BINS} END + bin LIMIT 1""")
def regression_best(spark, sf_dir):
    """The bin with the least validation mae."""
    return VA.learn_with_values(regression_curve(spark, sf_dir, "mae"), minimize=True)


@register("regression_reward", sql=f"""WITH {_PRICE_SQL},
near AS (SELECT row_id, y, g FROM pd WHERE d < 0.5),
am AS (SELECT g, avg(y) AS m FROM src GROUP BY g), nm AS (SELECT g, avg(y) AS m FROM near GROUP BY g),
e AS (SELECT v.y, coalesce(am.m, (SELECT avg(y) FROM src)) AS pa, coalesce(nm.m, (SELECT avg(y) FROM near)) AS pn FROM vr v
      LEFT JOIN am ON am.g = v.g LEFT JOIN nm ON nm.g = v.g),
r AS (SELECT sqrt(avg(((y - pa) / y) * ((y - pa) / y))) AS a, sqrt(avg(((y - pn) / y) * ((y - pn) / y))) AS n FROM e)
SELECT round(n, 6) AS rmspe, round(a - n, 6) AS reward FROM r""")
def regression_reward(spark, sf_dir):
    """Gain in rmspe (reversed: smaller is better) of the rows whose relative difference is
    under one half over all rows."""
    train, valid, _, nations = _price_task(spark, sf_dir)
    ref = AD.GroupMeans.of(nations, *AD.mean_statistics(valid, GROUP, nations))
    near = AD.mean_predict(train, GROUP, ref).filter(VA.relative_diff(F.col("y"), F.col("pred")) < 0.5)
    pairs = [AD.mean_statistics(x, GROUP, nations) for x in (train, near)]
    m = AD.GroupMeans.of(nations, *(np.concatenate(x) for x in zip(*pairs, strict=True)))
    got = {r["model"]: r["rmspe"] for r in VA.metric_table(AD.mean_predict(valid, GROUP, m), "rmspe", by=["model"]).collect()}
    return spark.createDataFrame([(round(got[1], 6), round(VA.gain(got[1], got[0], "rmspe"), 6))], "rmspe double, reward double")


# ---------------------------------------------------------------------------
# Classifiers and document vectors.
# ---------------------------------------------------------------------------

@register("text_classifier")
def text_classifier(spark, sf_dir):
    """Distributed text classification: fit the pipeline on the training split,
    accuracy per evaluated split."""
    lt = lang_task(spark, sf_dir).withColumn("label", F.col("y").cast("double"))
    model = VA.text_classifier_pipeline().fit(lt.filter(F.col("split") == "train"))
    s = model.transform(lt.filter(F.col("split") != "train"))
    return s.groupBy("split").agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))


@register("text_classifier_two")
def text_classifier_two(spark, sf_dir):
    """Two-text classifier: title and description have a vectoriser each."""
    lt = VA.two_texts(lang_task(spark, sf_dir)).withColumn("label", F.col("y").cast("double"))
    model = VA.two_text_classifier_pipeline().fit(lt.filter(F.col("split") == "train"))
    s = model.transform(lt.filter(F.col("split") != "train"))
    return s.groupBy("split").agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))


@register("graph_classifier")
def graph_classifier(spark, sf_dir):
    """The main path's predictor: a multilayer perceptron on pooled document-graph
    vectors, accuracy per evaluated split."""
    feats = VA.graph_features(spark, sf_dir)
    tr = feats.filter(F.col("split") == "train")
    m = VA.fit(tr, kind="mlp", layers=[VA.GRAPH_DIM, 16, VA.K_LANG], max_iter=60)
    s = VA.predict(m, feats.filter(F.col("split") != "train"))
    return s.groupBy("split").agg(F.avg((F.col("pred") == F.col("y")).cast("double")).alias("accuracy"))


def _graph_layers():
    return [VA.GRAPH_DIM, 16, VA.K_LANG]


@register("graph_values")
def graph_values(spark, sf_dir, iterations: int = ITERATIONS):
    """Row values of the main path: graph vectors are the inputs of the valuer and of the
    perceptron in the loop."""
    tr = VA.ValuerTrainer(VA.graph_task(spark, sf_dir), predictor="mlp", layers=_graph_layers(), moving_baseline=0.9, resume=True)
    return tr.train(iterations).values()


@register("graph_own_class_values")
def graph_own_class_values(spark, sf_dir):
    """Row values without a valuer: one minus the own-class difference of a perceptron on
    graph vectors, fitted on the clean validation rows."""
    data = VA.graph_task(spark, sf_dir)
    m = VA.fit(data.valid, kind="mlp", layers=_graph_layers(), max_iter=60)
    s = VA.predict(m, data.train)
    return s.select("row_id", F.element_at("p", F.col("y") + 1).alias("data_value"))
