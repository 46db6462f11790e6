"""Catalogue: metrics, statistics, ranking and value reports on stored deterministic
scores (``p`` = normalised hash uniforms, ``value`` = u(7, id)) and on ``orders``
/ ``lineitem``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import uniform, uniform_sql
from ..functions.rules import NUM_BINS
from ..operators import metrics as MT
from ..operators import recode as RC
from ..operators.ranking import argmax_index, bin_of_rank, global_rank, prefix_sum
from ..tables import table
from .registry import register
from .tasks import (K_LANG, LANG_TASK_SQL, NOISE_RATE, SEED, lang_task, noisy_train, noisy_train_sql,
                    scores_sql, with_scores)

SCORED_SQL = f"{LANG_TASK_SQL}, sc AS ({scores_sql('lang_task')})"
NOISY_SCORED_SQL = f"{noisy_train_sql()}, ns AS ({scores_sql('noisy')})"


def _scored(spark, sf_dir):
    return with_scores(lang_task(spark, sf_dir))


def _noisy_scored(spark, sf_dir):
    return with_scores(noisy_train(spark, sf_dir))


@register("label_counts", sql=f"WITH {LANG_TASK_SQL} SELECT split, y, count(*) AS n FROM lang_task GROUP BY split, y")
def label_counts(spark, sf_dir):
    return lang_task(spark, sf_dir).groupBy("split", "y").agg(F.count(F.lit(1)).alias("n"))


@register("grouped_stats", sql="""SELECT l_returnflag, count(*) AS size, round(avg(l_quantity), 6) AS mean,
round(stddev_pop(l_quantity), 6) AS std, max(l_quantity) AS max, min(l_quantity) AS min, round(median(l_quantity), 6) AS median
FROM lineitem GROUP BY l_returnflag""")
def grouped_stats(spark, sf_dir):
    """size/mean/std/max/min/median per group. The median is exact: values are counted per
    (group, value), a distributed prefix sum gives each value its place, and the values at
    the two middle places are averaged, so no task holds a group."""
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity")
    a = li.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("size"), F.round(F.avg("l_quantity"), 6).alias("mean"),
        F.round(F.stddev_pop("l_quantity"), 6).alias("std"),
        F.coalesce(F.max("l_quantity"), F.lit(-1.0)).alias("max"), F.coalesce(F.min("l_quantity"), F.lit(-1.0)).alias("min"))
    vc = (li.filter(F.col("l_quantity").isNotNull()).groupBy("l_returnflag", "l_quantity").agg(F.count(F.lit(1)).alias("c")))
    cum = prefix_sum(vc, "l_returnflag", "l_quantity", "c")
    n = vc.groupBy("l_returnflag").agg(F.sum("c").alias("n"))
    at = cum.join(n, "l_returnflag")
    holds = lambda place: (F.col("c_before") <= place) & (place < F.col("c_before") + F.col("c"))
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    med = at.groupBy("l_returnflag").agg(F.round((F.max(F.when(holds(low), F.col("l_quantity"))) + F.max(
        F.when(holds(high), F.col("l_quantity")))) / 2, 6).alias("median"))
    return a.join(med, "l_returnflag")


_FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_const"]


@register("feature_corr", sql=f"""WITH li AS (SELECT *, 1.0 AS l_const, CAST(l_returnflag = 'R' AS DOUBLE) AS y FROM lineitem)
{" UNION ALL ".join(f"SELECT '{c}' AS feature, round(coalesce(CASE WHEN isnan(corr({c}, y)) THEN NULL ELSE corr({c}, y) END, 0.0), 6) AS corr FROM li" for c in _FEATS)}""")
def feature_corr(spark, sf_dir):
    """Pearson correlation of each feature with the label; undefined (constant) -> 0."""
    li = table(spark, sf_dir, "lineitem").select(*_FEATS[:-1], F.lit(1.0).alias("l_const"),
                                                 (F.col("l_returnflag") == "R").cast("double").alias("y"))
    # corr of a constant column is undefined: guard it instead of dividing by zero
    row = li.agg(*[F.try_divide(F.covar_pop(c, "y"), F.stddev_pop(c) * F.stddev_pop("y")).alias(c)
                   for c in _FEATS])
    stack = "stack({}, {}) as (feature, corr)".format(
        len(_FEATS), ", ".join(f"'{c}', {c}" for c in _FEATS))
    return row.selectExpr(stack).select("feature", F.round(F.coalesce(F.nanvl("corr", F.lit(None)), F.lit(0.0)), 6)
                                        .alias("corr"))


@register("metric_accuracy", sql=f"""WITH {SCORED_SQL}
SELECT split, round(avg(CAST(list_position(p, list_max(p)) - 1 = y AS DOUBLE)), 6) AS accuracy FROM sc GROUP BY split""")
def metric_accuracy(spark, sf_dir):
    return MT.accuracy(_scored(spark, sf_dir), by="split").withColumn("accuracy", F.round("accuracy", 6))


@register("metric_auc", sql=f"""WITH {SCORED_SQL},
l AS (SELECT split, k, p[k + 1] AS s, CAST(y = k AS BIGINT) AS yy FROM sc, range(0, {K_LANG}) r(k)),
c AS (SELECT split, k, s, sum(yy) AS pos, sum(1 - yy) AS neg FROM l GROUP BY split, k, s),
cu AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY split, k ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM c),
a AS (SELECT split, k, sum(pos * (nb + 0.5 * neg)) / (sum(pos) * sum(neg)) AS auc FROM cu GROUP BY split, k)
SELECT split, round(avg(auc), 6) AS auc FROM a GROUP BY split""")
def metric_auc(spark, sf_dir):
    """Exact macro one-vs-rest ROC-AUC (ties count one half)."""
    return MT.auc(_scored(spark, sf_dir), k=K_LANG, by="split").withColumn("auc", F.round("auc", 6))


@register("metric_logloss", sql=f"""WITH {SCORED_SQL}
SELECT split, round(avg(ln(least(greatest(p[y + 1], 1e-15), 1 - 1e-15))), 6) AS neg_log_loss FROM sc GROUP BY split""")
def metric_logloss(spark, sf_dir):
    return MT.neg_log_loss(_scored(spark, sf_dir), by="split").withColumn("neg_log_loss", F.round("neg_log_loss", 6))


_PRED_SQL = (f"pr AS (SELECT o_orderstatus, o_totalprice AS y, o_totalprice * (0.8 + 0.4 * "
             f"{uniform_sql(SEED, 'o_orderkey')}) AS pred FROM orders)")


def _regression(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderstatus", F.col("o_totalprice").alias("y"),
                    (F.col("o_totalprice") * (F.lit(0.8) + F.lit(0.4) * uniform(SEED, "o_orderkey"))).alias("pred"))


@register("metric_rmspe", sql=f"""WITH {_PRED_SQL}
SELECT o_orderstatus, round(sqrt(avg(((y - pred) / y) * ((y - pred) / y))), 6) AS rmspe FROM pr GROUP BY o_orderstatus""")
def metric_rmspe(spark, sf_dir):
    return MT.rmspe(_regression(spark, sf_dir), by="o_orderstatus").withColumn("rmspe", F.round("rmspe", 6))


@register("metric_mae_mse", sql=f"""WITH {_PRED_SQL}
SELECT o_orderstatus, round(avg(abs(y - pred)), 4) AS mae, round(avg((y - pred) * (y - pred)), 2) AS mse FROM pr GROUP BY o_orderstatus""")
def metric_mae_mse(spark, sf_dir):
    return (MT.mae_mse(_regression(spark, sf_dir), by="o_orderstatus")
            .withColumn("mae", F.round("mae", 4)).withColumn("mse", F.round("mse", 2)))


@register("safe_divide", sql="""SELECT l_orderkey, l_linenumber, round(coalesce(l_extendedprice / nullif(l_discount, 0), 0.0), 6) AS v FROM lineitem""")
def safe_divide(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.round(RC.safe_divide("l_extendedprice", "l_discount"), 6).alias("v"))


@register("bits", sql="""SELECT o_orderkey, CAST(bit_count(o_orderkey) AS INTEGER) AS n_bits,
CASE WHEN o_orderkey = 0 THEN '' ELSE ltrim(bin(o_orderkey), '0') END AS binary FROM orders""")
def bits(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.bit_count("o_orderkey").cast("int").alias("n_bits"),
                    RC.binary_string("o_orderkey").alias("binary"))


@register("logit_logistic", sql=f"""WITH {LANG_TASK_SQL},
q AS (SELECT row_id, least(greatest({uniform_sql(SEED, 'row_id')}, 1e-15), 1 - 1e-15) AS p FROM lang_task)
SELECT row_id, round(ln(p / (1 - p)), 6) AS logit, round(exp(ln(p / (1 - p))) / (1 + exp(ln(p / (1 - p)))), 6) AS logistic FROM q""")
def logit_logistic(spark, sf_dir):
    lt = lang_task(spark, sf_dir).select("row_id", uniform(SEED, "row_id").alias("p"))
    lg = RC.logit("p")
    return lt.select("row_id", F.round(lg, 6).alias("logit"), F.round(RC.logistic(lg), 6).alias("logistic"))


@register("order_by_abs", sql="""SELECT l_orderkey, l_linenumber, l_quantity - 25 AS x,
row_number() OVER (ORDER BY abs(l_quantity - 25), l_quantity - 25, l_orderkey, l_linenumber) - 1 AS pos FROM lineitem""")
def order_by_abs(spark, sf_dir):
    """Order by |x|, the negative value first on ties."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") - 25).alias("x"))
    return global_rank(li, [F.abs("x"), F.col("x"), F.col("l_orderkey"), F.col("l_linenumber")], out="pos")


# ---------------------------------------------------------------------------
# Ranking-based reports on the noisy training rows.
# ---------------------------------------------------------------------------

@register("prediction_diff", sql=f"""WITH {NOISY_SCORED_SQL}
SELECT row_id, CAST(k AS INTEGER) AS k, round(abs(CAST(k = y AS DOUBLE) - p[k + 1]), 6) AS d FROM ns, range(0, {K_LANG}) r(k)""")
def prediction_diff(spark, sf_dir):
    """|onehot(y) - p| per class."""
    ns = _noisy_scored(spark, sf_dir)
    diff = F.zip_with(RC.label_one_hot("y", K_LANG), F.col("p"), lambda a, b: F.abs(a - b))
    return ns.select("row_id", F.posexplode(diff).alias("k", "d")).withColumn("d", F.round("d", 6))


@register("argmax_pred", sql=f"WITH {NOISY_SCORED_SQL} SELECT row_id, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS pred FROM ns")
def argmax_pred(spark, sf_dir):
    return _noisy_scored(spark, sf_dir).select("row_id", argmax_index(F.col("p")).alias("pred"))


_RANKS_SQL = ("rk AS (SELECT row_id, is_noisy, y, y_clean, p, value, row_number() OVER (ORDER BY value, row_id) - 1 AS rank_asc, "
              "row_number() OVER (ORDER BY value DESC, row_id DESC) - 1 AS rank_desc, count(*) OVER () AS n FROM ns)")


def _ranked(spark, sf_dir):
    """Ascending rank on (value, row_id); the descending order is its exact reverse."""
    ns = _noisy_scored(spark, sf_dir)  # ids, labels and scores; no text
    r = global_rank(ns, [F.col("value"), F.col("row_id")], out="rank_asc")
    n = r.count()
    return r.withColumn("rank_desc", F.lit(n - 1) - F.col("rank_asc"))


@register("rank_values", sql=f"WITH {NOISY_SCORED_SQL}, {_RANKS_SQL} SELECT row_id, rank_asc, rank_desc FROM rk")
def rank_values(spark, sf_dir):
    return _ranked(spark, sf_dir).select("row_id", "rank_asc", "rank_desc")


@register("bin_values", sql=f"""WITH {NOISY_SCORED_SQL}, {_RANKS_SQL}
SELECT row_id, CAST(floor(((rank_asc + 1) * {NUM_BINS} - 1) / n) AS INTEGER) AS bin FROM rk""")
def bin_values(spark, sf_dir):
    r = _ranked(spark, sf_dir)
    n = r.count()
    return r.select("row_id", bin_of_rank(F.col("rank_asc"), n, NUM_BINS).alias("bin"))


@register("top_bottom_n", sql=f"""WITH {NOISY_SCORED_SQL}
(SELECT row_id, 'high' AS which, round(value, 6) AS value, y FROM ns ORDER BY value DESC, row_id DESC LIMIT 10)
UNION ALL (SELECT row_id, 'low' AS which, round(value, 6) AS value, y FROM ns ORDER BY value, row_id LIMIT 10)""")
def top_bottom_n(spark, sf_dir, n: int = 10):
    ns = _noisy_scored(spark, sf_dir).select("row_id", "value", "y")
    hi = ns.orderBy(F.col("value").desc(), F.col("row_id").desc()).limit(n).withColumn("which", F.lit("high"))
    lo = ns.orderBy("value", "row_id").limit(n).withColumn("which", F.lit("low"))
    return hi.unionByName(lo).select("row_id", "which", F.round("value", 6).alias("value"), "y")


def discovery_table(ranked, n: int, rate: float, bins: int = NUM_BINS):
    """Share of noisy rows among the lowest floor(b*n/bins) valued rows, b = 1..bins,
    with the optimal and random reference lines. One aggregate over rows (count of
    noisy rows per first bin), then a running sum over the bins-row table."""
    spark = ranked.sparkSession
    per_bin = (ranked.filter("is_noisy").groupBy(bin_of_rank(F.col("rank_asc"), n, bins).alias("b0"))
               .agg(F.count(F.lit(1)).alias("c")))
    n_noisy = ranked.filter("is_noisy").count()
    spine = spark.range(1, bins + 1).select(F.col("id").cast("int").alias("b"))
    from pyspark.sql import Window
    w = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)  # bins rows
    cur = spine.join(per_bin, spine.b == per_bin.b0 + 1, "left").select("b", F.coalesce("c", F.lit(0)).alias("c"))
    frac = F.col("b") / F.lit(float(bins))
    tpr = (F.sum("c").over(w) / F.lit(n_noisy)) if n_noisy else F.lit(None).cast("double")
    return cur.select("b", F.round(frac, 6).alias("frac"), F.round(tpr, 6).alias("tpr"),
                      F.round(F.least(frac / F.lit(rate), F.lit(1.0)), 6).alias("optimal"),
                      F.round(frac, 6).alias("random"))


@register("discover_corrupted", sql=f"""WITH {NOISY_SCORED_SQL}, {_RANKS_SQL},
c AS (SELECT count(*) AS n, count(*) FILTER (WHERE is_noisy) AS nn FROM rk)
SELECT CAST(b AS INTEGER) AS b, round(b / {float(NUM_BINS)}, 6) AS frac,
round((SELECT count(*) FROM rk WHERE is_noisy AND rank_asc < floor(b * c.n / {float(NUM_BINS)})) / c.nn, 6) AS tpr,
round(least(b / {float(NUM_BINS)} / {NOISE_RATE}, 1.0), 6) AS optimal, round(b / {float(NUM_BINS)}, 6) AS random
FROM range(1, {NUM_BINS + 1}) t(b), c""")
def discover_corrupted(spark, sf_dir):
    r = _ranked(spark, sf_dir)
    return discovery_table(r, r.count(), NOISE_RATE)


def removal_subsets_table(ranked, n: int, bins: int = NUM_BINS, y: str = "y"):
    """For mode low/high and bin b: rows left after dropping the floor(b*n/bins) lowest
    (highest) valued rows, and how many classes they still hold. A class survives
    when its largest rank reaches the cut, so one small per-class table suffices."""
    out = None
    for mode, rk in (("low", "rank_asc"), ("high", "rank_desc")):
        per_cls = ranked.groupBy(y).agg(F.max(rk).alias("mr"))
        g = per_cls.select("mr", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
        cut = F.floor(F.col("bin") * n / F.lit(float(bins)))
        t = (g.groupBy("bin").agg(F.sum((F.col("mr") >= cut).cast("int")).alias("n_classes"))
             .select(F.lit(mode).alias("mode"), F.col("bin").cast("int"),
                     (F.lit(n) - cut).cast("bigint").alias("n_rows"), F.col("n_classes").cast("int")))
        out = t if out is None else out.unionByName(t)
    return out


@register("removal_subsets", sql=f"""WITH {NOISY_SCORED_SQL}, {_RANKS_SQL},
c AS (SELECT count(*) AS n FROM rk), b AS (SELECT CAST(bin AS INTEGER) AS bin FROM range(0, {NUM_BINS}) t(bin)),
m AS (SELECT 'low' AS mode, r.rank_asc AS rr, r.y FROM rk r UNION ALL SELECT 'high' AS mode, r.rank_desc AS rr, r.y FROM rk r)
SELECT m.mode, b.bin, CAST(c.n - floor(b.bin * c.n / {float(NUM_BINS)}) AS BIGINT) AS n_rows,
CAST(count(DISTINCT m.y) AS INTEGER) AS n_classes
FROM b CROSS JOIN c JOIN m ON m.rr >= floor(b.bin * c.n / {float(NUM_BINS)}) GROUP BY m.mode, b.bin, c.n""")
def removal_subsets(spark, sf_dir):
    r = _ranked(spark, sf_dir)
    return removal_subsets_table(r, r.count())


def curve_from_bins(ranked, n: int, metric_cols: dict, bins: int = NUM_BINS):
    """Deterministic removal curve: for each mode and bin, the mean of each 0/1 metric
    column over the rows left. Rows are counted per first bin, then suffix sums over
    the (bins)-row table give every subset without materialising any of them."""
    from pyspark.sql import Window
    out = None
    for mode, rk in (("low", "rank_asc"), ("high", "rank_desc")):
        per = ranked.groupBy(bin_of_rank(F.col(rk), n, bins).alias("b0")).agg(
            F.count(F.lit(1)).alias("c"), *[F.sum(e).alias(k) for k, e in metric_cols.items()])
        w = Window.orderBy(F.col("b0").desc()).rowsBetween(Window.unboundedPreceding, 0)  # bins rows
        suf = per.select("b0", F.sum("c").over(w).alias("c"), *[F.sum(k).over(w).alias(k) for k in metric_cols])
        t = suf.select(F.lit(mode).alias("mode"), F.col("b0").cast("int").alias("bin"),
                       *[(F.col(k) / F.col("c")).alias(k) for k in metric_cols])
        out = t if out is None else out.unionByName(t)
    return out


def best_bin_of(curve, valid: str = "valid_metric", test: str = "test_metric", minimize: bool = False):
    """Row with the best validation metric (first in curve order on ties)."""
    idx = F.when(F.col("mode") == "low", 0).otherwise(NUM_BINS) + F.col("bin")
    key = F.col(valid).asc() if minimize else F.col(valid).desc()
    return curve.withColumn("_i", idx).orderBy(key, F.col("_i")).limit(1).drop("_i")


@register("best_bin", sql=f"""WITH {NOISY_SCORED_SQL}, {_RANKS_SQL},
x AS (SELECT *, CAST(list_position(p, list_max(p)) - 1 = y AS DOUBLE) AS ok_v, CAST(list_position(p, list_max(p)) - 1 = y_clean AS DOUBLE) AS ok_t FROM rk),
cv AS (SELECT 'low' AS mode, CAST(b.bin AS INTEGER) AS bin, avg(ok_v) AS valid_metric, avg(ok_t) AS test_metric, 0 AS m
       FROM range(0, {NUM_BINS}) b(bin), x WHERE floor(((x.rank_asc + 1) * {NUM_BINS} - 1) / x.n) >= b.bin GROUP BY b.bin
       UNION ALL
       SELECT 'high' AS mode, CAST(b.bin AS INTEGER) AS bin, avg(ok_v), avg(ok_t), 1 AS m
       FROM range(0, {NUM_BINS}) b(bin), x WHERE floor(((x.rank_desc + 1) * {NUM_BINS} - 1) / x.n) >= b.bin GROUP BY b.bin)
SELECT mode, bin, round(valid_metric, 6) AS valid_metric, round(test_metric, 6) AS test_metric FROM cv
ORDER BY valid_metric DESC, m * {NUM_BINS} + bin LIMIT 1""")
def best_bin(spark, sf_dir):
    r = _ranked(spark, sf_dir)
    n = r.count()
    pred = argmax_index(F.col("p"))
    curve = curve_from_bins(r, n, {"valid_metric": (pred == F.col("y")).cast("double"),
                                   "test_metric": (pred == F.col("y_clean")).cast("double")})
    b = best_bin_of(curve)
    return b.select("mode", "bin", F.round("valid_metric", 6).alias("valid_metric"),
                    F.round("test_metric", 6).alias("test_metric"))
