"""Catalogue: the regression task with all columns of ``domain_value`` as inputs. Ridge
regression from Gram matrices, its removal curve, and the valuer with the regression reward.

The SQL twins add up the same Gram matrix and solve it by elimination."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ..functions.rules import NUM_BINS
from ..operators import least_squares as LS
from ..session import stored
from . import valuation as VA
from .cat_tabular import DOMAIN_SQL, SEGMENTS, domain_value
from .cat_values import _CURVE_OUT, _MAE, _RMSPE, ITERATIONS, _rounded
from .registry import register

NATIONS = 25     # nation keys are 0..24
PENALTY = 1.0
TARGET_UNIT = 1000.0  # prices in thousands keep the sums well scaled
NAMES = ["acctbal", *[f"seg_{s}" for s in SEGMENTS], *[f"nation_{k}" for k in range(NATIONS)]]
D = len(NAMES)


def inputs(df):
    """``(row_id, y, split, x)``: balance in thousands, one-hot segment, one-hot nation."""
    x = [F.col("c_acctbal") / 1000.0, *[F.col(f"seg_{s}").cast("double") for s in SEGMENTS],
         *[F.coalesce((F.col("c_nationkey") == k).cast("double"), F.lit(0.0)) for k in range(NATIONS)]]
    return df.select("row_id", (F.col("y") / TARGET_UNIT).alias("y"), "split", F.array(*x).alias("x"))


def _task(spark, sf_dir):
    t = stored(inputs(domain_value(spark, sf_dir)), "price-task")
    return [t.filter(F.col("split") == s).drop("split") for s in ("source", "valid", "rest")]


_X_SQL = "[" + ", ".join(["c_acctbal / 1000.0", *[f"CAST(seg_{s} AS DOUBLE)" for s in SEGMENTS],
                          *[f"coalesce(CAST(c_nationkey = {k} AS DOUBLE), 0.0)" for k in range(NATIONS)], "1.0"]) + "]"
_TASK_SQL = f"{DOMAIN_SQL}, tk AS (SELECT row_id, y / {TARGET_UNIT} AS y, split, {_X_SQL} AS x FROM dv)"


def gram_sql(name: str, rows: str, key: str = "0") -> str:
    """CTEs ``{name}_g (key, i, j, s)`` with the sums of x_i * x_j, j = D + 2 for x_i * y."""
    return f"""{name}_e AS (SELECT {key} AS key, unnest(range(1, {D + 2})) AS i, x, y FROM {rows}),
{name}_f AS (SELECT key, i, x[i] AS xi, unnest(range(1, {D + 3})) AS j, list_append(x, y) AS xy FROM {name}_e WHERE x[i] <> 0),
{name}_h AS (SELECT key, i, j, sum(xi * xy[j]) AS s FROM {name}_f GROUP BY 1, 2, 3),
{name}_g AS (SELECT k.key, i.i, j.j, coalesce(h.s, 0.0) AS s FROM (SELECT DISTINCT key FROM {name}_h) k, range(1, {D + 2}) i(i), range(1, {D + 3}) j(j)
  LEFT JOIN {name}_h h ON h.key = k.key AND h.i = i.i AND h.j = j.j)"""


def solve_sql(name: str) -> str:
    """CTE ``{name}_w (key, w)``: Gauss-Jordan elimination of the ridge system (positive
    definite, so pivots need no exchange)."""
    return f"""{name}_r AS (SELECT key, i, list(s + CASE WHEN i = j AND i <= {D} THEN {PENALTY} ELSE 0.0 END ORDER BY j) AS r FROM {name}_g GROUP BY key, i),
{name}_j(key, k, m) AS (SELECT key, 1, list(r ORDER BY i) FROM {name}_r GROUP BY key
  UNION ALL SELECT key, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda v: v / r[k])
    ELSE list_transform(r, lambda v, c: v - r[k] * m[k][c] / m[k][k]) END) FROM {name}_j WHERE k <= {D + 1}),
{name}_w AS (SELECT key, list_transform(m, lambda r: r[{D + 2}]) AS w FROM {name}_j WHERE k = {D + 2})"""


@register("gram_matrix", sql=f"""WITH {_TASK_SQL}, src AS (SELECT * FROM tk WHERE split = 'source'), {gram_sql('a', 'src')}
SELECT CAST(i - 1 AS INTEGER) AS i, CAST(j - 1 AS INTEGER) AS j, round(s, 3) AS s FROM a_g""")
def gram_matrix(spark, sf_dir):
    """X'X and, as the last column, X'y of the source rows (the last input is one)."""
    gram, moment, _ = LS.gram_statistics(_task(spark, sf_dir)[0], D)
    rows = [(i, j, round(float(v), 3)) for i in range(D + 1) for j, v in enumerate([*gram[0][i], moment[0][i]])]
    return spark.createDataFrame(rows, "i int, j int, s double")


@register("linear_fit", sql=f"""WITH RECURSIVE {_TASK_SQL}, src AS (SELECT * FROM tk WHERE split = 'source'), {gram_sql('a', 'src')}, {solve_sql('a')}
SELECT CAST(generate_subscripts(w, 1) - 1 AS INTEGER) AS i, round(unnest(w), 5) AS w FROM a_w""")
def linear_fit(spark, sf_dir):
    """Coefficients of the price model; the intercept is the last."""
    m = LS.LinearModels.of(*LS.gram_statistics(_task(spark, sf_dir)[0], D), PENALTY)
    return spark.createDataFrame([(i, round(float(v), 5)) for i, v in enumerate(m.theta[0])], "i int, w double")


_PRED = f"list_dot_product(x[1:{D + 1}], w)"


@register("linear_diff", sql=f"""WITH RECURSIVE {_TASK_SQL}, va AS (SELECT * FROM tk WHERE split = 'valid'), {gram_sql('v', 'va')}, {solve_sql('v')}
SELECT row_id, round({_PRED}, 4) AS pred, round(abs(y - {_PRED}) / abs(y), 5) AS d FROM tk, v_w WHERE split = 'source'""")
def linear_diff(spark, sf_dir):
    """Every source row's prediction by the validation rows' model and its relative
    difference |y - p| / |y|."""
    source, valid, _ = _task(spark, sf_dir)
    s = LS.linear_predict(source, LS.LinearModels.of(*LS.gram_statistics(valid, D), PENALTY))
    return s.select("row_id", F.round("pred", 4).alias("pred"), F.round(VA.relative_diff(F.col("y"), F.col("pred")), 5).alias("d"))


def _curve_sql(perf: str) -> str:
    return f"""{_TASK_SQL}, va AS (SELECT * FROM tk WHERE split = 'valid'), {gram_sql('v', 'va')}, {solve_sql('v')},
vl AS (SELECT row_id, x, y, round(1 / (1 + abs(y - {_PRED}) / abs(y)), 7) AS data_value FROM tk, v_w WHERE split = 'source'),
rk AS (SELECT *, row_number() OVER (ORDER BY data_value, row_id) - 1 AS r, count(*) OVER () AS n FROM vl),
bn AS (SELECT 'low' AS mode, x, y, floor(((r + 1) * {NUM_BINS} - 1) / n) AS b FROM rk
       UNION ALL SELECT 'high' AS mode, x, y, floor(((n - r) * {NUM_BINS} - 1) / n) AS b FROM rk),
cl AS (SELECT mode || CAST(b AS INTEGER) AS key, mode, CAST(b AS INTEGER) AS b, x, y FROM bn), {gram_sql('c', 'cl', 'key')},
cb AS (SELECT DISTINCT key, mode, b FROM cl), kn AS (SELECT key, count(*) AS n FROM cl GROUP BY key),
gb AS (SELECT CAST(bin AS INTEGER) AS bin FROM range(0, {NUM_BINS}) t(bin)),
m_g AS (SELECT cb.mode || ':' || gb.bin AS key, g.i, g.j, sum(g.s) AS s FROM c_g g JOIN cb ON cb.key = g.key JOIN gb ON cb.b >= gb.bin GROUP BY 1, 2, 3),
m_n AS (SELECT cb.mode, gb.bin, sum(kn.n) AS n FROM cb JOIN kn ON kn.key = cb.key JOIN gb ON cb.b >= gb.bin GROUP BY 1, 2),
{solve_sql('m')},
ev AS (SELECT x, y, split = 'valid' AS is_valid FROM tk WHERE split <> 'source'),
pr AS (SELECT m.key, e.y, {_PRED} AS p, part FROM ev e, m_w m, (VALUES ('valid'), ('test')) t(part) WHERE part = 'test' OR e.is_valid),
sc AS (SELECT key, {", ".join(f"{perf.format(x)} AS {x}_metric" for x in ("valid", "test"))} FROM pr GROUP BY key),
cur AS (SELECT m_n.mode, m_n.bin, CAST(m_n.n AS BIGINT) AS n_rows, valid_metric, test_metric FROM sc JOIN m_n ON sc.key = m_n.mode || ':' || m_n.bin)"""


def _curve(spark, sf_dir, perf: str):
    source, valid, rest = _task(spark, sf_dir)
    ref = LS.LinearModels.of(*LS.gram_statistics(valid, D), PENALTY)
    d = VA.relative_diff(F.col("y"), F.col("pred"))
    values = LS.linear_predict(source, ref).select("row_id", F.round(F.coalesce(F.lit(1.0) / (F.lit(1.0) + d), F.lit(0.0)), 7).alias("data_value"))
    evals = valid.withColumn("part", F.lit("valid")).unionByName(valid.unionByName(rest).withColumn("part", F.lit("test")))
    return _rounded(VA.linear_curve(source, evals, values, D, perf, PENALTY), 4)


@register("linear_curve", sql=f"WITH RECURSIVE {_curve_sql(_RMSPE)} {_CURVE_OUT.format(t='cur').replace(', 6)', ', 4)')}")
def linear_curve(spark, sf_dir):
    """The removal curve of the linear price model: 40 models from the Gram matrices of 20
    bins, rmspe on the validation rows and on all rows that are not training rows."""
    return _curve(spark, sf_dir, "rmspe")


@register("linear_best", sql=f"""WITH RECURSIVE {_curve_sql(_MAE)}, best AS ({_CURVE_OUT.format(t='cur').replace(', 6)', ', 4)')})
SELECT * FROM best ORDER BY valid_metric, CASE mode WHEN 'low' THEN 0 ELSE {NUM_BINS} END + bin LIMIT 1""")
def linear_best(spark, sf_dir):
    """The bin with the least validation mae."""
    return VA.learn_with_values(_curve(spark, sf_dir, "mae"), minimize=True)


def price_data(spark, sf_dir) -> VA.TaskData:
    """The price task for the valuer: one output, inputs as a vector."""
    train, valid, rest = (t.select("row_id", "y", array_to_vector("x").alias("features")) for t in _task(spark, sf_dir))
    return VA.TaskData(train, valid, valid.unionByName(rest), 1, D, None)


@register("regression_valuer")
def regression_valuer(spark, sf_dir, iterations: int = ITERATIONS):
    """Row values of the price task from the trained valuer: targets and |y - p| / |y| are its
    inputs, ridge regression on the selected rows is the predictor, and the reward is the fall
    of the validation rmspe. Training goes on from stored state (see ``train_valuer``)."""
    tr = VA.ValuerTrainer(price_data(spark, sf_dir), perf="rmspe", moving_baseline=0.9, resume=True)
    return tr.train(iterations).values()
