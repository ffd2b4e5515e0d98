"""Catalogue: models (M1-M9), evaluation (V1-V8), search (H1s-H4s),
explanations (B1, B3-B6), scoring (L5) and file round trips (S1-S5).

Queries whose oracle needs no fitted model use a fixed linear predictor
(``y_pred = 20000 + 1000 * time``); OLS fits are checked against their
closed form in SQL.
"""

from __future__ import annotations

import uuid
from statistics import NormalDist

from pyspark.sql import functions as F

from ..operators.model import cv, explain, metrics
from ..operators.model.estimators import (assemble, coefficients_table, make_estimator,
                                          nominal_sizes)
from ..plans import config as C
from ..plans.layers import fit_gold, gold_base, silver_transform
from ..plans.scoring import ScoringBundle, score
from ..session import checkpoint, ensure_checkpoint_dir, write_table
from ..sources import readers, sinks
from ..sources.tables import flights, raw_flights
from ..streaming.scoring import files_per_trigger, read_scored, score_stream, stage_files
from .base import BAYES_RIDGE_SQL, TIE, r, register, with_flights

B0, B1 = 20000.0, 1000.0
_PRED_SQL = f"{B0} + {B1} * time"


def _fixed_pred(spark, sf):
    f = flights(spark, sf)
    return f.withColumn("y_true", F.col("price")).withColumn(
        "y_pred", F.lit(B0) + F.lit(B1) * F.col("time"))


_ROUND = {"r2": 6, "rmse": 4, "mae": 4, "mse": 1, "median_ae": 4, "max_error": 4}


def _metric_sql(y, p, src, by="", rounded=True):
    e = f"({y} - ({p}))"
    g = f"{by}, " if by else ""
    exprs = {"r2": f"1 - sum({e} * {e}) / (count(*) * var_pop({y}))",
             "rmse": f"sqrt(avg({e} * {e}))", "mae": f"avg(abs({e}))", "mse": f"avg({e} * {e})",
             "median_ae": f"quantile_cont(abs({e}), 0.5)", "max_error": f"max(abs({e}))"}
    cols = ", ".join((f"ROUND({x}, {_ROUND[k]}) AS {k}" if rounded else f"{x} AS {k}")
                     for k, x in exprs.items())
    return f"SELECT {g}{cols} FROM {src}" + (f" GROUP BY {by}" if by else "")


def _round_metrics(df, by=()):
    return df.select(*by, *[r(c, d) for c, d in _ROUND.items()])


# --- M1 / V6 -----------------------------------------------------------------

_OLS2 = """
SELECT name AS feature, ROUND(val, 3) AS value FROM (
  SELECT (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1,
         (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2, my, m1, m2
  FROM (SELECT var_pop(time) AS s11, var_pop(distance) AS s22, covar_pop(time, distance) AS s12,
               covar_pop(time, price) AS s1y, covar_pop(distance, price) AS s2y,
               avg(price) AS my, avg(time) AS m1, avg(distance) AS m2 FROM flights)) c,
  LATERAL (VALUES ('intercept', my - b1 * m1 - b2 * m2), ('time', b1), ('distance', b2)) t(name, val)
"""


@register("linreg_coef", "M1 V6", with_flights(_OLS2))
def q_linreg(spark, sf):
    f = assemble(flights(spark, sf), ["time", "distance"])
    m = make_estimator("LinearRegression", {}, label="price").fit(f)
    t = coefficients_table(spark, m, ["time", "distance"])
    return t.select("feature", r("value", 3))


# With both coefficients away from zero the l1 penalty only shifts the
# covariances by its sign.
_TWO_FEATURES_SQL = """
SELECT model, feature, ROUND(value, 2) AS value FROM (
  SELECT model, my - b1 * m1 - b2 * m2 AS b0, b1, b2 FROM (
    SELECT *, ((s22 + l2) * t1 - s12 * t2) / ((s11 + l2) * (s22 + l2) - s12 * s12) AS b1,
           ((s11 + l2) * t2 - s12 * t1) / ((s11 + l2) * (s22 + l2) - s12 * s12) AS b2 FROM (
      SELECT *, c1 - l1 * sign(s22 * c1 - s12 * c2) AS t1, c2 - l1 * sign(s11 * c2 - s12 * c1) AS t2 FROM (
        SELECT var_pop(time) AS s11, var_pop(distance) AS s22, covar_pop(time, distance) AS s12,
               covar_pop(time, price) AS c1, covar_pop(distance, price) AS c2, avg(price) AS my, avg(time) AS m1,
               avg(distance) AS m2, count(*) AS n FROM flights),
        LATERAL (VALUES ('Ridge', 0.0, 1000.0 / n), ('Lasso', 10.0, 0.0), ('ElasticNet', 5.0, 5.0),
                        ('SGDRegressor', 0.0, 0.0001)) v(model, l1, l2)))) x,
  LATERAL (VALUES ('intercept', b0), ('time', b1), ('distance', b2)) w(feature, value)
"""


@register("penalized_coef", "M2 M3 M4 M5", with_flights(_TWO_FEATURES_SQL))
def q_penalized(spark, sf):
    """Ridge / Lasso / ElasticNet / SGD(l2) coefficients on the same inputs
    (penalties translated to MLlib's parameterisation)."""
    # every fit reads the rows several times: join once, keep what they use
    f = assemble(write_table(flights(spark, sf).select("time", "distance", "price"), "fit_rows"), ["time", "distance"])
    out = None
    for name, p in [("Ridge", {"alpha": 1000.0}), ("Lasso", {"alpha": 10.0}),
                    ("ElasticNet", {"alpha": 10.0, "l1_ratio": 0.5}),
                    ("SGDRegressor", {"alpha": 0.0001})]:
        m = make_estimator(name, {**p, "tol": 1e-13, "max_iter": 1000}, label="price", train=f).fit(f)
        t = coefficients_table(spark, m, ["time", "distance"]).withColumn("model", F.lit(name))
        out = t if out is None else out.unionByName(t)
    return out.select("model", "feature", r("value", 2).alias("value"))


_ONE_FEATURE_SQL = """
SELECT m.model, m.feature, ROUND(CASE WHEN m.feature = 'intercept' THEN my - b * mx ELSE b END, 2) AS value
FROM (SELECT *, CASE model
        WHEN 'Ridge' THEN cxy * n / (vx * n + 1000.0)
        WHEN 'Lasso' THEN sign(cxy) * greatest(abs(cxy) - 10.0, 0.0) / vx
        WHEN 'SGDRegressor' THEN cxy / (vx + 0.5)
        ELSE sign(cxy) * greatest(abs(cxy) - 5.0, 0.0) / (vx + 5.0) END AS b
      FROM (SELECT covar_pop(price, time) AS cxy, var_pop(time) AS vx, avg(price) AS my, avg(time) AS mx,
                   count(*) AS n FROM flights),
           (VALUES ('Ridge'), ('Lasso'), ('ElasticNet'), ('SGDRegressor')) t(model)) m0,
     LATERAL (SELECT m0.model AS model, m0.b AS b, unnest(['intercept', 'time']) AS feature) m
"""


@register("penalized_one_feature", "M2 M3 M4 M5", with_flights(_ONE_FEATURE_SQL.replace("b * mx", "m.b * mx").replace(
    "ELSE b END", "ELSE m.b END")))
def q_penalized_one(spark, sf):
    """Ridge, lasso, elastic net and SGD with an l2 penalty on one feature,
    where the optimum has a closed form."""
    # every fit reads the rows several times: join once, keep what they use
    f = assemble(write_table(flights(spark, sf).select("time", "price"), "fit_rows"), ["time"])
    out = None
    for name, p in [("Ridge", {"alpha": 1000.0}), ("Lasso", {"alpha": 10.0}),
                    ("ElasticNet", {"alpha": 10.0, "l1_ratio": 0.5}), ("SGDRegressor", {"alpha": 0.5})]:
        m = make_estimator(name, {**p, "tol": 1e-12, "max_iter": 500}, label="price", train=f).fit(f)
        t = coefficients_table(spark, m, ["time"]).withColumn("model", F.lit(name))
        out = t if out is None else out.unionByName(t)
    return out.select("model", "feature", r("value", 2).alias("value"))


@register("metrics_constant_label", "V1", with_flights(
    "SELECT 0.0::DOUBLE AS r2, ROUND(sqrt(avg((price - 100.0) * (price - 100.0))), 4) AS rmse, "
    "ROUND(avg(abs(price - 100.0)), 4) AS mae FROM flights"))
def q_metrics_constant(spark, sf):
    f = flights(spark, sf).select(F.lit(100.0).alias("y_true"), F.col("price").alias("y_pred"))
    return metrics.regression_metrics(f).select("r2", r("rmse", 4).alias("rmse"), r("mae", 4).alias("mae"))


# --- V1, V7, V8 --------------------------------------------------------------

@register("metrics", "V1", with_flights(_metric_sql("price", _PRED_SQL, "flights")))
def q_metrics(spark, sf):
    return _round_metrics(metrics.regression_metrics(_fixed_pred(spark, sf)))


_QQ_POINTS = 20
_QQ_ROWS = ", ".join(
    f"({i + 1}, {(i + 0.5) / _QQ_POINTS!r}, {NormalDist().inv_cdf((i + 0.5) / _QQ_POINTS)!r})"
    for i in range(_QQ_POINTS))


@register("qq_table", "V7", with_flights(
    f"SELECT CAST(t.i AS INTEGER) AS i, ROUND(CAST(t.prob AS DOUBLE), 6) AS prob, "
    f"ROUND(CAST(t.th AS DOUBLE), 6) AS theoretical, "
    f"ROUND(q.sample, 6) AS sample FROM (VALUES {_QQ_ROWS}) t(i, prob, th) JOIN "
    f"(SELECT unnest(range(1, {_QQ_POINTS + 1})) AS i, unnest(qs) AS sample FROM "
    f"(SELECT quantile_cont(price - ({_PRED_SQL}), "
    f"[{', '.join(repr((i + 0.5) / _QQ_POINTS) for i in range(_QQ_POINTS))}]) AS qs FROM flights)) q "
    f"ON q.i = t.i"))
def q_qq(spark, sf):
    d = _fixed_pred(spark, sf).withColumn("residual", F.col("y_true") - F.col("y_pred"))
    q = metrics.qq_table(d, "residual", _QQ_POINTS)
    return q.select("i", r("prob"), r("theoretical"), r("sample"))


@register("residual_bins", "V8", with_flights(
    f"SELECT CAST(s.bin AS INTEGER) AS bin, count(x.bin) AS count, ROUND(avg(price - p), 4) AS "
    f"mean_residual, ROUND(avg(price), 4) AS mean_actual, ROUND(avg(p), 4) AS mean_predicted "
    f"FROM (SELECT unnest(range(1, 21)) AS bin) s LEFT JOIN (SELECT price, p, least(CAST(floor(20.0 * (p - lo) / (hi - lo)) AS BIGINT) + 1, 20) AS bin "
    f"FROM (SELECT price, {_PRED_SQL} AS p FROM flights) x, "
    f"(SELECT min({_PRED_SQL}) AS lo, max({_PRED_SQL}) AS hi FROM flights) m) x USING (bin) GROUP BY s.bin"))
def q_residual_bins(spark, sf):
    b = metrics.residual_bins(_fixed_pred(spark, sf), "y_true", "y_pred", 20)
    return b.select("bin", "count", r("mean_residual", 4), r("mean_actual", 4),
                    r("mean_predicted", 4))


@register("residual_sample", "V8 O3", with_flights(
    f"SELECT {TIE}, ROUND({_PRED_SQL}, 4) AS y_pred, ROUND(price - ({_PRED_SQL}), 4) AS residual FROM flights ORDER BY "
    f"md5(concat_ws('|', {TIE}, 7)), {TIE} LIMIT 500"))
def q_residual_sample(spark, sf):
    s = metrics.residual_sample(_fixed_pred(spark, sf), 500, 7, C.TIE_KEY)
    return s.select(*C.TIE_KEY, r("y_pred", 4), r("residual", 4))


# --- V3 / V4 -----------------------------------------------------------------

_CV_SQL_CTE = f"""
p AS (SELECT time, price, row_number() OVER (ORDER BY date, {TIE}) - 1 AS pos FROM flights),
fo AS (SELECT i AS fold, n - (5 - i) * (n // 6) AS test_start, n - (5 - i) * (n // 6) + (n // 6) AS test_end
       FROM (SELECT count(*) AS n FROM flights), range(5) t(i)),
fit AS (SELECT fo.fold, covar_pop(time, price) / var_pop(time) AS b,
               avg(price) - covar_pop(time, price) / var_pop(time) * avg(time) AS a
        FROM p JOIN fo ON p.pos < fo.test_start GROUP BY fo.fold),
pred AS (SELECT fo.fold, p.price, fit.a + fit.b * p.time AS yhat
         FROM p JOIN fo ON p.pos >= fo.test_start AND p.pos < fo.test_end
         JOIN fit ON fit.fold = fo.fold)"""


def _cv_metrics(spark, sf):
    f = flights(spark, sf)
    ordered, n = cv.ordered_frame(f, "date", C.TIE_KEY, ["time"], "price", prune=False)
    return cv.time_cv_metrics(ordered, n, "LinearRegression", {}, ["time"], "price", 5,
                              parallelism=4)


@register("cv_metrics", "V3 T3 M9", with_flights(
    "SELECT CAST(fold AS INTEGER) AS fold, " + _metric_sql("price", "yhat", "pred", "fold")
    .replace("SELECT fold, ", ""), extra=_CV_SQL_CTE))
def q_cv(spark, sf):
    return _round_metrics(_cv_metrics(spark, sf), ["fold"])


_SCALES_CTE = _CV_SQL_CTE.replace(
    "p AS (SELECT time, price, row_number()",
    "u AS (SELECT avg(ln(1 + price)) AS m, stddev_samp(ln(1 + price)) AS s FROM flights),\n"
    "p AS (SELECT time, (ln(1 + price) - (SELECT m FROM u)) / (SELECT s FROM u) AS price, row_number()") + """,
two_scales AS (SELECT fold, 'scaled' AS scale, price AS y, yhat FROM pred UNION ALL
         SELECT fold, 'unscaled', exp(price * s + m) - 1, exp(yhat * s + m) - 1 FROM pred, u)"""


@register("cv_metrics_scales", "V3 V2 S9", with_flights(
    "SELECT CAST(fold AS INTEGER) AS fold, scale, " + _metric_sql("y", "yhat", "two_scales", "fold, scale")
    .replace("SELECT fold, scale, ", ""), extra=_SCALES_CTE))
def q_cv_scales(spark, sf):
    """Folds of a log-transformed, standard-scaled target: metrics as the
    model sees it and in price units, written and read back."""
    from ..operators.fitted.power import fit_power
    from ..operators.fitted.scaler import fit_scaler
    f = flights(spark, sf).select("date", *C.TIE_KEY, "time", "price")
    pw = fit_power(f, ["price"], "log")
    sc = fit_scaler(pw.transform(f), ["price"], "standard")
    ordered, n = cv.ordered_frame(sc.transform(pw.transform(f)), "date", C.TIE_KEY, ["time"], "price", prune=False)
    met = cv.time_cv_metrics(ordered, n, "LinearRegression", {}, ["time"], "price", 5, scaler=sc, power=pw)
    path = _staging(spark, "cv_metrics")
    sinks.write_metrics(met, path)
    return _round_metrics(spark.read.parquet(path), ["fold", "scale"])


@register("cv_summary", "V4", with_flights(
    "SELECT metric, ROUND(avg(v), 4) AS mean, ROUND(stddev_samp(v), 4) AS std FROM (" +
    " UNION ALL ".join(
        f"SELECT '{m}' AS metric, {m} AS v FROM "
        f"({_metric_sql('price', 'yhat', 'pred', 'fold', rounded=False)})"
        for m in metrics.METRICS) + ") GROUP BY metric", extra=_CV_SQL_CTE))
def q_cv_summary(spark, sf):
    s = metrics.summarize(_cv_metrics(spark, sf))
    return s.select("metric", r("mean", 4), r("std", 4))


# --- M6 / M7 / M8 / V5 -------------------------------------------------------

def _gold_split(spark, sf, raw=None):
    """The gold chain and its training and evaluation rows.  The training rows
    are deduplicated once, for the fits of the chain and for the model, and
    written as the model reads them, which it does many times."""
    s = silver_transform(raw_flights(spark, sf) if raw is None else raw, keep_tie_key=False)
    d = F.col("date")
    base = gold_base(s.where(d < F.lit("1999-01-01").cast("date")))
    test = s.where(d >= F.lit("1999-01-01").cast("date"))
    gm = fit_gold(base, is_tree_model=True, prepared=True)
    feats = [c for c in gm.final_columns if c != C.TARGET and c not in C.MULTICOLLINEAR_DROP]
    cut = lambda df: df.select(*feats, C.TARGET)
    return gm, feats, write_table(cut(gm.transform(base, prepared=True)), "gold_train"), cut(gm.transform(test))


def _tree_eval(spark, sf, name, params, categorical=False):
    gm, feats, tr, te = _gold_split(spark, sf)
    nominal = nominal_sizes(gm.encoder, feats) if categorical else None
    model = make_estimator(name, params, label=C.TARGET, nominal=nominal).fit(
        assemble(tr, feats, nominal=nominal))
    # the metrics read the predictions twice
    pred = write_table(model.transform(assemble(te, feats, nominal=nominal)).select(
        F.col(C.TARGET).alias("y_true"), F.col("prediction").alias("y_pred")), "predictions")
    met = metrics.regression_metrics(pred)
    imp = coefficients_table(spark, model, feats)
    return met, imp


@register("rf_predict", "M6 V5 V6")
def q_rf(spark, sf):
    met, _ = _tree_eval(spark, sf, "RandomForestRegressor",
                        {"n_estimators": 20, "max_depth": 6, "random_state": 42})
    return _round_metrics(met)


@register("gbt_predict", "M7 M8 V5")
def q_gbt(spark, sf):
    met, _ = _tree_eval(spark, sf, "LGBMRegressor",
                        {"n_estimators": 20, "learning_rate": 0.1, "max_depth": 5,
                         "random_state": 42}, categorical=True)
    return _round_metrics(met)


@register("feature_importance_top", "V6 O2")
def q_importance(spark, sf):
    _, imp = _tree_eval(spark, sf, "RandomForestRegressor",
                        {"n_estimators": 20, "max_depth": 6, "random_state": 42})
    return imp.orderBy(F.col("value").desc(), "feature").limit(15)


# --- H1s-H4s -----------------------------------------------------------------

def _search_frame(spark, sf, prune):
    f = flights(spark, sf)
    return cv.ordered_frame(f, "date", C.TIE_KEY, ["time", "distance"], "price", prune)


_ALPHAS = [0.1, 100.0, 100000.0]


def _trials_sql(rung: int, rows: str, points: str) -> str:
    """CTEs ``t{rung}``: trials of ridge on time and distance over the first
    ``rows`` rows, three folds, for the penalties of ``points``."""
    return f"""
n{rung} AS (SELECT {rows} AS n FROM (SELECT count(*) AS n FROM flights)),
f{rung} AS (SELECT i AS fold, n - (3 - i) * (n // 4) AS lo, n - (3 - i) * (n // 4) + n // 4 AS hi FROM n{rung}, range(3) r(i)),
c{rung} AS (SELECT fold, any_value(lo) AS lo, any_value(hi) AS hi, count(*) AS k, var_pop(time) AS s11, var_pop(distance) AS s22,
       covar_pop(time, distance) AS s12, covar_pop(time, price) AS s1y, covar_pop(distance, price) AS s2y,
       avg(price) AS my, avg(time) AS m1, avg(distance) AS m2 FROM p JOIN f{rung} ON pos < lo GROUP BY fold),
b{rung} AS (SELECT *, ((s22 + alpha / k) * s1y - s12 * s2y) / ((s11 + alpha / k) * (s22 + alpha / k) - s12 * s12) AS b1,
       ((s11 + alpha / k) * s2y - s12 * s1y) / ((s11 + alpha / k) * (s22 + alpha / k) - s12 * s12) AS b2
       FROM c{rung}, ({points})),
e{rung} AS (SELECT trial, any_value(alpha) AS alpha, fold,
       sqrt(avg((price - my - b1 * (time - m1) - b2 * (distance - m2)) ** 2)) AS rmse
       FROM p JOIN b{rung} ON pos >= lo AND pos < hi GROUP BY trial, fold),
t{rung} AS (SELECT trial, alpha, {rung} AS rung, (SELECT n FROM n{rung}) AS n_rows, avg(rmse) AS mean_score,
       stddev_samp(rmse) AS std_score, row_number() OVER (ORDER BY avg(rmse), trial) AS rank
       FROM (SELECT trial, alpha, rmse FROM e{rung}) GROUP BY trial, alpha)"""


_TRIALS_P = f"p AS (SELECT time, distance, price, row_number() OVER (ORDER BY date, {TIE}) - 1 AS pos FROM flights),"
_POINTS = "SELECT * FROM (VALUES " + ", ".join(f"({i}, {a})" for i, a in enumerate(_ALPHAS)) + ") v(trial, alpha)"
_PARAMS = "CASE trial " + " ".join(f"WHEN {i} THEN '{{\"alpha\": {a}}}'" for i, a in enumerate(_ALPHAS)) + " END AS params"
_TRIALS_OUT = (f"SELECT CAST(trial AS INTEGER) AS trial, {_PARAMS}, CAST(rung AS INTEGER) AS rung, n_rows, 'rmse' AS metric, "
               "ROUND(mean_score, 4) AS mean_score, ROUND(std_score, 4) AS std_score, CAST(rank AS INTEGER) AS rank FROM ")


def _trials(spark, found):
    """The trial table, written and read back."""
    path = _staging(spark, "trials")
    sinks.write_metrics(found, path)
    return spark.read.parquet(path).select("trial", "params", "rung", "n_rows", "metric", r("mean_score", 4),
                                           r("std_score", 4), "rank")


@register("grid_trials", "H1s H4s S9", with_flights(
    _TRIALS_OUT + "t0", extra=_TRIALS_P + _trials_sql(0, "n", _POINTS)))
def q_grid(spark, sf):
    o, n = _search_frame(spark, sf, False)
    return _trials(spark, cv.search(o, n, "Ridge", cv.grid_points({"alpha": _ALPHAS}), ["time", "distance"], "price",
                                    n_splits=3))


@register("random_trials", "H2s H4s")
def q_random(spark, sf):
    o, n = _search_frame(spark, sf, True)
    pts = cv.random_points({"n_estimators": ("int", 5, 15), "max_depth": ("int", 2, 5)}, 3, 42,
                           {"random_state": 42})
    return cv.search(o, n, "RandomForestRegressor", pts, ["time", "distance"], "price",
                     n_splits=3)


@register("halving_trials", "H3s H4s S9", with_flights(
    f"{_TRIALS_OUT} (SELECT * FROM t0 UNION ALL SELECT * FROM t1)",
    extra=_TRIALS_P + _trials_sql(0, "n // 3", _POINTS) + "," + _trials_sql(
        1, "n", "SELECT trial, alpha FROM t0 WHERE rank = 1")))
def q_halving(spark, sf):
    o, n = _search_frame(spark, sf, False)
    return _trials(spark, cv.successive_halving(o, n, "Ridge", cv.grid_points({"alpha": _ALPHAS}), ["time", "distance"],
                                                "price", factor=3, n_splits=3))


# --- B1, B3-B6 ---------------------------------------------------------------

_COEFS = {"time": 1000.0, "distance": 20.0}


def _linear_long(spark, sf):
    f = flights(spark, sf)
    return explain.linear_contributions(f, _COEFS, C.TIE_KEY)


_LIN_SQL = " UNION ALL ".join(
    f"SELECT {TIE}, '{c}' AS feature, ROUND({b} * ({c} - (SELECT avg({c}) FROM flights)), 6) AS phi, "
    f"ROUND(CAST({c} AS DOUBLE), 6) AS value FROM flights" for c, b in _COEFS.items())


@register("linear_contrib", "B1", with_flights(_LIN_SQL))
def q_linear_contrib(spark, sf):
    return _linear_long(spark, sf).select(*C.TIE_KEY, "feature", r("phi"), r("value"))


@register("global_importance", "B5 O4", with_flights(
    "SELECT feature, ROUND(avg(abs(phi)), 6) AS mean_abs FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {b} * ({c} - (SELECT avg({c}) FROM flights)) AS phi FROM flights"
        for c, b in _COEFS.items()) + ") GROUP BY feature"))
def q_global_importance(spark, sf):
    return explain.global_importance(_linear_long(spark, sf)).select("feature", r("mean_abs"))


@register("dependence_table", "B6", with_flights(
    "SELECT ROUND(CAST(time AS DOUBLE), 6) AS value, ROUND(1000.0 * (time - (SELECT avg(time) "
    "FROM flights)), 6) AS phi FROM flights"))
def q_dependence(spark, sf):
    return explain.dependence(_linear_long(spark, sf), "time").select(r("value"), r("phi"))


_GCOEFS = {"month_sin": 100.0, "month_cos": -50.0, "day_sin": 10.0, "day_cos": 5.0,
           "time": 1000.0}
_CYC_SQL = ("c AS (SELECT *, sin(2 * pi() * month(date) / 12) AS month_sin, "
            "cos(2 * pi() * month(date) / 12) AS month_cos, sin(2 * pi() * day(date) / 31) AS day_sin, "
            "cos(2 * pi() * day(date) / 31) AS day_cos FROM flights)")


def _grp_sql(group, parts, rep):
    phi = " + ".join(f"{_GCOEFS[p]} * ({p} - (SELECT avg({p}) FROM c))" for p in parts)
    return (f"SELECT {TIE}, '{group}' AS \"group\", ROUND({phi}, 6) AS phi, "
            f"ROUND(CAST({rep} AS DOUBLE), 6) AS value FROM c")


@register("group_contrib", "B3 B4", with_flights(" UNION ALL ".join([
    _grp_sql("month", ["month_sin", "month_cos"], "month_cos"),
    _grp_sql("day", ["day_sin", "day_cos"], "day_cos"),
    _grp_sql("time", ["time"], "time")]), extra=_CYC_SQL))
def q_group_contrib(spark, sf):
    from ..functions.numeric import cyclical
    f = flights(spark, sf)
    ms, mc = cyclical(F.month("date"), 12)
    ds, dc = cyclical(F.dayofmonth("date"), 31)
    f = f.withColumns({"month_sin": ms, "month_cos": mc, "day_sin": ds, "day_cos": dc})
    g = explain.linear_contributions(f, _GCOEFS, C.TIE_KEY, groups=explain.feature_groups(list(_GCOEFS)))
    return g.select(*C.TIE_KEY, "group", r("phi"), r("value"))


_HCOEFS = {"agency_F": 30.0, "agency_O": -20.0, "agency_P": 5.0, "distance": 2.0}
_HOT_SQL = "h AS (SELECT *, " + ", ".join(
    f"CASE WHEN agency = '{a}' THEN 1.0 ELSE 0.0 END AS agency_{a}" for a in "FOP") + " FROM flights)"


def _hot_sum(parts):
    return " + ".join(f"{_HCOEFS[p]} * ({p} - (SELECT avg({p}) FROM h))" for p in parts)


@register("onehot_group_contrib", "B3 B4 E3", with_flights(
    f"SELECT {TIE}, 'agency' AS \"group\", ROUND({_hot_sum(['agency_F', 'agency_O', 'agency_P'])}, 6) AS phi, "
    f"ROUND(CAST(agency_F + agency_O + agency_P AS DOUBLE), 6) AS value FROM h UNION ALL "
    f"SELECT {TIE}, 'distance', ROUND({_hot_sum(['distance'])}, 6), ROUND(CAST(distance AS DOUBLE), 6) FROM h",
    extra=_HOT_SQL))
def q_onehot_contrib(spark, sf):
    """Contributions of one-hot columns, summed under the column that they
    come from."""
    from ..operators.fitted.encoder import fit_encoder
    f = flights(spark, sf).select(*C.TIE_KEY, "agency", "distance")
    hot = fit_encoder(f, onehot_cols=["agency"]).transform(f)
    kinds = {c: f.schema[c].dataType for c in C.TIE_KEY}
    g = explain.linear_contributions(hot, _HCOEFS, C.TIE_KEY, groups=explain.feature_groups(list(_HCOEFS), ["agency"]))
    return g.select(*[F.col(c).cast(kinds[c]).alias(c) for c in C.TIE_KEY], "group", r("phi"), r("value"))


# --- L5 ----------------------------------------------------------------------

def _bundle(spark, sf, raw=None):
    gm, feats, tr, _ = _gold_split(spark, sf, raw)
    model = make_estimator("LinearRegression", {}, label=C.TARGET).fit(assemble(tr, feats))
    return ScoringBundle(gm, model, feats, ["travel_code", "line_number", "part_key", "supp_key"])


@register("score_batch", "L5 P10 V2")
def q_score_batch(spark, sf):
    raw = write_table(raw_flights(spark, sf), "raw")        # joined once: the fit and the scoring read it
    return score(raw, _bundle(spark, sf, raw))


@register("score_stream", "L5 streaming")
def q_score_stream(spark, sf):
    """The same bundle over a file stream of the raw rows (staged once as
    Parquet under the checkpoint folder); output read back as a table."""
    base = f"{ensure_checkpoint_dir(spark)}/score_stream_{uuid.uuid4().hex}"
    source = stage_files(raw_flights(spark, sf), f"{base}/source")
    b = _bundle(spark, sf, spark.read.parquet(source))      # the staged rows serve the fit, too
    score_stream(spark, source, b, f"{base}/sink", f"{base}/chk", max_files_per_trigger=files_per_trigger(spark, source, 2))
    return read_scored(spark, f"{base}/sink")[0]


# --- S1-S5 -------------------------------------------------------------------

def _staging(spark, name):
    return f"{ensure_checkpoint_dir(spark)}/{name}_{uuid.uuid4().hex}"


@register("csv_roundtrip", "S1 S6", with_flights(
    f"SELECT {TIE}, from_location, price FROM flights"))
def q_csv(spark, sf):
    path = _staging(spark, "csv") + ".csv"
    f = flights(spark, sf).select(*C.TIE_KEY, "from_location", "price")
    f.write.option("header", True).csv(path)
    return readers.load_data(spark, path, schema=f.schema)


@register("csv_corrupt_rows", "S1", with_flights(
    f"SELECT {TIE}, travel_code % 7 = 0 OR travel_code % 7 = 1 AS rejected FROM flights"))
def q_csv_corrupt(spark, sf):
    """A file with bad rows (a word for a number, a field too many): every
    row comes back, as a good one or with its text."""
    path = _staging(spark, "csv_bad") + ".csv"
    f = flights(spark, sf)
    line = F.concat_ws(",", *C.TIE_KEY, F.when(F.col("travel_code") % 7 == 0, "xx").otherwise(F.col("price").cast("string")),
                       F.when(F.col("travel_code") % 7 == 1, "extra"))
    f.select(line.alias("value")).write.text(path)
    kinds = dict(f.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in C.TIE_KEY) + ", price double"
    good, bad = readers.split_corrupt(readers.read_csv(spark, path, schema, header=False))
    key = F.split(readers.CORRUPT, ",")
    back = bad.select(*[F.element_at(key, i + 1).cast(kinds[c]).alias(c) for i, c in enumerate(C.TIE_KEY)],
                      F.lit(True).alias("rejected"))
    return good.select(*C.TIE_KEY, F.lit(False).alias("rejected")).unionByName(back)


@register("json_roundtrip", "S3", with_flights(
    f"SELECT {TIE}, to_location, distance FROM flights"))
def q_json(spark, sf):
    path = _staging(spark, "json") + ".json"
    f = flights(spark, sf).select(*C.TIE_KEY, "to_location", "distance")
    f.write.json(path)
    return readers.load_data(spark, path, schema=f.schema)


@register("split_sink", "S5 T2", with_flights(
    f"SELECT {TIE}, CASE WHEN date <= DATE '1999-06-30' THEN 'train' WHEN date <= DATE '2000-03-31' "
    "THEN 'validation' ELSE 'test' END AS split FROM flights"))
def q_split_sink(spark, sf):
    from ..operators.splits import split_by_dates
    path = _staging(spark, "splits")
    s = split_by_dates(flights(spark, sf), "date", "1999-06-30", "2000-03-31")
    sinks.write_splits(s.select(*C.TIE_KEY, "split"), path)
    back = spark.read.parquet(path)
    return back.select(*C.TIE_KEY, "split")



# --- F2 / F6 / B2 ------------------------------------------------------------

@register("mice_impute", "F2")
def q_mice(spark, sf):
    """Chained-equation imputation of price and distance (NULLs injected)
    using time as a complete predictor; fitted on the training period."""
    from ..operators.fitted.mice import fit_mice
    from ..sources.tables import flights_with_nulls
    # the fit and the filling read the rows: join once
    f = write_table(flights_with_nulls(spark, sf).select(*C.TIE_KEY, "date", "price", "time", "distance"), "rows")
    m = fit_mice(f.where(F.col("date") < F.lit("1999-01-01").cast("date")),
                 ["price", "time", "distance"], max_iter=10)
    out = m.transform(f)
    return out.select(*C.TIE_KEY, r("price", 4), r("time", 4), r("distance", 4))


_MICE_CTE = f"""
tr AS (SELECT CAST(time AS DOUBLE) AS x, CAST(price AS DOUBLE) AS y FROM flights_n WHERE date < DATE '1999-01-01'),
mo AS (SELECT count(*)::DOUBLE AS n, var_pop(x) * count(*) AS ev, covar_pop(x, y) * count(*) AS xty,
         var_pop(y) * count(*) AS yty, var_pop(y) AS vy, avg(x) AS mx, avg(y) AS my FROM tr WHERE y IS NOT NULL),
ridge AS ({BAYES_RIDGE_SQL})"""


@register("mice_two_columns", "F2", with_flights(
    f"SELECT {TIE}, ROUND(COALESCE(CAST(price AS DOUBLE), my - coef * mx + coef * time), 3) AS price, "
    "ROUND(CAST(time AS DOUBLE), 4) AS time FROM flights_n, ridge, mo", nulls=True, extra=_MICE_CTE))
def q_mice_two(spark, sf):
    """Chained equations of two columns, one of them complete: every round
    is the same one-predictor regression."""
    from ..operators.fitted.mice import fit_mice
    from ..sources.tables import flights_with_nulls
    # the fit and the filling read the rows: join once
    f = write_table(flights_with_nulls(spark, sf).select(*C.TIE_KEY, "date", "price", "time"), "rows")
    m = fit_mice(f.where(F.col("date") < F.lit("1999-01-01").cast("date")), ["time", "price"], max_iter=10)
    return m.transform(f).select(*C.TIE_KEY, r("price", 3), r("time", 4))


@register("iforest_flags", "F6 F7")
def q_iforest(spark, sf):
    """Isolation-forest flags for price/time/distance (100 trees, psi 256,
    contamination auto) and the trimmed row count per flag pattern."""
    from ..operators.fitted.iforest import fit_isolation_forest
    f = flights(spark, sf)
    m = fit_isolation_forest(f.where(F.col("date") < F.lit("1999-01-01").cast("date")),
                             ["price", "time", "distance"], n_trees=100, seed=7,
                             key=C.TIE_KEY)
    flagged = m.mask(f)
    return flagged.groupBy("price_outlier", "time_outlier", "distance_outlier").agg(
        F.count(F.lit(1)).alias("n_rows"))


@register("tree_contrib", "B2 B5")
def q_tree_contrib(spark, sf):
    """Path-dependent TreeSHAP of a random forest on the gold features, for
    every evaluation row; reported per feature as mean |phi| together with
    the worst additivity gap |base + sum(phi) - prediction|."""
    from ..operators.model.treeshap import tree_contributions
    gm, feats, tr, te = _gold_split(spark, sf)
    model = make_estimator("RandomForestRegressor",
                           {"n_estimators": 10, "max_depth": 5, "random_state": 42},
                           label=C.TARGET).fit(assemble(tr, feats))
    # row ids are pinned by a reliable checkpoint so both uses agree
    te = checkpoint(te.withColumn("row_id", F.monotonically_increasing_id()))
    long = tree_contributions(te, model, feats, ["row_id"])
    sums = long.groupBy("row_id").agg(F.sum("phi").alias("s"))
    pred = model.transform(assemble(te, feats)).select("row_id", "prediction")
    gap = sums.join(pred, "row_id").agg(
        F.max(F.abs(F.col("s") - F.col("prediction")))).collect()[0][0]
    imp = (long.where(F.col("feature") != "__base__").groupBy("feature")
           .agg(F.avg(F.abs("phi")).alias("mean_abs_phi")))
    return imp.select("feature", r("mean_abs_phi"),
                      F.lit(round(float(gap), 9)).alias("max_additivity_gap"))


@register("cv_predictions", "S8 V3 V5", with_flights(
    f"SELECT {TIE}, CAST(fold AS INTEGER) AS fold, 'original' AS scale, ROUND(price, 4) AS y_true, "
    "ROUND(yhat, 4) AS y_pred FROM pred", extra=_CV_SQL_CTE.replace("p AS (SELECT time,", f"p AS (SELECT {TIE}, time,")
    .replace("SELECT fo.fold, p.price,", f"SELECT {TIE}, fo.fold, p.price,")))
def q_cv_predictions(spark, sf):
    f = flights(spark, sf)
    ordered, n = cv.ordered_frame(f, "date", C.TIE_KEY, ["time"], "price", prune=False)
    pred = cv.time_cv_predictions(ordered, n, "LinearRegression", {}, ["time"], "price", 5, keys=C.TIE_KEY)
    path = _staging(spark, "predictions")
    sinks.write_predictions(cv.both_scales(pred).drop("ordinal"), path)
    back = spark.read.parquet(path)
    return back.select(*C.TIE_KEY, "fold", "scale", r("y_true", 4), r("y_pred", 4))


_UNSCALE_CTE = ("u AS (SELECT quantile_cont(ln(1 + price), 0.5) AS m, "
                "quantile_cont(ln(1 + price), 0.75) - quantile_cont(ln(1 + price), 0.25) AS s "
                "FROM flights WHERE date < DATE '1999-01-01'), "
                "t AS (SELECT price, (ln(1 + price) - m) / s AS yt, (ln(1 + price) - m) / s + 0.05 "
                "AS pt, m, s FROM flights, u), "
                "v AS (SELECT exp(yt * s + m) - 1 AS y_true, exp(pt * s + m) - 1 AS y_pred FROM t)")


@register("unscale_metrics", "V2 V1 F11 F13", with_flights(
    _metric_sql("y_true", "y_pred", "v"), extra=_UNSCALE_CTE))
def q_unscale(spark, sf):
    """Target log-transformed then robust-scaled (fitted on the training
    period); a prediction 0.05 above the scaled truth is mapped back through
    the inverse scaler and inverse power transform, and scored in price units."""
    from ..operators.fitted.power import fit_power
    from ..operators.fitted.scaler import fit_scaler
    f = flights(spark, sf).select("price", "date")
    train = f.where(F.col("date") < F.lit("1999-01-01").cast("date"))
    pw = fit_power(train, ["price"], "log")
    sc = fit_scaler(pw.transform(train), ["price"], "robust")
    t = sc.transform(pw.transform(f))
    pred = t.select(F.col("price").alias("y_true"), (F.col("price") + 0.05).alias("y_pred"))
    back = metrics.unscale(pred, ["y_true", "y_pred"], sc, pw, target="price")
    return _round_metrics(metrics.regression_metrics(back))


_MODES_CTE = f"""
p AS (SELECT time, distance, price, row_number() OVER (ORDER BY date, {TIE}) - 1 AS pos
      FROM flights WHERE date IS NOT NULL),
cut AS (SELECT CAST(floor(n * CAST(0.7 AS DOUBLE)) AS BIGINT) AS c1,
               CAST(floor(n * CAST(0.7 AS DOUBLE)) AS BIGINT)
                 + CAST(floor(n * CAST(0.15 AS DOUBLE)) AS BIGINT) AS c2
        FROM (SELECT count(*) AS n FROM p)),
lab AS (SELECT p.*, CASE WHEN pos < c1 THEN 'train' WHEN pos < c2 THEN 'validation'
                         ELSE 'test' END AS split, c2 FROM p, cut),
st AS (SELECT 'v' AS fk, time, distance, price FROM lab WHERE split = 'train'
       UNION ALL SELECT 't', time, distance, price FROM lab WHERE split IN ('train', 'validation')
       UNION ALL SELECT 'f' || CAST(i AS VARCHAR), time, distance, price FROM lab, range(3) r(i)
                 WHERE pos < c2 - (3 - i) * (c2 // 4)),
fits AS (SELECT fk, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1,
                (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2, my, m1, m2
         FROM (SELECT fk, var_pop(time) AS s11, var_pop(distance) AS s22,
                      covar_pop(time, distance) AS s12, covar_pop(time, price) AS s1y,
                      covar_pop(distance, price) AS s2y, avg(price) AS my, avg(time) AS m1,
                      avg(distance) AS m2 FROM st GROUP BY fk)),
ev AS (SELECT 'validation' AS mode, 'validation' AS split, 'v' AS fk, time, distance, price
       FROM lab WHERE split = 'validation'
       UNION ALL SELECT 'validation', 'test', 'v', time, distance, price FROM lab WHERE split = 'test'
       UNION ALL SELECT 'train_only', 'test', 't', time, distance, price FROM lab WHERE split = 'test'
       UNION ALL SELECT 'cv', 'cv_fold_' || CAST(i AS VARCHAR), 'f' || CAST(i AS VARCHAR),
                 time, distance, price FROM lab, range(3) r(i)
                 WHERE pos >= c2 - (3 - i) * (c2 // 4) AND pos < c2 - (3 - i) * (c2 // 4) + c2 // 4
       UNION ALL SELECT 'cv', 'test', 't', time, distance, price FROM lab WHERE split = 'test'),
pr AS (SELECT ev.mode, ev.split, ev.price AS y,
              (my - b1 * m1 - b2 * m2) + b1 * ev.time + b2 * ev.distance AS yhat
       FROM ev JOIN fits ON ev.fk = fits.fk)"""


@register("train_modes", "M9 V5 U1", with_flights(
    _metric_sql("y", "yhat", "pr", "mode, split"), extra=_MODES_CTE))
def q_train_modes(spark, sf):
    """The three run modes on the chronological split of the flights rows
    (linear model on time and distance): metrics per evaluated split."""
    from ..operators.splits import split_by_fraction
    from ..plans.training import train_model
    f = write_table(flights(spark, sf).select(*C.TIE_KEY, "date", "time", "distance", "price"), "run_rows")
    s = split_by_fraction(f, "date", C.TIE_KEY)
    parts = {k: s.where(F.col("split") == k).drop("split") for k in ("train", "validation", "test")}
    out = None
    for mode in ("validation", "train_only", "cv"):
        _, met = train_model("LinearRegression", {}, ["time", "distance"], "price",
                             parts["train"], parts["validation"], parts["test"], mode=mode,
                             tie_key=C.TIE_KEY, n_splits=3)
        met = met.withColumn("mode", F.lit(mode))
        out = met if out is None else out.unionByName(met)
    return out.select("mode", "split", *[r(c, d) for c, d in _ROUND.items()])


_OUT_CTE = _MODES_CTE.replace(f"p AS (SELECT time, distance, price,", f"p AS (SELECT {TIE}, time, distance, price,") + f""",
sc AS (SELECT avg(ln(1 + price)) AS m, stddev_samp(ln(1 + price)) AS s FROM lab WHERE split = 'train'),
tl AS (SELECT lab.*, (ln(1 + price) - m) / s AS ty, m, s FROM lab, sc),
tf AS (SELECT covar_pop(time, ty) / var_pop(time) AS b, avg(ty) - covar_pop(time, ty) / var_pop(time) * avg(time) AS a
       FROM tl WHERE split = 'train'),
tp AS (SELECT {TIE}, split, ty, a + b * time AS hat, m, s FROM tl, tf WHERE split <> 'train')"""


@register("train_outputs", "V5 V6 S8 S9 M9 V2", with_flights(
    f"SELECT {TIE}, split, 'scaled' AS scale, ROUND(ty, 6) AS y_true, ROUND(hat, 6) AS y_pred FROM tp UNION ALL "
    f"SELECT {TIE}, split, 'unscaled', ROUND(exp(ty * s + m) - 1, 4), ROUND(exp(hat * s + m) - 1, 4) FROM tp "
    "UNION ALL SELECT NULL, NULL, NULL, NULL, 'importances', feature, ROUND(v, 6), NULL FROM "
    "(SELECT unnest(['intercept', 'time']) AS feature, unnest([a, b]) AS v FROM tf)", extra=_OUT_CTE))
def q_train_outputs(spark, sf):
    """What a validation run writes: predictions of every evaluated row with
    its key on both scales, and the coefficients (as rows of split
    ``importances``); the target is log-transformed and standard-scaled."""
    from ..operators.fitted.power import fit_power
    from ..operators.fitted.scaler import fit_scaler
    from ..operators.splits import split_by_fraction
    from ..plans.training import train_model
    f = write_table(flights(spark, sf).select(*C.TIE_KEY, "date", "time", "distance", "price"), "run_rows")
    s = split_by_fraction(f, "date", C.TIE_KEY)
    train = s.where("split = 'train'")
    pw = fit_power(train, ["price"], "log")
    sc = fit_scaler(pw.transform(train), ["price"], "standard")
    part = lambda k: sc.transform(pw.transform(s.where(F.col("split") == k).drop("split")))
    path = _staging(spark, "training")
    train_model("LinearRegression", {}, ["time"], "price", part("train"), part("validation"), part("test"),
                mode="validation", tie_key=C.TIE_KEY, scaler=sc, power=pw, keys=C.TIE_KEY, output=path)
    pred, unit = spark.read.parquet(f"{path}/predictions"), F.col("scale") == "unscaled"
    low = lambda c: F.when(unit, F.round(F.col(c), 4)).otherwise(F.round(F.col(c), 6)).alias(c)
    imp = spark.read.parquet(f"{path}/importances")
    return pred.select(*C.TIE_KEY, "split", "scale", low("y_true"), low("y_pred")).unionByName(imp.select(
        *[F.lit(None).cast(s.schema[c].dataType).alias(c) for c in C.TIE_KEY], F.lit("importances").alias("split"),
        F.col("feature").alias("scale"), r("value").alias("y_true"), F.lit(None).cast("double").alias("y_pred")))
