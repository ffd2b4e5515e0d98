"""Time-ordered cross-validation and hyper-parameter search (V3, V4, V5,
H1s-H4s).

Rows get a global ordinal once (range partition, no single-partition window)
and, for tree models, are written in that order, so a fold's ordinal range
prunes files and row groups.

Linear models take their folds from one scan (:mod:`.fold_stats`): fits of
all folds, penalties and halving rungs, and the RMSE, MSE and R2 of all of
them, cost no further pass; a metric of absolute errors reads the test rows
once more.  Tree models are an MLlib job per fold over the pruned ranges.
Independent fits may run side by side from a driver thread pool, as
``CrossValidator(parallelism=...)`` does.
"""

from __future__ import annotations

import itertools
import json
import math
import random
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..splits import time_series_folds, with_ordinal
from .estimators import LINEAR, assemble, make_estimator
from .fold_stats import QUADRATIC, fold_moments, fold_predictions, gram_metrics, solve_linear
from .metrics import METRICS, regression_metrics, unscale


def ordered_frame(df: DataFrame, date_col: str, tie_key, features, label,
                  prune: bool = True) -> tuple[DataFrame, int]:
    """The rows with their ordinals, and their number.  The table is written
    in time order, so models that read the folds' ranges one by one
    (``prune``) and those that read it whole share one form."""
    cols = list(dict.fromkeys([date_col, *tie_key, *features, label]))
    return with_ordinal(df.select(*cols), date_col, tie_key, return_count=True)


def _fold_predictions(ordered, fold, name, params, features, label, nominal=None, keys=()):
    o = F.col("ordinal")
    train = ordered.where((o >= fold.train_start) & (o < fold.train_end))
    test = ordered.where((o >= fold.test_start) & (o < fold.test_end))
    train_v = assemble(train, features, nominal=nominal)
    est = make_estimator(name, params, label=label, train=train_v, nominal=nominal)
    model = est.fit(train_v)
    pred = model.transform(assemble(test, features, nominal=nominal))
    return pred.select(*keys, F.lit(fold.fold).alias("fold"), "ordinal",
                       F.col(label).cast("double").alias("y_true"),
                       F.col("prediction").alias("y_pred"))


def time_cv_predictions(ordered: DataFrame, n: int, name: str, params: dict, features,
                        label: str, n_splits: int = 5, max_train_size=None, test_size=None,
                        gap: int = 0, parallelism: int = 1, nominal: dict | None = None,
                        keys=()) -> DataFrame:
    """V3: out-of-fold predictions of every fold, one DataFrame with the row's
    ``keys``, ``fold``, ``ordinal``, ``y_true`` and ``y_pred``."""
    folds = time_series_folds(n, n_splits, max_train_size, test_size, gap)
    if name in LINEAR:
        m = fold_moments(ordered, folds, features, label)
        betas = [solve_linear(m.train(f), m.shift, name, params) for f in folds]
        return fold_predictions(ordered, folds, betas, features, label, keys=keys)
    run = lambda f: _fold_predictions(ordered, f, name, params, features, label, nominal, keys)
    if parallelism > 1:
        with ThreadPoolExecutor(parallelism) as ex:
            parts = list(ex.map(run, folds))
    else:
        parts = [run(f) for f in folds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def both_scales(pred: DataFrame, scaler=None, power=None, target: str = "price") -> DataFrame:
    """Predictions with a ``scale``: every row as the model sees it (scaled)
    and, in a row of its own, mapped back through the fitted target scaler
    and power transform (unscaled).  Without either, rows are ``original``."""
    if scaler is None and power is None:
        return pred.withColumn("scale", F.lit("original"))
    back = unscale(pred, ["y_true", "y_pred"], scaler, power, target)
    return pred.withColumn("scale", F.lit("scaled")).unionByName(back.withColumn("scale", F.lit("unscaled")))


def time_cv_metrics(ordered: DataFrame, n: int, name: str, params: dict, features, label: str,
                    n_splits: int = 5, parallelism: int = 1, names=METRICS, scaler=None, power=None,
                    **kw) -> DataFrame:
    """V3: one ``groupBy(fold)`` aggregation over all folds' predictions.  With
    a fitted target scaler or power transform the table has a ``scale`` and
    metrics of both (scaled, unscaled) per fold."""
    pred = time_cv_predictions(ordered, n, name, params, features, label, n_splits,
                               parallelism=parallelism, **kw)
    if scaler is None and power is None:
        return regression_metrics(pred, "y_true", "y_pred", ["fold"], names)
    return regression_metrics(both_scales(pred, scaler, power, label), "y_true", "y_pred", ["fold", "scale"], names)


# --- search ------------------------------------------------------------------

def grid_points(param_grid: dict) -> list[dict]:
    keys = sorted(param_grid)
    return [dict(zip(keys, vals)) for vals in itertools.product(*[param_grid[k] for k in keys])]


def random_points(space: dict, n_iter: int, seed: int, fixed: dict | None = None) -> list[dict]:
    """H2s: seeded draws.  ``space`` entries: ``("int", lo, hi[, step])``,
    ``("float", lo, hi[, "log" or step])``, ``("categorical", [choices])``."""
    rng = random.Random(seed)
    pts = []
    for _ in range(n_iter):
        p = dict(fixed or {})
        for k in sorted(space):
            spec = space[k]
            kind = spec[0]
            if kind == "int":
                step = spec[3] if len(spec) > 3 else 1
                p[k] = rng.randrange(spec[1], spec[2] + 1, step)
            elif kind == "float":
                if len(spec) > 3 and spec[3] not in ("log", None):
                    step = float(spec[3])
                    p[k] = spec[1] + step * rng.randrange(int((spec[2] - spec[1]) / step + 1e-9) + 1)
                elif len(spec) > 3 and spec[3] == "log":
                    p[k] = math.exp(rng.uniform(math.log(spec[1]), math.log(spec[2])))
                else:
                    p[k] = rng.uniform(spec[1], spec[2])
            else:
                p[k] = rng.choice(list(spec[1]))
        pts.append(p)
    return pts


def _score_points(ordered, sizes, name, points, features, label, n_splits, parallelism, metric, nominal):
    """Fold scores of every (point index, rows) of ``sizes``, as a function;
    linear models read the table once for all of them."""
    folds = {m: time_series_folds(m, n_splits) for m in sizes}
    if name in LINEAR and metric in QUADRATIC:
        moments = fold_moments(ordered, [f for fs in folds.values() for f in fs], features, label)

        def linear(i, m):
            return [gram_metrics(moments.test(f), moments.shift,
                                 solve_linear(moments.train(f), moments.shift, name, points[i]))[metric]
                    for f in folds[m]]
        return lambda todo, m: [linear(i, m) for i in todo]

    def one(i, m):
        met = time_cv_metrics(ordered, m, name, points[i], features, label, n_splits, names=[metric],
                              nominal=nominal).collect()
        return [r[metric] for r in sorted(met, key=lambda r: r["fold"])]

    def every(todo, m):
        if parallelism > 1:
            with ThreadPoolExecutor(parallelism) as ex:
                return list(ex.map(lambda i: one(i, m), todo))
        return [one(i, m) for i in todo]
    return every


_TRIALS = ("trial int, params string, rung int, n_rows long, metric string, fold_scores array<double>, "
           "mean_score double, std_score double, rank int")


def _stats(v):
    mean = sum(v) / len(v)
    std = math.sqrt(sum((x - mean) ** 2 for x in v) / (len(v) - 1)) if len(v) > 1 else 0.0
    return mean, std


def _maximize(metric: str, direction: str | None) -> bool:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    if direction not in (None, "maximize", "minimize"):
        raise ValueError(f"unknown direction {direction!r}")
    return direction == "maximize" if direction else metric == "r2"


def _rung(points, todo, scores, rung, m, metric, maximize) -> list[tuple]:
    """Rows of one rung, best first (ties to the earlier point)."""
    rows = [(i, json.dumps(points[i], sort_keys=True), rung, m, metric, v, *_stats(v)) for i, v in zip(todo, scores)]
    rows.sort(key=lambda r: (-r[6] if maximize else r[6], r[0]))
    return [(*r, k + 1) for k, r in enumerate(rows)]


def search(ordered: DataFrame, n: int, name: str, points: list[dict], features, label: str,
           n_splits: int = 3, parallelism: int = 2, metric: str = "rmse", direction: str | None = None,
           nominal: dict | None = None) -> DataFrame:
    """H1s/H2s/H4s: every point scored by time-ordered CV; the trial table
    holds trial, params, rung (0), n_rows, metric, fold_scores, mean_score,
    std_score and rank (1 = best: highest for R2, else lowest, unless
    ``direction`` says ``maximize`` or ``minimize``)."""
    maximize = _maximize(metric, direction)
    score = _score_points(ordered, [n], name, points, features, label, n_splits, parallelism, metric, nominal)
    todo = list(range(len(points)))
    return ordered.sparkSession.createDataFrame(
        _rung(points, todo, score(todo, n), 0, n, metric, maximize), _TRIALS)


def best_params(trials: DataFrame) -> dict:
    """Parameters of the best trial of the last rung."""
    row = trials.where("rank = 1").orderBy(F.desc("rung")).first()
    return json.loads(row["params"])


def fit_best(ordered: DataFrame, trials: DataFrame, name: str, features, label: str,
             nominal: dict | None = None):
    """The model of the best-ranked trial, fitted on all rows, and its
    parameters."""
    best = best_params(trials)
    v = assemble(ordered, features, nominal=nominal)
    return make_estimator(name, best, label=label, train=v, nominal=nominal).fit(v), best


def successive_halving(ordered: DataFrame, n: int, name: str, points: list[dict], features,
                       label: str, factor: int = 3, min_rows: int | None = None,
                       n_splits: int = 3, parallelism: int = 2, metric: str = "rmse",
                       direction: str | None = None, nominal: dict | None = None) -> DataFrame:
    """H3s: rung ``r`` of ``R + 1`` scores the survivors on the first
    ``n // factor^(R-r)`` rows in time order and keeps the best ``1/factor``
    of them; the table is that of :func:`search`, a row per rung and
    survivor, ranked within the rung."""
    maximize = _maximize(metric, direction)
    rungs = 1
    while factor ** rungs <= len(points):
        rungs += 1
    sizes = [min(n, max(n // factor ** (rungs - 1 - r), min_rows or 0)) for r in range(rungs)]
    score = _score_points(ordered, sorted(set(sizes)), name, points, features, label, n_splits, parallelism,
                          metric, nominal)
    alive, rows = list(range(len(points))), []
    for rung, m in enumerate(sizes):
        ranked = _rung(points, alive, score(alive, m), rung, m, metric, maximize)
        rows += ranked
        alive = sorted(r[0] for r in ranked[:max(1, len(ranked) // factor)])
    return ordered.sparkSession.createDataFrame(rows, _TRIALS)
