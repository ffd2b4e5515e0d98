"""MICE, isolation forest and TreeSHAP against dense / brute-force references."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabforge.operators.fitted.iforest import IsolationForestModel, fit_isolation_forest
from tabforge.operators.fitted.mice import MICEModel, fit_mice
from tabforge.operators.model.estimators import assemble, make_estimator
from tabforge.operators.model.treeshap import _groups, _node_table, _pack, tree_contributions


def _dense_bayes_ridge(X, y, max_iter=300, tol=1e-3, a1=1e-6, a2=1e-6, l1=1e-6, l2=1e-6):
    xm, ym = X.mean(0), y.mean()
    Xc, yc = X - xm, y - ym
    n = len(y)
    U, S, Vh = np.linalg.svd(Xc, full_matrices=False)
    ev = S ** 2
    xty = Xc.T @ yc
    alpha, lam = 1.0 / (np.var(yc) + np.finfo(float).eps), 1.0

    def upd(a, l):
        c = np.linalg.multi_dot([Vh.T, Vh / (ev + l / a)[:, None], xty])
        return c, np.sum((yc - Xc @ c) ** 2)
    old = None
    for it in range(max_iter):
        c, rmse = upd(alpha, lam)
        gamma = np.sum((alpha * ev) / (lam + alpha * ev))
        lam = (gamma + 2 * l1) / (np.sum(c ** 2) + 2 * l2)
        alpha = (n - gamma + 2 * a1) / (rmse + 2 * a2)
        if it != 0 and np.sum(np.abs(old - c)) < tol:
            break
        old = np.copy(c)
    c, _ = upd(alpha, lam)
    return c, ym - xm @ c


def _dense_mice(X, max_iter=10, tol=1e-3):
    mask = np.isnan(X)
    means = np.nanmean(X, axis=0)
    cur = np.where(mask, means, X)
    order = np.argsort(mask.mean(0), kind="mergesort")
    norm_tol = tol * np.max(np.abs(X[~mask]))
    for _ in range(max_iter):
        prev = cur.copy()
        for j in order:
            others = [k for k in range(X.shape[1]) if k != j]
            obs = ~mask[:, j]
            c, b = _dense_bayes_ridge(cur[obs][:, others], cur[obs, j])
            if mask[:, j].any():
                cur[mask[:, j], j] = cur[mask[:, j]][:, others] @ c + b
        if np.max(np.abs(cur - prev).sum(axis=1)) < norm_tol:
            break
    return cur


def test_mice_matches_dense(spark):
    rng = np.random.default_rng(3)
    n = 400
    a = rng.normal(10, 2, n)
    b = 3 * a + rng.normal(0, 1, n)
    c = -a + 0.5 * b + rng.normal(0, 0.5, n)
    X = np.column_stack([a, b, c])
    X[rng.random(n) < 0.15, 0] = np.nan
    X[rng.random(n) < 0.25, 1] = np.nan
    X[rng.random(n) < 0.05, 2] = np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in X[i]]) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    m = fit_mice(df, ["a", "b", "c"])
    got = m.transform(df).orderBy("id").select("a", "b", "c").toPandas().to_numpy()
    want = _dense_mice(X)
    assert np.allclose(got, want, atol=1e-6)
    assert MICEModel.from_json(m.to_json()).steps == m.steps


def test_iforest_flags_far_value(spark):
    rng = np.random.default_rng(5)
    vals = list(rng.normal(0, 1, 2000)) + [25.0]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(vals)], "id long, x double")
    m = fit_isolation_forest(df, ["x"], n_trees=50, seed=1, key=["id"])
    scored = m.mask(df).where("x_outlier").select("x").collect()
    assert 25.0 in [r["x"] for r in scored]
    assert len(scored) < 1000
    m2 = fit_isolation_forest(df, ["x"], n_trees=50, seed=1, key=["id"], contamination=0.01)
    n_flag = m2.mask(df).where("x_outlier").count()
    assert 10 <= n_flag <= 30
    assert IsolationForestModel.from_json(m2.to_json()).thresholds == m2.thresholds


def _brute_shap(x, leaves_tree, nf):
    """Shapley values of v(S) = E[f | x_S] (path-dependent) by enumeration."""
    def cond_exp(S):
        tot = 0.0
        for value, _, conds in leaves_tree:
            w = 1.0
            for f, left, thr, cat, ratio in conds:
                if f in S:
                    inside = x[f] <= thr
                    w *= 1.0 if inside == left else 0.0
                else:
                    w *= ratio
            tot += value * w
        return tot
    phi = np.zeros(nf)
    for i in range(nf):
        others = [k for k in range(nf) if k != i]
        for r in range(len(others) + 1):
            for S in itertools.combinations(others, r):
                wgt = math.factorial(r) * math.factorial(nf - r - 1) / math.factorial(nf)
                phi[i] += wgt * (cond_exp(set(S) | {i}) - cond_exp(set(S)))
    return phi


def test_treeshap_exact_and_additive(spark):
    rng = np.random.default_rng(11)
    n = 300
    X = rng.normal(size=(n, 3))
    y = 3 * X[:, 0] + np.where(X[:, 1] > 0, 2.0, -1.0) + X[:, 0] * X[:, 2]
    df = spark.createDataFrame([(i, *map(float, X[i]), float(y[i])) for i in range(n)],
                               "id long, f0 double, f1 double, f2 double, y double")
    feats = ["f0", "f1", "f2"]
    model = make_estimator("RandomForestRegressor",
                           {"n_estimators": 3, "max_depth": 4, "random_state": 1},
                           label="y").fit(assemble(df, feats))
    long = tree_contributions(df, model, feats, ["id"]).toPandas()
    pred = model.transform(assemble(df, feats)).select("id", "prediction").toPandas()
    sums = long.groupby("id")["phi"].sum()
    merged = pred.set_index("id")["prediction"]
    assert np.allclose(sums.loc[merged.index].to_numpy(), merged.to_numpy(), atol=1e-9)
    nodes, weights = _node_table(spark, model)
    packed = _pack(nodes, _groups(nodes, 10 ** 6)[0], weights)
    trees = [(w, list(packed.leaves(k))) for k, w in enumerate(packed.weight)]
    for i in range(5):
        want = sum(w * _brute_shap(X[i], leaves, 3) for w, leaves in trees)
        got = long[(long["id"] == i) & (long["feature"] != "__base__")].set_index(
            "feature").loc[feats, "phi"].to_numpy()
        assert np.allclose(got, want, atol=1e-9)


def test_ridge_translation_matches_closed_form(spark):
    rng = np.random.default_rng(2)
    n = 500
    X = rng.normal(size=(n, 2)) * [3.0, 0.5] + [10.0, -2.0]
    y = 4.0 * X[:, 0] - 7.0 * X[:, 1] + rng.normal(0, 2.0, n) + 50.0
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(X, y)],
                               "x0 double, x1 double, y double")
    v = assemble(df, ["x0", "x1"])
    alpha = 250.0
    Xc, yc = X - X.mean(0), y - y.mean()
    want = np.linalg.solve(Xc.T @ Xc + alpha * np.eye(2), Xc.T @ yc)
    m = make_estimator("Ridge", {"alpha": alpha}, label="y", train=v).fit(v)
    assert np.allclose(m.coefficients.toArray(), want, rtol=2e-3)
    ols = make_estimator("LinearRegression", {}, label="y").fit(v)
    assert np.allclose(ols.coefficients.toArray(), np.linalg.lstsq(
        np.column_stack([Xc]), yc, rcond=None)[0], rtol=1e-8)
    with pytest.raises(ValueError):
        make_estimator("NoSuchModel", {})


def test_nominal_features_make_categorical_splits(spark):
    from tabforge.operators.model.estimators import assemble
    rng = np.random.default_rng(4)
    n = 600
    cat = rng.integers(0, 5, n)
    y = np.where(np.isin(cat, [0, 3]), 10.0, -10.0) + rng.normal(0, 0.1, n)
    df = spark.createDataFrame([(float(c), float(v)) for c, v in zip(cat, y)], "c double, y double")
    v = assemble(df, ["c"], nominal={"c": 5})
    m = make_estimator("GBTRegressor", {"n_estimators": 1, "max_depth": 1, "random_state": 1},
                       label="y").fit(v)
    root = m.trees[0]._call_java("rootNode")
    split = root.split()
    assert split.getClass().getSimpleName() == "CategoricalSplit"
    long = tree_contributions(df.withColumn("id", F.monotonically_increasing_id()), m, ["c"], ["id"])
    pred = m.transform(v).agg(F.sum("prediction")).collect()[0][0]
    assert abs(long.agg(F.sum("phi")).collect()[0][0] - pred) < 1e-6


def test_search_by_another_metric_and_best_refit(spark):
    from tabforge.operators.model import cv
    rng = np.random.default_rng(2)
    x = rng.normal(size=300)
    df = spark.createDataFrame([(int(i), float(v), float(3 * v + 1)) for i, v in enumerate(x)], "d int, x double, y double")
    ordered, n = cv.ordered_frame(df, "d", [], ["x"], "y")
    trials = cv.search(ordered, n, "Ridge", [{"alpha": 1e6}, {"alpha": 1e-6}], ["x"], "y", metric="r2")
    model, best = cv.fit_best(ordered, trials, "Ridge", ["x"], "y")
    assert best == {"alpha": 1e-6} and model.coefficients[0] == pytest.approx(3.0, abs=1e-3)
    steps = {p["z"] for p in cv.random_points({"z": ("float", 0.1, 0.5, 0.2)}, 40, 1)}
    assert {round(z, 9) for z in steps} == {0.1, 0.3, 0.5}


def test_isolation_forest_samples_a_mostly_null_column(spark):
    df = spark.createDataFrame([(i, float(i % 97), float(i) if i % 50 == 0 else None) for i in range(20_000)],
                               "k int, a double, b double")
    m = fit_isolation_forest(df, ["a", "b"], n_trees=8, max_samples=64, key=["k"])
    assert len(m.path["b"]) > 64      # cut points of eight trees on full samples


def test_tree_parameters_are_not_dropped_in_silence():
    from tabforge.operators.model.estimators import make_estimator
    with pytest.warns(UserWarning, match="min_samples_split"):
        make_estimator("RandomForestRegressor", {"min_samples_split": 4})
    gbt = make_estimator("XGBRegressor", {"colsample_bytree": 0.5, "max_depth": -1}, nominal={"c": 40})
    assert gbt.getFeatureSubsetStrategy() == "0.5" and gbt.getMaxDepth() == 30 and gbt.getMaxBins() == 40
    with pytest.raises(ValueError):
        make_estimator("LGBMRegressor", {"max_depth": 31})
