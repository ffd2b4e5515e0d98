"""Fold statistics, searches, composed imputation, forests on the JVM, the
step registry, bounded encoders, tree groups and dense tables."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabforge.operators import profile, splits
from tabforge.operators.fitted import registry
from tabforge.operators.fitted.encoder import fit_encoder
from tabforge.operators.fitted.iforest import avg_path_length, fit_isolation_forest
from tabforge.operators.fitted.mice import MICEModel, fit_mice
from tabforge.operators.fitted.outlier import fit_outliers
from tabforge.operators.model import cv, explain, metrics
from tabforge.operators.model.estimators import assemble, make_estimator
from tabforge.operators.model.fold_stats import fold_moments, gram_metrics, solve_linear
from tabforge.operators.model.treeshap import tree_contributions
from tabforge.operators.quality import rules as R


def _ordered(spark, n=240, p=3, seed=1, far=1e6):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) + far * np.arange(1, p + 1)
    y = x @ np.arange(1, p + 1) + rng.normal(0, 0.5, n) - 7
    names = [f"x{i}" for i in range(p)]
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))],
                               "ordinal long, " + ", ".join(f"{c} double" for c in names) + ", y double")
    return df.repartition(5), x, y, names


def test_moments_of_every_fold_from_one_scan(spark):
    df, x, y, names = _ordered(spark)
    folds = splits.time_series_folds(240, 4, gap=3)
    m = fold_moments(df, folds, names, "y")
    for f in folds:
        xs, ys = x[f.train_start:f.train_end], y[f.train_start:f.train_end]
        beta = solve_linear(m.train(f), m.shift, "LinearRegression")
        want = np.linalg.lstsq(xs - xs.mean(0), ys - ys.mean(), rcond=None)[0]
        assert np.allclose(beta[1:], want, rtol=1e-6)
        e = y[f.test_start:f.test_end] - beta[0] - x[f.test_start:f.test_end] @ beta[1:]
        got = gram_metrics(m.test(f), m.shift, beta)
        assert got["mse"] == pytest.approx((e ** 2).mean(), rel=1e-6)
        assert got["r2"] == pytest.approx(1 - (e ** 2).sum() / (240 // 5 * y[f.test_start:f.test_end].var()), rel=1e-6)
    with pytest.raises(Exception, match="not finite"):
        fold_moments(df.withColumn("x1", F.when(F.col("ordinal") != 5, F.col("x1"))), folds, names, "y").train(folds[0])


@pytest.mark.parametrize("name,params", [("Ridge", {"alpha": 30.0}), ("SGDRegressor", {"alpha": 0.2}),
                                         ("Lasso", {"alpha": 0.3}), ("ElasticNet", {"alpha": 0.4, "l1_ratio": 0.25}),
                                         ("Ridge", {"alpha": 3.0, "fit_intercept": False})])
def test_penalised_solutions_are_optimal(spark, name, params):
    df, x, y, names = _ordered(spark, far=3.0)
    folds = splits.time_series_folds(240, 2)
    m = fold_moments(df, folds, names, "y")
    f = folds[-1]
    beta = solve_linear(m.train(f), m.shift, name, params)
    xs, ys = x[:f.train_end], y[:f.train_end]
    free = params.get("fit_intercept", True)
    a, n = params["alpha"], len(ys)
    l1 = {"Lasso": a, "ElasticNet": a * params.get("l1_ratio", 0)}.get(name, 0.0)
    l2 = {"Ridge": a / n, "SGDRegressor": a, "ElasticNet": a * (1 - params.get("l1_ratio", 0))}.get(name, 0.0)

    def loss(b0, w):
        return ((ys - b0 - xs @ w) ** 2).mean() / 2 + l1 * np.abs(w).sum() + l2 / 2 * (w ** 2).sum()
    best, rng = loss(beta[0], beta[1:]), np.random.default_rng(3)
    assert free or beta[0] == 0
    for _ in range(200):
        d = rng.normal(size=4) * 10.0 ** rng.uniform(-5, -1)
        assert loss(beta[0] + (d[0] if free else 0), beta[1:] + d[1:]) >= best - 1e-9


def test_linear_folds_equal_mllib_folds(spark):
    df, x, y, names = _ordered(spark, far=2.0)
    got = {r["ordinal"]: r["y_pred"] for r in cv.time_cv_predictions(df, 240, "LinearRegression", {}, names, "y", 3).collect()}
    assert sorted(got) == list(range(60, 240))
    for f in splits.time_series_folds(240, 3):
        pred = {r["ordinal"]: r["y_pred"] for r in cv._fold_predictions(df, f, "LinearRegression", {}, names, "y").collect()}
        assert all(got[o] == pytest.approx(v, rel=1e-8) for o, v in pred.items())


@pytest.mark.parametrize("n,k,kw", [(50, 4, {}), (61, 5, {"gap": 2}), (80, 3, {"max_train_size": 13}),
                                    (90, 4, {"test_size": 7, "gap": 1, "max_train_size": 20})])
def test_fold_membership_by_arithmetic(spark, n, k, kw):
    folds = splits.time_series_folds(n, k, **kw)
    df = spark.range(n).withColumnRenamed("id", "ordinal")
    got = sorted((r["ordinal"], r["fold"], r["role"]) for r in splits.assign_folds(df, folds).collect())
    want = sorted((o, f.fold, "train") for f in folds for o in range(f.train_start, f.train_end))
    want += [(o, f.fold, "test") for f in folds for o in range(f.test_start, f.test_end)]
    assert got == sorted(want)


def _nominal_rows(spark):
    rng = np.random.default_rng(4)
    cat = rng.integers(0, 6, 400)
    y = np.where(np.isin(cat, [0, 2, 4]), 10.0, -10.0) + rng.normal(0, 0.1, 400)
    df = spark.createDataFrame([(i, float(c), float(v)) for i, (c, v) in enumerate(zip(cat, y))], "d int, c double, y double")
    return cv.ordered_frame(df, "d", [], ["c"], "y")


def test_searches_see_nominal_features_metric_and_direction(spark):
    ordered, n = _nominal_rows(spark)
    pts = [{"n_estimators": 3, "max_depth": 1, "random_state": 1}, {"n_estimators": 3, "max_depth": 0 + 1, "random_state": 2}]
    plain = cv.search(ordered, n, "RandomForestRegressor", pts[:1], ["c"], "y", n_splits=2).first()["mean_score"]
    told = cv.search(ordered, n, "RandomForestRegressor", pts[:1], ["c"], "y", n_splits=2, nominal={"c": 6}).first()
    assert told["mean_score"] < 1 < plain and told["metric"] == "rmse"
    halved = cv.successive_halving(ordered, n, "RandomForestRegressor", pts, ["c"], "y", factor=2, n_splits=2,
                                   metric="mae", nominal={"c": 6}).collect()
    assert [(r["rung"], r["n_rows"]) for r in halved] == [(0, 200), (0, 200), (1, 400)] and halved[0]["metric"] == "mae"
    worst = cv.search(ordered, n, "Ridge", [{"alpha": 1.0}, {"alpha": 1e9}], ["c"], "y", direction="maximize")
    assert cv.best_params(worst) == max(({"alpha": 1.0}, {"alpha": 1e9}), key=lambda p: dict(
        (r["params"], r["mean_score"]) for r in worst.collect())[f'{{"alpha": {p["alpha"]}}}'])
    with pytest.raises(ValueError):
        cv.search(ordered, n, "Ridge", [{}], ["c"], "y", direction="up")
    with pytest.raises(ValueError):
        cv.search(ordered, n, "Ridge", [{}], ["c"], "y", metric="accuracy")


# --- chained equations

def _replay(model, x):
    x = x.copy()
    miss = np.isnan(x)
    cur = np.where(miss, [model.means[c] for c in model.columns], x)
    for c, coef, b in model.steps:
        j = model.columns.index(c)
        cur[miss[:, j], j] = np.delete(cur[miss[:, j]], j, axis=1) @ np.array(coef) + b
    return cur


@pytest.mark.parametrize("limit", [8, 0])
def test_composed_imputation_equals_the_replay(spark, monkeypatch, limit):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(160, 4)) @ rng.normal(size=(4, 4)) + [100.0, -3.0, 0.0, 7.0]
    x[rng.random(x.shape) < 0.25] = np.nan
    rows = [tuple(None if math.isnan(v) and k % 2 else float(v) for v in r) for k, r in enumerate(x)]   # NULL and NaN
    df = spark.createDataFrame([(i, *r, "t") for i, r in enumerate(rows)], "id int, a double, b double, c double, d double, t string")
    m = fit_mice(df, ["a", "b", "c", "d"], max_iter=4)
    monkeypatch.setattr("tabforge.operators.fitted.mice.MAX_ENUMERATED", limit)
    out = m.transform(df)
    assert out.columns == df.columns
    got = np.array([r[1:5] for r in out.orderBy("id").collect()], float)
    assert np.allclose(got, _replay(m, x), rtol=1e-9, atol=1e-9)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        m.transform(df.drop("a"))
    assert MICEModel.from_json(m.to_json()).steps == m.steps


# --- isolation forest

def _forest_frame(spark, n=30_000):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=n), 3)
    x[:20] = 40.0 + np.arange(20)
    return spark.createDataFrame([(i, None if i % 97 == 0 else float("nan") if i % 89 == 0 else float(v))
                                  for i, v in enumerate(x)], "k int, a double"), x


@pytest.mark.parametrize("contamination", ["auto", 0.01])
def test_isolation_forest_flags_equal_numpy(spark, contamination):
    df, _ = _forest_frame(spark)
    m = fit_isolation_forest(df, ["a"], n_trees=20, max_samples=128, contamination=contamination, seed=3, key=["k"])
    cuts, path = np.array(m.breakpoints["a"]), np.array(m.path["a"])
    got = m.mask(m.scores(df)).collect()
    plan = m.mask(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    for r in got:
        if r["a"] is None or math.isnan(r["a"]):
            assert r["a_score"] is None and r["a_outlier"] is False
            continue
        s = 2.0 ** (-path[np.searchsorted(cuts, r["a"], side="left")] / avg_path_length([m.psi])[0])
        assert r["a_score"] == pytest.approx(s) and r["a_outlier"] == (s > m.thresholds["a"])
    assert sum(r["a_outlier"] for r in got) == m_count(m.transform(df), df)
    assert any(r["a_outlier"] for r in got if r["a"] is not None and r["a"] > 39)


def m_count(kept, df):
    return df.count() - kept.count()


def test_forest_through_fit_outliers(spark):
    df, _ = _forest_frame(spark, 2000)
    m = fit_outliers(df, ["a"], "iforest", "trim", n_trees=10, seed=1, key=["k"])
    assert m.transform(df).count() < 2000
    with pytest.raises(ValueError):
        fit_outliers(df, ["a"], "iforest", "winsorize")
    with pytest.raises(ValueError):
        fit_outliers(df, ["a"], "iqr", "trim", n_trees=3)
    again = registry.load_step(registry.dump_step(spark, "outliers", m, "unused"), "unused")
    assert again[0] == "outliers" and again[1] == m


# --- steps and encoders

def test_registry_names_versions_and_files(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), (None, 3.0)], "c string, x double")
    enc = fit_encoder(df, ordinal_cols=["c"], table_dir=str(tmp_path / "codes"))
    entry = registry.dump_step(spark, "encoder", enc, str(tmp_path / "bundle"))
    assert entry["type"] == "encoder" and entry["version"] == registry.STEP_TYPES["encoder"].version
    _, back = registry.load_step(entry, str(tmp_path / "bundle"))
    assert all(p.startswith(str(tmp_path / "bundle")) for p in back.auto_tables.values())
    assert sorted(map(tuple, back.transform(df).collect()), key=str) == sorted(map(tuple, enc.transform(df).collect()), key=str)
    for bad in ({**entry, "type": "none"}, {**entry, "version": 99}):
        with pytest.raises(ValueError):
            registry.load_step(bad, str(tmp_path / "bundle"))
    with pytest.raises(ValueError):
        registry.type_of(object())


def test_wide_one_hot_is_bounded(spark, tmp_path):
    df = spark.range(500).select(F.col("id").cast("string").alias("c"), F.col("id").cast("double").alias("x"))
    with pytest.raises(ValueError, match="sparse"):
        fit_encoder(df, onehot_cols=["c"], onehot_limit=100)
    enc = fit_encoder(df, onehot_cols=["c"], onehot_limit=100, wide="sparse", table_dir=str(tmp_path))
    out = enc.transform(df)
    assert out.columns == enc.output_columns() == ["c_onehot", "x"]
    rows = out.select("c_onehot.size", "c_onehot.indices").collect()
    assert {r["size"] for r in rows} == {500} and sorted(r["indices"][0] for r in rows) == list(range(500))
    new = spark.createDataFrame([("zzz", 1.0), (None, 2.0)], "c string, x double")
    assert all(r["c_onehot"]["indices"] == [] for r in enc.transform(new).collect())


def test_gold_chain_with_a_forest_is_saved_and_scores(spark, tmp_path):
    from tabforge.plans import config as C
    from tabforge.plans.bundle import load_bundle, save_bundle
    from tabforge.plans.layers import fit_gold, silver_transform
    from tabforge.plans.scoring import ScoringBundle, score
    from tabforge.sources.tables import raw_flights
    raw = raw_flights(spark, "/root/testdata/sf0.001")
    silver = silver_transform(raw)
    gm = fit_gold(silver, is_tree_model=False, onehot_cols=["agency", "flight_type"], mice_cols=["price", "distance"],
                  outlier_cols=["time"], outlier_detection="iforest", outlier_handling="trim",
                  outlier_options={"n_trees": 10, "seed": 1}, scaler_cols=["distance", "price"], scaler_strategy="robust")
    gold = gm.transform(silver)
    feats = [c for c in gm.final_columns if c != C.TARGET]
    assert {"agency_f", "flight_type_a"} <= set(feats)
    model = make_estimator("LinearRegression", {}, label=C.TARGET).fit(assemble(gold, feats))
    save_bundle(spark, ScoringBundle(gm, model, feats, list(C.TIE_KEY)), str(tmp_path / "b"))
    bundle = load_bundle(spark.newSession(), str(tmp_path / "b"))
    assert [r for r, _ in bundle.gold.steps()] == ["imputer", "mice", "encoder", "outliers", "scaler"]
    rows = raw.drop("price").limit(50)
    got = score(rows, bundle).collect()
    assert len(got) == 50 and all(r["predicted_price"] is not None for r in got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, score(rows, ScoringBundle(gm, model, feats, list(C.TIE_KEY))).collect()))


# --- contributions

def test_tree_groups_add_up(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(150, 3))
    y = 3 * x[:, 0] + np.where(x[:, 1] > 0, 2.0, -1.0) * x[:, 2]
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))],
                               "id int, a_sin double, a_cos double, b double, y double")
    feats = ["a_sin", "a_cos", "b"]
    model = make_estimator("GBTRegressor", {"n_estimators": 12, "max_depth": 3, "random_state": 1}, label="y").fit(assemble(df, feats))
    one = {(r["id"], r["feature"]): r["phi"] for r in tree_contributions(df, model, feats, ["id"]).collect()}
    many = {(r["id"], r["feature"]): r["phi"] for r in tree_contributions(df, model, feats, ["id"], group_nodes=20).collect()}
    assert one.keys() == many.keys() and all(many[k] == pytest.approx(v, abs=1e-9) for k, v in one.items())
    pred = {r["id"]: r["prediction"] for r in model.transform(assemble(df, feats)).collect()}
    grouped = tree_contributions(df, model, feats, ["id"], groups=explain.feature_groups(feats)).collect()
    sums = {}
    for r in grouped:
        sums[r["id"]] = sums.get(r["id"], 0.0) + r["phi"]
    assert {r["group"] for r in grouped} == {"a", "b", "__base__"}
    assert all(sums[i] == pytest.approx(p, abs=1e-9) for i, p in pred.items())
    assert all(r["value"] == pytest.approx(x[r["id"], 1]) for r in grouped if r["group"] == "a")


# --- dense tables

def test_correlation_in_one_scan(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame(rng.normal(size=(200, 5)) + 1e7, columns=list("abcde"))
    pdf["e"] = 4.0
    pdf = pdf.mask(rng.random(pdf.shape) < 0.2)
    want = pdf.corr()
    got = profile.corr_matrix(spark.createDataFrame(
        [tuple(None if pd.isna(v) else float(v) for v in r) for r in pdf.to_numpy()], ", ".join(f"{c} double" for c in pdf)))
    seen = {(r["col_a"], r["col_b"]): r["corr"] for r in got.collect()}
    assert len(seen) == 25
    for (a, b), v in seen.items():
        assert (v is None) if "e" in (a, b) else v == pytest.approx(want.loc[a, b], abs=1e-6)
    empty = spark.createDataFrame([], "a double, b double")
    assert [r["corr"] for r in profile.corr_matrix(empty).collect()] == [None] * 4


def test_bins_are_dense_and_defined_when_empty(spark):
    df = spark.createDataFrame([(0.0,), (100.0,), (None,)], "x double")
    rows = profile.histogram(df, "x", 10).orderBy("bin").collect()
    assert [r["count"] for r in rows] == [1] + [0] * 8 + [1] and profile.histogram(df.limit(0), "x").count() == 0
    pred = spark.createDataFrame([(1.0, 0.0), (3.0, 10.0)], "y_true double, y_pred double")
    rows = metrics.residual_bins(pred, bins=5).orderBy("bin").collect()
    assert [r["count"] for r in rows] == [1, 0, 0, 0, 1] and rows[2]["mean_residual"] is None
    assert metrics.residual_bins(pred.limit(0)).count() == 0


def test_failing_rows_of_a_hot_rule(spark):
    df = spark.range(20_000).select(F.col("id").alias("k"), F.when(F.col("id") % 3 != 0, F.col("id")).alias("v"),
                                    F.when(F.col("id") < 3, "bad").otherwise("ok").alias("s"))
    rules = [R.row_count_between(1), R.not_null("v"), R.in_set("s", ["ok"]), R.not_null("absent")]
    got = R.failing_rows(df, rules, 10, ["k"], seed=1).collect()
    by = {name: [r for r in got if r["rule"] == name] for name in ("not_null:v", "in_set:s")}
    assert len(by["not_null:v"]) == 10 and all(r["k"] % 3 == 0 for r in by["not_null:v"])
    assert sorted(r["k"] for r in by["in_set:s"]) == [0, 1, 2] and len(got) == 13
    masks = {r["k"]: r["broken"] for r in R.with_broken_rules(df, rules).where("k < 5").collect()}
    assert masks == {0: 6, 1: 4, 2: 4, 3: 2, 4: 0}
    many = [R.between("k", 0, 5)] * 70
    assert R.with_broken_rules(df, many).select(F.bit_count("broken_1")).where("k = 9").first()[0] == 7


def test_uncommitted_stream_batches_are_not_read(spark, tmp_path):
    from tabforge.streaming.scoring import read_scored
    base = str(tmp_path / "sink")
    for i, done in ((0, True), (1, False)):
        for side in (base, f"{base}_rejected"):
            spark.range(3).write.parquet(f"{side}/batch={i}")
        if done:
            spark.createDataFrame([(i,)], "batch long").write.parquet(f"{base}_commits/{i}")
    good, bad = read_scored(spark, base)
    assert good.count() == bad.count() == 3 and good.columns == ["id"]
