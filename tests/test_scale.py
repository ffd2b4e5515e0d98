"""How often queries and operators read their rows, and in how many pieces."""

import pytest

from tabforge import catalog

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("query", ["penalized_coef", "penalized_one_feature"])
def test_penalized_fits_read_no_join(spark, monkeypatch, query):
    from tabforge.catalog import modelling
    seen, make = [], modelling.make_estimator
    monkeypatch.setattr(modelling, "make_estimator", lambda *a, **k: seen.append(k["train"]) or make(*a, **k))
    catalog.queries()[query](spark, SF)
    assert len(seen) == 4 and not any("Join" in plan_of(f) for f in seen)


def test_sgd_optimum_does_not_hang_on_partitions(spark):
    """Badly scaled features: iterations stop short of the closed form."""
    import numpy as np
    from tabforge.operators.model.estimators import assemble, make_estimator
    rng = np.random.default_rng(3)
    x = np.c_[rng.uniform(1, 50, 4000), rng.uniform(900, 2000, 4000)]
    y = 55000 + 7 * x[:, 0] - 2 * x[:, 1] + rng.normal(0, 30000, 4000)
    c = x - x.mean(axis=0)
    w = np.linalg.solve(c.T @ c / 4000 + 1e-4 * np.eye(2), c.T @ (y - y.mean()) / 4000)
    want = y.mean() - x.mean(axis=0) @ w
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, y double")
    for n in (1, 7):
        v = assemble(df.repartition(n), ["a", "b"])
        m = make_estimator("SGDRegressor", {"alpha": 1e-4, "tol": 1e-13, "max_iter": 1000}, label="y", train=v).fit(v)
        assert abs(m.intercept - want) < 1e-5


def test_train_modes_reads_no_join(spark, monkeypatch):
    from tabforge.plans import training
    seen, train = [], training.train_model
    monkeypatch.setattr(training, "train_model", lambda *a, **k: seen.append(a[4]) or train(*a, **k))
    catalog.queries()["train_modes"](spark, SF)
    assert len(seen) == 3 and not any("Join" in plan_of(f) for f in seen)


def test_ordinals_prune_and_are_dealt_by_rows(spark, monkeypatch):
    """The session's number of partitions does not bound a task's rows, and a
    range of ordinals reaches the scan."""
    from tabforge.operators import ordinal
    monkeypatch.setattr(ordinal, "ROWS_PER_PARTITION", 100, raising=False)
    df = spark.range(0, 3000, 1, 3).selectExpr("id", "id % 7 AS v")
    out, n = ordinal.with_global_ordinal(df, ["v", "id"], return_count=True)
    assert n == 3000 and [r[0] for r in out.orderBy("ordinal").select("ordinal").collect()] == list(range(3000))
    assert [r["id"] for r in out.orderBy("ordinal").collect()] == sorted(range(3000), key=lambda i: (i % 7, i))
    files = out.selectExpr("input_file_name() AS f").groupBy("f").count().collect()
    assert max(r["count"] for r in files) < 600 and len(files) > 15
    part = out.where("ordinal >= 1000 AND ordinal < 1010")
    assert part.count() == 10 and "GreaterThanOrEqual(ordinal,1000)" in part._jdf.queryExecution().executedPlan().toString()


def test_staged_files_and_triggers_follow_the_rows(spark, tmp_path, monkeypatch):
    from tabforge.streaming import scoring
    monkeypatch.setattr(scoring, "STAGED_ROWS", 100)
    few = scoring.stage_files(spark.range(0, 50, 1, 1), str(tmp_path / "few"))
    many = scoring.stage_files(spark.range(0, 5000, 1, 2), str(tmp_path / "many"))
    for path, rows, files in ((few, 50, 4), (many, 5000, 50)):
        df = spark.read.parquet(path)
        assert df.count() == rows and len(df.inputFiles()) == files
    assert scoring.files_per_trigger(spark, few, 2) == 2 and scoring.files_per_trigger(spark, many, 2) == 13


@pytest.mark.parametrize("query", ["score_rejects", "score_linear_stream"])
def test_scoring_joins_once(spark, monkeypatch, query):
    from tabforge.catalog import layers
    seen, silver = [], layers.silver_transform
    monkeypatch.setattr(layers, "silver_transform", lambda raw, *a, **k: seen.append(raw) or silver(raw, *a, **k))
    catalog.queries()[query](spark, SF)
    assert seen and not any("Join" in plan_of(f) for f in seen)


def test_date_formats_of_all_columns_in_one_job(spark):
    from tabforge.operators import schema
    df = spark.createDataFrame([("2020-01-05", "13/01/2020", "x", None)] * 3 + [("2020-1-6", "01/02/2020", None, None)],
                               "a string, b string, c string, d string")
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("formats"))
    spark.sparkContext.setJobGroup("formats", "")
    try:
        got = schema.pick_date_formats(df, ["a", "b", "c", "d"])
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {"a": "%Y-%m-%d", "b": "%d/%m/%Y", "c": False, "d": "%Y-%m-%d"}
    assert schema.date_format_failures(df, "c")["%Y-%m-%d"] == 3 and jobs() <= 3


@pytest.mark.parametrize("query", ["dates_with_time", "union_splits"])
def test_parts_of_a_table_read_no_join(spark, query):
    assert "Join" not in plan_of(catalog.queries()[query](spark, SF))


def test_power_fit_joins_once_and_scans_rows_once_a_grid(spark, monkeypatch):
    """Rows are not multiplied by the candidates: the scan hands each batch's
    values on once, and the tasks' moments merge to the whole column's."""
    import numpy as np
    from tabforge.catalog import features
    from tabforge.operators.fitted import power
    seen, fit = [], features.fit_power
    monkeypatch.setattr(features, "fit_power", lambda df, *a: seen.append(df) or fit(df, *a))
    catalog.queries()["power_fit"](spark, SF)
    assert len(seen) == 2 and not any("Join" in plan_of(f) for f in seen)
    x = np.random.default_rng(1).normal(0, 2, 3000)
    rows = [(float(v), float(np.exp(v))) for v in x] + [(None, 1e3), (float("nan"), 2e3)]
    df = spark.createDataFrame(rows, "a double, b double").repartition(5)
    y = {"a": x, "b": np.r_[np.exp(x), 1e3, 2e3]}
    grid = {"a": [-1.0, 0.0, 0.7, 2.0], "b": [-0.5, 0.0, 4e-6, 3.0]}
    got = power._evaluate_grid(df, "yeo-johnson", grid)

    def yj(v, lam):
        pos = np.log1p(np.abs(v)) if lam == 0 else np.expm1(lam * np.log1p(np.abs(v))) / lam
        neg = -np.log1p(np.abs(v)) if lam == 2 else -np.expm1((2 - lam) * np.log1p(np.abs(v))) / (2 - lam)
        return np.where(v >= 0, pos, neg)
    for c in grid:
        logs = (np.sign(y[c]) * np.log1p(np.abs(y[c]))).sum()
        want = [(lam - 1) * logs - len(y[c]) / 2 * np.log(yj(y[c], lam).var()) for lam in grid[c]]
        assert [got[c][lam] for lam in grid[c]] == pytest.approx(want, rel=1e-11)


@pytest.mark.parametrize("query", ["mice_two_columns", "mice_impute"])
def test_mice_queries_join_once(spark, query):
    assert "Join" not in plan_of(catalog.queries()[query](spark, SF))


def test_mice_rounds_follow_from_the_patterns(spark, monkeypatch):
    """Same steps as filling the rows round by round, with no rows written;
    a column without a value is left out."""
    import numpy as np
    from tabforge.operators.fitted import mice
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 3)) @ rng.normal(size=(3, 3)) + [1e4, -3.0, 0.0]
    x[rng.random(x.shape) < 0.2] = np.nan
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) + (None,) for r in x]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(3)
    written = []
    monkeypatch.setattr(mice, "checkpoint", lambda f, keep=mice.checkpoint: written.append(f) or keep(f))
    for max_iter in (1, 10):
        got = mice.fit_mice(df, ["a", "b", "c", "d"], max_iter=max_iter)
        assert not written
        base = df.select("a", "b", "c", "d")
        want = mice._fit_by_rows(base, base.columns, max_iter, 1e-3)
        written.clear()
        assert (got.columns, got.n_iter, len(got.steps)) == (want.columns, want.n_iter, len(want.steps))
        assert got.means == pytest.approx(want.means)
        for g, w in zip(got.steps, want.steps):
            assert g[0] == w[0] and np.allclose([*g[1], g[2]], [*w[1], w[2]], rtol=1e-8)


@pytest.mark.parametrize("query", ["gate_scaled", "gold_options"])
def test_gold_chains_share_their_training_rows(spark, monkeypatch, query):
    """Duplicates are dropped once per query, not per fit and per reading."""
    from tabforge.catalog import layers
    from tabforge.plans import layers as plans
    written, read, write, transform = [], [], plans.write_table, plans.GoldModel.transform
    monkeypatch.setattr(plans, "write_table", lambda df, name: written.append(name) or write(df, name))
    monkeypatch.setattr(layers, "write_table", lambda df, name: written.append(name) or write(df, name))

    def seen(self, *a, **k):
        out = transform(self, *a, **k)
        read.append(plan_of(out))
        return out
    monkeypatch.setattr(plans.GoldModel, "transform", seen)
    catalog.queries()[query](spark, SF)
    assert written.count("gold_train_base") == 1
    fitted_on = read if query == "gate_scaled" else read[:1]    # the other reading is of evaluation rows
    assert fitted_on and not any("Aggregate" in p for p in fitted_on)


@pytest.mark.parametrize("strategy", ["standard", "robust", "minmax"])
def test_chain_on_fitted_steps_equals_the_whole_fit(spark, strategy):
    from pyspark.sql import functions as F
    from tabforge.catalog import layers
    from tabforge.plans import layers as plans
    s = layers._silver(spark, SF).where("date < date'1993-01-01'")
    s = s.unionByName(s.limit(50)).withColumn("price", F.when(F.col("travel_code") % 9 != 0, F.col("price")))
    options = dict(is_tree_model=False, outlier_cols=["price", "time"], outlier_handling="winsorize",
                   scaler_cols=["time", "distance"], scaler_strategy=strategy)
    whole, base = plans.fit_gold(s, **options), plans.gold_base(s)
    plain = plans.fit_gold(base, is_tree_model=False, prepared=True)
    short = plans.fit_gold(base, prepared=True, fitted=plain, **options)
    assert plain.scaler is None and whole.final_columns == short.final_columns

    def near(a, b):
        if isinstance(a, dict):
            return a.keys() == b.keys() and all(near(a[k], b[k]) for k in a)
        return a == pytest.approx(b)
    assert near(whole.scaler.params, short.scaler.params) and near(whole.outliers.bounds, short.outliers.bounds)
    rows = lambda df: sorted(tuple(round(v, 6) for v in r) for r in df.collect())
    assert rows(short.transform(s)) == rows(short.transform(base, prepared=True)) == rows(whole.transform(s))


def test_gold_split_drops_training_duplicates_once(spark, monkeypatch):
    from tabforge.catalog import modelling
    from tabforge.plans import layers
    seen, rows = [], layers._gold_rows
    monkeypatch.setattr(layers, "_gold_rows", lambda df: seen.append(df) or rows(df))
    _, _, train, _ = modelling._gold_split(spark, SF)
    assert len(seen) == 2           # training and evaluation rows
    assert train.count() and "Aggregate" not in plan_of(train)


@pytest.mark.parametrize("depth", [4, 9])
def test_tree_contributions_take_tables(spark, monkeypatch, depth):
    """Leaves of few facts are worked out per combination, not per row; the
    others row by row.  Both give the sums over leaves, also for categories
    and missing values."""
    import numpy as np
    from tabforge.operators.model import treeshap
    from tabforge.operators.model.estimators import assemble, make_estimator
    rng = np.random.default_rng(8)
    x = np.c_[rng.normal(size=(600, 8)), rng.integers(0, 6, 600)]
    y = x[:, :8] @ np.arange(1, 9) + np.sin(3 * x[:, 0]) * 5 * x[:, 1] + np.where(np.isin(x[:, 8], [1, 4]), 9, -9)
    feats = [f"f{i}" for i in range(9)]
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], ", ".join(f"{c} double" for c in [*feats, "y"]))
    v = assemble(df, feats, nominal={"f8": 6})
    model = make_estimator("RandomForestRegressor", {"n_estimators": 2, "max_depth": depth, "random_state": 3}, label="y",
                           nominal={"f8": 6}).fit(v)
    nodes, weights = treeshap._node_table(spark, model)
    forest = treeshap._pack(nodes, [0, 1], weights)
    x[5, :8] = np.nan
    widths, shapley = [], treeshap._shapley
    monkeypatch.setattr(treeshap, "_shapley", lambda value, met, z: widths.append(met.shape[1]) or shapley(value, met, z))
    for k in range(2):
        want = np.zeros((9, 600))
        for value, _, conds in forest.leaves(k):
            names = sorted({c[0] for c in conds})
            met, z = np.ones((len(names), 600)), np.ones(len(names))
            for f, left, cut, categories, share in conds:
                inside = x[:, f] <= cut if categories is None else np.isin(x[:, f], categories)
                met[names.index(f)] *= inside if left else ~inside
                z[names.index(f)] *= share
            want[names] += shapley(value, met, z)
        for _ in range(2):          # the second time from kept tables
            got = np.zeros((9, 600))
            treeshap._add_tree(forest, k, x.T.copy(), got)
            assert np.allclose(got, want, atol=1e-9)
    limit = 1 << treeshap.TABLE_BITS
    assert widths and all(w <= limit for w in widths) == (depth == 4)
    widths.clear()
    forest.kept.clear()
    monkeypatch.setattr(treeshap, "TABLE_BYTES", 0)
    treeshap._add_tree(forest, 0, x.T.copy(), np.zeros((9, 600)))
    assert widths and not forest.kept


# --- boosted trees from blocks

def boosting_rows(spark, n=6000):
    import numpy as np
    from tabforge.operators.model.estimators import assemble
    rng = np.random.default_rng(5)
    cat, x = rng.integers(0, 6, n), rng.normal(size=(n, 4))
    x[:, 2], x[:, 3] = rng.integers(0, 5, n), 1.5
    y = 3 * x[:, 0] + np.sin(4 * x[:, 1]) + np.where(np.isin(cat, [1, 4]), 5, -2) + x[:, 2] * x[:, 0] + rng.normal(size=n)
    df = spark.createDataFrame([(*map(float, r), float(c), float(v)) for r, c, v in zip(x, cat, y)],
                               "a double, b double, c double, constant double, cat double, y double").repartition(5)
    return assemble(df, ["a", "b", "c", "constant", "cat"], nominal={"cat": 6})


def shapes(model):
    import re
    number = r"-?\d+\.\d+(?:E-?\d+)?"
    text = model.toDebugString.split("\n", 1)[1]
    return re.sub(number, "#", text), [float(z) for z in re.findall(number, text)]


@pytest.mark.parametrize("options", [{}, {"minInfoGain": 0.02}, {"maxDepth": 1}, {"maxIter": 1}])
def test_boosting_from_blocks_grows_the_same_trees(spark, monkeypatch, options):
    import numpy as np
    from pyspark.ml.regression import GBTRegressor
    from tabforge.operators.model import gbt
    v = boosting_rows(spark)
    options = {"labelCol": "y", "maxIter": 4, "maxDepth": 4, "minInstancesPerNode": 40, "seed": 42, **options}
    want = GBTRegressor(**options).fit(v)
    monkeypatch.setattr(gbt, "LEAST_ROWS", 0)
    monkeypatch.setattr(gbt, "PARTS_AT_ONCE", 2)
    monkeypatch.setattr(gbt, "SUMS_BYTES", 3 * 24 * 150)        # a few nodes a pass
    monkeypatch.setattr(GBTRegressor, "_fit", lambda *a: pytest.fail("MLlib's own fit"))
    got = gbt.BlockGBTRegressor(**options).fit(v)
    assert shapes(got)[0] == shapes(want)[0] and np.allclose(shapes(got)[1], shapes(want)[1], rtol=1e-9)
    assert np.allclose(got.featureImportances.toArray(), want.featureImportances.toArray(), rtol=1e-9)
    assert got.treeWeights == want.treeWeights and got.getStepSize() == want.getStepSize()
    pairs = [[r["prediction"] for r in m.transform(v).orderBy("a", "b").collect()] for m in (got, want)]
    assert np.allclose(*pairs, rtol=1e-9)


def test_boosting_from_blocks_of_one_label_and_in_bundles(spark, monkeypatch, tmp_path):
    from pyspark.ml.regression import GBTRegressionModel
    from tabforge.operators.model import gbt
    from tabforge.operators.model.estimators import make_estimator
    monkeypatch.setattr(gbt, "LEAST_ROWS", 0)
    v = boosting_rows(spark, 300)
    flat = make_estimator("GBTRegressor", {"n_estimators": 3}, label="constant").fit(v)
    assert {r["prediction"] for r in flat.transform(v).collect()} == {1.5}
    model = make_estimator("GBTRegressor", {"n_estimators": 3, "random_state": 1}, label="y", nominal={"cat": 6}).fit(v)
    model.write().save(str(tmp_path / "m"))
    back = GBTRegressionModel.load(str(tmp_path / "m"))
    assert back.toDebugString.split("\n", 1)[1] == model.toDebugString.split("\n", 1)[1]


@pytest.mark.parametrize("params, rows", [({}, 10 ** 6), ({"subsample": 0.5}, 0), ({"colsample": 0.5}, 0)])
def test_boosting_that_stays_with_mllib(spark, monkeypatch, params, rows):
    from tabforge.operators.model import gbt
    from tabforge.operators.model.estimators import make_estimator
    monkeypatch.setattr(gbt, "LEAST_ROWS", rows)
    monkeypatch.setattr(gbt.BlockGBTRegressor, "_fit_blocks", lambda *a: pytest.fail("blocks"))
    v = boosting_rows(spark, 300)
    assert make_estimator("GBTRegressor", {"n_estimators": 2, **params}, label="y", nominal={"cat": 6}).fit(v).getNumTrees == 2


def test_evaluated_predictions_are_written_once(spark, monkeypatch):
    from tabforge.catalog import modelling
    seen, evaluate = [], modelling.metrics.regression_metrics
    monkeypatch.setattr(modelling.metrics, "regression_metrics", lambda df: seen.append(df) or evaluate(df))
    modelling._tree_eval(spark, SF, "LGBMRegressor", {"n_estimators": 1, "max_depth": 2}, categorical=True)
    assert len(seen) == 1 and "Aggregate" not in plan_of(seen[0]) and "UDF" not in plan_of(seen[0])
