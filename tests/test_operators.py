"""Per-operator facts (tiny literal frames, exact expected values)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabforge import session
from tabforge.functions.names import snake_name
from tabforge.operators import dedup, ordinal, profile, schema, splits
from tabforge.operators.fitted.encoder import EncoderModel, fit_encoder, onehot_sparse
from tabforge.operators.fitted.imputer import SimpleImputerModel, fit_simple_imputer
from tabforge.operators.fitted.outlier import OutlierModel, fit_outliers
from tabforge.operators.fitted.power import PowerModel, fit_power
from tabforge.operators.fitted.rare import fit_rare_grouper
from tabforge.operators.fitted.scaler import ScalerModel, fit_scaler
from tabforge.operators.model import metrics
from tabforge.operators.model.metrics import regression_metrics
from tabforge.sources import readers


def test_snake_names():
    assert snake_name("LAST NAME") == "l_a_s_t_n_a_m_e"
    assert snake_name("  First Name  ") == "first_name"
    assert snake_name("travelCode") == "travel_code"
    assert snake_name("Favorite Color") == "favorite_color"


def test_messy_business_key_dedup(spark):
    rows = [("john", "smith", "30", 85.5, "2023-01-10", "blue"),
            ("jane", "doe", "25", 90.0, "2023-01-05", "red"),
            ("john", "smith", "30", 85.5, "2023-01-10", "blue"),
            ("peter", "jones", "40", 75.5, "2022-12-20", "green"),
            ("jane", "doe", "25", 92.0, "2023-01-05", "red"),
            ("sue", "storm", "35", 88.0, "2023-02-01", "blue"),
            ("sue", "storm", "35", 88.0, "2023-02-01", "red")]
    df = spark.createDataFrame(rows, ["  First Name  ", "LAST NAME", "Age", "Score", "Join Date",
                                      "Favorite Color"])
    df = schema.standardize_column_names(df)
    assert df.columns == ["first_name", "l_a_s_t_n_a_m_e", "age", "score", "join_date",
                          "favorite_color"]
    out = dedup.dedup_business_key(df, ["first_name", "l_a_s_t_n_a_m_e", "join_date"],
                                   ["join_date", "score"])
    assert out.count() == 4
    jane = out.where("first_name = 'jane'").collect()[0]
    assert jane["score"] == 90.0          # first by the order columns
    typed = df.withColumn("age", F.col("age").cast("int"))
    plans, _ = schema.plan_types(typed)
    assert {p.column: p.new_type for p in plans}["age"] == "tinyint"


@pytest.mark.parametrize("subset,keep,expected", [
    (None, "first", 5), (["feature_1", "feature_2"], "first", 5), (None, "last", 5),
    (None, False, 4)])
def test_drop_duplicates_counts(spark, subset, keep, expected):
    data = [(1, 10.0, 100.0, "x", True), (2, 20.0, 200.0, "y", False),
            (2, 20.0, 200.0, "y", False), (3, 30.0, 300.0, "z", True),
            (4, 40.0, 300.0, "w", False), (5, 50.0, None, "q", True)]
    df = spark.createDataFrame(data, "feature_1 long, feature_2 double, target double, "
                                     "col_to_drop string, another_col_to_drop boolean")
    assert dedup.drop_duplicates(df, subset, keep).count() == expected


def test_iqr_bounds(spark):
    vals = [1, 50, 52, 55, 58, 60, 62, 65, 68, 70, 150]
    df = spark.createDataFrame([(v,) for v in vals], "col1 long")
    m = fit_outliers(df, ["col1"], "iqr", "trim")
    assert m.bounds["col1"] == [34.0, 86.0]
    assert m.transform(df).count() == 9
    w = OutlierModel("iqr", "winsorize", m.bounds).transform(df)
    assert sorted(r[0] for r in w.collect())[0] == 34.0
    assert OutlierModel.from_json(m.to_json()) == m


def test_scalers(spark):
    df = spark.createDataFrame([(10, 10, 10, 5), (20, 20, 20, 5), (30, 30, 30, 5),
                                (40, 40, 100, 5), (50, 50, 110, 5)], "a long, b long, c long, d long")
    st = fit_scaler(df, ["a", "d"], "standard")
    assert st.params["a"]["center"] == 30.0
    out = st.transform(df).collect()
    assert all(r["d"] == 0.0 for r in out)
    rb = fit_scaler(df, ["c"], "robust")
    vals = sorted(r["c"] for r in rb.transform(df).collect())
    assert vals[0] == pytest.approx(-20 / 80) and 0.0 in vals
    back = rb.inverse(rb.transform(df)).collect()
    assert sorted(r["c"] for r in back) == [10, 20, 30, 100, 110]
    assert ScalerModel.from_json(rb.to_json()) == rb


def test_imputer_mode_tie_and_median(spark):
    df = spark.createDataFrame(
        [(10.0, 5.0, 100.0, "A"), (20.0, 15.0, 200.0, "B"), (None, 25.0, 300.0, "A"),
         (40.0, None, 400.0, None), (50.0, 45.0, None, "B")],
        "n1 double, n2 double, c double, cat string")
    m = fit_simple_imputer(df, {"mean": ["n1"], "median": ["n2"], "mode": ["cat"],
                                "constant": {"c": 0.0}})
    assert m.values["cat"] == "A" and m.values["n2"] == 20.0 and m.values["n1"] == 30.0
    out = m.transform(df)
    assert out.where(F.col("n1").isNull() | F.col("n2").isNull() | F.col("cat").isNull()
                     | F.col("c").isNull()).count() == 0
    with pytest.raises(ValueError):
        fit_simple_imputer(df, {"bogus": ["n1"]})
    assert SimpleImputerModel.from_json(m.to_json()) == m


def test_encoders(spark):
    df = spark.createDataFrame(
        [("Indigo", "BLR", "non-stop", "Economy", 10), ("Air India", "DEL", "1 stop", "Business", 20),
         ("Indigo", "BLR", "1 stop", "Economy", 30), ("Vistara", "BOM", "non-stop", "Premium Economy", 40)],
        "airline string, source string, total_stops string, class string, numeric_col long")
    m = fit_encoder(df, onehot_cols=["airline"], ordinal_cols=["total_stops", "class"],
                    ordinal_mapping={"total_stops": ["non-stop", "1 stop"]})
    out = m.transform(df).collect()
    assert [r["total_stops"] for r in out] == [0.0, 1.0, 1.0, 0.0]
    assert [r["class"] for r in out] == [1.0, 0.0, 1.0, 2.0]
    assert out[0]["airline_Indigo"] == 1.0 and out[0]["airline_Vistara"] == 0.0
    new = spark.createDataFrame([("GoAir", "BLR", "non-stop", "First", 50)], df.schema)
    r = m.transform(new).collect()[0]
    assert r["class"] == -1.0 and r["airline_Indigo"] == 0.0 and r["airline_Vistara"] == 0.0
    bad = spark.createDataFrame([("Indigo", "BLR", "2 stops", "Economy", 1)], df.schema)
    with pytest.raises(Exception):
        m.transform(bad).collect()
    assert EncoderModel.from_json(m.to_json()) == m


def test_rare_grouper(spark):
    city = ["A"] * 10 + ["B"] * 5 + ["C"] * 2 + ["D"]
    country = ["X"] * 15 + ["Y"] * 3
    df = spark.createDataFrame(list(zip(city, country, range(18))), "city string, country string, value long")
    m = fit_rare_grouper(df, ["city", "country"], 0.2)
    assert m.frequent == {"city": ["A", "B"], "country": ["X"]}
    new = spark.createDataFrame([("Z", "Y", 1), (None, "X", 2)], df.schema)
    got = [(r["city"], r["country"]) for r in m.transform(new).collect()]
    assert got == [("Other", "Other"), ("Other", "X")]


def test_power_roundtrip_and_boxcox_rejects(spark):
    rng = np.random.default_rng(42)
    pos = rng.lognormal(size=100)
    mixed = rng.normal(size=100)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(pos, mixed)],
                               "col_pos double, col_mixed double")
    yj = fit_power(df, ["col_pos", "col_mixed"], "yeo-johnson")
    back = yj.inverse(yj.transform(df)).collect()
    assert np.allclose([r["col_pos"] for r in back], pos)
    assert np.allclose([r["col_mixed"] for r in back], mixed)
    # lambda equals the maximiser of the same likelihood found by brute force
    x = pos
    grid = np.linspace(-3, 3, 60001)

    def llf(lam):
        t = np.log(x) if abs(lam) < 1e-12 else (x ** lam - 1) / lam
        return (lam - 1) * np.log(x).sum() - len(x) / 2 * np.log(t.var())
    best = grid[np.argmax([llf(v) for v in grid])]
    bc = fit_power(df, ["col_pos"], "box-cox")
    assert abs(bc.lambdas["col_pos"] - best) < 1e-3
    assert PowerModel.from_json(bc.to_json()) == bc
    bad = spark.createDataFrame([(1,), (2,), (0,), (-1,), (5,)], "col_non_pos long")
    with pytest.raises(ValueError):
        fit_power(bad, ["col_non_pos"], "box-cox")


def test_metrics_pinned(spark):
    df = spark.createDataFrame([(100, 110), (150, 145), (200, 210), (250, 240)],
                               "y_true long, y_pred long")
    m = regression_metrics(df).collect()[0]
    assert m["mae"] == 8.75 and m["mse"] == 81.25 and m["median_ae"] == 10.0
    assert m["max_error"] == 10.0 and round(m["r2"], 3) == 0.974


def test_split_fraction_70_15_15(spark):
    import datetime
    import random
    days = [datetime.date(2023, 1, 1) + datetime.timedelta(days=i) for i in range(100)]
    random.Random(0).shuffle(days)
    df = spark.createDataFrame([(d, i) for i, d in enumerate(days)], "date date, feature long")
    s = splits.split_by_fraction(df, "date", ["feature"])
    sizes = splits.split_sizes(s)
    assert sizes == {"train": 70, "validation": 15, "test": 15}
    agg = {r["split"]: (r["lo"], r["hi"]) for r in
           s.groupBy("split").agg(F.min("date").alias("lo"), F.max("date").alias("hi")).collect()}
    assert agg["train"][1] < agg["validation"][0] <= agg["validation"][1] < agg["test"][0]


def test_split_fraction_ties_inside_a_date(spark):
    # a single date holding most rows: the cut falls inside it
    rows = [(1, "2020-01-01")] * 3 + [(i, "2020-01-02") for i in range(3, 90)] + \
           [(i, "2020-01-03") for i in range(90, 100)]
    df = spark.createDataFrame(rows, "k long, d string").withColumn("date", F.to_date("d"))
    df = df.withColumn("k", F.monotonically_increasing_id())
    s = splits.split_by_fraction(df, "date", ["k"])
    assert splits.split_sizes(s) == {"train": 70, "validation": 15, "test": 15}
    tr = s.where("split = 'train'").agg(F.max("k")).collect()[0][0]
    va = s.where("split = 'validation'").agg(F.min("k")).collect()[0][0]
    assert tr < va


def test_ordinal_partition_invariance(spark):
    base = spark.range(0, 5000).withColumn("v", (F.col("id") * 7919) % 1000)
    a = ordinal.with_global_ordinal(base.repartition(1), ["v", "id"]).select("id", "ordinal")
    b = ordinal.with_global_ordinal(base.repartition(7), ["v", "id"], num_partitions=5) \
        .select("id", "ordinal")
    assert sorted(a.collect()) == sorted(b.collect())
    got = sorted(r["ordinal"] for r in a.collect())
    assert got == list(range(5000))


def test_quantiles_match_numpy_with_hot_value(spark):
    rng = np.random.default_rng(1)
    vals = np.concatenate([rng.normal(size=3000), np.full(1500, 0.25)])
    df = spark.createDataFrame([(float(v), "g" if i % 3 else "h") for i, v in enumerate(vals)],
                               "x double, grp string")
    q = ordinal.quantile_map(df, ["x"], [0.1, 0.25, 0.5, 0.9])
    for p, v in q["x"].items():
        assert v == pytest.approx(np.quantile(vals, p), abs=1e-12)
    by = ordinal.exact_quantiles(df, ["x"], [0.5], ["grp"]).collect()
    grp = np.array(["g" if i % 3 else "h" for i in range(len(vals))])
    for r in by:
        assert r["value"] == pytest.approx(np.median(vals[grp == r["grp"]]), abs=1e-12)


def test_mode_smallest_on_tie(spark):
    df = spark.createDataFrame([("A",), ("B",), ("A",), (None,), ("B",)], "c string")
    assert ordinal.mode_values(df, ["c"]) == {"c": "A"}


def test_skew_and_histogram(spark):
    vals = [1.0, 2.0, 2.0, 3.0, 10.0, 11.0, 40.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    s = profile.skewness(df, ["x"]).collect()[0]["skew"]
    n = len(vals)
    m = np.mean(vals)
    g1 = np.mean((np.array(vals) - m) ** 3) / np.mean((np.array(vals) - m) ** 2) ** 1.5
    assert s == pytest.approx(g1 * math.sqrt(n * (n - 1)) / (n - 2))
    h = {r["bin"]: r["count"] for r in profile.histogram(df, "x", 40).collect()}
    assert sum(h.values()) == 7 and h[40] == 1


def test_time_series_folds():
    f = splits.time_series_folds(100, 5)
    assert [(x.train_end, x.test_start, x.test_end) for x in f] == \
        [(20, 20, 36), (36, 36, 52), (52, 52, 68), (68, 68, 84), (84, 84, 100)]
    g = splits.time_series_folds(100, 3, max_train_size=10, gap=2)
    assert g[0].train_start == 13 and g[0].train_end == 23


def test_zip_scan_reads_first_member_per_archive(spark, tmp_path):
    import io
    import zipfile
    import pandas as pd
    from tabforge.sources.readers import load_data
    d = tmp_path / "zips.zip"
    d.mkdir()
    for k in range(3):
        buf = io.StringIO()
        pd.DataFrame({"col_a": [k * 10 + i for i in range(4)], "col_b": [4.0, 5.0, 6.0, 7.0],
                      "col_c": list("xyzw")}).to_csv(buf, index=False)
        with zipfile.ZipFile(d / f"part{k}.zip", "w") as z:
            z.writestr("readme.txt", "not data")
            z.writestr("data.csv", buf.getvalue())
            z.writestr("other.csv", "col_a,col_b,col_c\n99,9.0,q\n")
    df = load_data(spark, str(d))
    rows = sorted(tuple(r) for r in df.collect())
    assert len(rows) == 12 and rows[0] == (0, 4.0, "x")
    assert load_data(spark, str(tmp_path / "missing.csv")) is None
    assert load_data(spark, str(tmp_path / "x.xlsx")) is None


def test_contract_on_stream(spark, tmp_path):
    from tabforge.operators.schema import Contract
    from tabforge.streaming.scoring import contract_stream
    src = tmp_path / "in"
    spark.createDataFrame([("A", 1.0), ("Z", 2.0), ("N", -1.0)], "t string, x double") \
        .write.parquet(str(src))
    stream = spark.readStream.schema("t string, x double").parquet(str(src))
    c = Contract(enums={"t": ["A", "N"]}, positive=("x",))
    q = (contract_stream(stream, c).writeStream.format("memory").queryName("contract_out")
         .outputMode("append").start())
    q.processAllAvailable()
    q.stop()
    got = {r["t"]: list(r["violations"]) for r in spark.sql("select * from contract_out").collect()}
    assert got == {"A": [], "Z": ["t:not_allowed"], "N": ["x:not_positive"]}


def test_imputer_fractional_median_widens_int_column(spark):
    df = spark.createDataFrame([(1,), (2,), (None,), (3,), (4,)], "k int")
    m = fit_simple_imputer(df, {"median": ["k"]})
    out = m.transform(df)
    assert dict(out.dtypes)["k"] == "double"
    assert sorted(r["k"] for r in out.collect()) == [1.0, 2.0, 2.5, 3.0, 4.0]


def test_quantiles_of_groups_and_hot_values(spark):
    rng = np.random.default_rng(9)
    rows = [(float(v), int(i % 40) if i % 41 else None) for i, v in enumerate(rng.normal(size=3000))]
    rows += [(0.5, 7)] * 4000 + [(None, 7), (float("nan"), 8)]
    df = spark.createDataFrame(rows, "x double, g int")
    probs = [0.0, 0.25, 0.5, 0.99, 1.0]
    got = {(r["g"], r["prob"]): r["value"] for r in ordinal.exact_quantiles(df, ["x"], probs, ["g"]).collect()}
    groups = {}
    for x, g in rows:
        if x is not None and x == x:
            groups.setdefault(g, []).append(x)
    assert len(got) == len(groups) * len(probs)
    assert all(got[g, p] == pytest.approx(np.quantile(v, p), abs=1e-12) for g, v in groups.items() for p in probs)


def test_encoder_code_tables_of_two_fits_do_not_meet(spark, tmp_path):
    df = spark.createDataFrame([(c, c.upper()) for c in "dbacbdxa"], "c string, d string")
    first = fit_encoder(df, ordinal_cols=["c", "d"], table_dir=str(tmp_path))
    fit_encoder(df.where("c > 'a'"), ordinal_cols=["c", "d"], table_dir=str(tmp_path))
    assert first.auto_sizes == {"c": 5, "d": 5}
    new = spark.createDataFrame([("a", "A"), ("x", None), ("zz", "B"), (None, "X")], "c string, d string")
    assert sorted(map(tuple, first.transform(new).collect()), key=str) == sorted(
        [(0.0, 0.0), (4.0, None), (-1.0, 1.0), (None, 4.0)], key=str)


def test_onehot_of_a_wide_domain(spark, tmp_path):
    df = spark.createDataFrame([(f"v{i:04d}",) for i in range(300)], "c string")
    m = fit_encoder(df, onehot_cols=["c"])
    assert len(m.onehot["c"]) == 300
    codes = fit_encoder(df, ordinal_cols=["c"], table_dir=str(tmp_path))
    new = spark.createDataFrame([("v0007",), ("other",), (None,)], "c string")
    got = {r["c"]: r["c_onehot"] for r in onehot_sparse(new, "c", codes).collect()}
    assert got["v0007"].size == 300 and got["v0007"].indices == [7] and got["v0007"]["values"] == [1.0]
    assert got["other"].indices == [] and got[None].indices == []


def test_power_lambda_outside_the_first_bracket(spark):
    rng = np.random.default_rng(3)
    x = 100 + 5 * np.abs(rng.beta(9, 1.2, 4000))
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    lam = fit_power(df, ["x"], "box-cox").lambdas["x"]
    grid = np.linspace(-20, 400, 8401)
    grid = grid[np.abs(grid) > 1e-9]
    z = x / x.mean()
    llf = [(g - 1) * np.log(z).sum() - len(z) / 2 * np.log(np.var((z ** g - 1) / g)) for g in grid]
    assert lam == pytest.approx(grid[int(np.argmax(llf))], abs=0.1) and abs(lam) > 4.5


def test_constant_label_and_constant_column(spark):
    df = spark.createDataFrame([(5.0, 5.0), (5.0, 6.0)], "y_true double, y_pred double")
    assert metrics.regression_metrics(df).first()["r2"] == 0.0
    same = df.withColumn("y_pred", df["y_true"])
    assert metrics.regression_metrics(same).first()["r2"] == 1.0
    c = {(r["col_a"], r["col_b"]): r["corr"] for r in profile.corr_matrix(df).collect()}
    assert c["y_true", "y_pred"] is None and c["y_true", "y_true"] is None and c["y_pred", "y_pred"] == 1.0


def test_malformed_csv_rows_are_kept(spark, tmp_path):
    f = tmp_path / "x.csv"
    f.write_text("a,b\n1,2\nxx,3\n4,5,6,7\n")
    good, bad = readers.split_corrupt(readers.read_csv(spark, str(f), "a int, b int"))
    assert [tuple(r) for r in good.collect()] == [(1, 2)]
    assert sorted(r["_corrupt"] for r in bad.collect()) == ["4,5,6,7", "xx,3"]
    with pytest.raises(Exception):
        readers.load_data(spark, str(f), "a int, b int").collect()


def test_shipped_zip_holds_every_subpackage(tmp_path):
    import subprocess
    import sys
    z = session.build_zip(str(tmp_path / "p.zip"))
    code = ("import sys; sys.path.insert(0, sys.argv[1]); "
            "import tabforge.operators.fitted.iforest, tabforge.operators.model.treeshap, "
            "tabforge.operators.quality.rules, tabforge.plans.scoring; "
            "assert 'p.zip' in tabforge.operators.fitted.iforest.__file__")
    subprocess.run([sys.executable, "-c", code, z], cwd=tmp_path, check=True, timeout=120)


def test_weighted_prefix_below_a_union(spark):
    df = spark.createDataFrame([(i, i % 5 + 1) for i in range(50)], "k int, w int")
    out = ordinal.weighted_prefix(df, ["k"], "w", num_partitions=4)
    twice = out.unionByName(out).collect()
    want, acc = {}, 0
    for i in range(50):
        want[i] = acc
        acc += i % 5 + 1
    assert len(twice) == 100 and all(r["before"] == want[r["k"]] for r in twice)


def test_split_by_dates_strict_bounds(spark, caplog):
    import datetime
    df = spark.createDataFrame([(datetime.date(2020, 1, d),) for d in range(1, 11)], "date date")
    out = splits.split_by_dates(df, "date", "2020-01-03", "2020-01-06", "2020-01-20",
                                warn_empty=True)
    assert splits.split_sizes(out) == {"train": 3, "validation": 3, "test": 4}
    assert "holdout" in caplog.text
    with pytest.raises(ValueError):
        splits.split_by_dates(df, "date", "2020-13-01", "2020-01-06")
    with pytest.raises(ValueError):
        splits.split_by_dates(df, "date", "2020-01-06", "2020-01-03")


def test_weighted_prefix_matches_cumsum(spark):
    import pandas as pd
    rng = np.random.default_rng(8)
    keys = rng.permutation(500)
    w = rng.integers(0, 50, 500)
    df = spark.createDataFrame([(int(k), int(x)) for k, x in zip(keys, w)], "k long, w long")
    out, total = ordinal.weighted_prefix(df, ["k"], "w", "before", num_partitions=6,
                                         return_total=True)
    got = out.toPandas().sort_values("k")
    want = pd.DataFrame({"k": keys, "w": w}).sort_values("k")
    assert total == int(w.sum())
    assert got["before"].tolist() == (want["w"].cumsum() - want["w"]).tolist()
