"""Scalar expression facts."""

import datetime
import math

from pyspark.sql import functions as F

from tabforge.functions.dates import date_features, parse_date, spark_pattern
from tabforge.functions.numeric import clip, cyclical, safe_divide
from tabforge.functions.strings import interaction


def test_date_pattern_and_lenient_parse(spark):
    assert spark_pattern("%Y-%m-%d") == "yyyy-M-d"
    df = spark.createDataFrame([("2023-1-5",), ("2023-01-05",), ("05/01/2023",), (None,)], "t string")
    got = [r[0] for r in df.select(parse_date("t", "%Y-%m-%d")).collect()]
    assert got[:2] == [datetime.date(2023, 1, 5)] * 2 and got[2] is None and got[3] is None


def test_date_features_iso_week_and_weekday(spark):
    df = spark.createDataFrame([(datetime.date(2021, 1, 3),), (datetime.date(2024, 2, 29),)], "date date")
    r = df.select(*[e.alias(k) for k, e in date_features("date").items()]).collect()
    assert r[0]["week_of_year"] == 53 and r[0]["day_of_week"] == 6      # Sunday
    assert r[1]["day_of_year"] == 60 and r[1]["day_of_week"] == 3       # Thursday


def test_numeric_helpers(spark):
    df = spark.createDataFrame([(3.0, 0.0), (None, 2.0), (12.0, 4.0)], "a double, b double")
    out = df.select(safe_divide("a", "b").alias("q"), clip("a", 1.0, 10.0).alias("c"),
                    *[x.alias(n) for x, n in zip(cyclical(F.lit(3), 12), ["s", "co"])]).collect()
    assert out[0]["q"] == 3.0 / 1e-6 and out[1]["q"] is None and out[2]["q"] == 3.0
    assert [r["c"] for r in out] == [3.0, None, 10.0]
    assert math.isclose(out[0]["s"], 1.0) and abs(out[0]["co"]) < 1e-12


def test_interaction_writes_nan_for_null(spark):
    df = spark.createDataFrame([("a", None), ("b", "x")], "p string, q string")
    assert [r[0] for r in df.select(interaction(["p", "q"])).collect()] == ["a_nan", "b_x"]
