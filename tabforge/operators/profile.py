"""Profiling and aggregation operators.

Rule: every statistic of one profile is part of *one* aggregation (plus
the distributed quantile / mode jobs where exact order statistics are
asked for).  Outputs are small DataFrames (one row per column or group).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import write_table
from .ordinal import exact_quantiles, long_values, modes

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
            T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


# --- A1 ----------------------------------------------------------------------

def group_stats(df: DataFrame, by: Sequence[str], value: str,
                with_median: bool = True) -> DataFrame:
    """A1: per group mean / sum / count / any-nonzero, plus exact median.

    Mean/sum/count are one partial aggregation; the median comes from the
    distributed quantile operator and is joined back on the (small) group
    key table."""
    by = list(by)
    v = F.col(value).cast("double")
    base = df.groupBy(*by).agg(
        F.avg(v).alias(f"mean_{value}"),
        F.sum(v).alias(f"sum_{value}"),
        F.count(v).alias(f"count_{value}"),
        F.max((F.coalesce(v, F.lit(0.0)) != 0).cast("int")).cast("boolean").alias(f"any_{value}"),
    )
    if not with_median:
        return base
    med = (exact_quantiles(df, [value], [0.5], by)
           .select(*by, F.col("value").alias(f"median_{value}")))
    return base.join(med, by, "left")


def group_mode(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """A1 mode per group: most frequent value, smallest on ties."""
    return modes(df, value, by).withColumnRenamed("mode", f"mode_{value}")


# --- A2 ----------------------------------------------------------------------

def value_counts(df: DataFrame, c: str, sort: str = "desc", top_n: int | None = None,
                 normalize: bool = False, dropna: bool = False) -> DataFrame:
    """A2: counts per value, NULL kept as its own value unless ``dropna``.

    ``sort``: ``desc`` (count, ties by value), ``asc`` or ``key``.  A top-n
    is the feature here: ``orderBy + limit`` plans a TakeOrderedAndProject
    (per-partition top-n, one small merge)."""
    src = df.where(F.col(c).isNotNull()) if dropna else df
    out = src.groupBy(c).agg(F.count(F.lit(1)).alias("count"))
    if normalize:
        total = src.count()  # one number to the driver
        out = out.withColumn("share", F.col("count") / F.lit(max(total, 1)))
    if sort == "desc":
        order = [F.col("count").desc(), F.col(c).asc_nulls_first()]
    elif sort == "asc":
        order = [F.col("count").asc(), F.col(c).asc_nulls_first()]
    else:
        order = [F.col(c).asc_nulls_first()]
    out = out.orderBy(*order)
    return out.limit(top_n) if top_n else out


# --- A3 ----------------------------------------------------------------------

def missing_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A3: ``(column, n_missing, pct_missing)``; NaN counts as missing."""
    cols = list(columns or df.columns)
    float_cols = {f.name for f in df.schema.fields
                  if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    aggs = [F.count(F.lit(1)).alias("__n")]
    for c in cols:
        miss = F.col(c).isNull() | F.isnan(c) if c in float_cols else F.col(c).isNull()
        aggs.append(F.count_if(miss).alias(c))
    wide = df.agg(*aggs)
    long = wide.unpivot(["__n"], cols, "column", "n_missing")
    return long.select("column", F.col("n_missing").cast("long").alias("n_missing"),
                       (F.col("n_missing") * 100.0 / F.greatest(F.col("__n"), F.lit(1)))
                       .alias("pct_missing"))


# --- A4 / A5 / A10 -----------------------------------------------------------

def _moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, count, mean, std, min, max, skew) in one aggregation."""
    n = F.col("count").cast("double")
    skew = F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    return long_values(df, cols).groupBy("column").agg(
        F.count(F.lit(1)).alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"), F.skewness("value").alias("g1")).withColumn("skew", skew).drop("g1")


def _with_quantiles(moments: DataFrame, df: DataFrame, cols: Sequence[str], quantiles: Sequence[float]) -> DataFrame:
    q = exact_quantiles(df, cols, quantiles)
    qw = q.groupBy("column").pivot("prob", [float(p) for p in quantiles]).agg(F.first("value"))
    qw = qw.toDF("column", *[f"p{int(round(p * 100))}" for p in quantiles])
    return moments.join(qw, "column", "left")


def numeric_describe(df: DataFrame, columns: Sequence[str] | None = None,
                     quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """A4 numeric ``describe``: count, mean, sample std, min, quantiles, max,
    one row per column.  Moments in one aggregation over the long form;
    quantiles exact and distributed."""
    cols = list(columns or numeric_columns(df))
    return _with_quantiles(_moments(df, cols).drop("skew"), df, cols, quantiles)


def categorical_describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A4 categorical ``describe``: count, unique, top (most frequent,
    smallest on ties), freq."""
    cols = list(columns or string_columns(df))
    long = (df.select(*[F.col(c).cast("string").alias(c) for c in cols])
            .unpivot([], cols, "column", "value").where(F.col("value").isNotNull()))
    base = long.groupBy("column").agg(F.count(F.lit(1)).alias("count"),
                                      F.count_distinct("value").alias("unique"))
    top = modes(long, "value", ["column"]).withColumnRenamed("mode", "top") \
        .withColumnRenamed("mode_count", "freq")
    return base.join(top, "column", "left")


def nunique(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """A4: distinct non-null values per column."""
    cols = list(columns or df.columns)
    f = F.count_distinct if exact else F.approx_count_distinct
    wide = df.agg(*[f(F.col(c)).alias(c) for c in cols])
    return wide.unpivot([], cols, "column", "n_unique")


def unique_values(df: DataFrame, c: str) -> DataFrame:
    """A4 unique list, kept distributed: one row per distinct value."""
    return df.select(c).distinct()


def skewness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A5: bias-corrected sample skewness (pandas ``skew``):
    ``g1 * sqrt(n(n-1)) / (n-2)``."""
    cols = list(columns or numeric_columns(df))
    return _moments(df, cols).select("column", "skew")


def profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A10: one table per column: type, rows, nulls, distinct, min, max,
    mean, std, skew, quartiles and the top value; NaN counts as missing.

    Three scans: one counts the distinct values of all columns (missing,
    distinct and top values follow from that written table), one takes the
    moments, one the quantiles."""
    cols = list(columns or df.columns)
    spark = df.sparkSession
    kinds = {f.name: f.dataType for f in df.schema.fields}
    num = [c for c in cols if isinstance(kinds[c], _NUMERIC)]
    plain = [F.nanvl(F.col(c), F.lit(None).cast(kinds[c])) if isinstance(kinds[c], (T.FloatType, T.DoubleType)) else F.col(c)
             for c in cols]
    counts = write_table(
        df.select(*[x.cast("string").alias(c) for x, c in zip(plain, cols)]).unpivot([], cols, "column", "value")
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")), "profile_values")
    known = F.col("value").isNotNull()
    of = counts.groupBy("column").agg(
        F.sum("n").alias("rows"), F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("n_missing"),
        F.count("value").alias("n_unique"),
        F.min(F.when(known, F.struct((-F.col("n")).alias("neg"), F.col("value").alias("value")))).alias("best"))
    t = spark.createDataFrame([(c, kinds[c].simpleString()) for c in cols], "column string, dtype string")
    zero = F.lit(0).cast("long")
    out = t.join(of, "column", "left").select(
        "column", "dtype", F.coalesce("n_missing", zero).alias("n_missing"),
        (F.coalesce("n_missing", zero) * 100.0 / F.greatest(F.coalesce("rows", zero), F.lit(1))).alias("pct_missing"),
        F.coalesce("n_unique", zero).alias("n_unique"), F.col("best.value").alias("top"),
        (-F.col("best.neg")).alias("top_freq"))
    if num:
        out = out.join(_with_quantiles(_moments(df, num).drop("count"), df, num, (0.25, 0.5, 0.75)), "column", "left")
    return out


# --- A6 ----------------------------------------------------------------------

CONSTANT = 1e-13            # share of the squares that rounding may leave
HEAD_ROWS = 1000            # in which each column's shift is looked for


def corr_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation for every pair, pairwise-complete like pandas
    (NULL and NaN are missing).  Long output ``(col_a, col_b, corr)`` with both
    orders and the diagonal; NULL where a column is constant over the pair's
    complete rows.

    One scan for any number of columns: tasks sum four matrices over their
    Arrow batches - rows, sums, squares and products over the rows that a pair
    has in common - and the matrices are summed cell by cell on Spark.  Values
    are shifted by one of their column first, so sums stay exact to rounding."""
    cols = list(columns or numeric_columns(df))
    spark, out = df.sparkSession, "col_a string, col_b string, corr double"
    p = len(cols)
    rows = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(cols)])
    head = rows.limit(HEAD_ROWS).toPandas().to_numpy(float)
    if not cols or not len(head):
        return spark.createDataFrame([(a, b, None) for a in cols for b in cols], out)
    shift = np.array([next((v for v in x if np.isfinite(v)), np.nan) for x in head.T])
    late = [i for i in range(p) if np.isnan(shift[i])]
    if late:        # columns that start with many missing values
        means = rows.agg(*[F.avg(F.when(~F.isnan(f"v{i}"), F.col(f"v{i}"))).alias(f"v{i}") for i in late]).first()
        for i in late:
            shift[i] = means[f"v{i}"] if means[f"v{i}"] is not None and np.isfinite(means[f"v{i}"]) else 0.0

    def run(batches):
        sums = np.zeros((4, p, p))
        for b in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]).astype(float) - shift
            m = ~np.isnan(x)
            x = np.where(m, x, 0.0)
            m = m.astype(float)
            sums += [m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x]
        i, j = np.indices((p, p)).reshape(2, -1).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i), pa.array(j), *(pa.array(s.reshape(-1)) for s in sums)], names=["i", "j", "n", "s", "q", "c"])

    n, s, q, c = np.zeros((4, p, p))
    for r in rows.mapInArrow(run, "i int, j int, n double, s double, q double, c double").groupBy("i", "j").agg(
            *[F.sum(k).alias(k) for k in "nsqc"]).collect():
        at = r["i"], r["j"]
        n[at], s[at], q[at], c[at] = r["n"], r["s"], r["q"], r["c"]
    rows_in = np.maximum(n, 1.0)
    var = q - s * s / rows_in               # of column i over the rows that i and j have
    cov = c - s * s.T / rows_in
    var = np.where(var > CONSTANT * q, var, 0.0)
    data = []
    for i in range(p):
        for j in range(p):
            spread = float(np.sqrt(var[i, j]) * np.sqrt(var[j, i]))
            data.append((cols[i], cols[j], None if not spread else 1.0 if i == j else float(cov[i, j]) / spread))
    return spark.createDataFrame(data, out)


# --- A7 ----------------------------------------------------------------------

def box_stats(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (),
              whisker: float = 1.5) -> DataFrame:
    """q1, median, q3, iqr, min, max and the ``whisker*IQR`` fences per
    column (and per ``by`` group)."""
    by = list(by)
    q = exact_quantiles(df, columns, [0.25, 0.5, 0.75], by)
    qw = (q.groupBy(*by, "column").pivot("prob", [0.25, 0.5, 0.75]).agg(F.first("value"))
          .toDF(*by, "column", "q1", "median", "q3"))
    mm = long_values(df, columns, by).groupBy(*by, "column").agg(
        F.min("value").alias("min"), F.max("value").alias("max"))
    out = qw.join(mm, [*by, "column"])
    iqr = F.col("q3") - F.col("q1")
    return out.select(*by, "column", "q1", "median", "q3", iqr.alias("iqr"), "min", "max",
                      (F.col("q1") - whisker * iqr).alias("lower_fence"),
                      (F.col("q3") + whisker * iqr).alias("upper_fence"))


# --- A8 ----------------------------------------------------------------------

def histogram(df: DataFrame, c: str, bins: int = 40) -> DataFrame:
    """Equal-width bins over [min, max]; the max lands in the last bin.
    Every bin has a row, also an empty one; a column without values has no
    bins.  Two jobs: min/max, then ``width_bucket`` counts."""
    mm = df.agg(F.min(c).alias("lo"), F.max(c).alias("hi")).collect()[0]
    lo, hi = mm["lo"], mm["hi"]
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, lower double, upper double, count long")
    lo, hi = float(lo), float(hi)
    if hi == lo:
        lo, hi = lo - 0.5, hi + 0.5  # numpy widens a zero-width range
    width = (hi - lo) / bins
    b = F.least(F.width_bucket(F.col(c).cast("double"), F.lit(lo), F.lit(hi), F.lit(bins)),
                F.lit(bins))
    counts = df.where(F.col(c).isNotNull()).groupBy(b.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("count"))
    at = F.col("bin")
    return bin_spine(df.sparkSession, bins).join(counts, "bin", "left").select(
        "bin", (F.lit(lo) + (at - 1) * F.lit(width)).alias("lower"), (F.lit(lo) + at * F.lit(width)).alias("upper"),
        F.coalesce("count", F.lit(0)).alias("count"))


def bin_spine(spark, bins: int) -> DataFrame:
    """Every bin number from 1."""
    return spark.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))


# --- A9 ----------------------------------------------------------------------

def date_stats(df: DataFrame, c: str = "date") -> DataFrame:
    """Min, max, span in days, distinct days, distinct year-months (one
    aggregation).  Unparsable dates (NULL) are ignored."""
    d = F.col(c)
    return df.agg(F.min(d).alias("min_date"), F.max(d).alias("max_date"),
                  F.datediff(F.max(d), F.min(d)).cast("long").alias("span_days"),
                  F.count_distinct(d).alias("unique_days"),
                  F.count_distinct(F.date_format(d, "yyyy-MM")).alias("unique_year_months"))


def date_counts(df: DataFrame, c: str = "date", part: str = "year") -> DataFrame:
    """Rows per year / month / year-month."""
    d = F.col(c)
    key: Column = {"year": F.year(d), "month": F.month(d),
                   "year_month": F.date_format(d, "yyyy-MM")}[part]
    return df.where(d.isNotNull()).groupBy(key.alias(part)).agg(F.count(F.lit(1)).alias("count"))


# --- A11 ---------------------------------------------------------------------

DATE_SHARE = 0.8


def eda_type_plan(df: DataFrame) -> DataFrame:
    """EDA variant of type narrowing.  Text that parses as a date in at
    least 80% of rows is a date, otherwise category below the 0.5 distinct
    ratio; integers get the smallest signed type that holds their range (Spark
    has no unsigned types); floats float32
    when lossless within 5e-4.  One aggregation."""
    from .schema import plan_types
    plans, stats = plan_types(df)
    texts = string_columns(df)
    rows = stats["__rows"] or 0
    share = {}
    if texts and rows:
        r = df.agg(*[F.count_if(F.try_to_timestamp(F.col(c)).isNotNull()).alias(c)
                     for c in texts]).collect()[0]
        share = {c: r[c] / rows for c in texts}
    data = []
    for p in plans:
        new = p.new_type
        if p.column in share and share[p.column] >= DATE_SHARE:
            new = "date"
        data.append((p.column, p.old_type, new))
    return df.sparkSession.createDataFrame(data, "column string, old_type string, new_type string")

