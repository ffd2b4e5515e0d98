"""Catalogue: schema operators (P), de-duplication (U), profiling (A)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import dedup, profile, schema
from ..operators.quality.suites import SILVER_KEY
from ..plans import config as C
from ..session import ensure_checkpoint_dir, write_table
from ..sources.tables import flights, flights_with_nulls, raw_flights
from .base import TIE, r, register, with_flights

KEY_SQL = ", ".join(SILVER_KEY)
FLIGHT_COLS = ("travel_code, user_code, from_location, to_location, flight_type, price, time, "
               "distance, agency, date, line_number, part_key, supp_key")
NUM3 = ["price", "time", "distance"]
CAT4 = ["from_location", "to_location", "flight_type", "agency"]


# --- P1 / P2 -----------------------------------------------------------------

@register("rename_snake", "P1 P2", with_flights(
    "SELECT travel_code, user_code, from_location, to_location, flight_type, price, time, "
    "distance, agency, strftime(date, '%Y-%m-%d') AS date, line_number, part_key, supp_key "
    "FROM flights"))
def q_rename_snake(spark, sf):
    df = schema.rename_columns(raw_flights(spark, sf), C.COLUMN_RENAME_MAPPING)
    return schema.standardize_column_names(df)


# --- P4 ----------------------------------------------------------------------

def _narrow_sql(c, old):
    if old in ("bigint", "int"):
        return (f"SELECT '{c}' AS column, '{old}' AS old_type, CASE "
                f"WHEN min({c}) >= -128 AND max({c}) <= 127 THEN 'tinyint' "
                f"WHEN min({c}) >= -32768 AND max({c}) <= 32767 THEN 'smallint' "
                f"WHEN min({c}) >= -2147483648 AND max({c}) <= 2147483647 THEN 'int' "
                f"ELSE 'bigint' END AS new_type FROM r")
    if old == "double":
        return (f"SELECT '{c}', 'double', CASE WHEN max(abs(CAST(CAST({c} AS FLOAT) AS DOUBLE) - "
                f"{c})) <= 0.0005 THEN 'float' ELSE 'double' END FROM r")
    if old == "date":
        return f"SELECT '{c}', 'string', 'date'"
    return (f"SELECT '{c}', 'string', CASE WHEN CAST(count(DISTINCT {c}) AS DOUBLE) / count(*) "
            f"< 0.5 THEN 'category' ELSE 'string' END FROM r")


_P4_COLS = [("travel_code", "bigint"), ("user_code", "bigint"), ("from_location", "string"),
            ("to_location", "string"), ("flight_type", "string"), ("price", "double"),
            ("time", "double"), ("distance", "double"), ("agency", "string"), ("date", "date"),
            ("line_number", "int"), ("part_key", "bigint"), ("supp_key", "bigint")]


@register("type_narrowing_report", "P4 A11", with_flights(
    "\nUNION ALL\n".join(_narrow_sql(c, t) for c, t in _P4_COLS),
    extra="r AS (SELECT * FROM flights)"))
def q_type_report(spark, sf):
    df = schema.standardize_column_names(
        schema.rename_columns(raw_flights(spark, sf), C.COLUMN_RENAME_MAPPING))
    plans, _ = schema.plan_types(df, date_cols=["date"])
    return schema.type_report(df, plans)


# --- P5 ----------------------------------------------------------------------

_FMT_VIEWS = {"iso": "yyyy-MM-dd", "us": "MM/dd/yyyy", "eu": "dd/MM/yyyy", "ymd_slash": "yyyy/MM/dd"}
_DUCK_FMT = {"iso": "%Y-%m-%d", "us": "%m/%d/%Y", "eu": "%d/%m/%Y", "ymd_slash": "%Y/%m/%d"}


def _pick_sql(col):
    fmts = ["%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y", "%Y/%m/%d"]
    whens = " ".join(
        f"WHEN count_if(try_strptime({col}, '{f}') IS NULL AND {col} IS NOT NULL) = 0 THEN '{f}'"
        for f in fmts)
    return f"SELECT '{col}' AS column, CASE {whens} ELSE 'none' END AS picked_format FROM t"


@register("date_format_pick", "P5", with_flights(
    "\nUNION ALL\n".join(_pick_sql(c) for c in _FMT_VIEWS),
    extra="t AS (SELECT " + ", ".join(
        f"strftime(date, '{_DUCK_FMT[k]}') AS {k}" for k in _FMT_VIEWS) + " FROM flights)"))
def q_date_format_pick(spark, sf):
    f = flights(spark, sf)
    t = f.select(*[F.date_format("date", p).alias(k) for k, p in _FMT_VIEWS.items()])
    rows = [(k, fmt if isinstance(fmt, str) else "none") for k, fmt in schema.pick_date_formats(t, list(_FMT_VIEWS)).items()]
    return spark.createDataFrame(rows, "column string, picked_format string")


@register("dates_with_time", "P5 P4", with_flights(
    f"SELECT {TIE}, strftime(date + INTERVAL (line_number) HOUR, '%Y-%m-%d %H:%M:%S') AS at, "
    "strftime(date, '%Y-%m-%d') AS day, 'timestamp_ntz,string,date' AS kinds FROM flights"))
def q_dates_with_time(spark, sf):
    """Texts with a time of day become timestamps that keep it; texts without
    one become dates."""
    f = flights(spark, sf)
    at = F.date_format(F.col("date").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("line_number")), "yyyy-MM-dd HH:mm:ss")
    t = f.select(*C.TIE_KEY, at.alias("at"), F.date_format("date", "dd.MM.yyyy").alias("odd"),
                 F.date_format("date", "yyyy-MM-dd'T00:00:00'").alias("day"))
    t = write_table(t, "dated_rows")        # read for statistics, formats, times of day and the result
    out, plans = schema.optimize_data_types(t, date_cols=["at", "day", "odd"])
    kinds = ",".join(p.new_type for p in plans if p.column in ("at", "day", "odd"))
    return out.select(*[F.col(c).cast(f.schema[c].dataType).alias(c) for c in C.TIE_KEY],
                      F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"), F.date_format("day", "yyyy-MM-dd").alias("day"),
                      F.lit(kinds).alias("kinds"))


@register("coerced_dates", "P6", with_flights(
    f"SELECT {TIE}, date FROM flights WHERE travel_code % 9 <> 0"))
def q_coerced_dates(spark, sf):
    """Rows whose date does not parse are dropped, the others are typed."""
    f = flights(spark, sf)
    t = f.select(*C.TIE_KEY, F.when(F.col("travel_code") % 9 == 0, F.lit("n/a")).otherwise(
        F.date_format("date", "yyyy-MM-dd")).alias("date"))
    return schema.coerce_dates(t, "date", "%Y-%m-%d")


@register("model_inputs", "P8 P11", with_flights(
    "SELECT travel_code, line_number, part_key, supp_key, user_code, from_location, to_location, flight_type, distance, "
    "agency, date FROM flights_n WHERE price IS NOT NULL", nulls=True))
def q_model_inputs(spark, sf):
    """Rows with a target, without the target and the columns that go with
    another one."""
    f = schema.drop_missing_target(flights_with_nulls(spark, sf), C.TARGET)
    return f.select(*schema.feature_columns(f, [C.TARGET, *C.MULTICOLLINEAR_DROP]))


@register("parquet_scan", "S2", with_flights(
    f"SELECT {TIE}, CASE WHEN travel_code % 6 = 0 THEN NULL ELSE price END AS price FROM flights"))
def q_parquet_scan(spark, sf):
    """A Parquet table with NaN cells: they are read as NULL."""
    from ..sources.readers import load_data
    path = f"{ensure_checkpoint_dir(spark)}/scan_{uuid.uuid4().hex}.parquet"
    flights(spark, sf).select(*C.TIE_KEY, F.when(F.col("travel_code") % 6 == 0, F.lit(float("nan"))).otherwise(
        F.col("price")).alias("price")).write.parquet(path)
    return load_data(spark, path)


# --- P12 / P13 ---------------------------------------------------------------

@register("rows_between_dates", "P12", with_flights(
    "SELECT CAST(count_if(date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31') AS BIGINT) "
    "AS n_between, CAST(count(*) AS BIGINT) AS n_total, "
    "ROUND(count_if(date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31') * 100.0 / "
    "greatest(count(*), 1), 6) AS pct_between FROM flights"))
def q_rows_between(spark, sf):
    return schema.rows_between_dates(flights(spark, sf), "date", "1996-01-01", "1997-12-31")


CONTRACT = schema.Contract(
    enums={"flight_type": C.FLIGHT_TYPE_ORDER, "agency": ["F", "O"]},
    positive=("time", "distance"),
    ranges={"time": (1.0, 40.0), "distance": (150.3, 1300.5)},
    distinct_pairs=(("from_location", "to_location"),),
    date_col="date")

_CONTRACT_SQL = with_flights(f"""
SELECT {TIE},
  CAST((CASE WHEN flight_type IS NULL OR flight_type NOT IN ('A','N','R') THEN 1 ELSE 0 END)
     + (CASE WHEN agency IS NULL OR agency NOT IN ('F','O') THEN 1 ELSE 0 END)
     + (CASE WHEN time IS NULL OR time <= 0 THEN 1 ELSE 0 END)
     + (CASE WHEN distance IS NULL OR distance <= 0 THEN 1 ELSE 0 END)
     + (CASE WHEN time IS NULL OR time < 1.0 OR time > 40.0 THEN 1 ELSE 0 END)
     + (CASE WHEN distance IS NULL OR distance < 150.3 OR distance > 1300.5 THEN 1 ELSE 0 END)
     + (CASE WHEN from_location = to_location THEN 1 ELSE 0 END)
     + (CASE WHEN date IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_violations,
  concat_ws(',',
     CASE WHEN flight_type IS NULL OR flight_type NOT IN ('A','N','R') THEN 'flight_type:not_allowed' END,
     CASE WHEN agency IS NULL OR agency NOT IN ('F','O') THEN 'agency:not_allowed' END,
     CASE WHEN time IS NULL OR time <= 0 THEN 'time:not_positive' END,
     CASE WHEN distance IS NULL OR distance <= 0 THEN 'distance:not_positive' END,
     CASE WHEN time IS NULL OR time < 1.0 OR time > 40.0 THEN 'time:out_of_range' END,
     CASE WHEN distance IS NULL OR distance < 150.3 OR distance > 1300.5 THEN 'distance:out_of_range' END,
     CASE WHEN from_location = to_location THEN 'from_location=to_location' END,
     CASE WHEN date IS NULL THEN 'date:invalid' END) AS violations
FROM flights""")


@register("contract_violations", "P13", _CONTRACT_SQL)
def q_contract(spark, sf):
    v = schema.contract_violations(flights(spark, sf), CONTRACT)
    return v.select("travel_code", "line_number", "part_key", "supp_key",
                    F.size("violations").cast("long").alias("n_violations"),
                    F.array_join("violations", ",").alias("violations"))


# --- U1-U4 -------------------------------------------------------------------

@register("dedup_business_key", "U2 U3", with_flights(
    f"SELECT {FLIGHT_COLS} FROM flights QUALIFY row_number() OVER "
    f"(PARTITION BY {KEY_SQL} ORDER BY date, {TIE}) = 1"))
def q_dedup_first(spark, sf):
    return dedup.dedup_business_key(flights(spark, sf), SILVER_KEY, ["date", *C.TIE_KEY])


@register("dedup_keep_last", "U2", with_flights(
    f"SELECT {FLIGHT_COLS} FROM flights QUALIFY row_number() OVER "
    f"(PARTITION BY {KEY_SQL} ORDER BY date DESC, travel_code DESC, line_number DESC, "
    f"part_key DESC, supp_key DESC) = 1"))
def q_dedup_last(spark, sf):
    return dedup.drop_duplicates(flights(spark, sf), SILVER_KEY, "last", ["date", *C.TIE_KEY])


@register("dedup_keep_false", "U2", with_flights(
    f"SELECT {FLIGHT_COLS} FROM flights QUALIFY count(*) OVER (PARTITION BY {KEY_SQL}) = 1"))
def q_dedup_none(spark, sf):
    return dedup.drop_duplicates(flights(spark, sf), SILVER_KEY, keep=False)


@register("dedup_full_rows", "U2", with_flights(
    "SELECT DISTINCT from_location, to_location, flight_type, agency, time FROM flights"))
def q_dedup_full(spark, sf):
    return dedup.drop_duplicates(
        flights(spark, sf).select("from_location", "to_location", "flight_type", "agency", "time"))


@register("union_splits", "U1", with_flights(
    f"SELECT {TIE}, price, date < DATE '1998-01-01' AS early FROM flights"))
def q_union(spark, sf):
    f = write_table(flights(spark, sf).select(*C.TIE_KEY, "price", "date"), "union_rows")    # both parts read it
    early = F.col("date") < F.lit("1998-01-01").cast("date")
    return dedup.union_all(f.where(early).withColumn("early", F.lit(True)),
                           f.where(~early).withColumn("early", F.lit(False))).drop("date")


@register("duplicate_rate", "U4", with_flights(
    f"SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n - 1) AS BIGINT) AS n_duplicates, "
    f"CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS n_in_duplicate_groups, "
    f"ROUND(CAST(sum(n - 1) AS DOUBLE) / greatest(sum(n), 1), 8) AS duplicate_rate "
    f"FROM (SELECT {KEY_SQL}, count(*) AS n FROM flights GROUP BY {KEY_SQL})"))
def q_dup_rate(spark, sf):
    return dedup.duplicate_stats(flights(spark, sf), SILVER_KEY)


# --- A1 / A2 -----------------------------------------------------------------

@register("group_stats", "A1", with_flights(
    "SELECT flight_type, agency, ROUND(avg(price), 6) AS mean_price, ROUND(sum(price), 2) AS "
    "sum_price, count(price) AS count_price, bool_or(price <> 0) AS any_price, "
    "ROUND(quantile_cont(price, 0.5), 6) AS median_price FROM flights GROUP BY flight_type, agency"))
def q_group_stats(spark, sf):
    g = profile.group_stats(flights(spark, sf), ["flight_type", "agency"], "price")
    return g.select("flight_type", "agency", r("mean_price"), r("sum_price", 2), "count_price",
                    "any_price", r("median_price"))


@register("group_mode", "A1", with_flights(
    "SELECT from_location, time AS mode_time, n AS mode_count FROM (SELECT from_location, time, "
    "count(*) AS n FROM flights WHERE time IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER "
    "(PARTITION BY from_location ORDER BY n DESC, time ASC) = 1"))
def q_group_mode(spark, sf):
    return profile.group_mode(flights(spark, sf), ["from_location"], "time") \
        .withColumnRenamed("mode_count", "mode_count")


@register("value_counts_topn", "A2", with_flights(
    "SELECT from_location, count(*) AS count FROM flights GROUP BY from_location "
    "ORDER BY count DESC, from_location LIMIT 10"))
def q_value_counts(spark, sf):
    return profile.value_counts(flights(spark, sf), "from_location", "desc", top_n=10)


@register("value_counts_share", "A2", with_flights(
    "SELECT agency, count(*) AS count, ROUND(count(*) / (SELECT CAST(count(*) AS DOUBLE) "
    "FROM flights_n), 8) AS share FROM flights_n GROUP BY agency", nulls=True))
def q_value_share(spark, sf):
    v = profile.value_counts(flights_with_nulls(spark, sf), "agency", "key", normalize=True)
    return v.select("agency", "count", r("share", 8))


# --- A3-A10 ------------------------------------------------------------------

def _missing_sql(cols):
    parts = []
    for c in cols:
        parts.append(f"SELECT '{c}' AS column, CAST(count_if({c} IS NULL) AS BIGINT) AS n_missing, "
                     f"ROUND(count_if({c} IS NULL) * 100.0 / count(*), 6) AS pct_missing "
                     f"FROM flights_n")
    return "\nUNION ALL\n".join(parts)


_MISS_COLS = ["price", "time", "distance", "agency", "from_location", "date"]


@register("missing_profile", "A3", with_flights(_missing_sql(_MISS_COLS), nulls=True))
def q_missing(spark, sf):
    m = profile.missing_profile(flights_with_nulls(spark, sf), _MISS_COLS)
    return m.select("column", "n_missing", r("pct_missing"))


def _describe_sql(cols):
    return "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column, count({c}) AS count, ROUND(avg({c}), 6) AS mean, "
        f"ROUND(stddev_samp({c}), 6) AS std, ROUND(min({c}), 6) AS min, ROUND(max({c}), 6) AS max, "
        f"ROUND(quantile_cont({c}, 0.25), 6) AS p25, ROUND(quantile_cont({c}, 0.5), 6) AS p50, "
        f"ROUND(quantile_cont({c}, 0.75), 6) AS p75 FROM flights" for c in cols)


@register("describe", "A4", with_flights(_describe_sql(NUM3)))
def q_describe(spark, sf):
    d = profile.numeric_describe(flights(spark, sf), NUM3)
    return d.select("column", "count", *[r(c) for c in ["mean", "std", "min", "max", "p25",
                                                          "p50", "p75"]])


@register("describe_categorical", "A4", with_flights("\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, (SELECT count({c}) FROM flights) AS count, "
    f"(SELECT count(DISTINCT {c}) FROM flights) AS unique, {c} AS top, n AS freq FROM "
    f"(SELECT {c}, count(*) AS n FROM flights WHERE {c} IS NOT NULL GROUP BY {c} "
    f"ORDER BY n DESC, {c} LIMIT 1)" for c in CAT4)))
def q_describe_cat(spark, sf):
    return profile.categorical_describe(flights(spark, sf), CAT4)


@register("nunique", "A4", with_flights("\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, count(DISTINCT {c}) AS n_unique FROM flights"
    for c in ["from_location", "to_location", "user_code", "date", "time"])))
def q_nunique(spark, sf):
    return profile.nunique(flights(spark, sf),
                           ["from_location", "to_location", "user_code", "date", "time"])


@register("skew", "A5", with_flights("\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, ROUND(skewness({c}), 6) AS skew FROM flights" for c in NUM3)))
def q_skew(spark, sf):
    return profile.skewness(flights(spark, sf), NUM3).select("column", r("skew"))


@register("corr_matrix", "A6", with_flights("\nUNION ALL\n".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, "
    + (f"CAST(1.0 AS DOUBLE) AS corr" if a == b else f"ROUND(corr({a}, {b}), 6) AS corr FROM flights")
    for a in NUM3 for b in NUM3)))
def q_corr(spark, sf):
    return profile.corr_matrix(flights(spark, sf), NUM3).select("col_a", "col_b", r("corr"))


def _box_sql():
    parts = []
    for c in ["price", "distance"]:
        q1, q3 = f"quantile_cont({c}, 0.25)", f"quantile_cont({c}, 0.75)"
        parts.append(
            f"SELECT flight_type, '{c}' AS column, ROUND({q1}, 6) AS q1, "
            f"ROUND(quantile_cont({c}, 0.5), 6) AS median, ROUND({q3}, 6) AS q3, "
            f"ROUND({q3} - {q1}, 6) AS iqr, ROUND(min({c}), 6) AS min, ROUND(max({c}), 6) AS max, "
            f"ROUND({q1} - 1.5 * ({q3} - {q1}), 6) AS lower_fence, "
            f"ROUND({q3} + 1.5 * ({q3} - {q1}), 6) AS upper_fence FROM flights GROUP BY flight_type")
    return "\nUNION ALL\n".join(parts)


@register("box_stats", "A7", with_flights(_box_sql()))
def q_box(spark, sf):
    b = profile.box_stats(flights(spark, sf), ["price", "distance"], ["flight_type"])
    return b.select("flight_type", "column", *[r(c) for c in
                                                ["q1", "median", "q3", "iqr", "min", "max",
                                                 "lower_fence", "upper_fence"]])


_HIST_SQL = (
    "SELECT CAST(b.bin AS INTEGER) AS bin, ROUND(any_value(lo) + (b.bin - 1) * ((any_value(hi) - any_value(lo)) / 40.0), 6) "
    "AS lower, ROUND(any_value(lo) + b.bin * ((any_value(hi) - any_value(lo)) / 40.0), 6) AS upper, count(x.bin) AS count "
    "FROM (SELECT unnest(range(1, 41)) AS bin) b CROSS JOIN (SELECT min({c}) AS lo, max({c}) AS hi FROM flights) m "
    "LEFT JOIN (SELECT least(CAST(floor(40.0 * ({c} - lo) / (hi - lo)) AS BIGINT) + 1, 40) AS bin FROM flights, "
    "(SELECT min({c}) AS lo, max({c}) AS hi FROM flights) m WHERE {c} IS NOT NULL) x ON x.bin = b.bin GROUP BY b.bin")


@register("hist40", "A8", with_flights(
    _HIST_SQL.format(c="price")))
def q_hist(spark, sf):
    h = profile.histogram(flights(spark, sf), "price", 40)
    return h.select("bin", r("lower"), r("upper"), "count")


@register("hist40_gaps", "A8", with_flights(_HIST_SQL.format(c="time * time * time * time")))
def q_hist_gaps(spark, sf):
    """A skewed column of few values: most bins are empty and still there."""
    t = F.col("time")
    h = profile.histogram(flights(spark, sf).select((t * t * t * t).alias("x")), "x", 40)
    return h.select("bin", r("lower"), r("upper"), "count")


@register("unique_routes", "A4", with_flights(
    "SELECT DISTINCT from_location || ' - ' || to_location AS route FROM flights"))
def q_unique_routes(spark, sf):
    f = flights(spark, sf).select(F.concat_ws(" - ", "from_location", "to_location").alias("route"))
    return profile.unique_values(f, "route")


@register("date_stats", "A9", with_flights(
    "SELECT min(date) AS min_date, max(date) AS max_date, "
    "CAST(date_diff('day', min(date), max(date)) AS BIGINT) AS span_days, "
    "count(DISTINCT date) AS unique_days, count(DISTINCT strftime(date, '%Y-%m')) AS "
    "unique_year_months FROM flights"))
def q_date_stats(spark, sf):
    return profile.date_stats(flights(spark, sf), "date")


@register("date_counts_year", "A9", with_flights(
    "SELECT CAST(year(date) AS BIGINT) AS year, count(*) AS count FROM flights GROUP BY 1"))
def q_date_counts(spark, sf):
    d = profile.date_counts(flights(spark, sf), "date", "year")
    return d.select(F.col("year").cast("long").alias("year"), "count")


@register("date_counts_month", "A9", with_flights(
    "SELECT CAST(month(date) AS BIGINT) AS month, count(*) AS count FROM flights GROUP BY 1"))
def q_date_counts_month(spark, sf):
    d = profile.date_counts(flights(spark, sf), "date", "month")
    return d.select(F.col("month").cast("long").alias("month"), "count")


@register("date_counts_year_month", "A9", with_flights(
    "SELECT strftime(date, '%Y-%m') AS year_month, count(*) AS count FROM flights GROUP BY 1"))
def q_date_counts_year_month(spark, sf):
    return profile.date_counts(flights(spark, sf), "date", "year_month")


_PROFILE_TYPES = {"from_location": "string", "agency": "string", "price": "double",
                  "time": "double"}


def _profile_sql():
    parts = []
    for c, t in _PROFILE_TYPES.items():
        num = t == "double"
        stats = (f"ROUND(min({c}), 6) AS min, ROUND(max({c}), 6) AS max, ROUND(avg({c}), 6) AS mean, "
                 f"ROUND(stddev_samp({c}), 6) AS std, ROUND(quantile_cont({c}, 0.25), 6) AS p25, "
                 f"ROUND(quantile_cont({c}, 0.5), 6) AS p50, ROUND(quantile_cont({c}, 0.75), 6) AS p75, "
                 f"ROUND(skewness({c}), 6) AS skew") if num else (
            "CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS mean, "
            "CAST(NULL AS DOUBLE) AS std, CAST(NULL AS DOUBLE) AS p25, CAST(NULL AS DOUBLE) AS p50, "
            "CAST(NULL AS DOUBLE) AS p75, CAST(NULL AS DOUBLE) AS skew")
        top = (f"(SELECT CAST({c} AS VARCHAR) FROM flights_n WHERE {c} IS NOT NULL GROUP BY {c} "
               f"ORDER BY count(*) DESC, CAST({c} AS VARCHAR) LIMIT 1)")
        topn = (f"(SELECT count(*) FROM flights_n WHERE {c} IS NOT NULL GROUP BY {c} "
                f"ORDER BY count(*) DESC, CAST({c} AS VARCHAR) LIMIT 1)")
        parts.append(
            f"SELECT '{c}' AS column, '{t}' AS dtype, CAST(count_if({c} IS NULL) AS BIGINT) AS "
            f"n_missing, ROUND(count_if({c} IS NULL) * 100.0 / count(*), 6) AS pct_missing, "
            f"count(DISTINCT {c}) AS n_unique, {top} AS top, {topn} AS top_freq, {stats} "
            f"FROM flights_n")
    return "\nUNION ALL\n".join(parts)


@register("profile", "A10", with_flights(_profile_sql(), nulls=True))
def q_profile(spark, sf):
    df = flights_with_nulls(spark, sf).select(*_PROFILE_TYPES)
    p = profile.profile(df)
    num = ["min", "max", "mean", "std", "p25", "p50", "p75", "skew"]
    for c in num:
        if c not in p.columns:
            p = p.withColumn(c, F.lit(None).cast("double"))
    return p.select("column", "dtype", "n_missing", r("pct_missing"), "n_unique", "top",
                    "top_freq", *[r(c) for c in num])


# --- A11 / P10 / P9 ----------------------------------------------------------

def _eda_sql(c, old):
    if old in ("bigint", "int"):
        return _narrow_sql(c, old).replace(" FROM r", " FROM e")
    if old == "double":
        return _narrow_sql(c, old).replace(" FROM r", " FROM e")
    return (f"SELECT '{c}', 'string', CASE WHEN CAST(count_if(try_cast({c} AS TIMESTAMP) IS NOT NULL) "
            f"AS DOUBLE) / count(*) >= 0.8 THEN 'date' WHEN CAST(count(DISTINCT {c}) AS DOUBLE) / "
            f"count(*) < 0.5 THEN 'category' ELSE 'string' END FROM e")


_EDA_COLS = [("travel_code", "bigint"), ("from_location", "string"), ("price", "double"),
             ("time", "double"), ("date_text", "string"), ("mixed_text", "string")]


@register("eda_type_plan", "A11", with_flights(
    "\nUNION ALL\n".join(_eda_sql(c, t) for c, t in _EDA_COLS),
    extra="e AS (SELECT travel_code, from_location, price, time, strftime(date, '%Y-%m-%d') AS "
          "date_text, CASE WHEN line_number <= 2 THEN strftime(date, '%Y-%m-%d') ELSE agency END "
          "AS mixed_text FROM flights)"))
def q_eda_types(spark, sf):
    f = flights(spark, sf).select(
        "travel_code", "from_location", "price", "time",
        F.date_format("date", "yyyy-MM-dd").alias("date_text"),
        F.when(F.col("line_number") <= 2, F.date_format("date", "yyyy-MM-dd"))
        .otherwise(F.col("agency")).alias("mixed_text"))
    return profile.eda_type_plan(f)


_FINAL = ["price", "time", "distance", "extra_feature", "flight_type"]


@register("conform_columns", "P10 P9 P7", with_flights(
    f"SELECT {TIE}, price, time, distance, CAST(0.0 AS DOUBLE) AS extra_feature, flight_type "
    "FROM flights"))
def q_conform(spark, sf):
    f = flights(spark, sf)
    keep = schema.drop_columns(f, ["user_code", "no_such_column"])
    out = schema.conform_columns(keep, [*C.TIE_KEY, *_FINAL])
    return schema.enforce_column_order(out, [*C.TIE_KEY, *_FINAL])


@register("contract_split", "P13",
          f"SELECT {TIE}, n_violations > 0 AS rejected FROM ({_CONTRACT_SQL})")
def q_contract_split(spark, sf):
    """Accepted and rejected rows, written apart and read back: together all
    rows."""
    good, bad = schema.split_by_contract(flights(spark, sf), CONTRACT)
    base = f"{ensure_checkpoint_dir(spark)}/contract_{uuid.uuid4().hex}"
    good.write.parquet(f"{base}/accepted")
    bad.write.parquet(f"{base}/rejected")
    return (spark.read.parquet(f"{base}/accepted").select(*C.TIE_KEY, F.lit(False).alias("rejected"))
            .unionByName(spark.read.parquet(f"{base}/rejected").select(*C.TIE_KEY, F.lit(True).alias("rejected"))))


@register("contract_stream", "P13 streaming", _CONTRACT_SQL)
def q_contract_stream(spark, sf):
    """The input contract applied to a file stream of the rows."""
    from .layers import _stream
    src = flights(spark, sf)

    def check(batch):
        v = schema.contract_violations(batch, CONTRACT)
        return v.select("travel_code", "line_number", "part_key", "supp_key",
                        F.size("violations").cast("long").alias("n_violations"),
                        F.array_join("violations", ",").alias("violations"))
    return _stream(spark, src, check)
