"""Catalogue: scalar features (X1-X9) and fit/transform operators
(F1, F3-F13, E1-E4).  Fits run on the rows ordered before 1999 (a
training period), transforms on every row, so fit and apply are separate
as in the layer jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import date_features
from ..functions.numeric import NUMERIC_OPS, boxcox, cyclical, inv_boxcox, inv_yeojohnson, yeojohnson
from ..functions.strings import interaction
from ..operators.fitted.encoder import fit_encoder, onehot_sparse
from ..operators.fitted.imputer import fit_simple_imputer
from ..operators.fitted.outlier import fit_outliers
from ..operators.fitted.power import fit_power
from ..operators.fitted.rare import fit_rare_grouper
from ..operators.fitted.scaler import fit_scaler
from ..plans import config as C
from ..session import write_table
from ..sources.tables import flights, flights_with_nulls
from .base import TIE, r, register, with_flights

NUM3 = ["price", "time", "distance"]
TRAIN_END = "1999-01-01"
_TRAIN_SQL = "date < DATE '1999-01-01'"


def _train(df):
    return df.where(F.col("date") < F.lit(TRAIN_END).cast("date"))


# --- X1-X4 -------------------------------------------------------------------

@register("date_features", "X1", with_flights(
    f"SELECT {TIE}, CAST(year(date) AS SMALLINT) AS year, CAST(month(date) AS TINYINT) AS month, "
    "CAST(day(date) AS TINYINT) AS day, CAST(isodow(date) - 1 AS TINYINT) AS day_of_week, "
    "CAST(dayofyear(date) AS SMALLINT) AS day_of_year, CAST(weekofyear(date) AS INTEGER) AS "
    "week_of_year FROM flights"))
def q_date_features(spark, sf):
    f = flights(spark, sf)
    return f.select(*C.TIE_KEY, *[e.alias(k) for k, e in date_features("date").items()])


def _cyc_sql(c, p):
    return (f"ROUND(sin(2 * pi() * {c} / {p}), 6) AS {c}_sin, "
            f"ROUND(cos(2 * pi() * {c} / {p}), 6) AS {c}_cos")


@register("cyclical", "X2", with_flights(
    f"SELECT {TIE}, " + ", ".join(_cyc_sql(c, p) for c, p in C.CYCLICAL_FEATURES_MAP.items())
    + " FROM (SELECT *, month(date) AS month, isodow(date) - 1 AS day_of_week, day(date) AS day "
      "FROM flights)"))
def q_cyclical(spark, sf):
    f = flights(spark, sf).withColumns(
        {k: v for k, v in date_features("date").items() if k in C.CYCLICAL_FEATURES_MAP})
    cols = []
    for c, p in C.CYCLICAL_FEATURES_MAP.items():
        s, co = cyclical(c, p)
        cols += [r(s).alias(f"{c}_sin"), r(co).alias(f"{c}_cos")]
    return f.select(*C.TIE_KEY, *cols)


@register("cat_interaction", "X3", with_flights(
    f"SELECT {TIE}, concat_ws('_', COALESCE(from_location, 'nan'), COALESCE(agency, 'nan')) "
    "AS from_agency, concat_ws('|', COALESCE(flight_type, 'nan'), COALESCE(to_location, 'nan')) "
    "AS type_to FROM flights_n", nulls=True))
def q_cat_interaction(spark, sf):
    f = flights_with_nulls(spark, sf)
    return f.select(*C.TIE_KEY, interaction(["from_location", "agency"], "_").alias("from_agency"),
                    interaction(["flight_type", "to_location"], "|").alias("type_to"))


@register("num_interaction", "X4", with_flights(
    f"SELECT {TIE}, ROUND(price + distance, 6) AS p_add_d, ROUND(price - distance, 6) AS p_sub_d, "
    "ROUND(time * distance, 6) AS t_mul_d, "
    "ROUND(price / CASE WHEN (time - 25) = 0 THEN 1e-6 ELSE (time - 25) END, 6) AS p_div_t "
    "FROM flights"))
def q_num_interaction(spark, sf):
    f = flights(spark, sf).withColumn("t25", F.col("time") - 25)
    return f.select(*C.TIE_KEY,
                    r(NUMERIC_OPS["add"]("price", "distance")).alias("p_add_d"),
                    r(NUMERIC_OPS["subtract"]("price", "distance")).alias("p_sub_d"),
                    r(NUMERIC_OPS["multiply"]("time", "distance")).alias("t_mul_d"),
                    r(NUMERIC_OPS["divide"]("price", "t25")).alias("p_div_t"))


# --- F1 ----------------------------------------------------------------------

@register("impute_simple", "F1", with_flights(
    f"SELECT {TIE}, "
    "ROUND(COALESCE(price, (SELECT quantile_cont(price, 0.5) FROM flights_n WHERE "
    f"{_TRAIN_SQL})), 6) AS price, "
    f"ROUND(COALESCE(distance, (SELECT avg(distance) FROM flights_n WHERE {_TRAIN_SQL})), 6) "
    "AS distance, "
    "COALESCE(agency, (SELECT agency FROM flights_n WHERE agency IS NOT NULL AND "
    f"{_TRAIN_SQL} GROUP BY agency ORDER BY count(*) DESC, agency LIMIT 1)) AS agency, "
    "COALESCE(from_location, 'Unknown') AS from_location FROM flights_n", nulls=True))
def q_impute(spark, sf):
    f = flights_with_nulls(spark, sf)
    m = fit_simple_imputer(_train(f), {"median": ["price"], "mean": ["distance"],
                                       "mode": ["agency"],
                                       "constant": {"from_location": "Unknown"}})
    out = m.transform(f)
    return out.select(*C.TIE_KEY, r("price"), r("distance"), "agency", "from_location")


# --- F3-F9 -------------------------------------------------------------------

def _iqr_cte():
    parts = []
    for c in NUM3:
        parts.append(f"quantile_cont({c}, 0.25) AS {c}_q1, quantile_cont({c}, 0.75) AS {c}_q3")
    return "b AS (SELECT " + ", ".join(parts) + f" FROM flights WHERE {_TRAIN_SQL})"


def _iqr_flag(c):
    return (f"COALESCE({c} < {c}_q1 - 1.5 * ({c}_q3 - {c}_q1) OR "
            f"{c} > {c}_q3 + 1.5 * ({c}_q3 - {c}_q1), FALSE)")


@register("outlier_mask", "F3 F7", with_flights(
    f"SELECT {TIE}, " + ", ".join(f"{_iqr_flag(c)} AS {c}_outlier" for c in NUM3)
    + " FROM flights, b", extra=_iqr_cte()))
def q_outlier_mask(spark, sf):
    f = flights(spark, sf)
    m = fit_outliers(_train(f), NUM3, "iqr", "trim")
    return m.mask(f).select(*C.TIE_KEY, *[f"{c}_outlier" for c in NUM3])


@register("iqr_trim", "F3 F8", with_flights(
    f"SELECT {TIE}, price, time, distance FROM flights, b WHERE NOT ("
    + " OR ".join(_iqr_flag(c) for c in NUM3) + ")", extra=_iqr_cte()))
def q_iqr_trim(spark, sf):
    f = flights(spark, sf)
    m = fit_outliers(_train(f), NUM3, "iqr", "trim")
    return m.transform(f).select(*C.TIE_KEY, "price", "time", "distance")


def _z_cte():
    parts = [f"avg({c}) AS {c}_m, stddev_samp({c}) AS {c}_s" for c in NUM3]
    return "z AS (SELECT " + ", ".join(parts) + f" FROM flights WHERE {_TRAIN_SQL})"


@register("zscore_winsor", "F4 F9 X8", with_flights(
    f"SELECT {TIE}, " + ", ".join(
        f"ROUND(greatest({c}_m - 3.0 * {c}_s, least({c}_m + 3.0 * {c}_s, {c})), 6) AS {c}"
        for c in NUM3) + " FROM flights, z", extra=_z_cte()))
def q_zscore(spark, sf):
    f = flights(spark, sf)
    m = fit_outliers(_train(f), NUM3, "zscore", "winsorize", zscore_threshold=3.0)
    return m.transform(f).select(*C.TIE_KEY, *[r(c) for c in NUM3])


# --- F5 ----------------------------------------------------------------------

RARE_THRESHOLD = 0.041


def _rare_sql(c):
    return (f"CASE WHEN {c} IN (SELECT v FROM (SELECT {c} AS v, count(*) AS n, "
            f"sum(count(*)) OVER () AS t FROM flights WHERE {c} IS NOT NULL AND {_TRAIN_SQL} "
            f"GROUP BY {c}) WHERE CAST(n AS DOUBLE) / t >= {RARE_THRESHOLD}) THEN {c} "
            f"ELSE 'Other' END AS {c}")


@register("rare_group", "F5", with_flights(
    f"SELECT {TIE}, {_rare_sql('from_location')}, {_rare_sql('to_location')} FROM flights"))
def q_rare(spark, sf):
    f = flights(spark, sf)
    m = fit_rare_grouper(_train(f), ["from_location", "to_location"], RARE_THRESHOLD)
    return m.transform(f).select(*C.TIE_KEY, "from_location", "to_location")


# --- F12 / F13 ---------------------------------------------------------------

def _scale_sql(kind):
    if kind == "standard":
        st = ", ".join(f"avg({c}) AS {c}_c, stddev_samp({c}) AS {c}_s" for c in NUM3)
    elif kind == "minmax":
        st = ", ".join(f"min({c}) AS {c}_c, max({c}) - min({c}) AS {c}_s" for c in NUM3)
    else:
        st = ", ".join(f"quantile_cont({c}, 0.5) AS {c}_c, quantile_cont({c}, 0.75) - "
                       f"quantile_cont({c}, 0.25) AS {c}_s" for c in NUM3)
    body = f"SELECT {TIE}, " + ", ".join(
        f"ROUND(CASE WHEN {c}_s <= 1e-8 THEN 0.0 ELSE ({c} - {c}_c) / {c}_s END, 6) AS {c}"
        for c in NUM3) + " FROM flights, s"
    return with_flights(body, extra=f"s AS (SELECT {st} FROM flights WHERE {_TRAIN_SQL})")


def _scale_q(kind):
    def q(spark, sf):
        f = flights(spark, sf)
        m = fit_scaler(_train(f), NUM3, kind)
        return m.transform(f).select(*C.TIE_KEY, *[r(c) for c in NUM3])
    return q


register("scale_standard", "F12", _scale_sql("standard"))(_scale_q("standard"))
register("scale_minmax", "F12", _scale_sql("minmax"))(_scale_q("minmax"))
register("scale_robust", "F12", _scale_sql("robust"))(_scale_q("robust"))


@register("scale_inverse", "F12 F13", with_flights(
    f"SELECT {TIE}, ROUND(price, 6) AS price, ROUND(time, 6) AS time, "
    "ROUND(distance, 6) AS distance FROM flights"))
def q_scale_inverse(spark, sf):
    f = flights(spark, sf)
    m = fit_scaler(_train(f), NUM3, "robust")
    back = m.inverse(m.transform(f))
    return back.select(*C.TIE_KEY, *[r(c) for c in NUM3])


# --- E1-E4 -------------------------------------------------------------------

@register("ordinal_mapped", "E2", with_flights(
    f"SELECT {TIE}, CASE flight_type WHEN 'A' THEN 0.0 WHEN 'N' THEN 1.0 WHEN 'R' THEN 2.0 END "
    "AS flight_type FROM flights"))
def q_ordinal_mapped(spark, sf):
    f = flights(spark, sf)
    m = fit_encoder(_train(f), ordinal_cols=["flight_type"], ordinal_mapping=C.ENCODING_MAPPING)
    return m.transform(f.select(*C.TIE_KEY, "flight_type")).select(*C.TIE_KEY, "flight_type")


def _auto_sql(c):
    return (f"COALESCE((SELECT CAST(k AS DOUBLE) FROM (SELECT v, row_number() OVER (ORDER BY v) - 1 "
            f"AS k FROM (SELECT DISTINCT {c} AS v FROM flights WHERE {c} IS NOT NULL AND "
            f"{_TRAIN_SQL})) WHERE v = f.{c}), -1.0) AS {c}")


@register("ordinal_auto", "E1 E4", with_flights(
    f"SELECT {', '.join('f.' + t.strip() for t in TIE.split(','))}, "
    + ", ".join(_auto_sql(c) for c in ["from_location", "to_location", "agency"])
    + ", CAST(f.price AS DOUBLE) AS price FROM flights f"))
def q_ordinal_auto(spark, sf):
    f = flights(spark, sf).select(*C.TIE_KEY, "from_location", "to_location", "agency", "price")
    m = fit_encoder(_train(flights(spark, sf)).select("from_location", "to_location", "agency"),
                    ordinal_cols=["from_location", "to_location", "agency"])
    out = m.transform(f)
    return out.select(*[F.col(c).cast("long").alias(c) for c in C.TIE_KEY if c != "line_number"],
                      F.col("line_number").cast("int").alias("line_number"),
                      "from_location", "to_location", "agency", "price")


@register("ordinal_large", "E1", with_flights(
    f"SELECT {', '.join('f.' + t.strip() for t in TIE.split(','))}, coalesce(k.code, -1.0) AS code "
    "FROM flights f LEFT JOIN (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS DOUBLE) AS code "
    f"FROM (SELECT DISTINCT CAST(travel_code AS VARCHAR) AS v FROM flights WHERE {_TRAIN_SQL})) k "
    "ON CAST(f.travel_code AS VARCHAR) = k.v"))
def q_ordinal_large(spark, sf):
    """More codes than fit a literal; a second fit on the other period must
    not touch the first model's codes."""
    f = flights(spark, sf).withColumn("code", F.col("travel_code").cast("string"))
    m = fit_encoder(_train(f).select("code"), ordinal_cols=["code"])
    fit_encoder(f.where(F.col("date") >= F.lit(TRAIN_END).cast("date")).select("code"), ordinal_cols=["code"])
    out = m.transform(f.select(*C.TIE_KEY, "code"))
    return out.select(*[F.col(c).cast("long").alias(c) for c in C.TIE_KEY if c != "line_number"],
                      F.col("line_number").cast("int").alias("line_number"), "code")


@register("onehot_wide", "E3", with_flights(
    f"SELECT {', '.join('f.' + t.strip() for t in TIE.split(','))}, k.idx AS idx, 1.0::DOUBLE AS value "
    "FROM flights f JOIN (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS idx "
    "FROM (SELECT DISTINCT CAST(user_code AS VARCHAR) AS v FROM flights)) k "
    "ON CAST(f.user_code AS VARCHAR) = k.v"))
def q_onehot_wide(spark, sf):
    """Sparse one-hot of a wide domain, its entries as rows."""
    f = flights(spark, sf).select(*C.TIE_KEY, F.col("user_code").cast("string").alias("user"))
    m = fit_encoder(f.select("user"), ordinal_cols=["user"])
    out = onehot_sparse(f, "user", m)
    return out.select(*C.TIE_KEY, F.explode(F.arrays_zip("user_onehot.indices", "user_onehot.values")).alias("e")) \
        .select(*C.TIE_KEY, F.col("e.indices").alias("idx"), F.col("e.values").alias("value"))


@register("onehot", "E3 E4", with_flights(
    f"SELECT {TIE}, " + ", ".join(
        f"CAST(agency = '{v}' AS DOUBLE) AS agency_{v}" for v in C.AGENCIES) + ", "
    + ", ".join(f"CAST(flight_type = '{v}' AS DOUBLE) AS flight_type_{v}"
                for v in C.FLIGHT_TYPE_ORDER) + " FROM flights"))
def q_onehot(spark, sf):
    f = flights(spark, sf).select(*C.TIE_KEY, "agency", "flight_type")
    m = fit_encoder(_train(flights(spark, sf)), onehot_cols=["agency", "flight_type"])
    out = m.transform(f)
    return out.select(*[F.col(c).cast("long").alias(c) for c in C.TIE_KEY if c != "line_number"],
                      F.col("line_number").cast("int").alias("line_number"),
                      *[c for c in out.columns if c.startswith(("agency_", "flight_type_"))])


# --- X5-X7 / F10 / F11 -------------------------------------------------------

@register("power_log", "X5 F10 F11", with_flights(
    f"SELECT {TIE}, ROUND(ln(1 + price), 6) AS price_log, ROUND(exp(ln(1 + price)) - 1, 6) "
    "AS price_back FROM flights"))
def q_power_log(spark, sf):
    f = flights(spark, sf)
    m = fit_power(f, ["price"], "log")
    t = m.transform(f.select(*C.TIE_KEY, "price"))
    return t.select(*C.TIE_KEY, r("price").alias("price_log"),
                    r(m.inverse_expr(F.col("price"), "price")).alias("price_back"))


@register("boxcox_fixed", "X6", with_flights(
    f"SELECT {TIE}, ROUND((pow(distance, 0.5) - 1) / 0.5, 6) AS bc, "
    "ROUND(pow(0.5 * ((pow(distance, 0.5) - 1) / 0.5) + 1, 2.0), 6) AS bc_back, "
    "ROUND(ln(time), 6) AS bc0 FROM flights"))
def q_boxcox_fixed(spark, sf):
    f = flights(spark, sf)
    return f.select(*C.TIE_KEY, r(boxcox("distance", 0.5)).alias("bc"),
                    r(inv_boxcox(boxcox("distance", 0.5), 0.5)).alias("bc_back"),
                    r(boxcox("time", 0.0)).alias("bc0"))


@register("yeojohnson_fixed", "X7", with_flights(
    f"SELECT {TIE}, ROUND(CASE WHEN t >= 0 THEN (pow(t + 1, 0.3) - 1) / 0.3 "
    "ELSE -(pow(-t + 1, 1.7) - 1) / 1.7 END, 6) AS yj FROM "
    "(SELECT *, time - 25 AS t FROM flights)"))
def q_yj_fixed(spark, sf):
    f = flights(spark, sf).withColumn("t", F.col("time") - 25)
    return f.select(*C.TIE_KEY, r(yeojohnson("t", 0.3)).alias("yj"))


@register("yeojohnson_roundtrip", "X7 F11", with_flights(
    f"SELECT {TIE}, ROUND(time - 25, 6) AS t_back FROM flights"))
def q_yj_round(spark, sf):
    f = flights(spark, sf).withColumn("t", F.col("time") - 25)
    return f.select(*C.TIE_KEY, r(inv_yeojohnson(yeojohnson("t", 0.3), 0.3)).alias("t_back"))


# The grid zoom of the lambda search: 21 points, six rounds.
_LAMBDA_CTE = """
tr AS (SELECT * FROM flights WHERE date < DATE '1999-01-01'),
xs AS (SELECT 'box-cox' AS strategy, 'price' AS c, price / exp((SELECT avg(ln(price)) FROM tr)) AS x FROM tr UNION ALL
       SELECT 'box-cox', 'distance', distance / exp((SELECT avg(ln(distance)) FROM tr)) FROM tr UNION ALL
       SELECT 'yeo-johnson', 'time', time + 1.0 FROM tr),
lam AS (WITH RECURSIVE it(i, strategy, c, lo, hi, lam) AS (
  SELECT 0, strategy, c, -4.0::DOUBLE, 4.0::DOUBLE, NULL::DOUBLE FROM xs GROUP BY strategy, c UNION ALL
  SELECT i + 1, strategy, c, arg_max(l, llf) - any_value(step), arg_max(l, llf) + any_value(step), arg_max(l, llf) FROM (
    SELECT i, strategy, c, l, any_value((hi - lo) / 20) AS step, (l - 1) * sum(ln(x)) - count(*) / 2.0 * ln(var_pop(
             CASE WHEN abs(l) < 1e-12 THEN ln(x) ELSE (pow(x, l) - 1) / l END)) AS llf
    FROM (SELECT *, lo + (hi - lo) * k / 20 AS l FROM it, range(21) r(k) WHERE i < 6) JOIN xs USING (strategy, c)
    GROUP BY i, strategy, c, l) GROUP BY i, strategy, c)
  SELECT strategy, c, lam FROM it WHERE i = 6)"""


@register("power_fit", "F10 F11", with_flights(
    "SELECT strategy, c AS column, ROUND(lam, 4) AS lambda FROM lam", extra=_LAMBDA_CTE))
def q_power_fit(spark, sf):
    """Fitted lambdas (grid-zoom maximum likelihood) for Box-Cox and
    Yeo-Johnson; checked against a NumPy brute force in the tests."""
    # both fits read the rows: join once, keep what they use
    train = write_table(_train(flights(spark, sf)).select("price", "distance", "time"), "fit_rows")
    bc = fit_power(train, ["price", "distance"], "box-cox")
    yj = fit_power(train, ["time"], "yeo-johnson")
    rows = [("box-cox", c, round(v, 4)) for c, v in bc.lambdas.items()]
    rows += [("yeo-johnson", c, round(v, 4)) for c, v in yj.lambdas.items()]
    return spark.createDataFrame(rows, "strategy string, column string, lambda double")
