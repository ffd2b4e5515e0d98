"""Catalogue: quality gates (Q1-Q16) and layer jobs (L1-L4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.profile import group_stats
from ..operators.quality import rules as R
from ..operators.quality import suites
from ..plans import config as C
from ..plans.layers import bronze_gate, fit_gold, gold_base, gold_gate, silver_gate, silver_transform
from ..session import write_table
from ..sources.tables import RAW_COLUMNS, raw_flights
from .base import BAYES_RIDGE_SQL, TIE, r, register, with_flights

_GATE_COLS = ["rule", "kind", "column", "success", "unexpected_count", "element_count"]


def _raw(spark, sf):
    return raw_flights(spark, sf).select(*RAW_COLUMNS)


def _bronze_rules():
    return suites.bronze_suite(flight_types=C.FLIGHT_TYPE_ORDER)


def _row(rule, kind, column, success, bad="NULL", elems="NULL"):
    col = "NULL" if column is None else f"'{column}'"
    return (f"SELECT '{rule}' AS rule, '{kind}' AS kind, CAST({col} AS VARCHAR) AS column, "
            f"{success} AS success, CAST({bad} AS BIGINT) AS unexpected_count, "
            f"CAST({elems} AS BIGINT) AS element_count")


_NUMBERS = ["TINYINT", "SMALLINT", "INTEGER", "BIGINT", "FLOAT", "DOUBLE"]
# DuckDB types that each type name of the suites accepts
_DUCK_TYPES = {"int": _NUMBERS[:4], "int64": ["BIGINT"], "int32": ["INTEGER"], "int16": ["SMALLINT"], "int8": ["TINYINT"],
               "float64": ["DOUBLE"], "float32": ["FLOAT"], "category": ["VARCHAR"], "datetime64[ns]": ["DATE", "TIMESTAMP"]}


def _type_sql(c, src, types):
    return f"(SELECT bool_and(typeof(\"{c}\") IN ({', '.join(repr(t) for t in types)})) FROM {src})"


# Raw columns as the SQL side sees them (bronze view of the flights CTE)
_RAW_SQL = ("raw AS (SELECT travel_code AS travelCode, user_code AS userCode, from_location AS "
            "\"from\", to_location AS \"to\", flight_type AS flightType, price, time, distance, "
            "agency, strftime(date, '%Y-%m-%d') AS date FROM flights)")


def _bronze_sql():
    rows = [_row("columns_match_set", "columns_match_set", None, "TRUE"),
            _row("row_count_between", "row_count_between", None,
                 "(SELECT count(*) >= 1 FROM raw)")]
    for c in suites.RAW_REQUIRED:
        rows.append(_row(f"not_null:{c}", "not_null", c,
                         f"(SELECT count_if(\"{c}\" IS NULL) = 0 FROM raw)",
                         f"(SELECT count_if(\"{c}\" IS NULL) FROM raw)", "(SELECT count(*) FROM raw)"))
    for c in suites.RAW_NUMERIC:
        rows.append(_row(f"type_in_list:{c}", "type_in_list", c, _type_sql(c, "raw", _NUMBERS)))
        if c in suites.RAW_NON_NEGATIVE:
            rows.append(_row(f"between:{c}", "between", c,
                             f"(SELECT count_if(\"{c}\" < 0) = 0 FROM raw)",
                             f"(SELECT count_if(\"{c}\" < 0) FROM raw)",
                             f"(SELECT count(\"{c}\") FROM raw)"))
    for c in suites.RAW_STRING:
        rows.append(_row(f"type_in_list:{c}", "type_in_list", c, _type_sql(c, "raw", ["VARCHAR"])))
    bad_date = "count_if(try_strptime(date, '%Y-%m-%d') IS NULL AND date IS NOT NULL)"
    rows.append(_row("matches_strftime:date", "matches_strftime", "date",
                     f"(SELECT {bad_date} = 0 FROM raw)", f"(SELECT {bad_date} FROM raw)",
                     "(SELECT count(date) FROM raw)"))
    bad_t = "count_if(flightType NOT IN ('A', 'N', 'R'))"
    rows.append(_row("in_set:flightType", "in_set", "flightType",
                     f"(SELECT {bad_t} / count(flightType) <= 0.02 + 1e-12 FROM raw)",
                     f"(SELECT {bad_t} FROM raw)", "(SELECT count(flightType) FROM raw)"))
    return with_flights("\nUNION ALL\n".join(rows), extra=_RAW_SQL)


@register("gate_bronze", "Q1 Q3 Q4 Q5 Q7 Q8 Q9 Q15 L1", _bronze_sql())
def q_gate_bronze(spark, sf):
    res, _ = bronze_gate(_raw(spark, sf), _bronze_rules())
    return res.select(*_GATE_COLS)


# --- silver ------------------------------------------------------------------

_KEY = ", ".join(suites.SILVER_KEY)

_SILVER_SQL = f"""
SELECT CAST(travel_code AS BIGINT) AS travel_code, CAST(user_code AS BIGINT) AS user_code,
       from_location, to_location, flight_type, price, CAST(time AS FLOAT) AS time,
       CAST(distance AS FLOAT) AS distance, agency, date,
       CAST(year(date) AS SMALLINT) AS year, CAST(month(date) AS TINYINT) AS month,
       CAST(day(date) AS TINYINT) AS day, CAST(isodow(date) - 1 AS TINYINT) AS day_of_week,
       CAST(dayofyear(date) AS SMALLINT) AS day_of_year, CAST(weekofyear(date) AS INTEGER) AS week_of_year
FROM (SELECT * FROM flights QUALIFY row_number() OVER
      (PARTITION BY user_code, from_location, to_location, date, CAST(time AS FLOAT), agency
       ORDER BY date, {TIE}) = 1)"""


def _silver(spark, sf, raw=None):
    return silver_transform(raw_flights(spark, sf) if raw is None else raw, keep_tie_key=False,
                            tie_key=["travel_code", "line_number", "part_key", "supp_key"])


def _wide_codes(s):
    """Codes as long: the type that narrowing picks for them depends on the
    table's size (``type_narrowing_report`` checks the rule)."""
    return s.withColumns({c: F.col(c).cast("long") for c in ("travel_code", "user_code")})


@register("silver_layer", "L2 P1 P2 P4 P5 P9 U3 X1", with_flights(_SILVER_SQL))
def q_silver(spark, sf):
    return _wide_codes(_silver(spark, sf))


@register("silver_group_stats", "L2 A1", with_flights(
    "SELECT flight_type, agency, ROUND(avg(price), 6) AS mean_price, ROUND(sum(price), 2) AS "
    "sum_price, count(price) AS count_price, bool_or(price <> 0) AS any_price, "
    "ROUND(quantile_cont(price, 0.5), 6) AS median_price FROM s GROUP BY flight_type, agency",
    extra=f"s AS ({_SILVER_SQL})"))
def q_silver_stats(spark, sf):
    g = group_stats(_silver(spark, sf), ["flight_type", "agency"], "price")
    return g.select("flight_type", "agency", r("mean_price"), r("sum_price", 2), "count_price",
                    "any_price", r("median_price"))


def _silver_gate_sql():
    rows = [_row("columns_match_ordered_list", "columns_match_ordered_list", None, "TRUE"),
            _row("compound_columns_unique", "compound_columns_unique", None,
                 f"(SELECT coalesce(sum(n), 0) = 0 FROM (SELECT count(*) AS n FROM s GROUP BY {_KEY}) "
                 f"WHERE n > 1)",
                 f"(SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM s GROUP BY {_KEY}) "
                 f"WHERE n > 1)", "(SELECT count(*) FROM s)"),
            _row("row_count_between", "row_count_between", None, "(SELECT count(*) >= 1 FROM s)"),
            _row("mean_between:price", "mean_between", "price",
                 "(SELECT avg(price) BETWEEN 100 AND 5000 FROM s)")]
    for c, t in C.SILVER_TYPES.items():
        kind = "type_in_list" if t == "category" else "type_is"
        rows.append(_row(f"{kind}:{c}", kind, c, _type_sql(c, "s", _DUCK_TYPES[t])))
    for c in suites.SILVER_REQUIRED:
        rows.append(_row(f"not_null:{c}", "not_null", c,
                         f"(SELECT count_if({c} IS NULL) = 0 FROM s)",
                         f"(SELECT count_if({c} IS NULL) FROM s)", "(SELECT count(*) FROM s)"))
    return with_flights("\nUNION ALL\n".join(rows), extra=f"s AS ({_SILVER_SQL})")


@register("gate_silver", "Q2 Q6 Q10 Q11 Q15 L2", _silver_gate_sql())
def q_gate_silver(spark, sf):
    res, _ = silver_gate(_silver(spark, sf))
    return res.select(*_GATE_COLS)


# Raw rows with a fault of every kind that a row can have.
_DIRTY_SQL = ("dirty AS (SELECT travel_code, line_number, part_key, supp_key, "
              "CASE WHEN travel_code % 5 = 0 THEN NULL ELSE user_code END AS user_code, "
              "CASE WHEN travel_code % 7 = 0 THEN -price ELSE price END AS price, "
              "CASE WHEN travel_code % 9 = 0 THEN 'no date' ELSE strftime(date, '%Y-%m-%d') END AS date, "
              "CASE WHEN travel_code % 50 = 0 THEN 'Z' ELSE flight_type END AS flight_type, agency, time FROM flights)")


def _dirty(spark, sf):
    from ..sources.tables import flights
    f = flights(spark, sf)
    on = lambda k: F.col("travel_code") % k == 0
    return f.select(
        *C.TIE_KEY, F.when(~on(5), F.col("user_code")).alias("user_code"),
        F.when(on(7), -F.col("price")).otherwise(F.col("price")).alias("price"),
        F.when(on(9), F.lit("no date")).otherwise(F.date_format("date", "yyyy-MM-dd")).alias("date"),
        F.when(on(50), F.lit("Z")).otherwise(F.col("flight_type")).alias("flight_type"), "agency", "time")


def _dirty_rules():
    exact = R.in_set("flight_type", C.FLIGHT_TYPE_ORDER, mostly=1.0)
    loose = R.in_set("flight_type", C.FLIGHT_TYPE_ORDER, mostly=0.9)
    return [R.not_null("user_code"), R.between("price", 0, None), R.matches_date_format("date"),
            R.Rule(exact.kind, exact.column, exact.params, 1.0, "in_set_all"),
            R.Rule(loose.kind, loose.column, loose.params, 0.9, "in_set_most"),
            R.compound_unique(["travel_code", "agency"]), R.mean_between("time", 0, 1), R.stdev_between("time", 0, 1),
            R.median_between("time", 0, 1), R.row_count_between(1, 10)]


def _dirty_gate_sql():
    frac = lambda bad, col: f"(SELECT count_if({bad}) FROM dirty)"
    type_bad = "flight_type NOT IN ('A', 'N', 'R')"
    dup = "(SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM dirty GROUP BY travel_code, agency) WHERE n > 1)"
    n = "(SELECT count(*) FROM dirty)"
    rows = [
        _row("not_null:user_code", "not_null", "user_code", "(SELECT count_if(user_code IS NULL) = 0 FROM dirty)",
             frac("user_code IS NULL", ""), n),
        _row("between:price", "between", "price", "(SELECT count_if(price < 0) = 0 FROM dirty)", frac("price < 0", ""),
             "(SELECT count(price) FROM dirty)"),
        _row("matches_strftime:date", "matches_strftime", "date",
             "(SELECT count_if(try_strptime(date, '%Y-%m-%d') IS NULL) = 0 FROM dirty)",
             frac("try_strptime(date, '%Y-%m-%d') IS NULL", ""), "(SELECT count(date) FROM dirty)"),
        _row("in_set_all", "in_set", "flight_type", f"(SELECT count_if({type_bad}) = 0 FROM dirty)", frac(type_bad, ""), n),
        _row("in_set_most", "in_set", "flight_type", f"(SELECT count_if({type_bad}) / count(*) <= 0.1 + 1e-12 FROM dirty)",
             frac(type_bad, ""), n),
        _row("compound_columns_unique", "compound_columns_unique", None, f"({dup} = 0)", dup, n),
        _row("mean_between:time", "mean_between", "time", "(SELECT avg(time) BETWEEN 0 AND 1 FROM dirty)"),
        _row("stdev_between:time", "stdev_between", "time", "(SELECT stddev_samp(time) BETWEEN 0 AND 1 FROM dirty)"),
        _row("median_between:time", "median_between", "time", "(SELECT quantile_cont(time, 0.5) BETWEEN 0 AND 1 FROM dirty)"),
        _row("row_count_between", "row_count_between", None, "(SELECT count(*) BETWEEN 1 AND 10 FROM dirty)")]
    return with_flights("\nUNION ALL\n".join(rows), extra=_DIRTY_SQL)


@register("gate_dirty", "Q3 Q4 Q7 Q8 Q9 Q10 Q11 Q12 Q13", _dirty_gate_sql())
def q_gate_dirty(spark, sf):
    """A table that breaks a rule of every kind."""
    return R.run_rules(_dirty(spark, sf), _dirty_rules()).select(*_GATE_COLS)


_DIRTY_MASK = ("(CASE WHEN user_code IS NULL THEN 1 ELSE 0 END + CASE WHEN price < 0 THEN 2 ELSE 0 END + CASE WHEN "
               "date = 'no date' THEN 4 ELSE 0 END + CASE WHEN flight_type = 'Z' THEN 24 ELSE 0 END)")


@register("broken_rules", "Q14", with_flights(
    f"SELECT {TIE}, CAST({_DIRTY_MASK} AS BIGINT) AS broken FROM dirty", extra=_DIRTY_SQL))
def q_broken_rules(spark, sf):
    """Every row with the bit mask of the row rules that it breaks."""
    return R.with_broken_rules(_dirty(spark, sf), _dirty_rules()).select(*C.TIE_KEY, "broken")


@register("failing_rows", "Q14", with_flights(
    f"SELECT rule, {TIE} FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY md5(concat_ws('|', {TIE}, 3)), {TIE}) "
    "AS n FROM (SELECT unnest(['not_null:user_code', 'between:price', 'matches_strftime:date', 'in_set_all', 'in_set_most']) "
    f"AS rule, unnest([user_code IS NULL, price < 0, date = 'no date', flight_type = 'Z', flight_type = 'Z']) AS bad, {TIE} "
    "FROM dirty) WHERE bad) WHERE n <= 20", extra=_DIRTY_SQL))
def q_failing_rows(spark, sf):
    """For each rule 20 of the rows that break it."""
    return R.failing_rows(_dirty(spark, sf), _dirty_rules(), 20, C.TIE_KEY, seed=3).select("rule", *C.TIE_KEY)


@register("gate_failures", "Q14 Q16", with_flights(
    "SELECT 'mean_between:price' AS rule, 'mean_between' AS kind, 'price' AS column, "
    "ROUND(avg(price), 4) AS observed FROM s WHERE NOT (SELECT avg(price) "
    "BETWEEN 100 AND 5000 FROM s)", extra=f"s AS ({_SILVER_SQL})"))
def q_gate_failures(spark, sf):
    s = _silver(spark, sf)
    rules = [R.Rule(x.kind, x.column, x.params, x.mostly, x.name)
             for x in suites.silver_suite(types=C.SILVER_TYPES)]
    res = R.failing_rules(R.run_rules(s, rules))
    return res.select("rule", "kind", "column",
                      F.round(F.col("observed").try_cast("double"), 4).alias("observed"))


# --- gold --------------------------------------------------------------------


GOLD_TRAIN_END = "1999-01-01"
_ENC = ["from_location", "to_location", "agency"]


def _gold_sql(cond=f"date >= DATE '{GOLD_TRAIN_END}'", wrap=None):
    codes = ",\n".join(
        f"code_{c} AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS DOUBLE) AS k FROM "
        f"(SELECT DISTINCT {c} AS v FROM s WHERE date < DATE '{GOLD_TRAIN_END}' AND {c} IS NOT NULL))"
        for c in _ENC)
    body = f"""
SELECT CAST(CASE g.flight_type WHEN 'A' THEN 0.0 WHEN 'N' THEN 1.0 WHEN 'R' THEN 2.0 END AS DOUBLE) AS flight_type,
       {', '.join(f"COALESCE((SELECT k FROM code_{c} WHERE v = g.{c}), -1.0) AS {c}" for c in _ENC)},
       CAST(g.price AS DOUBLE) AS price, CAST(g.time AS DOUBLE) AS time,
       CAST(g.distance AS DOUBLE) AS distance, CAST(g.year AS DOUBLE) AS year,
       ROUND(sin(2 * pi() * g.month / 12), 6) AS month_sin, ROUND(cos(2 * pi() * g.month / 12), 6) AS month_cos,
       ROUND(sin(2 * pi() * g.day_of_week / 7), 6) AS day_of_week_sin,
       ROUND(cos(2 * pi() * g.day_of_week / 7), 6) AS day_of_week_cos,
       ROUND(sin(2 * pi() * g.day / 31), 6) AS day_sin, ROUND(cos(2 * pi() * g.day / 31), 6) AS day_cos
FROM (SELECT DISTINCT from_location, to_location, flight_type, price, time, distance, agency,
             year, month, day, day_of_week
      FROM s WHERE {cond} AND price IS NOT NULL) g"""
    if wrap is not None:
        return with_flights(wrap, extra=f"s AS ({_SILVER_SQL}),\n{codes},\ng AS ({body})")
    return with_flights(body, extra=f"s AS ({_SILVER_SQL}),\n{codes}")


_CYC = ["month_sin", "month_cos", "day_of_week_sin", "day_of_week_cos", "day_sin", "day_cos"]


@register("gold_tree", "L3 L4 P7 P8 U2 F1 X2 E1 E2 E4 P3", _gold_sql())
def q_gold_tree(spark, sf):
    s = _silver(spark, sf)
    d = F.col("date")
    train = s.where(d < F.lit(GOLD_TRAIN_END).cast("date"))
    rest = s.where(d >= F.lit(GOLD_TRAIN_END).cast("date"))
    model = fit_gold(train, is_tree_model=True)
    g = model.transform(rest)
    return g.select(*[r(c) if c in _CYC else F.col(c) for c in g.columns])


_GOLD_COLS = ["flight_type", "from_location", "to_location", "agency", "price", "time",
              "distance", "year", "month_sin", "month_cos", "day_of_week_sin",
              "day_of_week_cos", "day_sin", "day_cos"]


def _gold_gate_sql():
    rows = [_row("columns_match_ordered_list", "columns_match_ordered_list", None, "TRUE"),
            _row("between:price", "between", "price", "(SELECT count_if(price < 0) = 0 FROM g)",
                 "(SELECT count_if(price < 0) FROM g)", "(SELECT count(price) FROM g)"),
            _row("row_count_between", "row_count_between", None, "(SELECT count(*) >= 10 FROM g)")]
    rows += [_row(f"type_in_list:{c}", "type_in_list", c, _type_sql(c, "g", _NUMBERS)) for c in _GOLD_COLS]
    rows += [_row(f"not_null:{c}", "not_null", c, f"(SELECT count_if({c} IS NULL) = 0 FROM g)",
                  f"(SELECT count_if({c} IS NULL) FROM g)", "(SELECT count(*) FROM g)")
             for c in _GOLD_COLS]
    return _gold_sql(f"date < DATE '{GOLD_TRAIN_END}'", wrap="\nUNION ALL\n".join(rows))


@register("gate_gold", "Q2 Q3 Q4 Q5 Q7 Q15 L3", _gold_gate_sql())
def q_gate_gold(spark, sf):
    s = _silver(spark, sf)
    d = F.col("date")
    train = s.where(d < F.lit(GOLD_TRAIN_END).cast("date"))
    model = fit_gold(train, is_tree_model=True)
    res, _ = gold_gate(model.transform(train), model)
    return res.select(*_GATE_COLS)


def _gold_linear_sql():
    t = f"DATE '{GOLD_TRAIN_END}'"
    cols = ("from_location, to_location, flight_type, price, time, distance, agency, year, "
            "month, day, day_of_week")

    def rare(c):
        return (f"CASE WHEN {c} IN (SELECT v FROM (SELECT {c} AS v, count(*) AS n, "
                f"sum(count(*)) OVER () AS tot FROM bt WHERE {c} IS NOT NULL GROUP BY {c}) "
                f"WHERE CAST(n AS DOUBLE) / tot >= 0.041) THEN {c} ELSE 'Other' END AS {c}")

    def enc(src):
        auto = ", ".join(
            f"COALESCE((SELECT k FROM cd_{c} WHERE v = x.{c}), -1.0) AS {c}"
            for c in ["from_location", "to_location", "agency"])
        return (f"SELECT CASE x.flight_type WHEN 'A' THEN 0.0 WHEN 'N' THEN 1.0 WHEN 'R' THEN 2.0 END "
                f"AS flight_type, {auto}, CAST(x.price AS DOUBLE) AS price, CAST(x.time AS DOUBLE) "
                f"AS time, CAST(x.distance AS DOUBLE) AS distance, CAST(x.year AS DOUBLE) AS year, "
                f"sin(2 * pi() * x.month / 12) AS month_sin, cos(2 * pi() * x.month / 12) AS month_cos, "
                f"sin(2 * pi() * x.day_of_week / 7) AS day_of_week_sin, "
                f"cos(2 * pi() * x.day_of_week / 7) AS day_of_week_cos, "
                f"sin(2 * pi() * x.day / 31) AS day_sin, cos(2 * pi() * x.day / 31) AS day_cos "
                f"FROM {src} x")

    flag = " OR ".join(
        f"({c} < {c}_q1 - 1.5 * ({c}_q3 - {c}_q1) OR {c} > {c}_q3 + 1.5 * ({c}_q3 - {c}_q1))"
        for c in ["price", "time", "distance"])
    codes = ",\n".join(
        f"cd_{c} AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS DOUBLE) AS k FROM "
        f"(SELECT DISTINCT {c} AS v FROM rt WHERE {c} IS NOT NULL))"
        for c in ["from_location", "to_location", "agency"])
    extra = f"""s AS ({_SILVER_SQL}),
bt AS (SELECT DISTINCT {cols} FROM s WHERE date < {t} AND price IS NOT NULL),
br AS (SELECT DISTINCT {cols} FROM s WHERE date >= {t} AND price IS NOT NULL),
rt AS (SELECT {rare('from_location')}, {rare('to_location')}, flight_type, price, time, distance,
              agency, year, month, day, day_of_week FROM bt),
rr AS (SELECT {rare('from_location')}, {rare('to_location')}, flight_type, price, time, distance,
              agency, year, month, day, day_of_week FROM br),
{codes},
et AS ({enc('rt')}),
er AS ({enc('rr')}),
q AS (SELECT {", ".join(f"quantile_cont({c}, 0.25) AS {c}_q1, quantile_cont({c}, 0.75) AS {c}_q3"
                        for c in ["price", "time", "distance"])} FROM et),
tt AS (SELECT et.* FROM et, q WHERE NOT ({flag})),
sc AS (SELECT avg(time) AS tm, stddev_samp(time) AS ts, avg(distance) AS dm,
              stddev_samp(distance) AS ds FROM tt)"""
    body = ("SELECT ROUND(flight_type, 6) AS flight_type, ROUND(from_location, 6) AS from_location, "
            "ROUND(to_location, 6) AS to_location, ROUND(agency, 6) AS agency, "
            "ROUND(price, 6) AS price, ROUND((time - tm) / ts, 6) AS time, "
            "ROUND((distance - dm) / ds, 6) AS distance, ROUND(year, 6) AS year, "
            + ", ".join(f"ROUND({c}, 6) AS {c}" for c in
                        ["month_sin", "month_cos", "day_of_week_sin", "day_of_week_cos",
                         "day_sin", "day_cos"])
            + f" FROM er, q, sc WHERE NOT ({flag})")
    return with_flights(body, extra=extra)


@register("gold_linear", "L3 F5 F3 F8 F12", _gold_linear_sql())
def q_gold_linear(spark, sf):
    """Non-tree path: rare grouping before encoding, IQR trim, standard
    scaling of the numeric inputs; fitted on the training period."""
    s = _silver(spark, sf)
    d = F.col("date")
    train = s.where(d < F.lit(GOLD_TRAIN_END).cast("date"))
    rest = s.where(d >= F.lit(GOLD_TRAIN_END).cast("date"))
    model = fit_gold(train, is_tree_model=False, rare_cols=["from_location", "to_location"],
                     rare_threshold=0.041, outlier_cols=["price", "time", "distance"],
                     scaler_cols=["time", "distance"], scaler_strategy="standard")
    g = model.transform(rest)
    return g.select(*[r(c) for c in g.columns])


def _gold_options_sql():
    """Chain of ``gold_options`` in SQL: distance filled by the regression on
    time over its observed rows (one-predictor Bayesian ridge, iterated to
    its evidence maximum), one-hot agencies, z-score clipping, min-max."""
    t = f"DATE '{GOLD_TRAIN_END}'"
    cols = ("from_location, to_location, flight_type, price, time, distance, agency, year, month, day, "
            "day_of_week")
    codes = ",\n".join(
        f"cd_{c} AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS DOUBLE) AS k FROM (SELECT DISTINCT {c} AS v "
        f"FROM s2 WHERE date < {t} AND {c} IS NOT NULL))" for c in ("from_location", "to_location"))

    def enc(cond):
        hot = ", ".join(f"CASE WHEN x.agency = '{a}' THEN 1.0 ELSE 0.0 END AS agency_{a.lower()}" for a in C.AGENCIES)
        auto = ", ".join(f"COALESCE((SELECT k FROM cd_{c} WHERE v = x.{c}), -1.0) AS {c}"
                         for c in ("from_location", "to_location"))
        cyc = ", ".join(f"{f}(2 * pi() * x.{c} / {p}) AS {c}_{f}" for c, p in C.CYCLICAL_FEATURES_MAP.items()
                        for f in ("sin", "cos"))
        return (f"SELECT {hot}, CASE x.flight_type WHEN 'A' THEN 0.0 WHEN 'N' THEN 1.0 WHEN 'R' THEN 2.0 END AS flight_type, "
                f"{auto}, CAST(x.price AS DOUBLE) AS price, CAST(x.time AS DOUBLE) AS time, "
                "COALESCE(CAST(x.distance AS DOUBLE), a + b * x.time) AS distance, "
                f"CAST(x.year AS DOUBLE) AS year, {cyc} FROM (SELECT DISTINCT {cols} FROM s2 WHERE {cond}) x, mice")

    num = ("price", "time", "distance")
    clip = lambda c: f"least(greatest({c}, {c}_m - 3 * {c}_s), {c}_m + 3 * {c}_s)"
    extra = f"""s AS ({_SILVER_SQL}),
s2 AS (SELECT * REPLACE (CASE WHEN (travel_code + user_code) % 11 = 0 THEN NULL ELSE distance END AS distance) FROM s),
base AS (SELECT DISTINCT {cols} FROM s2 WHERE date < {t}),
mo AS (SELECT count(*)::DOUBLE AS n, var_pop(CAST(time AS DOUBLE)) * count(*) AS ev,
         covar_pop(CAST(time AS DOUBLE), CAST(distance AS DOUBLE)) * count(*) AS xty,
         var_pop(CAST(distance AS DOUBLE)) * count(*) AS yty, var_pop(CAST(distance AS DOUBLE)) AS vy,
         avg(CAST(time AS DOUBLE)) AS mx, avg(CAST(distance AS DOUBLE)) AS my FROM base WHERE distance IS NOT NULL),
ridge AS ({BAYES_RIDGE_SQL}),
mice AS (SELECT coef AS b, my - coef * mx AS a FROM ridge, mo),
{codes},
et AS ({enc(f"date < {t}")}),
er AS ({enc(f"date >= {t}")}),
q AS (SELECT {", ".join(f"avg({c}) AS {c}_m, stddev_samp({c}) AS {c}_s" for c in num)} FROM et),
mm AS (SELECT {", ".join(f"min({clip(c)}) AS {c}_lo, max({clip(c)}) AS {c}_hi" for c in num[1:])} FROM et, q)"""
    plain = [*(f"agency_{a.lower()}" for a in C.AGENCIES), "flight_type", "from_location", "to_location", "year",
             *(f"{c}_{f}" for c in C.CYCLICAL_FEATURES_MAP for f in ("sin", "cos"))]
    out = [f"ROUND({c}, 6) AS {c}" for c in plain] + [f"ROUND({clip('price')}, 4) AS price"]
    out += [f"ROUND(({clip(c)} - {c}_lo) / ({c}_hi - {c}_lo), 6) AS {c}" for c in num[1:]]
    return with_flights(f"SELECT {', '.join(out)} FROM er, q, mm", extra=extra)


@register("gold_options", "L3 L4 E3 F2 F4 F9 F12", _gold_options_sql())
def q_gold_options(spark, sf):
    """A non-tree chain of other options - chained equations, one-hot,
    z-score clipping, min-max - fitted, saved and applied by a second
    session to the evaluation rows."""
    import uuid
    from ..operators.model.estimators import assemble, make_estimator
    from ..plans.bundle import load_bundle, save_bundle
    from ..plans.scoring import ScoringBundle
    from ..session import ensure_checkpoint_dir
    s = _silver(spark, sf).withColumn("distance", F.when(
        (F.col("travel_code") + F.col("user_code")) % 11 != 0, F.col("distance")))
    train = s.where(F.col("date") < F.lit(GOLD_TRAIN_END).cast("date"))
    base = gold_base(train)         # the chain and the model read it
    gm = fit_gold(base, is_tree_model=False, prepared=True, mice_cols=["time", "distance"], onehot_cols=["agency"],
                  outlier_cols=["price", "time", "distance"], outlier_detection="zscore", outlier_handling="winsorize",
                  scaler_cols=["time", "distance"], scaler_strategy="minmax")
    model = make_estimator("LinearRegression", {}, label=C.TARGET).fit(
        assemble(gm.transform(base, prepared=True), ["time", "distance"]))
    path = f"{ensure_checkpoint_dir(spark)}/bundle_{uuid.uuid4().hex}"
    save_bundle(spark, ScoringBundle(gm, model, ["time", "distance"], list(C.TIE_KEY)), path)
    again = load_bundle(spark.newSession(), path).gold
    g = again.transform(s.where(F.col("date") >= F.lit(GOLD_TRAIN_END).cast("date")))
    return g.select(*[r(c, 4 if c == "price" else 6) for c in g.columns])


_SCALE_GATES = {"standard": ("avg", "stddev_samp"), "robust": ("quantile_cont",), "minmax": ("max",)}


def _gate_scaled_sql():
    stats = ", ".join(f"avg({c}) AS {c}_m, stddev_samp({c}) AS {c}_s, quantile_cont({c}, 0.5) AS {c}_q2, "
                      f"quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS {c}_iqr, min({c}) AS {c}_lo, "
                      f"max({c}) AS {c}_hi" for c in ("time", "distance"))
    def row(strategy, rule, c, ok):
        return (f"SELECT '{strategy}' AS strategy, '{rule}:{c}' AS rule, '{rule}' AS kind, '{c}' AS column, "
                f"({ok}) AS success")
    rows = []
    for c in ("time", "distance"):
        z = f"({c} - {c}_m) / {c}_s"
        rows += [row("standard", "mean_between", c, f"SELECT avg({z}) BETWEEN -0.2 AND 0.2 FROM g, st"),
                 row("standard", "stdev_between", c, f"SELECT stddev_samp({z}) BETWEEN 0.8 AND 1.2 FROM g, st"),
                 row("robust", "median_between", c,
                     f"SELECT quantile_cont(({c} - {c}_q2) / {c}_iqr, 0.5) BETWEEN -0.2 AND 0.2 FROM g, st"),
                 row("minmax", "between", c, f"SELECT count_if(NOT ({c} - {c}_lo) / ({c}_hi - {c}_lo) BETWEEN 0 AND 1.01) "
                     "= 0 FROM g, st"),
                 # the same suites over rows that nothing scaled
                 row("none/standard", "mean_between", c, f"SELECT avg({c}) BETWEEN -0.2 AND 0.2 FROM g"),
                 row("none/standard", "stdev_between", c, f"SELECT stddev_samp({c}) BETWEEN 0.8 AND 1.2 FROM g"),
                 row("none/robust", "median_between", c, f"SELECT quantile_cont({c}, 0.5) BETWEEN -0.2 AND 0.2 FROM g"),
                 row("none/minmax", "between", c, f"SELECT count_if(NOT {c} BETWEEN 0 AND 1.01) = 0 FROM g")]
    sql = _gold_sql(f"date < DATE '{GOLD_TRAIN_END}'", wrap="\nUNION ALL\n".join(rows))
    at = sql.rindex("\nSELECT 'standard' AS strategy, 'mean_between:time'")
    return sql[:at].rstrip() + f",\nst AS (SELECT {stats} FROM g)" + sql[at:]


@register("gate_scaled", "Q7 Q11 Q12 Q13 Q15 L3", _gate_scaled_sql())
def q_gate_scaled(spark, sf):
    """The scaler rules of the gold gate for each scaler: over the scaled
    training rows, where they hold, and over the rows before scaling, where
    they do not."""
    s = _silver(spark, sf)
    train = s.where(F.col("date") < F.lit(GOLD_TRAIN_END).cast("date"))
    cols, out = ["time", "distance"], None
    base = gold_base(train)         # all chains read it, and differ in their last step only
    plain = fit_gold(base, is_tree_model=False, prepared=True)
    unscaled = write_table(plain.transform(base, prepared=True), "gold_unscaled")
    for strategy in _SCALE_GATES:
        m = fit_gold(base, is_tree_model=False, scaler_cols=cols, scaler_strategy=strategy, prepared=True, fitted=plain)
        for name, df, model in ((strategy, m.transform(base, prepared=True), m), (f"none/{strategy}", unscaled, m)):
            res, _ = gold_gate(df, model, strategy)
            got = res.where(F.col("column").isin(cols) & F.col("kind").isin(
                "mean_between", "stdev_between", "median_between", "between")).select(
                F.lit(name).alias("strategy"), "rule", "kind", "column", "success")
            out = got if out is None else out.unionByName(got)
    return out


@register("silver_route", "S7 Q16 L2", with_flights(
    "SELECT 'quarantine' AS routed_to, * FROM s", extra=f"s AS ({_SILVER_SQL})"))
def q_silver_route(spark, sf):
    """The silver table goes through its gate and is written to processed or
    quarantine; the written table is read back with the area it went to."""
    import uuid
    from ..session import ensure_checkpoint_dir
    from ..sources.sinks import route_write
    s = _silver(spark, sf)
    _, ok = silver_gate(s)
    base = f"{ensure_checkpoint_dir(spark)}/layers_{uuid.uuid4().hex}"
    path = route_write(s, ok, f"{base}/processed", f"{base}/quarantine", "silver")
    area = "processed" if ok else "quarantine"
    return _wide_codes(spark.read.parquet(path)).select(F.lit(area).alias("routed_to"), *s.columns)


@register("bronze_route", "S6 S1 Q16 L1", with_flights(
    "SELECT 'processed' AS routed_to, * FROM raw", extra=_RAW_SQL))
def q_bronze_route(spark, sf):
    """Raw file through the bronze gate: written as CSV to processed or
    quarantine, then read back (typed) from where it went."""
    import uuid
    from ..plans.layers import run_bronze
    from ..session import ensure_checkpoint_dir
    from ..sources.readers import load_data
    raw = _raw(spark, sf)
    base = f"{ensure_checkpoint_dir(spark)}/layers_{uuid.uuid4().hex}"
    path = run_bronze(raw, f"{base}/processed", f"{base}/quarantine", "flights.csv",
                      rules=_bronze_rules())
    area = "processed" if "/processed/" in path else "quarantine"
    back = load_data(spark, path, schema=raw.schema)
    return back.select(F.lit(area).alias("routed_to"), *raw.columns)


_SCORE_FEATS = ["distance", "flight_type"]


def _score_sql():
    body_g = _gold_sql(f"date < DATE '{GOLD_TRAIN_END}'", wrap="SELECT 1")
    # reuse the gold CTEs, then a 2-feature OLS in closed form
    ctes_end = body_g.rindex("SELECT 1")
    prefix = body_g[:ctes_end].rstrip()
    tail = f""",
c AS (SELECT var_pop(distance) AS s11, var_pop(flight_type) AS s22,
             covar_pop(distance, flight_type) AS s12, covar_pop(distance, price) AS s1y,
             covar_pop(flight_type, price) AS s2y, avg(price) AS my, avg(distance) AS m1,
             avg(flight_type) AS m2 FROM g),
b AS (SELECT b1, b2, my - b1 * m1 - b2 * m2 AS b0 FROM (
        SELECT (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1,
               (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2, my, m1, m2 FROM c))
SELECT f.travel_code, f.line_number, f.part_key, f.supp_key,
       ROUND(b0 + b1 * f.distance + b2 * CASE f.flight_type WHEN 'A' THEN 0.0 WHEN 'N' THEN 1.0
             WHEN 'R' THEN 2.0 END, 0) AS predicted_price
FROM flights f, b"""
    return prefix + tail


@register("score_linear", "L5 P10 M1 E2", _score_sql())
def q_score_linear(spark, sf):
    """Batch scoring of every raw row with a bundle whose model is OLS on
    (distance, flight_type code) fitted on the gold training table; the
    prediction is compared at whole units (``score`` itself gives 2
    decimals)."""
    from ..operators.model.estimators import assemble, make_estimator
    from ..plans.scoring import ScoringBundle, score
    rows = write_table(raw_flights(spark, sf), "raw")       # joined once: the fit and the scoring read it
    s = _silver(spark, sf, rows)
    train = s.where(F.col("date") < F.lit(GOLD_TRAIN_END).cast("date"))
    gm = fit_gold(train, is_tree_model=True)
    model = make_estimator("LinearRegression", {}, label=C.TARGET).fit(
        assemble(gm.transform(train), _SCORE_FEATS))
    b = ScoringBundle(gm, model, _SCORE_FEATS, ["travel_code", "line_number", "part_key",
                                                "supp_key"])
    return score(rows, b, decimals=0)


@register("score_from_bundle", "L4 L5", _score_sql())
def q_score_from_bundle(spark, sf):
    """``score_linear`` with the bundle saved and loaded in between, as a
    training job and a scoring job would."""
    import uuid
    from ..operators.model.estimators import assemble, make_estimator
    from ..plans.bundle import load_bundle, save_bundle
    from ..plans.scoring import ScoringBundle, score
    from ..session import ensure_checkpoint_dir
    rows = write_table(raw_flights(spark, sf), "raw")       # joined once: the fit and the scoring read it
    s = _silver(spark, sf, rows)
    train = s.where(F.col("date") < F.lit(GOLD_TRAIN_END).cast("date"))
    gm = fit_gold(train, is_tree_model=True)
    model = make_estimator("LinearRegression", {}, label=C.TARGET).fit(
        assemble(gm.transform(train), _SCORE_FEATS))
    path = f"{ensure_checkpoint_dir(spark)}/bundle_{uuid.uuid4().hex}"
    save_bundle(spark, ScoringBundle(gm, model, _SCORE_FEATS, list(C.TIE_KEY)), path)
    return score(rows, load_bundle(spark, path), decimals=0)


@register("score_rejects", "L5 P13", with_flights(
    f"SELECT {TIE}, travel_code % 11 = 0 OR travel_code % 13 = 0 AS rejected FROM flights"))
def q_score_rejects(spark, sf):
    """Raw rows with dates and flight types that cannot be scored: every row
    is either scored or rejected."""
    import uuid
    from ..operators.model.estimators import assemble, make_estimator
    from ..plans.scoring import ScoringBundle, score_with_rejects
    from ..session import ensure_checkpoint_dir
    rows = write_table(raw_flights(spark, sf), "raw")       # joined once: the fit and the scoring read it
    s = _silver(spark, sf, rows)
    train = s.where(F.col("date") < F.lit(GOLD_TRAIN_END).cast("date"))
    gm = fit_gold(train, is_tree_model=True)
    model = make_estimator("LinearRegression", {}, label=C.TARGET).fit(
        assemble(gm.transform(train), _SCORE_FEATS))
    raw = rows.withColumns({
        "date": F.when(F.col("travelCode") % 11 == 0, F.lit("no date")).otherwise(F.col("date")),
        "flightType": F.when(F.col("travelCode") % 13 == 0, F.lit("Z")).otherwise(F.col("flightType"))})
    good, bad = score_with_rejects(raw, ScoringBundle(gm, model, _SCORE_FEATS, list(C.TIE_KEY)))
    base = f"{ensure_checkpoint_dir(spark)}/scored_{uuid.uuid4().hex}"
    good.write.parquet(f"{base}/scored")
    bad.write.parquet(f"{base}/rejected")
    return spark.read.parquet(f"{base}/scored").select(*C.TIE_KEY, F.lit(False).alias("rejected")).unionByName(
        spark.read.parquet(f"{base}/rejected").select(*C.TIE_KEY, F.lit(True).alias("rejected")))


@register("score_stream_rejects", "L5 S7 P13 streaming", with_flights(
    f"SELECT {TIE}, travel_code % 11 = 0 OR travel_code % 13 = 0 AS rejected FROM flights"))
def q_score_stream_rejects(spark, sf):
    """``score_rejects`` as a stream: rows that cannot be scored arrive among
    the others, end no batch, and lie in the second sink."""
    import uuid
    from ..operators.model.estimators import assemble, make_estimator
    from ..plans.scoring import ScoringBundle
    from ..session import ensure_checkpoint_dir
    from ..streaming.scoring import files_per_trigger, read_scored, score_stream, stage_files
    rows = write_table(raw_flights(spark, sf), "raw")       # joined once: the fit and the scoring read it
    s = _silver(spark, sf, rows)
    train = s.where(F.col("date") < F.lit(GOLD_TRAIN_END).cast("date"))
    gm = fit_gold(train, is_tree_model=True)
    model = make_estimator("LinearRegression", {}, label=C.TARGET).fit(
        assemble(gm.transform(train), _SCORE_FEATS))
    raw = rows.withColumns({
        "date": F.when(F.col("travelCode") % 11 == 0, F.lit("no date")).otherwise(F.col("date")),
        "flightType": F.when(F.col("travelCode") % 13 == 0, F.lit("Z")).otherwise(F.col("flightType"))})
    base = f"{ensure_checkpoint_dir(spark)}/stream_{uuid.uuid4().hex}"
    source = stage_files(raw, f"{base}/source")
    score_stream(spark, source, ScoringBundle(gm, model, _SCORE_FEATS, list(C.TIE_KEY)), f"{base}/sink",
                 f"{base}/chk", max_files_per_trigger=files_per_trigger(spark, source, 2))
    good, bad = read_scored(spark, f"{base}/sink")
    return good.select(*C.TIE_KEY, F.lit(False).alias("rejected")).unionByName(
        bad.select(*C.TIE_KEY, F.lit(True).alias("rejected")))


def _stream(spark, source_df, transform):
    import uuid
    from ..session import ensure_checkpoint_dir
    from ..streaming.scoring import files_per_trigger, run_stream_to_table, stage_files
    base = f"{ensure_checkpoint_dir(spark)}/stream_{uuid.uuid4().hex}"
    source = stage_files(source_df, f"{base}/source")
    run_stream_to_table(spark, source, transform, f"{base}/sink", f"{base}/chk",
                        max_files_per_trigger=files_per_trigger(spark, source, 1))
    return spark.read.parquet(f"{base}/sink").drop("batch")


@register("score_linear_stream", "L5 streaming", _score_sql())
def q_score_linear_stream(spark, sf):
    """``score_linear`` as a Structured Streaming job: the raw rows arrive
    as files (one per micro-batch), each batch is scored and appended."""
    from ..operators.model.estimators import assemble, make_estimator
    from ..plans.scoring import ScoringBundle, score
    rows = write_table(raw_flights(spark, sf), "raw")       # joined once: the fit and the scoring read it
    s = _silver(spark, sf, rows)
    train = s.where(F.col("date") < F.lit(GOLD_TRAIN_END).cast("date"))
    gm = fit_gold(train, is_tree_model=True)
    model = make_estimator("LinearRegression", {}, label=C.TARGET).fit(
        assemble(gm.transform(train), _SCORE_FEATS))
    b = ScoringBundle(gm, model, _SCORE_FEATS, ["travel_code", "line_number", "part_key",
                                                "supp_key"])
    return _stream(spark, rows, lambda batch: score(batch, b, decimals=0))
