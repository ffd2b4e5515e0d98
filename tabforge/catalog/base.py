"""Registry of catalogue queries: a Spark callable plus, where the result
is SQL-expressible, the equivalent DuckDB SQL over the driver's tables.

Floating results are rounded the same way on both sides (``ROUND(x, d)``)
so that summation order does not show in value hashes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Entry:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ops: str


REGISTRY: dict[str, Entry] = {}


def register(name: str, ops: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, fn, sql, ops)
        return fn
    return deco


def r(c: Column | str, d: int = 6) -> Column:
    """Spark side of the shared rounding rule."""
    if isinstance(c, str):
        return F.round(F.col(c).cast("double"), d).alias(c)
    return F.round(c.cast("double"), d)


FLIGHTS_SQL = """
SELECT l.l_orderkey AS travel_code, o.o_custkey AS user_code,
       ns.n_name AS from_location, nc.n_name AS to_location,
       l.l_returnflag AS flight_type, l.l_extendedprice AS price,
       l.l_quantity AS time, p.p_retailprice AS distance,
       o.o_orderstatus AS agency, CAST(o.o_orderdate AS DATE) AS date,
       l.l_linenumber AS line_number, l.l_partkey AS part_key, l.l_suppkey AS supp_key
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN nation ns ON s.s_nationkey = ns.n_nationkey
JOIN nation nc ON c.c_nationkey = nc.n_nationkey
JOIN part p ON l.l_partkey = p.p_partkey
"""

NULLS_SQL = """
SELECT travel_code, user_code, from_location, to_location, flight_type,
       CASE WHEN (travel_code * 7 + line_number) % 11 = 0 THEN NULL ELSE price END AS price,
       time,
       CASE WHEN (travel_code * 7 + line_number) % 11 = 0 THEN NULL ELSE distance END AS distance,
       CASE WHEN (travel_code * 7 + line_number) % 11 = 0 THEN NULL ELSE agency END AS agency,
       date, line_number, part_key, supp_key
FROM flights
"""


def no_negative_zero(sql: str) -> str:
    """Wrap every ``ROUND(...)`` as ``(ROUND(...) + 0.0)``: DuckDB keeps the
    sign of a rounded tiny negative (``-0.0``) where Spark gives ``0.0``."""
    out, i, key = [], 0, "ROUND("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 0, j + len(key) - 1
        while True:
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        inner = no_negative_zero(sql[j + len(key):k])
        out.append(sql[i:j] + "(ROUND(" + inner + ") + 0.0)")
        i = k + 1


def with_flights(body: str, nulls: bool = False, extra: str = "") -> str:
    """``WITH flights AS (...) [, flights_n AS (...)] <extra CTEs> <body>``."""
    ctes = [f"flights AS ({FLIGHTS_SQL})"]
    if nulls:
        ctes.append(f"flights_n AS ({NULLS_SQL})")
    if extra:
        ctes.append(extra)
    return no_negative_zero("WITH " + ",\n".join(ctes) + "\n" + body)


TIE = "travel_code, line_number, part_key, supp_key"

# One-predictor Bayesian ridge from the moments mo(n, ev, xty, yty, vy): at
# most 300 rounds, until the coefficient moves by less than 1e-3.
BAYES_RIDGE_SQL = """
WITH RECURSIVE it(i, alpha, lam, old, coef, done) AS (
  SELECT 0, 1.0 / (vy + 2.220446049250313e-16), 1.0::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, FALSE FROM mo
  UNION ALL
  SELECT i + 1,
    CASE WHEN done THEN alpha ELSE (n - g + 2e-6) / (greatest(yty - 2 * c * xty + c * c * ev, 0) + 2e-6) END,
    CASE WHEN done THEN lam ELSE (g + 2e-6) / (c * c + 2e-6) END, c, c,
    coalesce(i > 0 AND abs(old - c) < 1e-3, FALSE)
  FROM (SELECT it.*, mo.*, xty / (ev + lam / alpha) AS c, alpha * ev / (lam + alpha * ev) AS g FROM it, mo)
  WHERE NOT done AND i < 300)
SELECT xty / (ev + lam / alpha) AS coef FROM (SELECT * FROM it ORDER BY i DESC LIMIT 1), mo"""
