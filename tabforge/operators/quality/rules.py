"""Data-quality rules and their evaluation (Q1-Q14).

A suite is a list of :class:`Rule`.  :func:`run_rules` evaluates all of
them with

* the schema (column set / order / types) checked on the driver,
* **one** aggregation for every row-count, null, range, format, set,
  mean and std rule,
* one distributed exact-quantile job if any median rule is present,
* one grouped count if a compound-key uniqueness rule is present,

and returns one row per rule: ``(rule, column, success, observed,
unexpected_count, element_count)``.

Map rules skip NULLs and pass when ``unexpected / non_null <= 1 - mostly``;
aggregate rules look at the whole column.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...functions.dates import parse_date
from ..ordinal import quantile_map

# pandas dtype names -> Spark types accepted for them
_TYPE_NAMES = {
    "int": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "int64": (T.LongType,), "int32": (T.IntegerType,), "int16": (T.ShortType,),
    "int8": (T.ByteType,),
    "float": (T.FloatType, T.DoubleType), "float64": (T.DoubleType,), "float32": (T.FloatType,),
    "object": (T.StringType,), "str": (T.StringType,),
    "category": (T.StringType,), "CategoricalDtypeType": (T.StringType,),
    "datetime64[ns]": (T.TimestampType, T.TimestampNTZType, T.DateType),
    "bool": (T.BooleanType,),
}


@dataclass(frozen=True)
class Rule:
    kind: str
    column: str | None = None
    params: dict = field(default_factory=dict)
    mostly: float = 1.0
    name: str | None = None

    @property
    def label(self) -> str:
        return self.name or (f"{self.kind}:{self.column}" if self.column else self.kind)


def columns_match_set(cols) -> Rule:
    return Rule("columns_match_set", params={"column_set": list(cols)})


def columns_match_ordered(cols) -> Rule:
    return Rule("columns_match_ordered_list", params={"column_list": list(cols)})


def row_count_between(min_value=None, max_value=None) -> Rule:
    return Rule("row_count_between", params={"min_value": min_value, "max_value": max_value})


def not_null(c, mostly=1.0) -> Rule:
    return Rule("not_null", c, mostly=mostly)


def type_in(c, type_list) -> Rule:
    return Rule("type_in_list", c, {"type_list": list(type_list)})


def type_is(c, type_) -> Rule:
    return Rule("type_is", c, {"type_": type_})


def between(c, min_value=None, max_value=None, mostly=1.0) -> Rule:
    return Rule("between", c, {"min_value": min_value, "max_value": max_value}, mostly)


def matches_date_format(c, fmt="%Y-%m-%d", mostly=1.0) -> Rule:
    return Rule("matches_strftime", c, {"strftime_format": fmt}, mostly)


def in_set(c, values, mostly=1.0) -> Rule:
    return Rule("in_set", c, {"value_set": list(values)}, mostly)


def compound_unique(cols) -> Rule:
    return Rule("compound_columns_unique", None, {"column_list": list(cols)})


def mean_between(c, lo=None, hi=None) -> Rule:
    return Rule("mean_between", c, {"min_value": lo, "max_value": hi})


def stdev_between(c, lo=None, hi=None) -> Rule:
    return Rule("stdev_between", c, {"min_value": lo, "max_value": hi})


def median_between(c, lo=None, hi=None) -> Rule:
    return Rule("median_between", c, {"min_value": lo, "max_value": hi})


def _within(v, lo, hi) -> bool:
    if v is None:
        return False
    return (lo is None or v >= lo) and (hi is None or v <= hi)


def _type_ok(dt, names) -> bool:
    for n in names:
        for t in _TYPE_NAMES.get(n, ()):
            if isinstance(dt, t):
                return True
        if dt.simpleString() == n:
            return True
    return False


_MAP_KINDS = ("between", "matches_strftime", "in_set")


def _map_unexpected(rule: Rule):
    c = F.col(rule.column)
    p = rule.params
    if rule.kind == "between":
        bad = F.lit(False)
        if p.get("min_value") is not None:
            bad = bad | (c < F.lit(p["min_value"]))
        if p.get("max_value") is not None:
            bad = bad | (c > F.lit(p["max_value"]))
        return c.isNotNull() & bad
    if rule.kind == "matches_strftime":
        return c.isNotNull() & parse_date(c.cast("string"), p["strftime_format"]).isNull()
    if rule.kind == "in_set":
        return c.isNotNull() & ~c.isin(list(p["value_set"]))
    raise ValueError(rule.kind)


def run_rules(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Evaluate ``rules`` against ``df``; one row per rule."""
    schema = df.schema
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("__rows")]
    medians = []
    for i, r in enumerate(rules):
        if r.column is not None and r.column not in cols:
            continue
        if r.kind == "not_null":
            aggs.append(F.count_if(F.col(r.column).isNull()).alias(f"r{i}_bad"))
        elif r.kind in _MAP_KINDS:
            aggs += [F.count_if(_map_unexpected(r)).alias(f"r{i}_bad"),
                     F.count(F.col(r.column)).alias(f"r{i}_nn")]
        elif r.kind == "mean_between":
            aggs.append(F.avg(F.col(r.column).cast("double")).alias(f"r{i}_obs"))
        elif r.kind == "stdev_between":
            aggs.append(F.stddev_samp(F.col(r.column).cast("double")).alias(f"r{i}_obs"))
        elif r.kind == "median_between":
            medians.append(r.column)
    row = df.agg(*aggs).collect()[0].asDict()
    n_rows = row["__rows"]
    med = quantile_map(df, sorted(set(medians)), [0.5]) if medians else {}
    results = []
    for i, r in enumerate(rules):
        obs, bad, elems, ok = None, None, None, False
        if r.column is not None and r.column not in cols:
            obs = "missing column"
        elif r.kind == "columns_match_set":
            ok = set(cols) == set(r.params["column_set"])
            obs = json.dumps(sorted(cols))
        elif r.kind == "columns_match_ordered_list":
            ok = list(cols) == list(r.params["column_list"])
            obs = json.dumps(list(cols))
        elif r.kind == "row_count_between":
            obs, ok = n_rows, _within(n_rows, r.params.get("min_value"), r.params.get("max_value"))
        elif r.kind == "type_in_list":
            dt = schema[r.column].dataType
            obs, ok = dt.simpleString(), _type_ok(dt, r.params["type_list"])
        elif r.kind == "type_is":
            dt = schema[r.column].dataType
            obs, ok = dt.simpleString(), _type_ok(dt, [r.params["type_"]])
        elif r.kind == "not_null":
            bad, elems = row[f"r{i}_bad"], n_rows
            ok = (bad / elems if elems else 0.0) <= 1.0 - r.mostly + 1e-12
            obs = bad
        elif r.kind in _MAP_KINDS:
            bad, elems = row[f"r{i}_bad"], row[f"r{i}_nn"]
            ok = (bad / elems if elems else 0.0) <= 1.0 - r.mostly + 1e-12
            obs = bad
        elif r.kind in ("mean_between", "stdev_between"):
            obs = row[f"r{i}_obs"]
            ok = _within(obs, r.params.get("min_value"), r.params.get("max_value"))
        elif r.kind == "median_between":
            obs = med.get(r.column, {}).get(0.5)
            ok = _within(obs, r.params.get("min_value"), r.params.get("max_value"))
        elif r.kind == "compound_columns_unique":
            key = r.params["column_list"]
            if all(k in cols for k in key):
                d = (df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
                     .where(F.col("n") > 1).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("b"))
                     .collect()[0]["b"])
                bad, elems, ok, obs = int(d), n_rows, int(d) == 0, int(d)
            else:
                obs = "missing column"
        else:
            raise ValueError(f"unknown rule kind {r.kind!r}")
        results.append((r.label, r.kind, r.column, bool(ok),
                        None if obs is None else str(obs),
                        None if bad is None else int(bad),
                        None if elems is None else int(elems),
                        json.dumps(r.params, sort_keys=True, default=str)))
    return df.sparkSession.createDataFrame(
        results, "rule string, kind string, column string, success boolean, observed string, "
                 "unexpected_count long, element_count long, kwargs string")


def gate_passed(result: DataFrame) -> bool:
    """Q16: the table passes when every rule passes."""
    return result.where(~F.col("success")).limit(1).count() == 0


def failing_rules(result: DataFrame) -> DataFrame:
    """Q14: only the failed rules, with their arguments and observed values."""
    return result.where(~F.col("success"))


ROW_KINDS = ("not_null", *_MAP_KINDS)


def _breaks(rule: Rule):
    return F.col(rule.column).isNull() if rule.kind == "not_null" else _map_unexpected(rule)


def with_broken_rules(df: DataFrame, rules: list[Rule], out: str = "broken") -> DataFrame:
    """Q14, one pass: ``out``, a bit mask of the row rules (nulls, ranges,
    formats, sets) that the row breaks; bit ``i`` is the suite's rule ``i``,
    so several columns of 63 rules each are made where a suite is longer:
    ``out``, ``out_1``, ..."""
    masks = {}
    for start in range(0, max(1, len(rules)), 63):
        mask = F.lit(0).cast("long")
        for i, r in enumerate(rules[start:start + 63]):
            if r.kind in ROW_KINDS and r.column in df.columns:
                mask = mask + F.when(_breaks(r), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
        masks[out if not start else f"{out}_{start // 63}"] = mask
    return df.withColumns(masks)


def failing_rows(df: DataFrame, rules: list[Rule], n: int, key: list[str], seed: int = 0) -> DataFrame:
    """Q14: per broken row rule up to ``n`` of its rows (the sample is the
    feature): ``rule`` and the row, those with the smallest seeded hashes of
    their key.

    The rules' counts come from one aggregation; then each row is drawn for a
    rule with a probability that leaves about ``4 n`` rows per rule, and only
    those are ranked: a rule that a third of all rows break is no larger than
    the others."""
    held = [c for c in with_broken_rules(df.limit(0), rules, "__broken").columns if c not in df.columns]
    marked = with_broken_rules(df, rules, "__broken")
    has = lambda i: (F.shiftright(F.col(held[i // 63]), i % 63).bitwiseAND(F.lit(1)) == 1)
    rows = [i for i, r in enumerate(rules) if r.kind in ROW_KINDS and r.column in df.columns]
    label = "rule string, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    if not rows:
        return df.sparkSession.createDataFrame([], label)
    found = marked.agg(*[F.count_if(has(i)).alias(f"r{i}") for i in rows]).first()
    digest = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key], F.lit(str(seed))))
    # the digest's first 32 bits as a number from 0 to 1
    at = F.conv(F.substring("__h", 1, 8), 16, 10).cast("double") / float(1 << 32)
    # a share that holds n of the found rows but for a chance below 1e-9
    share = {i: 1.0 if found[f"r{i}"] <= 16 * n + 400 else (4.0 * n + 100) / found[f"r{i}"] for i in rows}
    picked = F.filter(F.array(*[F.when(has(i) & (F.col("__at") <= share[i]), F.lit(i)) for i in rows]),
                      lambda x: x.isNotNull())
    drawn = marked.withColumn("__h", digest).withColumn("__at", at).withColumn("__i", F.explode(picked))
    order = Window.partitionBy("__i").orderBy("__h", *key)
    names = F.array(*[F.lit(r.label) for r in rules])
    return drawn.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n).select(
        F.element_at(names, F.col("__i") + 1).alias("rule"), *df.columns)
