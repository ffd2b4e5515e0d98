"""Projection, renaming, typing and contract operators.

Every operator here is either a pure projection (names/casts computed on
the driver, applied by one ``select``) or a single aggregation job that
gathers whatever statistics the decision needs.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import parse_datetime, COMMON_DATE_FORMATS, parse_date
from ..functions.names import sanitize_name, snake_name, unique_or_raise


# --- P1 / P2 / P3: names ----------------------------------------------------

def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename by map; names that are not present are ignored."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def standardize_column_names(df: DataFrame) -> DataFrame:
    """snake_case every column name; fails on a collision."""
    return df.toDF(*unique_or_raise([snake_name(c) for c in df.columns]))


def sanitize_column_names(df: DataFrame) -> DataFrame:
    """Spaces to underscores, lower case."""
    return df.toDF(*unique_or_raise([sanitize_name(c) for c in df.columns]))


# --- P4 / A11: type narrowing ----------------------------------------------

_INT_RANGES = [("tinyint", -128, 127), ("smallint", -32768, 32767),
               ("int", -2**31, 2**31 - 1), ("bigint", -2**63, 2**63 - 1)]
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATS = (T.FloatType, T.DoubleType)
# Largest absolute change a float32 cast may cause and still be taken
# (fixed value of the downcast rule).
FLOAT32_TOLERANCE = 5e-4
CATEGORY_RATIO = 0.5
# distinct/rows ratios this close to the threshold are re-counted exactly: ten
# standard errors of the sketch (0.05 of the ratio), so it never decides
EXACT_BAND = 0.25


@dataclass(frozen=True)
class TypePlan:
    column: str
    old_type: str
    new_type: str
    kind: str          # integer | float | category | date | unchanged


def _narrow_int(lo, hi) -> str:
    if lo is None or hi is None:
        return "bigint"
    for name, a, b in _INT_RANGES:
        if lo >= a and hi <= b:
            return name
    return "bigint"


def type_narrowing_stats(df: DataFrame, exact_distinct: bool = True,
                         date_formats: dict | None = None) -> DataFrame:
    """One aggregation over every column: min/max of integers, largest
    float32 error of floats, distinct and row counts of strings, and - for
    the text columns in ``date_formats`` - how many values each candidate
    format fails to parse."""
    aggs: list[Column] = [F.count(F.lit(1)).alias("__rows")]
    for c, fmts in (date_formats or {}).items():
        raw = F.col(c)
        for i, fmt in enumerate(fmts):
            aggs.append(F.count_if(parse_date(raw, fmt).isNull() & raw.isNotNull())
                        .alias(f"{c}__fmt{i}"))
        aggs.append(F.count_if(F.try_to_timestamp(raw).isNull() & raw.isNotNull())
                    .alias(f"{c}__fmtinfer"))
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, _INTEGRAL):
            aggs += [F.min(c).alias(f"{f.name}__min"), F.max(c).alias(f"{f.name}__max")]
        elif isinstance(f.dataType, _FLOATS):
            err = F.abs(c.cast("float").cast("double") - c.cast("double"))
            aggs.append(F.max(F.when(F.isnan(c), F.lit(0.0)).otherwise(err)).alias(f"{f.name}__err"))
        elif isinstance(f.dataType, T.StringType):
            # HLL sketch (mergeable, fixed size); exact counts are taken
            # afterwards only for columns near the category threshold
            aggs.append(F.approx_count_distinct(c).alias(f"{f.name}__nd"))
    return df.agg(*aggs)


def plan_types(df: DataFrame, date_cols: Sequence[str] = (),
               exact_distinct: bool = True,
               date_formats: dict | None = None) -> tuple[list[TypePlan], dict]:
    """P4 decisions.  Integers take the smallest signed type holding their
    range; floats become float32 when no value moves by more than 5e-4;
    text with ``distinct/rows < 0.5`` is reported as category (it stays a
    string, Parquet dictionary-encodes it); ``date_cols`` are parsed by P5."""
    stats = type_narrowing_stats(df, exact_distinct, date_formats).collect()[0].asDict()
    rows = stats["__rows"] or 0
    if exact_distinct and rows:
        near = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)
                and abs((stats[f"{f.name}__nd"] or 0) / rows - CATEGORY_RATIO) < EXACT_BAND]
        if near:
            ex = df.agg(*[F.count_distinct(F.col(c)).alias(c) for c in near]).collect()[0]
            stats.update({f"{c}__nd": ex[c] for c in near})
    plans: list[TypePlan] = []
    for f in df.schema.fields:
        old = f.dataType.simpleString()
        if f.name in date_cols and isinstance(f.dataType, T.StringType):
            plans.append(TypePlan(f.name, old, "date", "date"))
        elif isinstance(f.dataType, _INTEGRAL):
            new = _narrow_int(stats[f"{f.name}__min"], stats[f"{f.name}__max"])
            plans.append(TypePlan(f.name, old, new, "integer"))
        elif isinstance(f.dataType, _FLOATS):
            err = stats[f"{f.name}__err"]
            new = "float" if (err is None or err <= FLOAT32_TOLERANCE) else "double"
            plans.append(TypePlan(f.name, old, new, "float"))
        elif isinstance(f.dataType, T.StringType):
            nd = stats[f"{f.name}__nd"] or 0
            cat = rows > 0 and nd / rows < CATEGORY_RATIO
            plans.append(TypePlan(f.name, old, "category" if cat else old,
                                  "category" if cat else "unchanged"))
        else:
            plans.append(TypePlan(f.name, old, old, "unchanged"))
    return plans, stats


def apply_type_plan(df: DataFrame, plans: Sequence[TypePlan],
                    date_formats: dict[str, str | None] | None = None) -> DataFrame:
    date_formats = date_formats or {}
    out = []
    for p in plans:
        c = F.col(p.column)
        if p.kind == "date":
            fmt = date_formats.get(p.column)
            if p.new_type == "timestamp_ntz":
                out.append(parse_datetime(c).alias(p.column))
            else:
                out.append(parse_date(c, fmt).alias(p.column) if fmt is not False else c)
        elif p.kind in ("integer", "float"):
            out.append(c.cast(p.new_type).alias(p.column))
        else:
            out.append(c)
    return df.select(*out)


def optimize_data_types(df: DataFrame, date_cols: Sequence[str] = ()
                        ) -> tuple[DataFrame, list[TypePlan]]:
    """P4 + P5: one statistics job (plus a date-format job only when the
    first format does not fit), then one ``select``.  The date formats have no
    time of day; a column that only generic parsing fits becomes a timestamp
    if any of its values has one, else a date."""
    text_dates = [c for c in date_cols if c in df.columns
                  and isinstance(df.schema[c].dataType, T.StringType)]
    # the first candidate format rides along with the type statistics;
    # the others are only tried (one more job) when it does not fit
    plans, stats = plan_types(df, date_cols, date_formats={
        c: [COMMON_DATE_FORMATS[0]] for c in text_dates})
    formats = {c: COMMON_DATE_FORMATS[0] for c in text_dates if stats[f"{c}__fmt0"] == 0}
    formats |= pick_date_formats(df, [c for c in text_dates if c not in formats])
    # a column no format fits stays text (reported as unchanged)
    plans = [p if not (p.kind == "date" and formats.get(p.column) is False)
             else TypePlan(p.column, p.old_type, p.old_type, "unchanged") for p in plans]
    inferred = [c for c, fmt in formats.items() if fmt is None]
    if inferred:
        at = {c: parse_datetime(c) for c in inferred}
        timed = df.agg(*[F.count_if(at[c] != F.to_date(at[c]).cast("timestamp_ntz")).alias(c) for c in inferred]).first()
        plans = [TypePlan(p.column, p.old_type, "timestamp_ntz", "date") if p.column in inferred and timed[p.column]
                 else p for p in plans]
    return apply_type_plan(df, plans, formats), plans


def type_report(df: DataFrame, plans: Sequence[TypePlan]) -> DataFrame:
    """``(column, old_type, new_type)`` as a DataFrame."""
    spark = df.sparkSession
    return spark.createDataFrame([(p.column, p.old_type, p.new_type) for p in plans],
                                 "column string, old_type string, new_type string")


# --- P5 / P6: dates ----------------------------------------------------------

def date_formats_failures(df: DataFrame, cols: Sequence[str],
                          formats: Sequence[str] = COMMON_DATE_FORMATS) -> dict[str, dict]:
    """For each column and format, how many non-null texts it fails to parse.
    One job for all columns: equal texts are counted first, and each is
    parsed once."""
    cols = list(dict.fromkeys(cols))
    texts = (df.select(*cols).unpivot([], cols, "c", "raw").where(F.col("raw").isNotNull())
             .groupBy("c", "raw").agg(F.count(F.lit(1)).alias("n")))
    fails = lambda parsed: F.sum(F.when(parsed.isNull(), F.col("n")).otherwise(0))
    rows = texts.groupBy("c").agg(*[fails(parse_date("raw", fmt)).alias(f"f{i}") for i, fmt in enumerate(formats)],
                                  fails(F.try_to_timestamp(F.col("raw"))).alias("infer")).collect()
    found = {c: {fmt: 0 for fmt in [*formats, None]} for c in cols}
    for row in rows:
        found[row["c"]] = {fmt: int(row[f"f{i}"]) for i, fmt in enumerate(formats)} | {None: int(row["infer"])}
    return found


def date_format_failures(df: DataFrame, c: str,
                         formats: Sequence[str] = COMMON_DATE_FORMATS) -> dict[str, int]:
    """:func:`date_formats_failures` of one column."""
    return date_formats_failures(df, [c], formats)[c]


def pick_date_formats(df: DataFrame, cols: Sequence[str], formats: Sequence[str] = COMMON_DATE_FORMATS) -> dict:
    """P5 per column: the first format that parses the *whole* column;
    ``None`` means generic parsing works; ``False`` means nothing fits (column
    stays text).  One job for all columns."""
    if not cols:
        return {}
    out = {}
    for c, fails in date_formats_failures(df, cols, formats).items():
        fit = [fmt for fmt in formats if fails[fmt] == 0]
        out[c] = fit[0] if fit else None if fails[None] == 0 else False
    return out


def pick_date_format(df: DataFrame, c: str, formats: Sequence[str] = COMMON_DATE_FORMATS):
    """:func:`pick_date_formats` of one column."""
    return pick_date_formats(df, [c], formats)[c]


def coerce_dates(df: DataFrame, c: str, fmt: str | None = None) -> DataFrame:
    """Parse with coercion, drop rows whose date did not parse."""
    return df.withColumn(c, parse_date(c, fmt)).where(F.col(c).isNotNull())


# --- P7-P11: column sets -----------------------------------------------------

def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Absent names are ignored."""
    return df.drop(*[c for c in cols if c in df.columns])


def drop_missing_target(df: DataFrame, target: str) -> DataFrame:
    """P8."""
    return df.dropna(subset=[target]) if target in df.columns else df


def enforce_column_order(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Reorder only when the column *sets* match, else unchanged."""
    if set(order) != set(df.columns) or len(order) != len(df.columns):
        logging.getLogger(__name__).warning(
            "column order not enforced: columns %s do not match %s", df.columns, list(order))
        return df
    return df.select(*order)


def conform_columns(df: DataFrame, final: Sequence[str], fill: float = 0.0) -> DataFrame:
    """P10: add missing columns as ``fill``, drop extras, fixed order."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(float(fill)).alias(c)
                       for c in final])


def feature_columns(df: DataFrame, exclude: Sequence[str]) -> list[str]:
    """Model inputs = all columns minus excluded (target, multicollinear)."""
    return [c for c in df.columns if c not in set(exclude)]


# --- P12: date range share ---------------------------------------------------

def rows_between_dates(df: DataFrame, c: str, start: str, end: str) -> DataFrame:
    """Rows with ``start <= c <= end`` (inclusive), total and percent,
    one aggregation."""
    inside = F.col(c).between(F.to_date(F.lit(start)), F.to_date(F.lit(end)))
    return df.agg(F.count_if(inside).alias("n_between"), F.count(F.lit(1)).alias("n_total")) \
        .withColumn("pct_between",
                    F.round(F.col("n_between") * 100.0 / F.greatest(F.col("n_total"), F.lit(1)), 6))


# --- P13: input contract -----------------------------------------------------

@dataclass(frozen=True)
class Contract:
    """Scoring input contract.  ``enums`` maps column -> allowed values;
    ``positive`` columns must be > 0; ``ranges`` are inclusive bounds;
    ``distinct_pairs`` must differ (e.g. origin != destination)."""
    enums: dict
    positive: tuple = ()
    ranges: dict | None = None
    distinct_pairs: tuple = ()
    date_col: str | None = None


def contract_violations(df: DataFrame, contract: Contract) -> DataFrame:
    """Adds ``violations: array<string>`` (empty when the row is valid).
    Stateless, so the same function runs on a stream."""
    checks: list[Column] = []
    for c, allowed in contract.enums.items():
        checks.append(F.when(F.col(c).isNull() | ~F.col(c).isin(list(allowed)),
                             F.lit(f"{c}:not_allowed")))
    for c in contract.positive:
        checks.append(F.when(F.col(c).isNull() | (F.col(c) <= 0), F.lit(f"{c}:not_positive")))
    for c, (lo, hi) in (contract.ranges or {}).items():
        checks.append(F.when(F.col(c).isNull() | (F.col(c) < lo) | (F.col(c) > hi),
                             F.lit(f"{c}:out_of_range")))
    for a, b in contract.distinct_pairs:
        checks.append(F.when(F.col(a) == F.col(b), F.lit(f"{a}={b}")))
    if contract.date_col:
        checks.append(F.when(F.col(contract.date_col).isNull(),
                             F.lit(f"{contract.date_col}:invalid")))
    arr = F.filter(F.array(*checks), lambda x: x.isNotNull()) if checks else F.array()
    return df.withColumn("violations", arr)


def split_by_contract(df: DataFrame, contract: Contract) -> tuple[DataFrame, DataFrame]:
    v = contract_violations(df, contract)
    return (v.where(F.size("violations") == 0).drop("violations"),
            v.where(F.size("violations") > 0))
