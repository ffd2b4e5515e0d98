"""Simple imputer (F1): mean / median / mode / constant per column.

Fit: one aggregation for all means, one distributed exact-quantile job for
all medians, one two-level aggregation per mode column.  Transform:
``fillna`` with literal values.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ordinal import mode_values, quantile_map
from .base import JsonState, present

STRATEGIES = ("mean", "median", "mode", "constant")
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@dataclass(frozen=True)
class SimpleImputerModel(JsonState):
    values: dict = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        fill = {c: v for c, v in self.values.items() if c in df.columns and v is not None}
        if not fill:
            return df
        out = {}
        for c, v in fill.items():
            dt = df.schema[c].dataType
            if isinstance(v, float) and isinstance(dt, _INTEGRAL) and not v.is_integer():
                dt = T.DoubleType()       # like pandas: a fractional fill widens the column
            col = F.col(c).cast(dt)
            if isinstance(v, float) and isinstance(dt, (T.FloatType, T.DoubleType)):
                col = F.when(~F.isnan(col), col)
            out[c] = F.coalesce(col, F.lit(v).cast(dt))
        return df.withColumns(out)


def fit_simple_imputer(df: DataFrame, config: dict) -> SimpleImputerModel:
    """``config``: ``{"mean": [...], "median": [...], "mode": [...],
    "constant": {col: value}}``; an unknown strategy is an error."""
    for s in config:
        if s not in STRATEGIES:
            raise ValueError(f"unknown imputation strategy {s!r}; use one of {STRATEGIES}")
    values: dict = {}
    means = present(df, config.get("mean", []))
    if means:
        row = df.agg(*[F.avg(F.col(c)).alias(c) for c in means]).collect()[0]
        values.update({c: float(row[c]) if row[c] is not None else None for c in means})
    meds = present(df, config.get("median", []))
    if meds:
        q = quantile_map(df, meds, [0.5])
        values.update({c: q[c].get(0.5) for c in meds})
    modes = present(df, config.get("mode", []))
    if modes:
        values.update(mode_values(df, modes))
    for c, v in (config.get("constant") or {}).items():
        if c in df.columns:
            values[c] = v
    return SimpleImputerModel(values)
