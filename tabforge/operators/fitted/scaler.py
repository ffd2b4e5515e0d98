"""Scaler (F12) and its inverse (F13): standard / minmax / robust.

Fit: one aggregation (mean, sample std, min, max) plus exact quartiles for
the robust strategy.  A spread at or below 1e-8 scales the column to 0.
Plain columns (not an ML vector), so any one column can be inverted.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ordinal import quantile_map
from .base import JsonState, present

MIN_SPREAD = 1e-8
SCALER_STRATEGIES = ("standard", "minmax", "robust")


@dataclass(frozen=True)
class ScalerModel(JsonState):
    strategy: str
    params: dict = field(default_factory=dict)   # col -> {center, spread}

    def transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for c, p in self.params.items():
            if c not in df.columns:
                continue
            if p["spread"] is None or p["spread"] <= MIN_SPREAD:
                out[c] = F.when(F.col(c).isNull(), F.lit(None)).otherwise(F.lit(0.0))
            else:
                out[c] = (F.col(c).cast("double") - F.lit(p["center"])) / F.lit(p["spread"])
        return df.withColumns(out) if out else df

    def inverse(self, df: DataFrame, columns=None) -> DataFrame:
        out = {}
        for c, p in self.params.items():
            if c not in df.columns or (columns and c not in columns):
                continue
            if p["spread"] is None or p["spread"] <= MIN_SPREAD:
                out[c] = F.when(F.col(c).isNull(), F.lit(None)).otherwise(F.lit(p["center"]))
            else:
                out[c] = F.col(c).cast("double") * F.lit(p["spread"]) + F.lit(p["center"])
        return df.withColumns(out) if out else df

    def inverse_column(self, c, param_col: str):
        p = self.params[param_col]
        if p["spread"] is None or p["spread"] <= MIN_SPREAD:
            return F.lit(p["center"])
        return c * F.lit(p["spread"]) + F.lit(p["center"])


def fit_scaler(df: DataFrame, columns, strategy: str = "standard") -> ScalerModel:
    if strategy not in SCALER_STRATEGIES:
        raise ValueError(f"unknown scaler strategy {strategy!r}")
    cols = present(df, columns)
    params = {}
    if not cols:
        return ScalerModel(strategy, params)
    if strategy == "robust":
        q = quantile_map(df, cols, [0.25, 0.5, 0.75])
        for c in cols:
            qq = q[c]
            iqr = None if qq.get(0.75) is None else qq[0.75] - qq[0.25]
            params[c] = {"center": qq.get(0.5), "spread": iqr}
        return ScalerModel(strategy, params)
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"{c}__mean"), F.stddev_samp(x).alias(f"{c}__std"),
                 F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max")]
    row = df.agg(*aggs).collect()[0]
    for c in cols:
        if strategy == "standard":
            params[c] = {"center": row[f"{c}__mean"], "spread": row[f"{c}__std"]}
        else:
            lo, hi = row[f"{c}__min"], row[f"{c}__max"]
            params[c] = {"center": lo, "spread": None if lo is None else hi - lo}
    return ScalerModel(strategy, params)
