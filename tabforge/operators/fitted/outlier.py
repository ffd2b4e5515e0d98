"""Outlier detection and handling.

Bounds come from one fit job (exact quartiles for IQR, mean and sample
std for z-score).  The mask is one boolean column per feature; trimming
drops a row flagged in any column (NULL never flags); winsorizing clips.
``fit_outliers`` also fits isolation forests (:mod:`.iforest`), which only
trim.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.numeric import clip
from ..ordinal import quantile_map
from .base import JsonState, present
from .iforest import IsolationForestModel, fit_isolation_forest

DETECTION = ("iqr", "zscore", "iforest")
HANDLING = ("trim", "winsorize")


@dataclass(frozen=True)
class OutlierModel(JsonState):
    detection: str
    handling: str
    bounds: dict = field(default_factory=dict)     # col -> [lo, hi]

    def flags(self, df: DataFrame) -> dict:
        out = {}
        for c, (lo, hi) in self.bounds.items():
            if c in df.columns:
                x = F.col(c)
                out[c] = F.coalesce((x < F.lit(lo)) | (x > F.lit(hi)), F.lit(False))
        return out

    def mask(self, df: DataFrame, suffix: str = "_outlier") -> DataFrame:
        """add ``<col>_outlier`` booleans."""
        return df.withColumns({f"{c}{suffix}": m for c, m in self.flags(df).items()})

    def transform(self, df: DataFrame) -> DataFrame:
        if self.handling == "trim":
            fl = list(self.flags(df).values())
            if not fl:
                return df
            anyf = fl[0]
            for m in fl[1:]:
                anyf = anyf | m
            return df.where(~anyf)                                    # F8
        return df.withColumns({c: clip(c, lo, hi) for c, (lo, hi) in self.bounds.items()
                               if c in df.columns})                   # F9


def fit_outliers(df: DataFrame, columns, detection: str = "iqr", handling: str = "trim",
                 iqr_multiplier: float = 1.5, zscore_threshold: float = 3.0,
                 **forest) -> OutlierModel | IsolationForestModel:
    """``forest``: further arguments of an isolation forest (``n_trees``,
    ``contamination``, ``seed``, ...)."""
    if detection not in DETECTION:
        raise ValueError(f"detection must be one of {DETECTION}, got {detection!r}")
    if handling not in HANDLING:
        raise ValueError(f"handling must be one of {HANDLING}")
    if detection == "iforest":
        if handling != "trim":
            raise ValueError("an isolation forest only trims")
        return fit_isolation_forest(df, columns, **forest)
    if forest:
        raise ValueError(f"{detection} takes no {sorted(forest)}")
    cols = present(df, columns)
    bounds = {}
    if detection == "iqr":
        q = quantile_map(df, cols, [0.25, 0.75])
        for c in cols:
            q1, q3 = q[c].get(0.25), q[c].get(0.75)
            if q1 is None:
                continue
            iqr = q3 - q1
            bounds[c] = [q1 - iqr_multiplier * iqr, q3 + iqr_multiplier * iqr]
    else:
        aggs = []
        for c in cols:
            x = F.col(c).cast("double")
            aggs += [F.avg(x).alias(f"{c}__m"), F.stddev_samp(x).alias(f"{c}__s")]
        row = df.agg(*aggs).collect()[0]
        for c in cols:
            m, s = row[f"{c}__m"], row[f"{c}__s"]
            if m is None or s is None:
                continue
            bounds[c] = [m - zscore_threshold * s, m + zscore_threshold * s]
    return OutlierModel(detection, handling, bounds)
