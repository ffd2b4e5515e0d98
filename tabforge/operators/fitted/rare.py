"""Rare-category grouping.

Fit: unpivot the columns, drop NULLs, count ``(column, value)`` pairs in
one partial aggregation and keep values whose share of the column's
non-null rows is at least ``threshold``.  At most ``1/threshold`` values
per column can pass, so the kept lists have a proven bound and travel as
literals.  Transform: kept values stay, everything else (unseen values
and NULL included) becomes ``Other``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import JsonState, present

OTHER = "Other"


@dataclass(frozen=True)
class RareGrouperModel(JsonState):
    threshold: float
    frequent: dict = field(default_factory=dict)    # col -> sorted kept values

    def transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for c, keep in self.frequent.items():
            if c in df.columns:
                out[c] = F.when(F.col(c).isin(list(keep)), F.col(c)).otherwise(F.lit(OTHER))
        return df.withColumns(out) if out else df


def fit_rare_grouper(df: DataFrame, columns, threshold: float = 0.01) -> RareGrouperModel:
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    cols = present(df, columns)
    if not cols:
        return RareGrouperModel(threshold, {})
    long = (df.select(*[F.col(c).cast("string").alias(c) for c in cols])
            .unpivot([], cols, "column", "value").where(F.col("value").isNotNull()))
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"))
    kept = (counts.join(F.broadcast(totals), "column")
            .where(F.col("n") / F.col("total") >= F.lit(float(threshold)))
            .select("column", "value").collect())
    freq: dict = {c: [] for c in cols}
    for r in kept:
        freq[r["column"]].append(r["value"])
    return RareGrouperModel(threshold, {c: sorted(v) for c, v in freq.items()})
