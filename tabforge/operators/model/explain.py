"""Explanation tables.

For a linear model the exact per-row contribution of feature ``i`` is
``phi_i = beta_i * (x_i - mean(x_i))`` (mean over the background data).
Contributions are produced in long form ``(row keys..., feature, phi,
value)``; features of a group are summed within the row, before rows are
unfolded, so grouping needs no shuffle.  Global importance and dependence
tables are aggregations over the long table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ordering import rank_by_mean_abs

CYCLIC_SUFFIXES = ("_sin", "_cos")


def contribution_rows(df: DataFrame, phi: dict, value: dict, keys, groups: dict | None = None,
                      base: float | None = None) -> DataFrame:
    """Long table of per-row contributions given as columns per feature; a
    row-local step.

    B4: with ``groups`` (feature -> group) phi is summed per group; the
    group's value is the cosine part of a cyclical pair (the sine part if that
    is all there is), else the sum of its plain parts (one-hot columns).
    ``base`` adds a ``__base__`` row with it to every row."""
    name = "feature" if groups is None else "group"
    members: dict = {}
    for f in phi:
        members.setdefault(groups[f] if groups is not None else f, []).append(f)
    rows = []
    for g, feats in members.items():
        cos = [f for f in feats if f.endswith("_cos")]
        plain = [f for f in feats if not f.endswith(CYCLIC_SUFFIXES)]
        picked = cos[:1] or plain or feats[:1]
        rows.append(F.struct(F.lit(g).alias(name), _total([phi[f] for f in feats]).alias("phi"),
                             _total([value[f].cast("double") for f in picked]).alias("value")))
    if base is not None:
        rows.append(F.struct(F.lit("__base__").alias(name), F.lit(float(base)).alias("phi"),
                             F.lit(float("nan")).alias("value")))
    return df.select(*keys, F.explode(F.array(*rows)).alias("__c")).select(*keys, "__c.*")


def _total(cols):
    out = cols[0]
    for c in cols[1:]:
        out = out + c
    return out


def linear_contributions(df: DataFrame, coefs: dict, keys, background: DataFrame | None = None,
                         means: dict | None = None, groups: dict | None = None) -> DataFrame:
    """B1: long table of contributions; ``means`` default to the averages of
    ``background`` (or ``df``), computed in one aggregation.  ``groups``: as
    in :func:`contribution_rows`."""
    feats = list(coefs)
    if means is None:
        bg = background if background is not None else df
        row = bg.agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in feats]).collect()[0]
        means = {f: row[f] for f in feats}
    x = {f: F.col(f).cast("double") for f in feats}
    return contribution_rows(df, {f: F.lit(float(coefs[f])) * (x[f] - F.lit(float(means[f]))) for f in feats}, x,
                             keys, groups)


def feature_groups(features, onehot_prefixes=()) -> dict:
    """Feature -> group.  ``x_sin``/``x_cos`` -> ``x``; one-hot columns
    ``<prefix>_<value>`` -> the first prefix that fits; everything else is
    its own group."""
    def group(f: str) -> str:
        for suf in CYCLIC_SUFFIXES:
            if f.endswith(suf):
                return f.removesuffix(suf)
        return next((p for p in onehot_prefixes if f.startswith(p + "_")), f)
    return {f: group(f) for f in features}


def global_importance(long: DataFrame, key: str = "feature", k: int | None = None) -> DataFrame:
    """Mean absolute contribution per feature (or group), sorted."""
    return rank_by_mean_abs(long, key, "phi", k)


def dependence(long: DataFrame, feature: str, key: str = "feature") -> DataFrame:
    """``(value, phi)`` pairs of one feature."""
    return long.where(F.col(key) == feature).select("value", "phi")
