"""Isolation-forest outlier detection, one forest per column (F6, trim only).

Fit, per column:

1. **Sampling** - tree ``t`` gets the ``psi`` (<= 256) candidates with the
   smallest seeded keys.  Every row is a candidate of each tree with the same
   small probability, sized for ~3 psi candidates per tree (all rows when
   small).  One hash per row is a skip draw: it says which tree is the first
   that takes the row, and for almost all rows that is none; only the others
   draw for the trees behind it.
2. **Trees** - ``groupBy(column, tree).applyInPandas`` builds each
   isolation tree from its <= psi values (random cut uniform between the
   node's min and max, depth limit ``ceil(log2 psi)``).
3. In one dimension a tree is a step function of ``x`` (path length per
   interval), and so is the forest average.  Its breakpoints (at most
   ``trees * psi`` numbers, a parameter bound) are the fitted state.

Score ``s(x) = 2 ** (-E[h(x)] / c(psi))``; a value is an outlier when
``s > 0.5`` (``contamination="auto"``) or when its score is above the
training scores' ``1 - contamination`` quantile.  A value's interval is found
by MLlib's ``Bucketizer`` (a binary search on the JVM): over all break points
for scores, and for flags over the few of them where the verdict changes.
"""

from __future__ import annotations

import json
import math
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ordinal import quantile_map
from .base import JsonState, present

EULER = 0.5772156649015329


def avg_path_length(n) -> np.ndarray:
    """c(n): average unsuccessful-search path length in a BST of n nodes."""
    n = np.asarray(n, dtype="float64")
    out = np.zeros_like(n)
    out[n == 2] = 1.0
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def _build_tree(values: np.ndarray, rng: np.random.Generator, max_depth: int):
    """Leaves of a 1-D isolation tree as (lo, hi, path length) intervals."""
    leaves = []

    def grow(v, lo, hi, depth):
        if depth >= max_depth or len(v) <= 1 or v.min() == v.max():
            leaves.append((lo, hi, depth + float(avg_path_length([len(v)])[0])))
            return
        cut = rng.uniform(v.min(), v.max())
        grow(v[v <= cut], lo, cut, depth + 1)
        grow(v[v > cut], cut, hi, depth + 1)

    grow(np.sort(values), -np.inf, np.inf, 0)
    return leaves


@dataclass(frozen=True)
class IsolationForestModel(JsonState):
    n_trees: int
    psi: int
    contamination: str | float
    breakpoints: dict = field(default_factory=dict)   # col -> sorted cut points
    path: dict = field(default_factory=dict)          # col -> mean path per interval
    thresholds: dict = field(default_factory=dict)    # col -> score threshold

    def _bucketed(self, df: DataFrame, cuts: dict) -> DataFrame:
        """``df`` with ``__at_<col>``: how many cuts lie strictly below the
        value (a value equal to a cut belongs to the interval that ends
        there); NULL for NULL and NaN."""
        cols = [c for c in cuts if c in df.columns]
        plain = {c: 0.0 for c in cols if not cuts[c]}
        real = [c for c in cols if cuts[c]]
        # Bucketizer's intervals hold their lower bound: negate both
        x = {f"__x_{c}": F.nanvl(0.0 - F.col(c).cast("double"), F.lit(None).cast("double")) for c in cols}
        out = df.withColumns(x) if x else df
        if real:
            out = Bucketizer(inputCols=[f"__x_{c}" for c in real], outputCols=[f"__b_{c}" for c in real], splitsArray=[
                [-math.inf, *(0.0 - v for v in reversed(cuts[c])), math.inf] for c in real]).setHandleInvalid("keep").transform(out)
        at = {f"__at_{c}": F.when(F.col(f"__x_{c}").isNotNull(), F.lit(0) if c in plain else (
            F.lit(len(cuts[c])) - F.col(f"__b_{c}").cast("int"))) for c in cols}
        out = out.withColumns(at) if at else out
        return out.drop(*x, *(f"__b_{c}" for c in real))

    def scores(self, df: DataFrame, suffix: str = "_score") -> DataFrame:
        """``df`` with ``<col>_score`` of every fitted column (NULL for NULL
        and NaN)."""
        denom = float(avg_path_length([self.psi])[0]) or 1.0
        out = self._bucketed(df, self.breakpoints)
        cols = [c for c in self.breakpoints if c in df.columns]
        made = {}
        for c in cols:
            levels = F.from_json(F.lit(json.dumps([2.0 ** (-p / denom) for p in self.path[c]])), "array<double>")
            made[f"{c}{suffix}"] = F.element_at(levels, F.col(f"__at_{c}") + 1)
        return (out.withColumns(made) if made else out).drop(*(f"__at_{c}" for c in cols))

    def verdicts(self, c: str) -> tuple[list, bool]:
        """The break points where the verdict on ``c`` changes, and whether
        values at or below the first of them are outliers."""
        denom = float(avg_path_length([self.psi])[0]) or 1.0
        out = [2.0 ** (-p / denom) > self.thresholds[c] for p in self.path[c]]
        return [b for b, x, y in zip(self.breakpoints[c], out, out[1:]) if x != y], out[0]

    def _flagged(self, df: DataFrame) -> tuple[DataFrame, dict]:
        told = {c: self.verdicts(c) for c in self.breakpoints if c in df.columns}
        out = self._bucketed(df, {c: edges for c, (edges, _) in told.items()})
        return out, {c: F.coalesce(F.col(f"__at_{c}") % 2 == (0 if first else 1), F.lit(False))
                     for c, (_, first) in told.items()}

    def mask(self, df: DataFrame, suffix: str = "_outlier") -> DataFrame:
        out, flags = self._flagged(df)
        return out.withColumns({f"{c}{suffix}": m for c, m in flags.items()}).drop(*(f"__at_{c}" for c in flags)) \
            if flags else df

    def transform(self, df: DataFrame) -> DataFrame:
        """Trim: drop rows flagged in any column (the only handling)."""
        out, flags = self._flagged(df)
        for m in flags.values():
            out = out.where(~m)
        return out.drop(*(f"__at_{c}" for c in flags))


def fit_isolation_forest(df: DataFrame, columns, n_trees: int = 100, max_samples: int = 256,
                         contamination: str | float = "auto", seed: int = 0,
                         key: list[str] | None = None) -> IsolationForestModel:
    cols = present(df, columns)
    # samples are sized by each column's own values: one that is mostly NULL
    # still gives every tree its psi values, as long as it has them
    usable = df.agg(*[F.count(F.when(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")), 1)).alias(c) for c in cols]).first() \
        if cols else {}
    n = max([usable[c] for c in cols], default=0)
    psi = int(min(max_samples, n))
    max_depth = int(math.ceil(math.log2(max(psi, 2))))
    keys = key or df.columns
    # probability that a row is a candidate of a tree: ~3 psi rows per tree
    share = {c: min(1.0, 3.0 * psi / max(usable[c], 1)) for c in cols}
    widest = max(share.values(), default=1.0)
    top = float(2 ** 63)
    uniform = lambda *h: (F.xxhash64(*h).bitwiseAND(F.lit(2 ** 63 - 1)).cast("double") + 0.5) / top
    hashed = df.select(F.xxhash64(*[F.col(k) for k in keys]).alias("_h"), *[F.col(c).cast("double").alias(c) for c in cols])
    if widest < 1.0:
        # trees passed over before the first that takes the row
        skip = F.floor(F.log(uniform(F.col("_h"), F.lit(seed))) / math.log1p(-widest))
        taken = hashed.withColumn("_t", skip).where(F.col("_t") < n_trees).withColumn("tree", F.explode(F.concat(
            F.array(F.col("_t").cast("int")), F.filter(
                F.sequence(F.lit(0), F.lit(n_trees - 1)),
                lambda t: (t > F.col("_t")) & (uniform(F.col("_h"), t, F.lit(seed)) <= widest))))).drop("_t")
    else:
        taken = hashed.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))))
    long = taken.unpivot(["_h", "tree"], cols, "column", "x").where(F.col("x").isNotNull() & ~F.isnan("x"))
    if len(set(share.values())) > 1:
        # a column with more values takes a smaller part of the candidates
        own = F.create_map(*[x for c, v in share.items() for x in (F.lit(c), F.lit(v / widest))])
        long = long.where(uniform(F.col("_h"), F.col("tree"), F.col("column"), F.lit(seed))
                          <= F.element_at(own, F.col("column")))
    long = long.withColumn("_k", F.xxhash64(F.col("_h"), F.col("tree"), F.lit(seed + 1)))
    out_schema = "column string, tree int, lo double, hi double, path double"

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_k", "x"]).head(psi)
        c, t = pdf["column"].iloc[0], int(pdf["tree"].iloc[0])
        rng = np.random.default_rng([seed, t, zlib.crc32(c.encode())])
        leaves = _build_tree(pdf["x"].to_numpy(), rng, max_depth)
        return pd.DataFrame({"column": c, "tree": t, "lo": [a for a, _, _ in leaves],
                             "hi": [b for _, b, _ in leaves], "path": [p for _, _, p in leaves]})

    leaves = long.groupBy("column", "tree").applyInPandas(build, out_schema).collect()
    bps, paths, thresholds = {}, {}, {}
    for c in cols:
        lv = [r for r in leaves if r["column"] == c]
        cuts = sorted({r["hi"] for r in lv if np.isfinite(r["hi"])})
        cut_arr = np.array(cuts)
        total = np.zeros(len(cuts) + 1)
        n_t = len({r["tree"] for r in lv}) or 1
        for r in lv:
            lo_i = 0 if not np.isfinite(r["lo"]) else int(np.searchsorted(cut_arr, r["lo"]) + 1)
            hi_i = len(cuts) if not np.isfinite(r["hi"]) else int(np.searchsorted(cut_arr, r["hi"]))
            total[lo_i:hi_i + 1] += r["path"]
        bps[c] = [float(v) for v in cuts]
        paths[c] = [float(v) / n_t for v in total]
        thresholds[c] = 0.5
    model = IsolationForestModel(n_trees, psi, contamination, bps, paths, thresholds)
    if contamination != "auto":
        scored = model.scores(df.select(*cols), "__s").select(*[F.col(f"{c}__s").alias(c) for c in cols])
        q = quantile_map(scored, cols, [1.0 - float(contamination)])
        model = IsolationForestModel(n_trees, psi, contamination, bps, paths,
                                     {c: q[c][1.0 - float(contamination)] for c in cols})
    return model
