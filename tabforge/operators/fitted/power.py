"""Power transforms (F10, F11; expressions X5-X7).

Lambda is the maximiser of the profile log-likelihood

    box-cox:      (lam - 1) * sum(ln x)               - n/2 * ln var_pop(bc(x, lam))
    yeo-johnson:  (lam - 1) * sum(sign(x) ln(1+|x|))  - n/2 * ln var_pop(yj(x, lam))

A whole grid of candidates of all columns is evaluated in **one** scan: the
tasks sum up count, mean and squared deviations per candidate (numpy per Arrow
batch), Spark merges the tasks' sums; the grid is then narrowed around the
best point and evaluated again (a few scans in total, with no shuffle of rows).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.numeric import boxcox, inv_boxcox, inv_yeojohnson, yeojohnson
from .base import JsonState, present

POWER_STRATEGIES = ("log", "box-cox", "yeo-johnson")
GRID_LO, GRID_HI, GRID_POINTS, ZOOM_ROUNDS = -4.0, 4.0, 21, 6
MAX_LAMBDA = 1e4            # beyond this the likelihood has no interior maximum in doubles


@dataclass(frozen=True)
class PowerModel(JsonState):
    strategy: str
    lambdas: dict = field(default_factory=dict)
    columns: list = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for c in self.columns:
            if c not in df.columns:
                continue
            if self.strategy == "log":
                out[c] = F.log1p(F.col(c).cast("double"))
            elif self.strategy == "box-cox":
                out[c] = boxcox(c, self.lambdas[c])
            else:
                out[c] = yeojohnson(c, self.lambdas[c])
        return df.withColumns(out) if out else df

    def inverse_expr(self, c, name: str):
        if self.strategy == "log":
            return F.expm1(c)
        if self.strategy == "box-cox":
            return inv_boxcox(c, self.lambdas[name])
        return inv_yeojohnson(c, self.lambdas[name])

    def inverse(self, df: DataFrame, columns=None) -> DataFrame:
        out = {c: self.inverse_expr(F.col(c), c) for c in self.columns
               if c in df.columns and (not columns or c in columns)}
        return df.withColumns(out) if out else df


def _logs(x: np.ndarray, strategy: str) -> list[tuple[np.ndarray, bool]]:
    """ln x (box-cox), or ln(1 + |x|) of the values of each sign (yeo-johnson)."""
    if strategy == "box-cox":
        return [(np.log(x), False)]
    return [(np.log1p(x[x >= 0]), False), (np.log1p(-x[x < 0]), True)]


def _transformed(logs: np.ndarray, lams: np.ndarray) -> np.ndarray:
    """(e^(lam * log) - 1) / lam, one row per lambda; the log itself at 0."""
    out = np.empty((len(lams), len(logs)))
    for row, lam in zip(out, lams):
        if abs(lam) < 1e-12:
            row[:] = logs
        else:
            np.multiply(logs, lam, out=row)
            # near 0 the difference to 1 would lose its digits
            if abs(lam) < 1e-2:
                np.expm1(row, out=row)
            else:
                np.exp(row, out=row)
                row -= 1.0
            row /= lam
    return out


def _merged(held, n: int, mean: np.ndarray, m2: np.ndarray):
    """Counts, means and squared deviations of two sets of rows as one."""
    if held is None:
        return n, mean, m2
    n0, mean0, m20 = held
    d = mean - mean0
    return n0 + n, mean0 + d * (n / (n0 + n)), m20 + m2 + d * d * (n0 * n / (n0 + n))


_PARTIAL = "column string, lam double, n long, logsum double, mean double, m2 double"


def _evaluate_grid(wide: DataFrame, strategy: str, grid: dict) -> dict:
    """Log-likelihood of every (column, lambda) in one scan: a value's
    logarithm is taken once for all candidates of its column, each task sums
    up its rows, and Spark merges the tasks' moments."""
    cols = list(grid)

    def run(batches):
        held, logsum = {}, dict.fromkeys(cols, 0.0)
        with np.errstate(over="ignore", invalid="ignore"):
            for b in batches:
                for c, values in zip(cols, b.columns):
                    x = values.to_numpy(zero_copy_only=False)
                    x = x[~np.isnan(x)]
                    lams = np.array(grid[c])
                    for logs, negative in _logs(x, strategy):
                        if len(logs):
                            t = -_transformed(logs, 2.0 - lams) if negative else _transformed(logs, lams)
                            mean = t.mean(axis=1)
                            t -= mean[:, None]
                            held[c] = _merged(held.get(c), len(logs), mean, np.einsum("ij,ij->i", t, t))
                            logsum[c] += float(-logs.sum() if negative else logs.sum())
        for c, (n, mean, m2) in held.items():
            k = len(mean)
            yield pa.RecordBatch.from_arrays(
                [pa.array([c] * k), pa.array(grid[c], pa.float64()), pa.array([n] * k, pa.int64()),
                 pa.array([logsum[c]] * k), pa.array(mean), pa.array(m2)], names=[f.split()[0] for f in _PARTIAL.split(", ")])

    def merge(a, b):
        n, d = a["n"] + b["n"], b["mean"] - a["mean"]
        return F.struct(n.alias("n"), (a["logsum"] + b["logsum"]).alias("logsum"),
                        (a["mean"] + d * (b["n"] / n)).alias("mean"),
                        (a["m2"] + b["m2"] + d * d * (a["n"] * b["n"] / n)).alias("m2"))
    parts = (wide.select(*cols).mapInArrow(run, _PARTIAL).groupBy("column", "lam")
             .agg(F.sort_array(F.collect_list(F.struct("n", "logsum", "mean", "m2"))).alias("parts")))
    rows = parts.select("column", "lam", F.reduce(F.slice("parts", 2, F.size("parts")), F.element_at("parts", 1), merge)
                        .alias("s")).select("column", "lam", "s.*").collect()
    out: dict = {c: {} for c in grid}
    for r in rows:
        v, n = r["m2"] / r["n"], r["n"]
        if not math.isfinite(v) or v <= 0:
            continue
        llf = (r["lam"] - 1.0) * r["logsum"] - n / 2.0 * math.log(v)
        if math.isfinite(llf):
            out[r["column"]][r["lam"]] = llf
    return out


def fit_power(df: DataFrame, columns, strategy: str = "yeo-johnson") -> PowerModel:
    if strategy not in POWER_STRATEGIES:
        raise ValueError("strategy must be one of 'log', 'box-cox', 'yeo-johnson'")
    cols = present(df, columns)
    if strategy == "log" or not cols:
        return PowerModel(strategy, {}, cols)
    scale: dict = {}
    if strategy == "box-cox":
        seen = df.agg(*[F.count_if(F.col(c) <= 0).alias(f"bad_{c}") for c in cols],
                      *[F.avg(F.when(F.col(c) > 0, F.log(F.col(c).cast("double")))).alias(f"log_{c}")
                        for c in cols]).collect()[0]
        neg = [c for c in cols if seen[f"bad_{c}"]]
        if neg:
            raise ValueError(f"box-cox needs strictly positive data; non-positive in {neg}")
        # the maximiser does not change when a column is divided by a
        # constant; divided by its geometric mean it does not overflow
        scale = {c: math.exp(seen[f"log_{c}"] or 0.0) for c in cols}
    # the grid is evaluated several times over the same rows: keep the
    # projected values (like MLlib's iterative fits do); a lost block is
    # recomputed from lineage
    wide = (df.select(*[(F.col(c).cast("double") / F.lit(scale.get(c, 1.0))).alias(c) for c in cols])
            .persist(StorageLevel.MEMORY_AND_DISK))
    lo = {c: GRID_LO for c in cols}
    hi = {c: GRID_HI for c in cols}
    lam, zooms = {}, {c: 0 for c in cols}
    while todo := [c for c in cols if zooms[c] < ZOOM_ROUNDS]:
        grid = {c: [lo[c] + (hi[c] - lo[c]) * i / (GRID_POINTS - 1) for i in range(GRID_POINTS)]
                for c in todo}
        llf = _evaluate_grid(wide, strategy, grid)
        for c in todo:
            if not llf[c]:
                wide.unpersist()
                raise ValueError(f"no finite likelihood for column {c!r}")
            step = grid[c][1] - grid[c][0]
            lam[c] = max(llf[c].items(), key=lambda kv: (kv[1], -abs(kv[0])))[0]
            if abs(lam[c]) > MAX_LAMBDA:
                wide.unpersist()
                raise ValueError(f"the likelihood of column {c!r} has no maximum below |lambda| = {MAX_LAMBDA:g}")
            edge = lam[c] in (grid[c][0], grid[c][-1])
            if edge and zooms[c] == 0:      # the maximum is not bracketed yet
                width = hi[c] - lo[c]
                lo[c], hi[c] = lam[c] - width, lam[c] + width
            else:
                zooms[c] += not edge
                lo[c], hi[c] = lam[c] - step, lam[c] + step
    wide.unpersist()
    return PowerModel(strategy, lam, cols)
