"""Chained-equation (MICE) imputation of numeric columns (F2).

Same procedure as an iterative imputer with Bayesian-ridge estimators:
start from the column means; then, round after round, for every column in
ascending order of missing count, regress it on all other columns (their
current values) over the rows where it is observed and replace its
missing cells by the prediction.  Stop after ``max_iter`` rounds or when
the largest row-wise sum of absolute changes in a round is below
``tol * max|observed value|``.

Distribution: each (round, column) fit needs only the means and the
covariance matrix of the observed rows, after which the Bayesian-ridge evidence
maximisation runs on the driver on a p x p eigen-decomposition.  A filled cell
is an affine function of its row's observed cells, the same for all rows of a
pattern of missing cells.  So **one aggregation** by pattern gives the moments
of every round; a second scan gives the rounds' largest changes.  Nothing is
written.  With more than ``MAX_ENUMERATED`` columns, whose patterns are too
many to list, the rows are filled round by round: an aggregation per fit, a
reliable checkpoint per round.

The fitted state is the initial means plus the ordered list of linear steps.
For a row they depend only on which of its cells are missing, so the steps of
each pattern of missing cells (a bit mask) are composed once, on the driver,
into one affine map of the observed cells; ``transform`` looks the row's map
up by its mask and applies it as a column expression: no Python, no shuffle,
no lineage growth.  With more than ``MAX_ENUMERATED`` columns, whose patterns
are too many to list, the steps are folded over the row's cells instead, also
as an expression.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import json

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...session import checkpoint
from .base import JsonState, present

MAX_ENUMERATED = 8          # columns: at most 2^8 patterns of missing cells

_EPS = float(np.finfo(np.float64).eps)


def bayesian_ridge(cov_xx: np.ndarray, cov_xy: np.ndarray, var_y: float, n: int,
                   max_iter: int = 300, tol: float = 1e-3, alpha_1: float = 1e-6,
                   alpha_2: float = 1e-6, lambda_1: float = 1e-6, lambda_2: float = 1e-6):
    """Evidence-maximising Bayesian ridge from centred second moments
    (population covariances of the observed rows).  Returns ``coef``."""
    xtx = cov_xx * n
    xty = cov_xy * n
    yty = var_y * n
    ev, V = np.linalg.eigh(xtx)
    ev = np.clip(ev, 0.0, None)
    vty = V.T @ xty
    alpha, lam = 1.0 / (var_y + _EPS), 1.0

    def coef_of(a, l):
        c = V @ (vty / (ev + l / a))
        rmse = yty - 2.0 * c @ xty + c @ xtx @ c
        return c, max(rmse, 0.0)

    coef_old = None
    for it in range(max_iter):
        coef, rmse = coef_of(alpha, lam)
        gamma = float(np.sum((alpha * ev) / (lam + alpha * ev)))
        lam = (gamma + 2 * lambda_1) / (float(np.sum(coef ** 2)) + 2 * lambda_2)
        alpha = (n - gamma + 2 * alpha_1) / (rmse + 2 * alpha_2)
        if it != 0 and np.sum(np.abs(coef_old - coef)) < tol:
            break
        coef_old = np.copy(coef)
    coef, _ = coef_of(alpha, lam)
    return coef


@dataclass(frozen=True)
class MICEModel(JsonState):
    columns: list
    means: dict = field(default_factory=dict)
    steps: list = field(default_factory=list)   # [column, [coef per other column], intercept]
    n_iter: int = 0

    def pattern_maps(self) -> list[list[list[float]]]:
        """For each mask (bit j: column j is missing) and column, the
        coefficients on the observed cells followed by the constant."""
        p, at = len(self.columns), {c: j for j, c in enumerate(self.columns)}
        maps = []
        for mask in range(1 << p):
            m = _first_map(mask, [self.means[c] for c in self.columns])
            for c, coef, b in self.steps:
                if mask >> at[c] & 1:
                    _step(m, at[c], coef, b)
            maps.append([[float(v) for v in row] for row in m])
        return maps

    def _by_pattern(self, cells: list[Column], missing: list[Column]) -> list[Column]:
        p = len(cells)
        # a foldable literal, whatever its length
        table = F.from_json(F.lit(json.dumps(self.pattern_maps())), "array<array<array<double>>>")
        mask = _mask(missing)
        known = [F.when(m, 0.0).otherwise(c) for c, m in zip(cells, missing)]
        out = []
        for j in range(p):
            row = F.element_at(F.element_at(table, mask + 1), j + 1)
            filled = F.element_at(row, p + 1)
            for k in range(p):
                filled = filled + F.element_at(row, k + 1) * known[k]
            out.append(F.when(missing[j], filled).otherwise(cells[j]))
        return out

    def _by_steps(self, cells: list[Column], missing: list[Column]) -> Column:
        """The filled cells of the row, as an array."""
        p, at = len(cells), {c: j for j, c in enumerate(self.columns)}
        steps = [{"j": at[c], "w": [*(float(v) for v in np.insert(np.array(coef), at[c], 0.0)), float(b)]}
                 for c, coef, b in self.steps]
        plan = F.from_json(F.lit(json.dumps(steps)), "array<struct<j:int,w:array<double>>>")
        start = F.array(*(F.when(m, F.lit(float(self.means[c]))).otherwise(x)
                          for x, m, c in zip(cells, missing, self.columns)))
        gone = F.array(*missing)

        def step(cur, s):
            w = s["w"]
            new = F.element_at(w, p + 1)
            for k in range(p):
                new = new + F.element_at(w, k + 1) * F.element_at(cur, k + 1)
            return F.when(F.element_at(gone, s["j"] + 1),
                          F.transform(cur, lambda v, k: F.when(k == s["j"], new).otherwise(v))).otherwise(cur)

        return F.aggregate(plan, start, step)

    def transform(self, df: DataFrame) -> DataFrame:
        """Columns come out as double, NULL and NaN cells filled."""
        cols = list(self.columns)
        gone = [c for c in cols if c not in df.columns]
        if gone:
            raise ValueError(f"MICE columns missing from input: {set(gone)}")
        cells = [F.col(c).cast("double") for c in cols]
        missing = [x.isNull() | F.isnan(x) for x in cells]
        if not cols:
            return df
        if len(cols) <= MAX_ENUMERATED:
            return df.withColumns(dict(zip(cols, self._by_pattern(cells, missing))))
        return (df.withColumn("__filled", self._by_steps(cells, missing))
                .withColumns({c: F.element_at("__filled", j + 1) for j, c in enumerate(cols)}).drop("__filled"))


def fit_mice(df: DataFrame, columns, max_iter: int = 10, tol: float = 1e-3) -> MICEModel:
    cols = present(df, columns)
    base = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in cols])
    return (_fit_by_pattern if len(cols) <= MAX_ENUMERATED else _fit_by_rows)(base, cols, max_iter, tol)


@dataclass
class _Pattern:
    """Moments of the known cells (0 where missing) of the rows of one
    pattern, and the map from these cells to the filled row."""
    n: int
    mean: np.ndarray
    cov: np.ndarray
    most: np.ndarray
    map: np.ndarray | None = None

    def filled(self) -> tuple[int, np.ndarray, np.ndarray]:
        a, b = self.map[:, :-1], self.map[:, -1]
        return self.n, a @ self.mean + b, a @ self.cov @ a.T


def _mask(missing) -> Column:
    return sum((F.when(m, 1 << j).otherwise(0) for j, m in enumerate(missing)), F.lit(0))


def _patterns(base: DataFrame, cols: list) -> dict[int, _Pattern]:
    p = len(cols)
    rows = base.select(_mask([F.col(c).isNull() for c in cols]).alias("mask"),
                       *[F.coalesce(F.col(c), F.lit(0.0)).alias(f"x{j}") for j, c in enumerate(cols)])
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    got = rows.groupBy("mask").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(f"x{j}").alias(f"m{j}") for j in range(p)],
        *[F.max(F.abs(f"x{j}")).alias(f"a{j}") for j in range(p)],
        *[F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}_{j}") for i, j in pairs]).collect()
    out = {}
    for r in sorted(got, key=lambda r: r["mask"]):
        cov = np.zeros((p, p))
        for i, j in pairs:
            cov[i, j] = cov[j, i] = r[f"c{i}_{j}"] or 0.0
        out[r["mask"]] = _Pattern(r["n"], np.array([r[f"m{j}"] for j in range(p)], float), cov,
                                  np.array([r[f"a{j}"] for j in range(p)], float))
    return out


def _largest_changes(base: DataFrame, cols: list, changes: list[dict]) -> list[float]:
    """Per round the largest row-wise sum of absolute changes, from one scan
    of the rows that miss a cell."""
    p, rounds = len(cols), len(changes)

    def run(batches):
        most = np.zeros(rounds)
        for b in batches:
            mask = b.column(0).to_numpy()
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns[1:]])
            for m in np.unique(mask).tolist():
                part = x[mask == m]
                for k, change in enumerate(changes):
                    d = change[m]
                    most[k] = np.maximum(most[k], np.abs(part @ d[:, :p].T + d[:, p]).sum(axis=1).max())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rounds, dtype=np.int32)), pa.array(most)],
                                         names=["round", "most"])
    missing = [F.col(c).isNull() for c in cols]
    rows = base.select(_mask(missing).alias("mask"), *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in cols])
    got = (rows.where("mask <> 0").mapInArrow(run, "round int, most double").groupBy("round")
           .agg(F.max("most").alias("most")).collect())
    most = {r["round"]: r["most"] for r in got}
    return [most.get(k, 0.0) for k in range(rounds)]


def _fit_by_pattern(base: DataFrame, cols: list, max_iter: int, tol: float) -> MICEModel:
    """Two scans: the moments of each pattern's observed cells, from which
    every round's regressions follow, and the rounds' largest changes."""
    found = _patterns(base, cols)
    rows = sum(g.n for g in found.values())
    gone = [sum(g.n for m, g in found.items() if m >> j & 1) for j in range(len(cols))]
    # columns with no observed value cannot be modelled and are left out
    kept = [j for j in range(len(cols)) if gone[j] < rows]
    cols, gone = [cols[j] for j in kept], [gone[j] for j in kept]
    found = {sum((m >> j & 1) << i for i, j in enumerate(kept)): _Pattern(
        g.n, g.mean[kept], g.cov[np.ix_(kept, kept)], g.most[kept]) for m, g in found.items()}
    p = len(cols)
    norm_tol = tol * max(max(g.most) for g in found.values())
    means = [sum(g.n * g.mean[j] for m, g in found.items() if not m >> j & 1) / (rows - gone[j]) for j in range(p)]
    for m, g in found.items():
        g.map = _first_map(m, means)
    steps, changes = [], []
    for _ in range(max_iter):
        before = {m: g.map.copy() for m, g in found.items()}
        for j in sorted(range(p), key=lambda j: gone[j]):       # stable, ascending
            seen = [g.filled() for m, g in found.items() if not m >> j & 1]
            n = sum(k for k, _, _ in seen)
            mean = sum(k * mu for k, mu, _ in seen) / n
            cov = sum(k * (c + np.outer(mu - mean, mu - mean)) for k, mu, c in seen) / n
            others = [o for o in range(p) if o != j]
            coef = bayesian_ridge(cov[np.ix_(others, others)], cov[others, j], float(cov[j, j]), n)
            intercept = float(mean[j] - coef @ mean[others])
            steps.append([cols[j], [float(v) for v in coef], intercept])
            for m, g in found.items():
                if m >> j & 1:
                    _step(g.map, j, coef, intercept)
        changes.append({m: g.map - before[m] for m, g in found.items()})
    n_iter = len(changes)
    for k, most in enumerate(_largest_changes(base.select(*cols), cols, changes)):
        if most < norm_tol:
            n_iter = k + 1
            break
    return MICEModel(cols, dict(zip(cols, map(float, means))), steps[:n_iter * p], n_iter)


def _first_map(mask: int, means) -> np.ndarray:
    """Rows: columns; on the observed cells, then the constant."""
    p = len(means)
    m = np.zeros((p, p + 1))
    for j in range(p):
        if mask >> j & 1:
            m[j, p] = means[j]
        else:
            m[j, j] = 1.0
    return m


def _step(m: np.ndarray, j: int, coef, intercept: float) -> None:
    m[j] = np.array(coef) @ np.delete(m, j, axis=0)
    m[j, -1] += intercept


def _fit_by_rows(base: DataFrame, cols: list, max_iter: int, tol: float) -> MICEModel:
    """Too many patterns to list: the rows are filled round by round."""
    stats = base.agg(*[F.avg(c).alias(f"{c}__m") for c in cols],
                     *[F.count_if(F.col(c).isNull()).alias(f"{c}__nm") for c in cols],
                     *[F.max(F.abs(c)).alias(f"{c}__ab") for c in cols]).collect()[0]
    # columns with no observed value cannot be modelled and are left out
    cols = [c for c in cols if stats[f"{c}__m"] is not None]
    p = len(cols)
    means = {c: float(stats[f"{c}__m"]) for c in cols}
    order = sorted(range(p), key=lambda i: stats[f"{cols[i]}__nm"])   # stable, ascending
    norm_tol = tol * max(float(stats[f"{c}__ab"]) for c in cols)
    miss = {c: F.col(f"__o_{c}").isNull() for c in cols}
    cur = base.select(*[F.col(c).alias(f"__o_{c}") for c in cols],
                      *[F.coalesce(F.col(c), F.lit(means[c])).alias(c) for c in cols])
    cur = checkpoint(cur)
    steps, n_iter = [], 0
    for rnd in range(max_iter):
        prev = cur.select(*[F.col(c).alias(f"__p_{c}") for c in cols], *cur.columns)
        work = prev
        held = []          # persisted step frames of this round
        for j in order:
            c = cols[j]
            others = [o for o in cols if o != c]
            obs = work.where(~miss[c])
            aggs = [F.count(F.lit(1)).alias("n"), F.var_pop(c).alias("vy"), F.avg(c).alias("my")]
            aggs += [F.avg(o).alias(f"m_{o}") for o in others]
            aggs += [F.covar_pop(o, c).alias(f"cy_{o}") for o in others]
            for a in range(len(others)):
                for b in range(a, len(others)):
                    aggs.append(F.covar_pop(others[a], others[b]).alias(f"c_{a}_{b}"))
            r = obs.agg(*aggs).collect()[0]
            # ``work`` is now materialised; earlier step frames are not needed
            # (a lost block recomputes from the round's checkpoint)
            for h in held[:-1]:
                h.unpersist()
            held = held[-1:]
            k = len(others)
            cxx = np.zeros((k, k))
            for a in range(k):
                for b in range(a, k):
                    cxx[a, b] = cxx[b, a] = r[f"c_{a}_{b}"] or 0.0
            cxy = np.array([r[f"cy_{o}"] or 0.0 for o in others])
            coef = bayesian_ridge(cxx, cxy, float(r["vy"] or 0.0), int(r["n"]))
            intercept = float(r["my"]) - float(sum(coef[i] * r[f"m_{o}"]
                                                   for i, o in enumerate(others)))
            steps.append([c, [float(v) for v in coef], intercept])
            pred = F.lit(intercept)
            for i, o in enumerate(others):
                pred = pred + F.lit(float(coef[i])) * F.col(o)
            work = work.withColumn(c, F.when(miss[c], pred).otherwise(F.col(c))) \
                .persist(StorageLevel.MEMORY_AND_DISK)
            held.append(work)
        n_iter = rnd + 1
        change = F.lit(0.0)
        for c in cols:
            change = change + F.abs(F.col(c) - F.col(f"__p_{c}"))
        inf_norm = work.agg(F.max(change)).collect()[0][0] or 0.0
        cur = checkpoint(work.drop(*[f"__p_{c}" for c in cols]))
        for h in held:
            h.unpersist()
        if inf_norm < norm_tol:
            break
    return MICEModel(cols, means, steps, n_iter)
