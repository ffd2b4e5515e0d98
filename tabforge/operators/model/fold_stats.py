"""Linear models of all time-ordered folds from one scan (V3, H1s-H3s).

The bounds of the folds cut the ordinals into segments.  One pass over the
ordered table sums, per segment, the cross products of ``z = (1, features,
label)``.  A fold's training rows are a run of segments, so its normal
equations are a sum of these matrices, and every linear model of every penalty
follows from them without reading the rows again.  The squared error on a
fold's test rows is a quadratic form of the test segments' matrix, so RMSE,
MSE and R2 of any number of parameter settings cost no scan either.

Columns are shifted by one row's values before the products: sums stay exact
to rounding however far the values lie from zero.

What reaches the driver: (segments x q (q + 1) / 2) numbers with q = features
+ 2, where segments is at most four times the number of folds.  Rows are
folded batch by batch in the tasks, with a matrix per segment met, and summed
per matrix cell on Spark.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..splits import Fold

QUADRATIC = ("r2", "rmse", "mse")       # metrics that the test matrices give


@dataclass
class FoldMoments:
    """Cross products per segment ``[bounds[i], bounds[i + 1])`` of the
    shifted columns."""
    bounds: np.ndarray
    grams: np.ndarray
    shift: np.ndarray

    def between(self, lo: int, hi: int) -> np.ndarray:
        """Matrix of the rows with ordinals in ``[lo, hi)``; both are bounds."""
        i, j = np.searchsorted(self.bounds, [lo, hi])
        if self.bounds[i] != lo or self.bounds[j] != hi:
            raise ValueError(f"[{lo}, {hi}) is not a run of segments")
        return self.grams[i:j].sum(axis=0)

    def train(self, fold: Fold) -> np.ndarray:
        return self.between(fold.train_start, fold.train_end)

    def test(self, fold: Fold) -> np.ndarray:
        return self.between(fold.test_start, fold.test_end)


def fold_moments(ordered: DataFrame, folds: Sequence[Fold], features: Sequence[str], label: str,
                 ordinal_col: str = "ordinal") -> FoldMoments:
    """One scan of ``ordered``.  A null or not finite feature or label is an
    error, as it is for every model of this package."""
    bounds = np.array(sorted({b for f in folds for b in (f.train_start, f.train_end, f.test_start, f.test_end)}))
    values = [F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate([*features, label])]
    rows = ordered.select(F.col(ordinal_col).alias("o"), *values)
    first = rows.drop("o").first()
    if first is None:
        raise ValueError("no rows to fit on")
    shift = np.array([v if v is not None and math.isfinite(v) else 0.0 for v in first], float)
    q = len(values) + 1

    def run(batches):
        import pyarrow as pa
        sums: dict = {}
        for b in batches:
            z = np.ones((b.num_rows, q))
            for i in range(1, q):
                z[:, i] = b.column(i).to_numpy(zero_copy_only=False)
            if not np.isfinite(z).all():
                raise ValueError("a feature or the label is null or not finite")
            z[:, 1:] -= shift
            at = np.searchsorted(bounds, b.column(0).to_numpy(), side="right") - 1
            for s in np.unique(at):
                if 0 <= s < len(bounds) - 1:
                    part = z[at == s]
                    sums[int(s)] = sums.get(int(s), 0.0) + part.T @ part
        i, j = np.triu_indices(q)
        for s, m in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), s, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
                 pa.array(m[i, j])], names=["segment", "i", "j", "v"])

    cells = rows.mapInArrow(run, "segment int, i int, j int, v double").groupBy("segment", "i", "j").agg(
        F.sum("v").alias("v")).collect()
    grams = np.zeros((max(1, len(bounds) - 1), q, q))
    for r in cells:
        grams[r["segment"], r["i"], r["j"]] = grams[r["segment"], r["j"], r["i"]] = r["v"]
    return FoldMoments(bounds, grams, shift)


def _descend(s: np.ndarray, c: np.ndarray, l1: float, l2: float, max_iter: int, tol: float) -> np.ndarray:
    """Minimum of ``w's w / 2 - c'w + l1 |w| + l2 w'w / 2`` by coordinate
    descent."""
    w = np.zeros(len(c))
    for _ in range(max_iter):
        moved = 0.0
        for j in range(len(c)):
            if s[j, j] + l2 <= 0:
                continue
            rest = c[j] - s[j] @ w + s[j, j] * w[j]
            new = math.copysign(max(abs(rest) - l1, 0.0), rest) / (s[j, j] + l2)
            moved = max(moved, abs(new - w[j]) * math.sqrt(s[j, j]))
            w[j] = new
        if moved <= tol:
            break
    return w


def solve_linear(gram: np.ndarray, shift: np.ndarray, name: str, params: dict | None = None) -> np.ndarray:
    """(intercept, coefficients) of a linear model by name on the rows behind
    ``gram``; parameters as in :func:`estimators.make_estimator`.

    Ridge adds alpha to the cross products, SGD (its optimum) alpha per row;
    lasso and elastic net descend on the mean cross products.  Linearly
    dependent features share their weight (least norm)."""
    p = dict(params or {})
    n = gram[0, 0]
    if n <= 0:
        raise ValueError("no rows to fit on")
    if p.get("fit_intercept", True):
        mean = gram[0, 1:] / n
        centre = mean + shift
        c = gram[1:, 1:] - n * np.outer(mean, mean)
    else:
        centre = np.zeros(len(shift))
        c = gram[1:, 1:] + np.outer(gram[0, 1:], shift) + np.outer(shift, gram[0, 1:]) + n * np.outer(shift, shift)
    s, t = c[:-1, :-1], c[:-1, -1]
    alpha = float(p.get("alpha", 1.0))
    if name in ("Lasso", "ElasticNet"):
        ratio = 1.0 if name == "Lasso" else float(p.get("l1_ratio", 0.5))
        tol = float(p.get("tol", 1e-10)) * math.sqrt(max(c[-1, -1] / n, 0.0))
        w = _descend(s / n, t / n, alpha * ratio, alpha * (1 - ratio), int(p.get("max_iter", 10_000)), tol)
    elif name in ("LinearRegression", "Ridge", "SGDRegressor"):
        add = {"LinearRegression": 0.0, "Ridge": alpha, "SGDRegressor": alpha * n}[name]
        s = s + add * np.eye(len(t))
        size = np.sqrt(np.where(np.diag(s) > 0, np.diag(s), 1.0))
        w = np.linalg.lstsq(s / np.outer(size, size), t / size, rcond=1e-12)[0] / size
    else:
        raise ValueError(f"unknown linear model {name!r}")
    return np.concatenate([[centre[-1] - centre[:-1] @ w], w])


def gram_metrics(gram: np.ndarray, shift: np.ndarray, beta: np.ndarray) -> dict:
    """R2, RMSE and MSE of ``beta`` (intercept first) on the rows behind
    ``gram``; a constant label has R2 1 if every prediction is right, else 0."""
    n = gram[0, 0]
    a = np.concatenate([[shift[-1] - beta[0] - shift[:-1] @ beta[1:]], -beta[1:], [1.0]])
    sse = max(float(a @ gram @ a), 0.0)
    spread = float(gram[-1, -1] - gram[0, -1] ** 2 / n)
    r2 = 1 - sse / spread if spread > 0 else float(sse == 0)
    return {"r2": r2, "mse": sse / n, "rmse": math.sqrt(sse / n)}


def fold_predictions(ordered: DataFrame, folds: Sequence[Fold], betas: Sequence[np.ndarray], features: Sequence[str],
                     label: str, ordinal_col: str = "ordinal", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, fold, ordinal, y_true, y_pred) of every fold's test rows in one
    scan: the fold's number is computed from the ordinal, its coefficients
    are looked up by it."""
    at = F.col(ordinal_col)
    start, size = folds[0].test_start, folds[0].test_end - folds[0].test_start
    fold = F.floor((at - start) / size).cast("int")

    def weight(i: int) -> Column:
        return F.element_at(F.array(*(F.lit(float(b[i])) for b in betas)), F.col("_f") + 1)

    y = weight(0)
    for i, c in enumerate(features, 1):
        y = y + weight(i) * F.col(c).cast("double")
    number = F.element_at(F.array(*(F.lit(f.fold) for f in folds)), F.col("_f") + 1)
    return (ordered.where((at >= start) & (at < folds[-1].test_end)).withColumn("_f", fold)
            .select(*keys, number.alias("fold"), at.alias("ordinal"), F.col(label).cast("double").alias("y_true"),
                    y.alias("y_pred")))
