"""Time-ordered splits.

T1 (split by fraction) does not sort the table.  Rows are counted per date
(partial aggregation), a running sum over the *per-date* table locates the
at most two dates where a cut falls, and only the rows of those dates are
ranked by the tie key.  Everything else is labelled by comparing its date.
The output is the union of those two labelled parts: no join, and the
full table is never range-shuffled.

T3 (expanding-window folds) needs every row's position, so it uses the
global ordinal; a row's folds follow from it by arithmetic.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordinal import weighted_prefix, with_global_ordinal

TRAIN, VALIDATION, TEST, HOLDOUT = "train", "validation", "test", "holdout"
DEFAULT_TRAIN_SIZE = 0.70
DEFAULT_VAL_SIZE = 0.15


def split_by_fraction(df: DataFrame, date_col: str, tie_key: Sequence[str],
                      train_size: float = DEFAULT_TRAIN_SIZE,
                      val_size: float = DEFAULT_VAL_SIZE,
                      split_col: str = "split") -> DataFrame:
    """Sort by ``(date, tie_key)``; first ``int(n*train)`` rows train,
    next ``int(n*val)`` validation, the rest test.  Rows with a NULL date
    are dropped first (the coercing parse of the source)."""
    src = df.where(F.col(date_col).isNotNull())
    counts = src.groupBy(date_col).agg(F.count(F.lit(1)).alias("_n"))
    # the per-date counts also give n: no separate pass over the rows
    cum, n = weighted_prefix(counts, [date_col], "_n", "_before", return_total=True)
    c1 = int(n * train_size)
    c2 = c1 + int(n * val_size)
    cum_rows = cum.where(
        ((F.col("_before") < c1) & (F.col("_before") + F.col("_n") > c1))
        | ((F.col("_before") < c2) & (F.col("_before") + F.col("_n") > c2))
        | (F.col("_before") == c1) | (F.col("_before") == c2)
    ).select(date_col, "_n", "_before").collect()

    def locate(p):
        """(date, rows of that date before the cut) for cut position p."""
        for r in cum_rows:
            if r["_before"] < p < r["_before"] + r["_n"]:
                return r[date_col], p - r["_before"]
        for r in cum_rows:
            if r["_before"] == p:
                return r[date_col], 0
        return None, 0   # cut at the very end: everything is before it

    (d1, k1), (d2, k2) = locate(c1), locate(c2)
    d = F.col(date_col)

    def label_by_date():
        lab = F.lit(TEST)
        if d2 is not None:
            lab = F.when(d < F.lit(d2), F.lit(VALIDATION)).otherwise(lab)
        else:
            lab = F.lit(VALIDATION)
        if d1 is not None:
            lab = F.when(d < F.lit(d1), F.lit(TRAIN)).otherwise(lab)
        else:
            lab = F.lit(TRAIN)
        return lab

    boundary = [x for x in {d1, d2} if x is not None]
    if not boundary:
        return src.withColumn(split_col, label_by_date())
    plain = src.where(~d.isin(boundary)).withColumn(split_col, label_by_date())
    # rank rows of the boundary dates only, in (date, tie_key) order
    edge = src.where(d.isin(boundary))
    ranked = with_global_ordinal(edge, [d, *[F.col(c) for c in tie_key]], "_pos")
    # position of each boundary row within its own date
    starts = {}
    for bd in sorted(boundary):
        starts[bd] = 0
    # rows before a date among the boundary rows: the earlier boundary date's count
    if len(boundary) == 2:
        first, second = sorted(boundary)
        n_first = [r["_n"] for r in cum_rows if r[date_col] == first][0]
        starts[second] = n_first
    start_col = F.lit(0)
    for bd, s in starts.items():
        start_col = F.when(d == F.lit(bd), F.lit(s)).otherwise(start_col)
    within = F.col("_pos") - start_col

    def edge_label():
        # earlier split when (date, within) is before the cut
        lab = F.lit(TEST)
        if d2 is not None:
            before2 = (d < F.lit(d2)) | ((d == F.lit(d2)) & (within < F.lit(k2)))
            lab = F.when(before2, F.lit(VALIDATION)).otherwise(lab)
        else:
            lab = F.lit(VALIDATION)
        if d1 is not None:
            before1 = (d < F.lit(d1)) | ((d == F.lit(d1)) & (within < F.lit(k1)))
            lab = F.when(before1, F.lit(TRAIN)).otherwise(lab)
        else:
            lab = F.lit(TRAIN)
        return lab

    edged = ranked.withColumn(split_col, edge_label()).drop("_pos")
    return plain.unionByName(edged.select(*plain.columns))


def split_by_dates(df: DataFrame, date_col: str, train_end: str, val_end: str,
                   test_end: str | None = None, split_col: str = "split",
                   warn_empty: bool = False) -> DataFrame:
    """``date <= train_end`` train, ``<= val_end`` validation,
    ``<= test_end`` test, later holdout (or test when no ``test_end``).

    Bounds must be ``YYYY-MM-DD`` and increasing (checked on the driver).
    With ``warn_empty`` one grouped count reports any empty split."""
    import datetime
    bounds = [b for b in (train_end, val_end, test_end) if b is not None]
    parsed = [datetime.date.fromisoformat(b) for b in bounds]   # strict: raises on bad text
    if parsed != sorted(parsed):
        raise ValueError(f"split bounds must increase: {bounds}")
    d = F.col(date_col)
    lab = (F.when(d <= F.to_date(F.lit(train_end)), F.lit(TRAIN))
           .when(d <= F.to_date(F.lit(val_end)), F.lit(VALIDATION)))
    if test_end is None:
        lab = lab.otherwise(F.lit(TEST))
    else:
        lab = lab.when(d <= F.to_date(F.lit(test_end)), F.lit(TEST)).otherwise(F.lit(HOLDOUT))
    out = df.where(d.isNotNull()).withColumn(split_col, lab)
    if warn_empty:
        names = [TRAIN, VALIDATION, TEST] + ([HOLDOUT] if test_end is not None else [])
        sizes = split_sizes(out, split_col)
        empty = [n for n in names if not sizes.get(n)]
        if empty:
            logging.getLogger(__name__).warning("empty splits: %s", empty)
    return out


def split_sizes(df: DataFrame, split_col: str = "split") -> dict:
    return {r[split_col]: r["count"] for r in df.groupBy(split_col).count().collect()}


# --- T3 ----------------------------------------------------------------------

@dataclass(frozen=True)
class Fold:
    fold: int
    train_start: int
    train_end: int      # exclusive
    test_start: int
    test_end: int       # exclusive


def time_series_folds(n: int, n_splits: int = 5, max_train_size: int | None = None,
                      test_size: int | None = None, gap: int = 0) -> list[Fold]:
    """Expanding-window fold bounds over ordinals ``0..n-1`` (the
    scikit-learn ``TimeSeriesSplit`` rule)."""
    n_folds = n_splits + 1
    ts = test_size if test_size is not None else n // n_folds
    if n_folds > n or n - gap - ts * n_splits <= 0:
        raise ValueError("too few rows for the requested folds")
    folds = []
    for i in range(n_splits):
        test_start = n - (n_splits - i) * ts
        train_end = test_start - gap
        train_start = 0 if max_train_size is None else max(0, train_end - max_train_size)
        folds.append(Fold(i, train_start, train_end, test_start, test_start + ts))
    return folds


def with_ordinal(df: DataFrame, date_col: str, tie_key: Sequence[str],
                 ordinal_col: str = "ordinal", return_count: bool = False):
    """Global 0-based position in ``(date, tie_key)`` order."""
    return with_global_ordinal(df, [F.col(date_col), *[F.col(c) for c in tie_key]], ordinal_col,
                               return_count=return_count)


def _fold_range(folds: Sequence[Fold], o) -> tuple:
    """First and last fold whose training rows include ordinal ``o`` (first >
    last: none), from the folds' common step."""
    k, step = len(folds), folds[0].test_end - folds[0].test_start
    last = folds[-1]
    width = None if last.train_start == 0 else last.train_end - last.train_start
    for i, f in enumerate(folds):
        want_end = last.train_end - (k - 1 - i) * step
        if (f.fold, f.train_end, f.test_end - f.test_start) != (i, want_end, step) or \
                f.train_start != (0 if width is None else max(0, want_end - width)):
            raise ValueError("folds are not those of time_series_folds")
    # fold i trains on [.., last.train_end - (k - 1 - i) * step)
    first = F.greatest(F.lit(0), F.lit(k) - F.ceil((F.lit(last.train_end) - o) / step))
    if width is None:
        return first, F.lit(k - 1)
    return first, F.least(F.lit(k - 1), F.lit(k - 1) - F.ceil((F.lit(last.train_end - width) - o) / step))


def assign_folds(ordered: DataFrame, folds: Sequence[Fold],
                 ordinal_col: str = "ordinal") -> DataFrame:
    """Rows x folds they take part in, with ``role`` train/test.

    The folds of a row follow from its ordinal by arithmetic: the training
    folds are a run of numbers, the test fold is one; they are exploded, and
    a row meets no fold that it isn't part of."""
    o, step = F.col(ordinal_col), folds[0].test_end - folds[0].test_start
    first, last = (c.cast("int") for c in _fold_range(folds, o))
    none = F.array().cast("array<struct<fold:int,role:string>>")
    train = F.when(first <= last, F.transform(F.sequence(first, F.greatest(first, last)), lambda i: F.struct(
        i.alias("fold"), F.lit("train").alias("role")))).otherwise(none)
    in_test = (o >= folds[0].test_start) & (o < folds[-1].test_end)
    test = F.when(in_test, F.array(F.struct(
        F.floor((o - folds[0].test_start) / step).cast("int").alias("fold"), F.lit("test").alias("role")))).otherwise(none)
    return ordered.withColumn("_m", F.explode(F.concat(train, test))).select(
        *ordered.columns, F.col("_m.fold").alias("fold"), F.col("_m.role").alias("role"))
