"""Sinks (S5-S10): split output, gate-routed writes, prediction and
metric tables, seeded sample export.

All writes are distributed ``DataFrameWriter`` calls; ``overwrite`` makes
a retried job idempotent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_splits(df: DataFrame, path: str, split_col: str = "split",
                 fmt: str = "parquet") -> None:
    """One directory per split value (``split=train/...``).  Parquet by
    default; ``fmt="csv"`` keeps the text layout with a header."""
    w = df.write.mode("overwrite").partitionBy(split_col)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


def route_write(df: DataFrame, passed: bool, processed_dir: str, quarantine_dir: str,
                name: str, fmt: str = "parquet") -> str:
    """Write the table to ``processed`` when its gate passed, else to
    ``quarantine``.  Returns the path written."""
    target = f"{(processed_dir if passed else quarantine_dir).rstrip('/')}/{name}"
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(target)
    else:
        w.parquet(target)
    return target


def route_rows(df: DataFrame, ok: F.Column, processed_dir: str, quarantine_dir: str,
               name: str) -> None:
    """Row-level variant of the gate (ours, optional): rows passing ``ok``
    go to processed, the rest (including rows where ``ok`` is NULL) to
    quarantine.  Two filtered writes over the same lazy plan."""
    flag = F.coalesce(ok, F.lit(False))
    df.where(flag).write.mode("overwrite").parquet(f"{processed_dir.rstrip('/')}/{name}")
    df.where(~flag).write.mode("overwrite").parquet(f"{quarantine_dir.rstrip('/')}/{name}")


def write_predictions(pred: DataFrame, path: str) -> None:
    """Table of (row keys, ``split`` or ``fold``, ``y_true``, ``y_pred``,
    ``scale``)."""
    pred.write.mode("overwrite").parquet(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Table of metrics per fold or evaluated set, of search trials, or of
    a model's coefficients or importances."""
    metrics.write.mode("overwrite").parquet(path)


def sample_rows(df: DataFrame, n: int, seed: int, key: list[str] | None = None) -> DataFrame:
    """Exactly ``n`` rows chosen by a seeded hash of the row key.

    Deterministic and partition-independent (no ``rand``): ordering by
    ``md5(key|seed)`` and taking ``n`` plans a TakeOrderedAndProject,
    i.e. a per-partition top-n then one merge of ``n * partitions`` rows.
    The sample size is the feature here, so the limit is intended.
    """
    cols = key or df.columns
    h = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols], F.lit(str(int(seed)))))
    return df.orderBy(h, *[F.col(c) for c in cols]).limit(int(n))


def export_sample_csv(df: DataFrame, path: str, n: int = 50, seed: int = 0,
                      key: list[str] | None = None) -> None:
    sample_rows(df, n, seed, key).coalesce(1).write.mode("overwrite").option(
        "header", True).csv(path)
