"""Training run modes (M9, V5).

* ``train_only``  - fit on train and validation together (time order kept),
  evaluate on test when given;
* ``cv``          - time-ordered CV on train + validation, then refit on all
  of it, evaluate on test when given;
* ``validation``  - fit on train, evaluate on validation (and test).

Linear folds come from one scan, tree folds are an MLlib job each.  Every
evaluated set gives metrics (``scaled`` and ``unscaled`` when the target was
scaled or power-transformed), the predictions with the rows' keys, and the
model's coefficients or importances; with ``output`` they are written as
tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dedup import union_all
from ..operators.model import cv
from ..operators.model.estimators import LINEAR, assemble, coefficients_table, make_estimator
from ..operators.model.metrics import regression_metrics
from ..sources import sinks

MODES = ("train_only", "cv", "validation")


@dataclass
class Evaluation:
    """V5 of one set: metrics per scale, and (keys, split, y_true, y_pred,
    scale) of every row."""
    metrics: DataFrame
    predictions: DataFrame


def evaluate(model, df: DataFrame, features, label: str, split: str, nominal: dict | None = None,
             keys=(), scaler=None, power=None) -> Evaluation:
    pred = model.transform(assemble(df, features, nominal=nominal)).select(
        *keys, F.lit(split).alias("split"), F.col(label).cast("double").alias("y_true"),
        F.col("prediction").alias("y_pred"))
    both = cv.both_scales(pred, scaler, power, label)
    by = ["split"] if scaler is None and power is None else ["split", "scale"]
    return Evaluation(regression_metrics(both, "y_true", "y_pred", by), both)


def train_model(name: str, params: dict, features, label: str, train: DataFrame,
                validation: DataFrame | None = None, test: DataFrame | None = None,
                mode: str = "validation", date_col: str = "date", tie_key=(),
                n_splits: int = 5, nominal: dict | None = None, parallelism: int = 4,
                scaler=None, power=None, keys=(), output: str | None = None):
    """The fitted model and the metrics table ``(split, [scale,] r2, rmse,
    ...)``.  ``output``: predictions, metrics and coefficients or importances
    are written below it."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    tables, predictions = [], []
    if mode == "validation":
        fit_on = train
    else:
        fit_on = train if validation is None else union_all(train, validation)
        if mode == "cv":
            ordered, n = cv.ordered_frame(fit_on, date_col, list(tie_key), list(features), label,
                                           prune=name not in LINEAR)
            m = cv.time_cv_metrics(ordered, n, name, params, list(features), label, n_splits,
                                   parallelism=parallelism, nominal=nominal, scaler=scaler, power=power)
            tables.append(m.select(F.concat(F.lit("cv_fold_"), F.col("fold").cast("string"))
                                   .alias("split"), *[c for c in m.columns if c != "fold"]))
    v = assemble(fit_on, features, nominal=nominal)
    model = make_estimator(name, params, label=label, train=v, nominal=nominal).fit(v)
    sets = [("validation", validation if mode == "validation" else None), ("test", test)]
    for split, df in sets:
        if df is not None:
            e = evaluate(model, df, features, label, split, nominal, keys, scaler, power)
            tables.append(e.metrics)
            predictions.append(e.predictions)
    out = tables[0] if tables else None
    for t in tables[1:]:
        out = out.unionByName(t)
    if output is not None:
        _write(train.sparkSession, output.rstrip("/"), model, list(features), out, predictions)
        out = out and train.sparkSession.read.parquet(f"{output.rstrip('/')}/metrics")
    return model, out


def _write(spark, path: str, model, features, metrics, predictions) -> None:
    if predictions:
        every = predictions[0]
        for p in predictions[1:]:
            every = every.unionByName(p)
        sinks.write_predictions(every, f"{path}/predictions")
    if metrics is not None:
        sinks.write_metrics(metrics, f"{path}/metrics")
    sinks.write_metrics(coefficients_table(spark, model, features), f"{path}/importances")
