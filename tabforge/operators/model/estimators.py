"""Model construction (M1-M9): names and scikit-style parameters mapped
onto MLlib estimators, which fit distributed.

Penalty translation (our design, verified against closed forms in tests):
* Ridge(alpha)        -> elasticNetParam=0, regParam = alpha * sigma_y / n
* Lasso(alpha)        -> elasticNetParam=1, regParam = alpha
* ElasticNet(a, r)    -> A = a*r, B = a*(1-r)*sigma_y; regParam=A+B, elasticNetParam=A/(A+B)
* SGDRegressor(l2, a) -> same optimum as Ridge with regParam = a * sigma_y
all with ``standardization=False`` (the penalty acts on raw coefficients).
Gradient-boosting configurations (XGB / LGBM names) become ``GBTRegressor``,
fitted from blocks of binned rows (:mod:`.gbt`).
An option without an MLlib counterpart is named in a warning, never dropped in
silence; a depth that MLlib cannot grow is an error.
"""

from __future__ import annotations

import warnings

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .gbt import BlockGBTRegressor

LINEAR = ("LinearRegression", "Ridge", "Lasso", "ElasticNet", "SGDRegressor")
TREES = ("RandomForestRegressor", "GBTRegressor", "XGBRegressor", "LGBMRegressor")
MAX_DEPTH = 30              # MLlib's limit
_TREE_PARAMS = {
    "RandomForestRegressor": {"n_estimators", "max_depth", "min_samples_leaf", "max_features", "max_samples"},
    "GBTRegressor": {"n_estimators", "learning_rate", "max_depth", "subsample", "colsample", "colsample_bytree"},
}


def tree_depth(value) -> int:
    """MLlib depth of a configured one; None or not positive means no limit,
    which is MLlib's largest."""
    if value is None or int(value) <= 0:
        return MAX_DEPTH
    if int(value) > MAX_DEPTH:
        raise ValueError(f"max_depth {value} is over MLlib's limit of {MAX_DEPTH}")
    return int(value)


def _bins(nominal: dict | None) -> int:
    """Split candidates: MLlib needs one per category of a nominal feature."""
    return max(32, *(int(k) for k in (nominal or {}).values()), 2)


def assemble(df: DataFrame, features, out: str = "features",
             nominal: dict | None = None) -> DataFrame:
    """Feature vector; NULL/NaN inputs are an error (gold data has none).

    ``nominal`` (M8) maps feature name -> number of categories for features
    holding category codes ``0..k-1``; they are declared as nominal ML
    attributes on the vector, so MLlib trees split them as categories."""
    v = VectorAssembler(inputCols=list(features), outputCol=out,
                        handleInvalid="error").transform(df)
    if not nominal:
        return v
    attrs = {"nominal": [], "numeric": []}
    for i, f in enumerate(features):
        if f in nominal:
            attrs["nominal"].append({"idx": i, "name": f, "num_vals": int(nominal[f])})
        else:
            attrs["numeric"].append({"idx": i, "name": f})
    meta = {"ml_attr": {"attrs": {k: x for k, x in attrs.items() if x},
                        "num_attrs": len(features)}}
    return v.withColumn(out, F.col(out).alias(out, metadata=meta))


def nominal_sizes(encoder_model, features) -> dict:
    """Category counts of encoded columns (auto and mapped ordinals)."""
    sizes = dict(encoder_model.auto_sizes)
    sizes.update({c: len(v) for c, v in encoder_model.mapped.items()})
    return {f: n for f, n in sizes.items() if f in features}


def label_std(df: DataFrame, label: str) -> tuple[float, int]:
    row = df.agg(F.stddev_samp(F.col(label).cast("double")).alias("s"),
                 F.count(F.col(label)).alias("n")).collect()[0]
    return float(row["s"] or 0.0), int(row["n"])


def make_estimator(name: str, params: dict | None = None, label: str = "label",
                   features: str = "features", train: DataFrame | None = None,
                   nominal: dict | None = None):
    """Estimator by model name; unknown names are an error.  ``nominal``
    (feature -> categories) sets how many bins a tree looks at."""
    p = dict(params or {})
    seed = p.pop("random_state", p.pop("seed", None))
    if name in LINEAR:
        sigma = n = None
        if name in ("Ridge", "ElasticNet", "SGDRegressor"):
            if train is None:
                raise ValueError(f"{name} needs the training frame to scale its penalty")
            sigma, n = label_std(train, label)
        alpha = float(p.get("alpha", 1.0))
        if name == "LinearRegression":
            reg, enet, solver = 0.0, 0.0, "normal"
        elif name == "Ridge":
            reg, enet, solver = alpha * sigma / n, 0.0, "normal"
        elif name == "Lasso":
            reg, enet, solver = alpha, 1.0, "auto"
        elif name == "ElasticNet":
            r = float(p.get("l1_ratio", 0.5))
            a, b = alpha * r, alpha * (1 - r) * sigma
            reg, enet, solver = a + b, (a / (a + b) if a + b > 0 else 0.0), "auto"
        else:
            # the optimum from one pass while the moments fit, else by steps
            reg, enet, solver = alpha * sigma, 0.0, "auto"
        return LinearRegression(featuresCol=features, labelCol=label, regParam=reg,
                                elasticNetParam=enet, standardization=False,
                                fitIntercept=bool(p.get("fit_intercept", True)), solver=solver,
                                maxIter=int(p.get("max_iter", 100)), tol=float(p.get("tol", 1e-6)))
    if name in TREES:
        kind = "RandomForestRegressor" if name == "RandomForestRegressor" else "GBTRegressor"
        unknown = sorted(set(p) - _TREE_PARAMS[kind])
        if unknown:
            warnings.warn(f"{name}: no MLlib counterpart for {unknown}", stacklevel=2)
        kw = dict(featuresCol=features, labelCol=label, maxBins=_bins(nominal))
        if seed is not None:
            kw["seed"] = int(seed)
        if kind == "RandomForestRegressor":
            return RandomForestRegressor(
                numTrees=int(p.get("n_estimators", 20)), maxDepth=tree_depth(p.get("max_depth")),
                minInstancesPerNode=int(p.get("min_samples_leaf", 1)),
                featureSubsetStrategy=str(p.get("max_features", "auto")),
                subsamplingRate=float(p.get("max_samples", 1.0) or 1.0), **kw)
        return BlockGBTRegressor(
            maxIter=int(p.get("n_estimators", 20)), stepSize=float(p.get("learning_rate", 0.1)),
            maxDepth=tree_depth(p.get("max_depth", 5)), subsamplingRate=float(p.get("subsample", 1.0)),
            featureSubsetStrategy=str(p.get("colsample_bytree", p.get("colsample", "all"))), **kw)
    raise ValueError(f"unknown model name {name!r}")


def coefficients_table(spark, model, features) -> DataFrame:
    """V6: ``(feature, value)`` for a linear model (intercept first) or
    feature importances of a tree ensemble."""
    if hasattr(model, "coefficients"):
        rows = [("intercept", float(model.intercept))]
        rows += [(f, float(c)) for f, c in zip(features, model.coefficients.toArray())]
    else:
        imp = model.featureImportances.toArray()
        rows = [(f, float(v)) for f, v in zip(features, imp)]
    return spark.createDataFrame(rows, "feature string, value double")
