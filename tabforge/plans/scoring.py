"""Batch scoring.

``score(raw, bundle)`` takes raw booking rows of any count through the
same silver steps and fitted gold transforms as training, conforms the
columns to the model's contract, predicts with the MLlib model and undoes
any target transform.  Every step is a column expression or the model's
``transform``: it runs on any number of rows, batch or stream.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import date_features, parse_date
from ..operators.model.estimators import assemble
from ..operators.schema import drop_columns, rename_columns, sanitize_column_names, standardize_column_names
from . import config as C
from .layers import GoldModel, add_features


@dataclass
class ScoringBundle:
    gold: GoldModel
    model: object                # fitted MLlib model
    features: list
    keys: list

    def target_inverse(self, c):
        e = c
        if self.gold.scaler is not None and C.TARGET in self.gold.scaler.params:
            e = self.gold.scaler.inverse_column(e, C.TARGET)
        if self.gold.power is not None and C.TARGET in self.gold.power.columns:
            e = self.gold.power.inverse_expr(e, C.TARGET)
        return e


def silver_for_scoring(raw: DataFrame) -> DataFrame:
    """Row-wise silver steps (no dedup at scoring time: every request row
    keeps its prediction)."""
    df = standardize_column_names(rename_columns(raw, C.COLUMN_RENAME_MAPPING))
    if "date" in df.columns and dict(df.dtypes)["date"] == "string":
        df = df.withColumn("date", parse_date("date", "%Y-%m-%d"))
    return df.withColumns(date_features("date"))


def scoring_violations(silver: DataFrame, bundle: ScoringBundle) -> DataFrame:
    """Adds ``violations: array<string>``: what the bundle cannot score (a
    date that does not parse, a category that its mapping does not know, a
    missing value that its imputer does not fill)."""
    gm, checks = bundle.gold, []
    if "date" in silver.columns:
        checks.append(F.when(F.col("date").isNull(), F.lit("date:invalid")))
    for c, known in gm.encoder.mapped.items():
        if c in silver.columns:
            checks.append(F.when(F.col(c).isNotNull() & ~F.col(c).isin(list(known)), F.lit(f"{c}:not_allowed")))
            if gm.imputer.values.get(c) is None:
                checks.append(F.when(F.col(c).isNull(), F.lit(f"{c}:missing")))
    arr = F.filter(F.array(*checks), lambda x: x.isNotNull()) if checks else F.array().cast("array<string>")
    return silver.withColumn("violations", arr)


def score_with_rejects(raw: DataFrame, bundle: ScoringBundle, decimals: int = 2) -> tuple[DataFrame, DataFrame]:
    """(predictions, rejected rows with their violations): rows in = rows of
    both.  One bad row does not end a batch."""
    v = scoring_violations(silver_for_scoring(raw), bundle)
    good, bad = v.where(F.size("violations") == 0).drop("violations"), v.where(F.size("violations") > 0)
    return score_silver(good, bundle, decimals), bad


def score(raw: DataFrame, bundle: ScoringBundle, decimals: int = 2) -> DataFrame:
    """``keys..., predicted_price`` for every input row."""
    return score_silver(silver_for_scoring(raw), bundle, decimals)


def score_silver(s: DataFrame, bundle: ScoringBundle, decimals: int = 2) -> DataFrame:
    """Predictions of rows that went through the silver steps."""
    keys = [k for k in bundle.keys if k in s.columns]
    gm = bundle.gold
    # run the fitted chain with the keys renamed out of the drop list
    renamed = s.select(*[F.col(k).alias(f"key__{k}") for k in keys], *s.columns)
    if C.TARGET not in renamed.columns:
        renamed = renamed.withColumn(C.TARGET, F.lit(None).cast("double"))
    g = add_features(gm.fill(drop_columns(renamed, C.GOLD_DROP_COLS)), gm.cyclical_map, gm.interactions,
                     gm.numeric_interactions)
    if gm.rare is not None:
        g = gm.rare.transform(g)
    g = g.withColumn(C.TARGET, F.coalesce(F.col(C.TARGET).cast("double"), F.lit(0.0)))
    enc_in = g.select(*[c for c in gm.encoder.input_columns if c in g.columns],
                      *[f"key__{k}" for k in keys])
    g = sanitize_column_names(gm.scale(gm.encoder.transform(enc_in), scoring=True))
    feats = g.select(*[F.col(f"key__{k}").cast(s.schema[k].dataType).alias(k) for k in keys],
                     *[F.col(c) if c in g.columns else F.lit(0.0).alias(c)
                       for c in bundle.features])
    pred = bundle.model.transform(assemble(feats, bundle.features))
    out = bundle.target_inverse(F.col("prediction"))
    return pred.select(*keys, F.round(out, decimals).alias("predicted_price"))
