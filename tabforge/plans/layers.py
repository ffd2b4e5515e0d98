"""Layer jobs (L1-L4): bronze gate, silver cleaning, gold features.

Each layer is one lazy Catalyst plan per split; the only actions are the
statistics a step needs (type narrowing, the fits, the gate aggregation)
and the final write.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import date_features
from ..functions.numeric import cyclical
from ..functions.strings import interaction
from ..operators.dedup import dedup_business_key, drop_duplicates
from ..operators.fitted.encoder import EncoderModel, fit_encoder
from ..operators.fitted.iforest import IsolationForestModel
from ..operators.fitted.imputer import SimpleImputerModel, fit_simple_imputer
from ..operators.fitted.mice import MICEModel, fit_mice
from ..operators.fitted.outlier import OutlierModel, fit_outliers
from ..operators.fitted.power import PowerModel, fit_power
from ..operators.fitted.rare import RareGrouperModel, fit_rare_grouper
from ..operators.fitted.scaler import ScalerModel, fit_scaler
from ..operators.quality import rules as R
from ..operators.quality import suites
from ..operators.schema import (drop_columns, drop_missing_target, enforce_column_order,
                                optimize_data_types, rename_columns, sanitize_column_names,
                                standardize_column_names)
from ..functions.numeric import NUMERIC_OPS
from ..session import write_table
from ..sources.sinks import route_write
from . import config as C


# --- L1 bronze ---------------------------------------------------------------

def bronze_gate(raw: DataFrame, rules=None) -> tuple[DataFrame, bool]:
    """Validate the raw table; returns the rule table and the verdict."""
    res = R.run_rules(raw, rules or suites.bronze_suite())
    return res, R.gate_passed(res)


def run_bronze(raw: DataFrame, processed: str, quarantine: str, name: str,
               rules=None) -> str:
    res, ok = bronze_gate(raw, rules)
    return route_write(raw, ok, processed, quarantine, name, fmt="csv")


# --- L2 silver ---------------------------------------------------------------

def silver_transform(raw: DataFrame, key=suites.SILVER_KEY, keep_tie_key: bool = False,
                     tie_key=C.TIE_KEY, materialize: bool = True) -> DataFrame:
    """rename -> snake_case -> type narrowing (+date parse) -> business-key
    dedup (first by date, then the tie key) -> date features -> order.

    The silver table is a layer boundary: with ``materialize`` it is written
    once as Parquet in the shared checkpoint folder, so every later
    statistic and fit reads it (with column pruning) instead of re-running
    the joins and the dedup shuffle."""
    out = _silver_plan(raw, key, keep_tie_key, tie_key, materialize)
    return write_table(out, "silver") if materialize else out


def _silver_plan(raw, key, keep_tie_key, tie_key, materialize=False):
    df = rename_columns(raw, C.COLUMN_RENAME_MAPPING)
    df = standardize_column_names(df)
    if materialize:
        # the validated input is read twice (type statistics, then the
        # cleaning write): read it once from its source, keep it as Parquet
        df = write_table(df, "bronze_input")
    df, _ = optimize_data_types(df, date_cols=["date"])
    order = ["date", *[c for c in tie_key if c in df.columns]]
    df = dedup_business_key(df, key, order)
    df = df.withColumns(date_features("date"))
    extra = [c for c in df.columns if c not in suites.SILVER_ORDER]
    if not keep_tie_key:
        df = df.drop(*extra)
        return enforce_column_order(df, suites.SILVER_ORDER)
    return df.select(*suites.SILVER_ORDER, *extra)


def silver_gate(silver: DataFrame, types=None) -> tuple[DataFrame, bool]:
    res = R.run_rules(silver, suites.silver_suite(types=types or C.SILVER_TYPES))
    return res, R.gate_passed(res)


# --- L3 / L4 gold ------------------------------------------------------------

@dataclass
class GoldModel:
    """Everything fitted on the training split, applied to any split.  The
    steps run in the order of their fields; any of them but the imputer and
    the encoder may be absent."""
    is_tree_model: bool
    imputer: SimpleImputerModel
    encoder: EncoderModel
    mice: MICEModel | None = None
    rare: RareGrouperModel | None = None
    outliers: OutlierModel | IsolationForestModel | None = None
    power: PowerModel | None = None
    scaler: ScalerModel | None = None
    final_columns: list = field(default_factory=list)
    cyclical_map: dict = field(default_factory=dict)
    interactions: dict = field(default_factory=dict)
    numeric_interactions: dict = field(default_factory=dict)

    def steps(self) -> list[tuple[str, object]]:
        """(role, step) of the steps that the chain has, in order."""
        named = [(r, getattr(self, r)) for r in GOLD_ROLES]
        return [(r, s) for r, s in named if s is not None]

    def fill(self, df: DataFrame) -> DataFrame:
        df = self.imputer.transform(df)
        return df if self.mice is None else self.mice.transform(df)

    def encode(self, df: DataFrame, scoring: bool = False) -> DataFrame:
        """The steps up to encoding, of rows ready for them."""
        df = add_features(self.fill(df), self.cyclical_map, self.interactions, self.numeric_interactions)
        if self.rare is not None:
            df = self.rare.transform(df)
        if scoring:
            df = df.withColumn(C.TARGET, F.coalesce(F.col(C.TARGET).cast("double"), F.lit(0.0)))
        return self.encoder.transform(df)

    def scale(self, df: DataFrame, scoring: bool = False) -> DataFrame:
        """The steps of a non-tree model after encoding.  At scoring time no
        row is dropped: trimming is left out, clipping is not."""
        if self.is_tree_model:
            return df
        if self.outliers is not None and (not scoring or getattr(self.outliers, "handling", "trim") == "winsorize"):
            df = self.outliers.transform(df)
        for step in (self.power, self.scaler):
            df = df if step is None else step.transform(df)
        return df

    def transform(self, df: DataFrame, scoring: bool = False, prepared: bool = False) -> DataFrame:
        """Apply the fitted chain; ``prepared``: ``df`` is a :func:`gold_base`."""
        if scoring:
            df = drop_columns(df, C.GOLD_DROP_COLS)
            if C.TARGET not in df.columns:
                df = df.withColumn(C.TARGET, F.lit(None).cast("double"))
        elif not prepared:
            df = _gold_rows(df)
        df = sanitize_column_names(self.scale(self.encode(df, scoring), scoring))
        return df.select(*[c for c in self.final_columns if c in df.columns]) \
            if self.final_columns else df


GOLD_ROLES = ("imputer", "mice", "rare", "encoder", "outliers", "power", "scaler")


def add_features(df: DataFrame, cyclical_map: dict, interactions: dict | None = None,
                 numeric_interactions: dict | None = None) -> DataFrame:
    """X2 cyclical (source dropped), X3 categorical and X4 numeric
    interactions; absent columns are skipped."""
    new = {}
    drop = []
    for c, period in cyclical_map.items():
        if c in df.columns:
            s, co = cyclical(c, period)
            new[f"{c}_sin"], new[f"{c}_cos"] = s, co
            drop.append(c)
    for name, cols in (interactions or {}).items():
        if all(c in df.columns for c in cols):
            new[name] = interaction(list(cols))
    for name, (a, b, op) in (numeric_interactions or {}).items():
        if a in df.columns and b in df.columns and op in NUMERIC_OPS:
            new[name] = NUMERIC_OPS[op](a, b)
    out = df.withColumns(new) if new else df
    return out.drop(*drop)


def _gold_rows(df: DataFrame) -> DataFrame:
    return drop_missing_target(drop_duplicates(drop_columns(df, C.GOLD_DROP_COLS)), C.TARGET)


def gold_base(train: DataFrame) -> DataFrame:
    """The training rows of a chain: without dropped columns, repeated rows
    and rows that lack the target.  Written once: every fit reads them, and
    several chains may share them."""
    return write_table(_gold_rows(train), "gold_train_base")


def fit_gold(train: DataFrame, is_tree_model: bool = True, imputation=None,
             cyclical_map=None, encoding_cols=None, encoding_mapping=None,
             rare_cols=None, rare_threshold: float = 0.01, outlier_cols=None,
             power_cols=None, power_strategy: str = "yeo-johnson", scaler_cols=None,
             scaler_strategy: str = "standard", interactions=None,
             numeric_interactions=None, mice_cols=None, mice_max_iter: int = 10, onehot_cols=(),
             onehot_wide: str = "error", outlier_detection: str = C.OUTLIER_DETECTION,
             outlier_handling: str = C.OUTLIER_HANDLING, outlier_options: dict | None = None,
             prepared: bool = False, fitted: GoldModel | None = None) -> GoldModel:
    """Fit the gold chain on the training split.  Order: drop -> dedup ->
    target -> impute [-> chained equations] -> features -> [rare] -> encode ->
    [outlier -> power -> scale]; the bracketed steps of a non-tree model are
    left out for a tree model.

    ``mice_cols``: filled by chained equations, not by the simple imputer;
    ``onehot_cols``: one-hot, not ordinal (``onehot_wide``: what to do with a
    wide one, see :func:`fit_encoder`); ``outlier_detection``: iqr, zscore or
    iforest, ``outlier_handling``: trim or winsorize, ``outlier_options``:
    further arguments of :func:`fit_outliers`.

    ``prepared``: ``train`` is a :func:`gold_base`.  ``fitted``: a chain of the
    same rows whose steps up to encoding are taken over, not fitted again; the
    arguments of these steps are then its own."""
    imputation = imputation or C.GOLD_IMPUTATION
    if mice_cols:
        keep = lambda v: {c: x for c, x in v.items() if c not in mice_cols} if isinstance(v, dict) else [
            c for c in v if c not in mice_cols]
        imputation = {k: keep(v) for k, v in imputation.items()}
    cyclical_map = C.CYCLICAL_FEATURES_MAP if cyclical_map is None else cyclical_map
    df = train if prepared else gold_base(train)
    if fitted is not None:
        model = replace(fitted, is_tree_model=is_tree_model, outliers=None, power=None, scaler=None)
        return _fit_scaling(model, model.encode(df), outlier_cols, outlier_detection, outlier_handling, outlier_options,
                            power_cols, power_strategy, scaler_cols, scaler_strategy)
    imp = fit_simple_imputer(df, imputation)
    df = imp.transform(df)
    mice = fit_mice(df, mice_cols, max_iter=mice_max_iter) if mice_cols else None
    df = df if mice is None else mice.transform(df)
    df = add_features(df, cyclical_map, interactions, numeric_interactions)
    rare = None
    if not is_tree_model and rare_cols:
        rare = fit_rare_grouper(df, rare_cols, rare_threshold)
        df = rare.transform(df)
    ordinal = [c for c in encoding_cols or C.ENCODING_ORDINAL_COLS if c not in onehot_cols]
    enc = fit_encoder(df, onehot_cols=onehot_cols, ordinal_cols=ordinal, wide=onehot_wide,
                      ordinal_mapping=C.ENCODING_MAPPING if encoding_mapping is None
                      else encoding_mapping)
    df = enc.transform(df)
    model = GoldModel(is_tree_model, imp, enc, mice, rare, cyclical_map=dict(cyclical_map),
                      interactions=dict(interactions or {}), numeric_interactions=dict(numeric_interactions or {}))
    return _fit_scaling(model, df, outlier_cols, outlier_detection, outlier_handling, outlier_options,
                        power_cols, power_strategy, scaler_cols, scaler_strategy)


def _fit_scaling(model: GoldModel, df: DataFrame, outlier_cols, outlier_detection, outlier_handling, outlier_options,
                 power_cols, power_strategy, scaler_cols, scaler_strategy) -> GoldModel:
    """The steps after encoding, fitted to the encoded rows."""
    if not model.is_tree_model:
        if outlier_cols:
            model.outliers = fit_outliers(df, outlier_cols, outlier_detection, outlier_handling, **(outlier_options or {}))
            df = model.outliers.transform(df)
        if power_cols:
            model.power = fit_power(df, power_cols, power_strategy)
            df = model.power.transform(df)
        if scaler_cols:
            model.scaler = fit_scaler(df, scaler_cols, scaler_strategy)
            df = model.scaler.transform(df)
    model.final_columns = list(sanitize_column_names(df).columns)
    return model


def gold_gate(gold: DataFrame, model: GoldModel, scaler_strategy: str = "") -> tuple[DataFrame, bool]:
    scaled = list(model.scaler.params) if model.scaler else []
    rules = suites.gold_suite(model.final_columns, C.TARGET, scaler_strategy,
                              model.is_tree_model, scaled)
    res = R.run_rules(gold, rules)
    return res, R.gate_passed(res)


def run_layer(df: DataFrame, gate_result: DataFrame, passed: bool, processed: str,
              quarantine: str, name: str) -> str:
    return route_write(df, passed, processed, quarantine, name)
