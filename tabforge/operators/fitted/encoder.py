"""Categorical encoding.

* one-hot: sorted categories, columns ``<col>_<value>``, unseen -> all 0;
* mapped ordinal: explicit order, an unseen value is an error;
* auto ordinal: sorted categories -> 0..k-1, unseen -> -1, NULL stays NULL.

Output layout: one-hot columns, mapped ordinals, auto ordinals, then the
other columns in input order; numeric columns come out as double.

Auto ordinals of any size go one way: the distinct values get their codes from
the global ordinal helper and are written as a code table, in a folder of its
own for every fit; transform is an equi-join with that table per column (Spark
broadcasts a small one).  One-hot columns have one output column per value,
up to ``ONEHOT_LIMIT`` values; a wider column is an error or, on request, one
column of the sparse form (:func:`onehot_sparse`) from a code table, whatever
its width.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...session import ensure_checkpoint_dir
from ..ordinal import with_global_ordinal
from .base import JsonState

ONEHOT_LIMIT = 1000         # values of a column with one output column each

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
            T.DecimalType, T.BooleanType)


@dataclass(frozen=True)
class EncoderModel(JsonState):
    onehot: dict = field(default_factory=dict)     # col -> sorted categories
    mapped: dict = field(default_factory=dict)     # col -> ordered categories
    auto_tables: dict = field(default_factory=dict)  # col -> folder of its code table
    auto_sizes: dict = field(default_factory=dict)   # col -> number of codes
    input_columns: list = field(default_factory=list)
    strict: bool = True
    sparse: list = field(default_factory=list)       # wide one-hot columns, by their code tables
    auto_first: dict = field(default_factory=dict)   # col -> place of its first value in its table

    def codes(self, spark, c: str) -> DataFrame:
        """(value, code) of an auto ordinal."""
        return spark.read.parquet(self.auto_tables[c]).select(
            "value", (F.col("at") - F.lit(int(self.auto_first.get(c, 0)))).alias("code"))

    def output_columns(self) -> list[str]:
        enc = set(self.onehot) | set(self.mapped) | set(self.auto_tables)
        out = [f"{c}_{v}" for c, cats in self.onehot.items() for v in cats]
        out += [f"{c}_onehot" for c in self.sparse]
        out += list(self.mapped) + [c for c in self.auto_tables if c not in self.sparse]
        return out + [c for c in self.input_columns if c not in enc]

    def transform(self, df: DataFrame) -> DataFrame:
        missing = [c for c in [*self.onehot, *self.mapped, *self.auto_tables] if c not in df.columns]
        if missing:
            raise ValueError(f"encoding columns missing from input: {missing}")
        spark = df.sparkSession
        src = df
        for c in self.auto_tables:
            codes = self.codes(spark, c).select(F.col("value").alias(c), F.col("code").alias(f"__code_{c}"))
            src = src.join(codes, c, "left")
        exprs = []
        for c, cats in self.onehot.items():
            for v in cats:
                exprs.append(F.coalesce((F.col(c) == F.lit(v)).cast("double"), F.lit(0.0))
                             .alias(f"{c}_{v}"))
        for c in self.sparse:
            exprs.append(_sparse(F.col(f"__code_{c}"), int(self.auto_sizes[c])).alias(f"{c}_onehot"))
        for c, cats in self.mapped.items():
            e = None
            for i, v in enumerate(cats):
                e = F.when(F.col(c) == F.lit(v), F.lit(float(i))) if e is None \
                    else e.when(F.col(c) == F.lit(v), F.lit(float(i)))
            if self.strict:
                e = e.when(F.col(c).isNull(), F.lit(None).cast("double")).otherwise(
                    F.raise_error(F.concat(F.lit(f"unknown category in {c}: "),
                                           F.col(c).cast("string"))).cast("double"))
            exprs.append(e.alias(c))
        for c in self.auto_tables:
            if c in self.sparse:
                continue
            exprs.append(F.when(F.col(c).isNull(), F.lit(None).cast("double"))
                         .otherwise(F.coalesce(F.col(f"__code_{c}").cast("double"),
                                               F.lit(-1.0))).alias(c))
        enc = set(self.onehot) | set(self.mapped) | set(self.auto_tables)
        for c in df.columns:
            if c in enc:
                continue
            if isinstance(df.schema[c].dataType, _NUMERIC):
                exprs.append(F.col(c).cast("double").alias(c))
            else:
                exprs.append(F.col(c))
        return src.select(*exprs)


def _code_tables(df: DataFrame, cols: list, table_dir: str) -> tuple[dict, dict, dict]:
    """Write (value, at) of each column to a folder of its own, with ``at``
    the position in value order over all columns of one type, which share one
    sort and one write; a code is the distance from the column's first."""
    paths, sizes, firsts = {}, {}, {}
    by_type: dict = {}
    for c in cols:
        by_type.setdefault(df.schema[c].dataType.simpleString(), []).append(c)
    for k, group in enumerate(by_type.values()):
        number = {f"c{i:04d}": c for i, c in enumerate(group)}
        values = (df.select(*[F.col(c).alias(i) for i, c in number.items()]).unpivot([], list(number), "col", "value")
                  .where(F.col("value").isNotNull()).distinct())
        path = f"{table_dir.rstrip('/')}/encoder_{uuid.uuid4().hex}/{k}"
        with_global_ordinal(values, ["col", "value"], "at").select("col", "value", "at").write.partitionBy("col").parquet(path)
        table = df.sparkSession.read.schema(f"value {df.schema[group[0]].dataType.simpleString()}, at long, col string").parquet(path)
        spans = {r["col"]: r for r in table.groupBy("col").agg(
            F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).collect()}
        for i, c in number.items():
            span = spans.get(i)
            sizes[c], firsts[c] = (int(span["n"]), int(span["first"])) if span else (0, 0)
            paths[c] = f"{path}/col={i}"
            if not span:        # no value: an empty table
                table.where(F.lit(False)).select("value", "at").write.parquet(paths[c])
    return paths, sizes, firsts


def fit_encoder(df: DataFrame, onehot_cols=(), ordinal_cols=(), ordinal_mapping=None,
                table_dir: str | None = None, strict: bool = True, wide: str = "error",
                onehot_limit: int = ONEHOT_LIMIT) -> EncoderModel:
    """A one-hot column with over ``onehot_limit`` values is an error, or with
    ``wide="sparse"`` a code table and a sparse output column."""
    if wide not in ("error", "sparse"):
        raise ValueError(f"wide must be error or sparse, got {wide!r}")
    ordinal_mapping = ordinal_mapping or {}
    need = list(onehot_cols) + list(ordinal_cols)
    missing = [c for c in need if c not in df.columns]
    if missing:
        raise ValueError(f"encoding columns not in the DataFrame: {missing}")
    onehot, sparse = {}, []
    for c in onehot_cols:
        # at most one value more than the limit reaches the driver
        values = df.select(c).where(F.col(c).isNotNull()).distinct().limit(onehot_limit + 1).collect()
        if len(values) <= onehot_limit:
            onehot[c] = sorted(r[0] for r in values)
        elif wide == "sparse":
            sparse.append(c)
        else:
            raise ValueError(f"one-hot column {c!r} has over {onehot_limit} values; use wide='sparse'")
    mapped = {c: list(ordinal_mapping[c]) for c in ordinal_cols if c in ordinal_mapping}
    auto = [c for c in ordinal_cols if c not in ordinal_mapping] + sparse
    paths, sizes, first = _code_tables(df, auto, table_dir or ensure_checkpoint_dir(df.sparkSession)) if auto else ({}, {}, {})
    return EncoderModel(onehot, mapped, paths, sizes, list(df.columns), strict, sparse, first)


def _sparse(code, size: int):
    """Struct of the width, the indices and the values: one of each, none for
    an unseen value or NULL."""
    hit = code.isNotNull()
    return F.struct(
        F.lit(size).alias("size"),
        F.when(hit, F.array(code.cast("int"))).otherwise(F.array().cast("array<int>")).alias("indices"),
        F.when(hit, F.array(F.lit(1.0))).otherwise(F.array().cast("array<double>")).alias("values"))


def onehot_sparse(df: DataFrame, column: str, model: EncoderModel, out: str | None = None) -> DataFrame:
    """Adds ``out``: the sparse one-hot form of ``column``, a struct of the
    width, the indices and the values (one of each, none for an unseen value
    or NULL), from the column's fitted code table."""
    out = out or f"{column}_onehot"
    codes = model.codes(df.sparkSession, column).select(F.col("value").alias(column), F.col("code").alias("__code"))
    return df.join(codes, column, "left").select(
        *df.columns, _sparse(F.col("__code"), int(model.auto_sizes[column])).alias(out))
