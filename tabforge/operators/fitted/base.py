"""Shared shape of fitted operators.

``fit(df) -> Model`` runs aggregations only; the model is a small frozen
dataclass whose numbers enter ``transform`` as literals (Catalyst folds
them), and it round-trips through JSON.
"""

from __future__ import annotations

import dataclasses
import json
import math

from pyspark.sql import DataFrame, SparkSession


def _clean(v):
    if isinstance(v, float) and (math.isnan(v) or math.isinf(v)):
        return None
    if isinstance(v, dict):
        return {str(k): _clean(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [_clean(x) for x in v]
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


class JsonState:
    """Mixin: ``to_json`` / ``from_json`` for dataclass models."""

    def to_json(self) -> str:
        d = {f.name: _clean(getattr(self, f.name)) for f in dataclasses.fields(self)}
        return json.dumps({"type": type(self).__name__, "state": d}, sort_keys=True)

    @classmethod
    def from_json(cls, text: str):
        d = json.loads(text)
        if d.get("type") != cls.__name__:
            raise ValueError(f"state is a {d.get('type')}, not a {cls.__name__}")
        state = d["state"]
        for f in dataclasses.fields(cls):
            if f.name in state and isinstance(state[f.name], list) and f.type in (
                    "tuple", "tuple[str, ...]"):
                state[f.name] = tuple(state[f.name])
        return cls(**state)

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the state to a folder of any file system that Spark reads."""
        spark.createDataFrame([(self.to_json(),)], "value string").coalesce(1).write.text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str):
        return cls.from_json(spark.read.text(path).first()["value"])


def present(df: DataFrame, cols) -> list[str]:
    """Columns of ``cols`` that exist in ``df`` (absent ones are skipped)."""
    have = set(df.columns)
    return [c for c in cols if c in have]
