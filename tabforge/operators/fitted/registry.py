"""Registry of fitted steps (L3, L4).

Every kind of step has a name, a version of its state and, where it keeps
tables beside its state, the field that names their folders.  A gold chain and
a saved bundle are lists of registered steps, so an option of the chain is
saved and loaded without code of its own: registering its class is enough.

A step's files are copied below the bundle's folder when it is saved, and its
folders are made absolute again when it is loaded.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import SparkSession

from .encoder import EncoderModel
from .iforest import IsolationForestModel
from .imputer import SimpleImputerModel
from .mice import MICEModel
from .outlier import OutlierModel
from .power import PowerModel
from .rare import RareGrouperModel
from .scaler import ScalerModel


@dataclass(frozen=True)
class StepType:
    name: str
    version: int
    cls: type
    tables: str | None = None       # field: key -> folder of a Parquet table


STEP_TYPES = {t.name: t for t in (
    StepType("simple_imputer", 1, SimpleImputerModel),
    StepType("mice", 1, MICEModel),
    StepType("rare_grouper", 1, RareGrouperModel),
    StepType("encoder", 3, EncoderModel, "auto_tables"),
    StepType("outlier_bounds", 1, OutlierModel),
    StepType("isolation_forest", 1, IsolationForestModel),
    StepType("power", 1, PowerModel),
    StepType("scaler", 1, ScalerModel),
)}


def type_of(model) -> StepType:
    for t in STEP_TYPES.values():
        if type(model) is t.cls:
            return t
    raise ValueError(f"{type(model).__name__} is not a registered step")


def dump_step(spark: SparkSession, role: str, model, path: str) -> dict:
    """Copy the step's tables below ``path/<role>`` and describe the step."""
    kind = type_of(model)
    if kind.tables:
        moved = {}
        for i, (key, old) in enumerate(getattr(model, kind.tables).items()):
            moved[key] = f"{role}/{i}"
            spark.read.parquet(old).write.parquet(f"{path}/{moved[key]}")
        model = replace(model, **{kind.tables: moved})
    return {"role": role, "type": kind.name, "version": kind.version, "state": model.to_json()}


def load_step(entry: dict, path: str):
    """(role, model) of a described step whose tables lie below ``path``."""
    kind = STEP_TYPES.get(entry["type"])
    if kind is None:
        raise ValueError(f"unknown step type {entry['type']!r}")
    if entry["version"] != kind.version:
        raise ValueError(f"step {kind.name} has version {entry['version']}, this library reads {kind.version}")
    model = kind.cls.from_json(entry["state"])
    if kind.tables:
        model = replace(model, **{kind.tables: {k: f"{path}/{v}" for k, v in getattr(model, kind.tables).items()}})
    return entry["role"], model
