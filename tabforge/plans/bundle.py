"""Saving and loading a scoring bundle.

A bundle folder lies on any file system that Spark writes to, so training and
scoring can be two jobs on two clusters:

    <path>/state   one JSON line: the gold chain's steps (role, type, version
                   and state of each), feature and key names
    <path>/steps   tables that steps keep beside their state (code tables)
    <path>/model   the MLlib model

Steps are those of :mod:`..operators.fitted.registry`; a step that the chain
does not have is left out and comes back as None.
"""

from __future__ import annotations

import json
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import SparkSession

from ..operators.fitted.registry import dump_step, load_step
from .layers import GoldModel
from .scoring import ScoringBundle

PLAIN = ("is_tree_model", "final_columns", "cyclical_map", "interactions", "numeric_interactions")


def save_bundle(spark: SparkSession, bundle: ScoringBundle, path: str) -> None:
    """Write the bundle below ``path``, which must not exist yet."""
    path, gold = path.rstrip("/"), bundle.gold
    state = {"steps": [dump_step(spark, role, step, f"{path}/steps") for role, step in gold.steps()],
             "plain": {k: getattr(gold, k) for k in PLAIN},
             "features": list(bundle.features), "keys": list(bundle.keys)}
    bundle.model.write().save(f"{path}/model")
    # last: a folder with a state is a whole bundle
    spark.createDataFrame([(json.dumps(state, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/state")


def load_bundle(spark: SparkSession, path: str) -> ScoringBundle:
    path = path.rstrip("/")
    state = json.loads(spark.read.text(f"{path}/state").first()["value"])
    gold = GoldModel(**dict(load_step(e, f"{path}/steps") for e in state["steps"]), **state["plain"])
    model = DefaultParamsReader.loadParamsInstance(f"{path}/model", spark)
    return ScoringBundle(gold, model, state["features"], state["keys"])
