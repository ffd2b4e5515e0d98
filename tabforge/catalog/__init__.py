"""Query catalogue: every registered operator query with its SQL oracle."""

from . import tabular  # noqa: F401  (registers queries)
from .base import REGISTRY


def _load_all():
    from . import features, layers, modelling, temporal  # noqa: F401


def queries():
    _load_all()
    return {k: e.fn for k, e in REGISTRY.items()}


def oracle_sql():
    _load_all()
    return {k: e.sql for k, e in REGISTRY.items() if e.sql}
