"""String expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_text(c: str) -> Column:
    """Value as text, NULL written as ``nan`` (pandas ``astype(str)``)."""
    return F.coalesce(F.col(c).cast("string"), F.lit("nan"))


def interaction(cols: list[str], sep: str = "_") -> Column:
    """Join several columns' text with ``sep``.  Unlike ``concat_ws``
    alone, a NULL contributes ``nan`` instead of vanishing."""
    return F.concat_ws(sep, *[as_text(c) for c in cols])
