"""Union and de-duplication.

"Keep first/last by an order" is written as a partial aggregation
(``min``/``max`` of a struct whose leading fields are the order), not as a
``row_number`` window: the aggregation combines rows map-side, so a key
that holds a third of all rows never lands whole in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_all(*dfs: DataFrame) -> DataFrame:
    """By name; the time-order key must be among the columns."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


def drop_duplicates(df: DataFrame, subset: Sequence[str] | None = None,
                    keep: str | bool = "first",
                    order_by: Sequence[str] | None = None) -> DataFrame:
    """Pandas ``drop_duplicates`` semantics with an explicit order.

    * ``subset=None``: whole rows; keep first/last are the same row.
    * ``keep="first"|"last"``: per ``subset`` key keep the row that is first
      (last) by ``order_by``, ties broken by the remaining columns.
    * ``keep=False``: drop every row whose key occurs more than once.

    NULLs in the key compare equal, as in pandas.
    """
    cols = df.columns
    key = list(subset) if subset is not None else list(cols)
    rest = [c for c in cols if c not in key]
    if keep is False or keep == "none":
        agg = [F.count(F.lit(1)).alias("__n")]
        if rest:
            agg.append(F.first(F.struct(*rest)).alias("__r"))
        g = df.groupBy(*key).agg(*agg).where(F.col("__n") == 1)
        return g.select(*key, *[F.col(f"__r.{c}") for c in rest]).select(*cols) if rest \
            else g.select(*cols)
    if not rest:
        return df.dropDuplicates()
    order = [c for c in (order_by or []) if c in rest]
    fields = order + [c for c in rest if c not in order]
    pick = F.min if keep == "first" else F.max
    if keep not in ("first", "last"):
        raise ValueError(f"keep must be 'first', 'last' or False, got {keep!r}")
    g = df.groupBy(*key).agg(pick(F.struct(*fields)).alias("__r"))
    return g.select(*key, *[F.col(f"__r.{c}").alias(c) for c in fields]).select(*cols)


def dedup_business_key(df: DataFrame, key: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Keep the first row per business key in ``order_by`` order."""
    return drop_duplicates(df, key, "first", order_by)


def duplicate_stats(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """U4: ``n_rows``, ``n_duplicates`` (rows beyond the first of their key),
    ``n_in_duplicate_groups`` (pandas ``duplicated(keep=False).sum()``) and
    ``duplicate_rate`` in one two-level aggregation."""
    key = list(subset) if subset is not None else df.columns
    g = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(
        F.sum("n").cast("long").alias("n_rows"),
        F.sum(F.col("n") - 1).cast("long").alias("n_duplicates"),
        F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).cast("long").alias(
            "n_in_duplicate_groups"),
    ).withColumn("duplicate_rate",
                 F.round(F.col("n_duplicates") / F.greatest(F.col("n_rows"), F.lit(1)), 8))
