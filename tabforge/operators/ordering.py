"""Sort, top-k and sampling operators.

A global sort is never an intermediate stage here: order is defined by an
explicit key and realised where it matters (the sink, a top-k, or the
ordinal helper).  Top-k is ``orderBy + limit``, which Spark plans as a
TakeOrderedAndProject (per-partition top-k, one small merge).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import sample_rows


def sort_by_date(df: DataFrame, date_col: str, tie_key: Sequence[str] = ()) -> DataFrame:
    """O1: rows ordered by ``(date, tie_key)`` within each partition, and
    range-partitioned so the partitions are in order too - use it right
    before a sink.  A hash of the row comes last, so a date that holds a large
    share of the rows is split without a tie key, too.  A missing column
    leaves the frame unchanged."""
    if date_col not in df.columns or df.schema[date_col].dataType.typeName() not in (
            "date", "timestamp", "timestamp_ntz"):
        return df
    keys = [F.col(date_col), *[F.col(c) for c in tie_key], F.xxhash64(*df.columns)]
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def top_k(df: DataFrame, value: str, k: int, tie: Sequence[str] = ()) -> DataFrame:
    """O2: ``k`` rows with the largest ``value`` (ties by ``tie`` ascending)."""
    return df.orderBy(F.col(value).desc(), *[F.col(c).asc() for c in tie]).limit(int(k))


def seeded_sample(df: DataFrame, n: int, seed: int, key: Sequence[str] | None = None,
                  only_if_larger: bool = True) -> DataFrame:
    """O3: ``n`` rows chosen by a seeded hash (deterministic, independent of
    partitioning); with ``only_if_larger`` the whole frame is kept when it
    has at most ``n`` rows (the limit is then a no-op)."""
    return sample_rows(df, n, seed, list(key) if key else None)


def rank_by_mean_abs(long: DataFrame, group: str = "feature", value: str = "phi",
                     k: int | None = None) -> DataFrame:
    """Groups ranked by mean absolute ``value`` (descending)."""
    g = long.groupBy(group).agg(F.avg(F.abs(F.col(value))).alias("mean_abs"))
    out = g.orderBy(F.col("mean_abs").desc(), F.col(group).asc())
    return out.limit(int(k)) if k else out
