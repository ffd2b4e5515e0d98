"""Order-dependent primitives without a single-partition window.

``Window.orderBy`` with no ``partitionBy`` moves every row into one task.
These helpers give the same answers with range partitioning instead:

* :func:`with_global_ordinal` - 0-based position of every row in a total
  order.  Range-partition + sort, per-partition counts (P numbers to the
  driver), then ``offset[pid] + local index`` computed JVM-side and written.
* :func:`weighted_prefix` - running sum of a weight column in order, for
  small aggregated tables (e.g. per-date counts).
* :func:`exact_quantiles` - pandas/NumPy ``linear`` quantiles, per column and
  optionally per group, without holding a group's values in one buffer:
  only the few target positions are looked up.
* :func:`modes` - most frequent value (smallest on ties) via two partial
  aggregations, so a hot value is combined map-side.

A row id (``monotonically_increasing_id`` taken at the scan) is the last
sort key everywhere: it makes the order total and lets the range
partitioner split a value that holds a large share of all rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint, shuffle_partitions, write_table

_TB = "__tf_rowid"
ROWS_PER_PARTITION = 1_000_000


def _ordered_checkpoint(df: DataFrame, order: Sequence[Column | str],
                        num_partitions: int | None) -> DataFrame:
    n = num_partitions or shuffle_partitions(df.sparkSession)
    # The row id is assigned once and pinned by a reliable checkpoint: if an
    # executor is lost and a map task re-runs, a recomputed id could send a
    # row to a different range partition; read from the checkpoint it
    # cannot.  This also lets the range partitioner's sampling pass and the
    # shuffle read the (narrow) input without re-running the upstream plan.
    keyed = checkpoint(df.withColumn(_TB, F.monotonically_increasing_id()))
    keys = [*order, F.col(_TB)]
    ordered = keyed.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return checkpoint(ordered)


def _partition_offsets(ordered: DataFrame, weight: Column | None = None,
                       with_total: bool = False):
    w = F.count(F.lit(1)) if weight is None else F.sum(weight)
    rows = (ordered.groupBy(F.spark_partition_id().alias("p"))
            .agg(w.alias("w")).collect())
    per = {r["p"]: int(r["w"] or 0) for r in rows}
    offsets, acc = [], 0
    for p in range(ordered.rdd.getNumPartitions()):
        offsets.append(acc)
        acc += per.get(p, 0)
    return (offsets, acc) if with_total else offsets


def with_global_ordinal(df: DataFrame, order: Sequence[Column | str],
                        ordinal_col: str = "ordinal",
                        num_partitions: int | None = None,
                        return_count: bool = False):
    """Add a 0-based ``ordinal`` following ``order`` (ascending, nulls first).

    Ties in ``order`` are broken by scan position, so pass a unique key in
    ``order`` when the result must not depend on file layout.  With
    ``return_count`` the row count (known from the partition counts) is
    returned as well: ``(frame, n)``.

    The frame is a Parquet table with a range of ordinals per file, so a
    filter on the ordinal prunes files and row groups.  Row ids are pinned by
    a first table (see :func:`_ordered_checkpoint`); the sorted partitions,
    at most about ``ROWS_PER_PARTITION`` rows each whatever the session's
    number, are held on local disk between their count and the write (a lost
    one is sorted again from the same shuffle)."""
    keyed = write_table(df.withColumn(_TB, F.monotonically_increasing_id()), "ordinal_rows")
    n = num_partitions or max(shuffle_partitions(df.sparkSession), math.ceil(keyed.count() / ROWS_PER_PARTITION))
    keys = [*order, F.col(_TB)]
    ordered = keyed.repartitionByRange(n, *keys).sortWithinPartitions(*keys).persist(StorageLevel.DISK_ONLY)
    offsets, total = _partition_offsets(ordered, with_total=True)
    pid = F.spark_partition_id()
    local = F.monotonically_increasing_id() - F.shiftleft(pid.cast("long"), 33)
    base = F.element_at(F.array(*[F.lit(int(o)) for o in offsets]), pid + 1)
    out = write_table(ordered.withColumn(ordinal_col, base + local).drop(_TB), "ordered")
    ordered.unpersist()
    return (out, total) if return_count else out


def weighted_prefix(df: DataFrame, order: Sequence[str], weight_col: str,
                    out_col: str = "before",
                    num_partitions: int | None = None,
                    return_total: bool = False):
    """Add ``before`` = sum of ``weight_col`` over all rows strictly earlier.

    Meant for aggregated tables (one row per date, per group...): the work
    is a range shuffle plus one vectorised pass per partition.  With
    ``return_total`` the grand total comes back too: ``(frame, total)``.
    """
    ordered = _ordered_checkpoint(df, [F.col(c) for c in order], num_partitions)
    offsets, total = _partition_offsets(ordered, F.col(weight_col), with_total=True)
    fields = [f for f in ordered.schema.fields if f.name != _TB]
    out_schema = T.StructType(fields + [T.StructField(out_col, T.LongType(), False)])
    names = [f.name for f in fields]
    # the partition's offset travels with its rows: a task id would be
    # another one below a union
    based = ordered.withColumn(_TB, F.element_at(
        F.array(*[F.lit(int(o)) for o in offsets]), F.spark_partition_id() + 1))

    def run(batches):
        acc = None
        for pdf in batches:
            if len(pdf) and acc is None:
                acc = int(pdf[_TB].iloc[0])
            w = pdf[weight_col].fillna(0).astype("int64")
            csum = w.cumsum()
            pdf = pdf[names].copy()
            pdf[out_col] = (csum - w + (acc or 0)).astype("int64")
            if len(w):
                acc += int(w.sum())
            yield pdf

    out = based.mapInPandas(run, out_schema)
    return (out, total) if return_total else out


def long_values(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Unpivot numeric ``columns`` to ``(by..., column, value double)``,
    dropping NULL and NaN (pandas skips both in statistics)."""
    cast = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns])
    long = cast.unpivot(list(by), list(columns), "column", "value")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value"))


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                    by: Sequence[str] = ()) -> DataFrame:
    """Exact linear-interpolation quantiles.

    Returns ``(by..., column, prob, value)``.  Position ``h = (n-1)*p``;
    value ``v[floor h] + (v[ceil h] - v[floor h]) * (h - floor h)``, the
    same rule as pandas ``quantile`` and DuckDB ``quantile_cont``.

    Equal values of a group are counted first (a partial aggregation, so a
    hot value folds on the map side and every row is unique).  The distinct
    values are range partitioned by (column, group, value) and written once;
    a running count inside each (partition, group), plus what the group has
    in earlier partitions, gives every value the interval of positions that
    it holds.  Values whose interval holds a target position are all that is
    left.  One way for any number of groups; nothing is collected.
    """
    by = list(by)
    key = ["column", *by]
    counts = long_values(df, columns, by).groupBy(*key, "value").agg(F.count(F.lit(1)).alias("_c"))
    n = shuffle_partitions(df.sparkSession)
    placed = write_table(
        counts.repartitionByRange(n, *key, "value").withColumn("_part", F.spark_partition_id()), "quantile_values")
    inside = Window.partitionBy("_part", *key).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    running = placed.withColumn("_end", F.sum("_c").over(inside))
    parts = placed.groupBy("_part", *key).agg(F.sum("_c").alias("_held"))
    earlier = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select(
        F.col("_part").alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)],
        F.coalesce(F.sum("_held").over(earlier), F.lit(0)).alias("_base"),
        F.sum("_held").over(Window.partitionBy(*key)).alias("_n"))
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    spans = running.join(base, same).select(
        *key, "value", (F.col("_base") + F.col("_end") - F.col("_c")).alias("_first"),
        (F.col("_base") + F.col("_end")).alias("_stop"), "_n")
    targets = []
    for p in probs:
        h = (F.col("_n") - 1).cast("double") * F.lit(float(p))
        targets.append(F.struct(F.lit(float(p)).alias("prob"), F.floor(h).alias("lo"), F.ceil(h).alias("hi"),
                                (h - F.floor(h)).alias("frac")))
    holds = lambda x: (x >= F.col("_first")) & (x < F.col("_stop"))
    hit = (spans.withColumn("t", F.explode(F.filter(F.array(*targets), lambda t: holds(t["lo"]) | holds(t["hi"]))))
           .select(*key, "t.*", F.when(holds(F.col("t.lo")), F.col("value")).alias("_vlo"),
                   F.when(holds(F.col("t.hi")), F.col("value")).alias("_vhi")))
    ends = hit.groupBy(*key, "prob").agg(F.max("_vlo").alias("_vlo"), F.max("_vhi").alias("_vhi"),
                                         F.max("frac").alias("frac"))
    value = F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("frac")
    return ends.select(*by, "column", "prob", value.alias("value"))


def quantile_map(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict:
    """``{column: {prob: value}}`` for ungrouped quantiles (small result)."""
    res: dict = {c: {} for c in columns}
    for r in exact_quantiles(df, columns, probs).collect():
        res[r["column"]][float(r["prob"])] = r["value"]
    return res


def modes(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Most frequent non-null value of ``column`` per ``by`` group; the
    smallest value wins a tie (pandas ``mode()[0]``).  Returns
    ``(by..., mode, mode_count)``."""
    by = list(by)
    counts = (df.where(F.col(column).isNotNull())
              .groupBy(*by, column).agg(F.count(F.lit(1)).alias("_c")))
    best = F.min(F.struct((-F.col("_c")).alias("neg"), F.col(column).alias("v")))
    return (counts.groupBy(*by).agg(best.alias("_b"))
            .select(*by, F.col("_b.v").alias("mode"), (-F.col("_b.neg")).alias("mode_count")))


def mode_values(df: DataFrame, columns: Sequence[str]) -> dict:
    """``{column: mode}`` for several columns.  All text columns share one
    two-level aggregation over the long ``(column, value)`` form; other
    types keep their own ordering and get one job each."""
    out: dict = {c: None for c in columns}
    texts = [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]
    if texts:
        long = df.select(*texts).unpivot([], texts, "column", "value")
        for r in modes(long, "value", ["column"]).collect():
            out[r["column"]] = r["mode"]
    for c in columns:
        if c not in texts:
            rows = modes(df, c).collect()
            out[c] = rows[0]["mode"] if rows else None
    return out
