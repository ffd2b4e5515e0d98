"""Helpers shared by the operators of this subpackage: table access,
written scratch tables, batch-wise Arrow maps."""

from __future__ import annotations

import gc
import uuid
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


class Scratch:
    """Tables written below the shared checkpoint folder.

    ``write`` cuts lineage (the table survives lost executors); ``drop``
    deletes a table whose readers have all been written themselves;
    ``release`` lets Spark's cleaner remove the shuffle files of plans that
    nobody refers to any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/scratch/{name}_{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(self.path(name))
        return self.open(name, df)

    def open(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def release(self) -> None:
        gc.collect()
        self.spark._jvm.System.gc()


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lower-cased and nothing else; a text of one-byte
    characters takes the fast way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def ranked(df: DataFrame, order: list[Column], scratch: Scratch, name: str, group: str | None = None) -> DataFrame:
    """``df`` with at (position from 0 in ``order``, within each value of
    ``group``, which never is null and leads ``order``) and m (rows of the
    group).

    One range sort, written once; positions come from the counts per (sort
    partition, group), a table of partitions plus groups, so a group of any
    size is spread over the partitions.  Rows that tie in all of ``order``
    share its places in any way."""
    at, part = F.col("__at"), F.shiftright("__at", 33)
    placed = scratch.write(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), name)
    key = F.lit("") if group is None else F.col(group)
    held = placed.groupBy(part.alias("__part"), key.alias("__group")).agg(
        F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy("__group").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = held.select("__part", "__group", (F.col("__first") - F.coalesce(F.sum("__n").over(earlier), F.lit(0))).alias("__shift"),
                       F.sum("__n").over(Window.partitionBy("__group")).alias("m"))
    return (placed.join(base, (part == F.col("__part")) & (key == F.col("__group")))
            .withColumn("at", at - F.col("__shift")).drop("__at", "__part", "__group", "__shift"))


def filter_rows(df: DataFrame, text_col: str, make_keep: Callable[[], Callable[[str], bool]]) -> DataFrame:
    """Rows of ``df``, all columns, whose text passes a per-text predicate;
    one pass, no shuffle.  ``make_keep`` is called once per task.  A null
    text is passed on as the empty text."""
    def run(batches):
        keep = make_keep()
        for b in batches:
            mask = [keep(t or "") for t in b.column(b.schema.get_field_index(text_col)).to_pylist()]
            yield b.filter(pa.array(mask, pa.bool_()))
    return df.mapInArrow(run, df.schema)


def pack_counts(counts, chunks: int) -> pa.RecordBatch | None:
    """A task's count array as rows (chunk, counts): the non-zero ones of
    ``chunks`` equal parts, compressed."""
    parts = counts.reshape(chunks, -1)
    some = [i for i in range(chunks) if parts[i].any()]
    if not some:
        return None
    return pa.RecordBatch.from_arrays(
        [pa.array(some, pa.int32()),
         pa.array([zlib.compress(parts[i].astype(np.int64).tobytes(), 1) for i in some], pa.binary())],
        names=["chunk", "counts"])


def sum_counts(parts: DataFrame, chunks: int, size: int) -> np.ndarray:
    """Sum of the tasks' count arrays (rows chunk, counts of
    :func:`pack_counts`).  Rows of a chunk are added as they stream by, first
    within a task, then per chunk; the driver gets one array of ``size``."""
    def run(batches):
        acc: dict = {}
        for b in batches:
            for c, z in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v = np.frombuffer(zlib.decompress(z), np.int64)
                acc[c] = acc[c] + v if c in acc else v
        if acc:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(acc), pa.int32()),
                 pa.array([zlib.compress(v.tobytes(), 1) for v in acc.values()], pa.binary())],
                names=["chunk", "counts"])
    local = parts.select("chunk", "counts").mapInArrow(run, "chunk int, counts binary")
    total = local.repartition(chunks, "chunk").mapInArrow(run, "chunk int, counts binary")
    out = np.zeros((chunks, size // chunks), np.int64)
    for r in total.collect():
        out[r["chunk"]] += np.frombuffer(zlib.decompress(bytes(r["counts"])), np.int64)
    return out.reshape(-1)
