"""Streaming scoring (L5 on Structured Streaming) and the contract check
(P13) on a stream.

Scoring is stateless, so the stream is a plain ``readStream -> score ->
writeStream``: no watermark, no state store.  ``foreachBatch`` writes each
micro-batch to two sinks, scored and rejected rows, under the batch id's own
folders, and then a commit marker.  A replayed batch overwrites its folders;
:func:`read_scored` reads batches with a marker only, so a batch is there
whole or not at all, and no row is lost or repeated.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.schema import Contract, contract_violations, split_by_contract
from ..plans.scoring import ScoringBundle, score_with_rejects


STAGED_ROWS = 500_000
TRIGGERS = 4                # micro-batches that a staged folder is read in, at most


def stage_files(df: DataFrame, path: str) -> str:
    """Write rows as the files of a stream, without a shuffle: a task's rows
    make files of at most ``STAGED_ROWS``.  Where that makes fewer than four
    files, the few rows are dealt into four.  Returns the folder."""
    df.write.option("maxRecordsPerFile", STAGED_ROWS).parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    if len(staged.inputFiles()) >= 4:
        return path
    staged.repartition(4).write.parquet(f"{path}_dealt")
    return f"{path}_dealt"


def files_per_trigger(spark: SparkSession, source_dir: str, least: int) -> int:
    """How many files of a staged folder a micro-batch takes: ``least``, or
    more where that would make over ``TRIGGERS`` batches, each of which has
    its own jobs and commits however many files it holds."""
    return max(least, math.ceil(len(spark.read.parquet(source_dir).inputFiles()) / TRIGGERS))


def score_stream(spark: SparkSession, source_dir: str, bundle: ScoringBundle, sink_dir: str,
                 checkpoint_dir: str, contract: Contract | None = None,
                 max_files_per_trigger: int | None = None, decimals: int = 2) -> None:
    """Score every file under ``source_dir`` (Parquet, schema taken from
    the folder) into ``sink_dir``; runs to completion (``availableNow``).
    Rows that the bundle cannot score, and with a contract those that break
    it, go to ``<sink_dir>_rejected`` with their violations, in the same
    micro-batch: rows in = scored + rejected."""
    schema = spark.read.parquet(source_dir).schema
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    sink = sink_dir.rstrip("/")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        rejected = None
        if contract is not None:
            batch, rejected = split_by_contract(batch, contract)
        good, bad = score_with_rejects(batch, bundle, decimals)
        if rejected is not None:
            bad = bad.unionByName(rejected, allowMissingColumns=True)
        good.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
        bad.write.mode("overwrite").parquet(f"{sink}_rejected/batch={batch_id}")
        # last: what has a marker is whole
        batch.sparkSession.createDataFrame([(batch_id,)], "batch long").coalesce(1).write.mode("overwrite").parquet(
            f"{sink}_commits/{batch_id}")

    q = (reader.parquet(source_dir).writeStream.foreachBatch(write_batch)
         .option("checkpointLocation", checkpoint_dir)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def read_scored(spark: SparkSession, sink_dir: str) -> tuple[DataFrame, DataFrame]:
    """(scored, rejected) rows of the committed batches of ``score_stream``."""
    sink = sink_dir.rstrip("/")
    done = spark.read.parquet(f"{sink}_commits/*").select(F.col("batch").cast("int").alias("batch"))
    return tuple(spark.read.parquet(path).join(done, "batch", "left_semi").drop("batch")
                 for path in (sink, f"{sink}_rejected"))


def contract_stream(stream: DataFrame, contract: Contract) -> DataFrame:
    """P13 on a stream: adds ``violations``; split with ``size(...) == 0``."""
    return contract_violations(stream, contract)


def run_stream_to_table(spark: SparkSession, source_dir: str, transform, sink_dir: str,
                        checkpoint_dir: str, max_files_per_trigger: int | None = None) -> None:
    """Apply a stateless ``transform(DataFrame) -> DataFrame`` to a file
    stream and append every micro-batch to ``sink_dir`` (one folder per
    batch id, overwritten on retry, so a replayed batch is not doubled)."""
    schema = spark.read.parquet(source_dir).schema
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(
            f"{sink_dir.rstrip('/')}/batch={batch_id}")

    q = (reader.parquet(source_dir).writeStream.foreachBatch(write_batch)
         .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
    q.awaitTermination()
