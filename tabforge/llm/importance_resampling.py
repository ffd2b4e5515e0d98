"""Importance resampling towards a target text distribution.

A document's features are its runs of 1 to ``max_run`` consecutive words,
hashed into buckets.  The gain of a bucket compares its smoothed share in the
target texts with its share in the corpus; a document weighs the sum of its
features' gains, Gumbel noise from a hash of its id is added, and the highest
scores are drawn without replacement.

Words come from an untrained Regex Split pre-tokeniser of ``tokenizers``, run
over the ASCII-lowered text, as (word, byte offsets).  A feature is a window
over the offset pairs: the bytes of its words joined by one space, whose
CRC-32 modulo the bucket number is its bucket.

Two passes: the first writes every document's own histogram (distinct buckets
and counts, far smaller than the text), so texts are split once.  Each task
folds its histograms into one array, and the tasks' non-zero buckets are summed
on Spark; the driver gets at most ``buckets`` rows for the corpus and as many
for the target.  The second pass sums gains over the histograms.  The draw is
one range sort of narrow rows with counts per sort partition; nothing is
collected, whatever the corpus.  The weights and ranks do not depend on how
rows are dealt to tasks.

Null, empty or word-less text: no features, weight 0, never drawn.  A null id
hashes as the empty text.  Equal scores and ids (repeated rows) are drawn as
rows of their own.  An empty target or corpus is smoothed like any other.  An
empty table gives no rows.  Other columns are not looked at.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ranked

BUCKETS = 10_000
MAX_RUN = 1
MIN_WORDS = 20
DRAW_PERCENT = 10
SEED = 2024
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MEMO_BYTES = 1 << 24        # of words whose bucket a task remembers


def splitter():
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split
    return Split(Regex(WORD), "removed", invert=True)


def word_offsets(split, low: str) -> list[tuple[int, int]]:
    """Byte offsets of the words of an ASCII-lowered text."""
    from tokenizers import PreTokenizedString
    cut = PreTokenizedString(low)
    split.pre_tokenize(cut)
    return [at for _, at, _ in cut.get_splits("original", "byte")]


class Features:
    """Histograms of texts; remembers the buckets of words up to
    ``MEMO_BYTES``, whatever their lengths."""

    def __init__(self, max_run: int, buckets: int):
        self.split, self.max_run, self.buckets = splitter(), max_run, buckets
        self.memo: dict = {}
        self.held = 0

    def bucket(self, run: bytes) -> int:
        b = self.memo.get(run)
        if b is None:
            b = zlib.crc32(run) % self.buckets
            self.held += len(run) + 100
            if self.held > MEMO_BYTES:
                self.memo, self.held = {}, len(run) + 100
            if len(run) < MEMO_BYTES // 100:
                self.memo[run] = b
        return b

    def histogram(self, text: str) -> tuple[int, dict]:
        """Number of words, and features per bucket."""
        raw = text.encode().lower()         # bytes: lowers A-Z only
        at = word_offsets(self.split, raw.decode())
        runs: Counter = Counter(raw[a:b] for a, b in at)
        for n in range(2, self.max_run + 1):
            runs.update(b" ".join(raw[a:b] for a, b in at[i:i + n]) for i in range(len(at) - n + 1))
        hist: dict = {}
        for run, c in runs.items():
            b = self.bucket(run)
            hist[b] = hist.get(b, 0) + c
        return len(at), hist


def histograms(df: DataFrame, id_col: str, text_col: str, max_run: int = MAX_RUN,
               buckets: int = BUCKETS) -> DataFrame:
    """(id, n_words, n_features, buckets, counts) of every row."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        features = Features(max_run, buckets)
        for batch in batches:
            got = [features.histogram(t) if t else (0, {}) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *(len(h) for _, h in got)]).astype(np.int32)
            lists = lambda pick, t: pa.ListArray.from_arrays(
                pa.array(ends), pa.array([x for _, h in got for x in pick(h)], t))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _ in got], pa.int64()),
                 pa.array([sum(h.values()) for _, h in got], pa.int64()),
                 lists(dict.keys, pa.int32()), lists(dict.values, pa.int64())],
                names=["id", "n_words", "n_features", "buckets", "counts"])
    return df.select(id_col, text_col).mapInArrow(
        run, f"id {kind}, n_words long, n_features long, buckets array<int>, counts array<bigint>")


def bucket_totals(hists: DataFrame, buckets: int) -> np.ndarray:
    """Features per bucket over all rows."""
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            np.add.at(total, b.column(0).flatten().to_numpy(zero_copy_only=False),
                      b.column(1).flatten().to_numpy(zero_copy_only=False))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])
    rows = hists.select("buckets", "counts").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(
        F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> list[int]:
    """Per bucket floor(1000 * ln of the smoothed target share over the
    smoothed source share)."""
    m, all_s, all_t = len(source), float(source.sum()), float(target.sum())
    return [math.floor(1000 * math.log((t + 1.0) * (all_s + m) / ((s + 1.0) * (all_t + m))))
            for s, t in zip(source.tolist(), target.tolist())]


def weighed(hists: DataFrame, gains: list[int]) -> DataFrame:
    """(id, n_words, n_features, weight) of every row."""
    def run(batches):
        gain = np.array(gains, np.int64)
        for b in batches:
            lists, counts = b.column(3), b.column(4)
            ends = lists.offsets.to_numpy().astype(np.int64)
            flat = gain[lists.flatten().to_numpy(zero_copy_only=False)] * counts.flatten().to_numpy(zero_copy_only=False)
            run_sum = np.concatenate([[0], np.cumsum(flat)])
            ends = ends - ends[0]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(run_sum[ends[1:]] - run_sum[ends[:-1]])],
                names=["id", "n_words", "n_features", "weight"])
    kind = hists.schema["id"].dataType.simpleString()
    return hists.mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long")


def noise(id_: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from the first 32 bits of the SHA-256 of
    ``seed:id``."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             target_text: str = "text", max_run: int = MAX_RUN, buckets: int = BUCKETS, min_words: int = MIN_WORDS,
             draw_percent: int = DRAW_PERCENT, seed: int = SEED) -> DataFrame:
    """Every document's id, n_features, weight, score and rank: 1, 2, 3, ...
    for the ``draw_percent`` per cent (rounded down) of the documents with at
    least ``min_words`` words that score highest, ties to the smaller id; null
    for the others."""
    scratch = Scratch(docs.sparkSession, "resampling")
    hists = scratch.write(histograms(docs, id_col, text_col, max_run, buckets), "histograms")
    wanted = histograms(target.select(F.lit(0).alias("id"), target_text), "id", target_text, max_run, buckets)
    gains = bucket_gains(bucket_totals(hists, buckets), bucket_totals(wanted, buckets))
    able = F.col("n_words") >= min_words
    scored = weighed(hists, gains).select("*", able.alias("able"), (F.col("weight") + noise(F.col("id"), seed)).alias("score"))
    placed = ranked(scored, [F.col("able").desc(), F.col("score").desc(), F.col("id").asc_nulls_first(), F.col("n_features"),
                             F.col("n_words")], scratch, "scored")
    n = placed.agg(F.count(F.when(F.col("able"), 1))).first()[0]
    scratch.drop("histograms")
    drawn = F.col("able") & (F.col("at") < draw_percent * n // 100)
    return placed.select(F.col("id").alias(id_col), "n_features", "weight", "score",
                         F.when(drawn, F.col("at") + 1).alias("rank"))
