"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is quantised to ``bits`` bits by quantile bounds: approximate
ones of numbers, exact ones of whole strings, from a sorted table of their
distinct values and counts.  The bits are folded into one curve index, rows are sorted by it, and the sorted sequence is
cut into runs.  Rows that lie near each other in all dimensions share a shard,
so the minima and maxima of a shard's files prune scans in each dimension.

DataFrame functions only.  Strings compare bytewise.  The sort is a range partition on (index, tie
breakers), so one value that holds a third of all rows is spread over many
tasks; positions come from the partitions' row counts, never from one window
over everything.  The quantile bounds (``2**bits - 1`` numbers a dimension)
and the counts of the partitions are all that reaches the driver.

Nulls: a null dimension is the lowest cell; a null id sorts first.  Null
text: size 1, checksum 0.  Repeated rows get slots of their own.  An empty
table gives no rows.  Other columns of the table are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

BITS = 5


def _gray_inverse(x: int) -> int:
    y = 0
    while x:
        y, x = y ^ x, x >> 1
    return y


def _tables(n: int) -> tuple[list[int], list[int], list[int]]:
    """For each n-bit word: its Gray rank, the entry point and the direction
    of the sub-cube of that rank."""
    rank = [_gray_inverse(i) for i in range(1 << n)]
    entry = [0] + [(g := 2 * ((i - 1) // 2)) ^ g >> 1 for i in range(1, 1 << n)]
    ones = lambda i: (~i & i + 1).bit_length() - 1  # noqa: E731  trailing ones
    turn = [0] + [ones(i if i & 1 else i - 1) % n for i in range(1, 1 << n)]
    return rank, entry, turn


def hilbert_index(cells: list[Column], bits: int = BITS) -> Column:
    """Index on the Hilbert curve of a point with integer coordinates below
    ``2**bits``: one fold over the bit planes, with the state (index, entry
    point, direction)."""
    n = len(cells)
    rank, entry, turn = (F.array(*map(F.lit, t)) for t in _tables(n))
    mask = (1 << n) - 1
    size, shift = F.lit(n), F.call_function

    def rotate_right(x, k):
        return shift("shiftright", x, k).bitwiseOR(shift("shiftleft", x, size - k)).bitwiseAND(F.lit(mask))

    def rotate_left(x, k):
        return shift("shiftleft", x, k).bitwiseOR(shift("shiftright", x, size - k)).bitwiseAND(F.lit(mask))

    planes = F.array(*(sum((F.shiftright(c, b).bitwiseAND(1) * (1 << d) for d, c in enumerate(cells)), F.lit(0))
                       for b in range(bits - 1, -1, -1)))

    def step(acc, plane):
        k = acc["d"] + 1
        w = F.element_at(rank, rotate_right(plane.bitwiseXOR(acc["e"]), k) + 1)
        return F.struct(
            (F.shiftleft(acc["h"], n) + w).alias("h"),
            acc["e"].bitwiseXOR(rotate_left(F.element_at(entry, w + 1), k)).alias("e"),
            ((k + F.element_at(turn, w + 1)) % n).alias("d"))

    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("e"), F.lit(0).alias("d"))
    return F.aggregate(planes, start, step, lambda acc: acc["h"])


def string_bounds(df: DataFrame, name: str, shares: list[float], scratch: Scratch) -> list[str]:
    """The values that hold the given shares of the non-null rows in value
    order.  Distinct values are counted first, so a hot one is one row; the
    sorted table is summed up within its sort partitions, and only the
    partitions' sums and the few bounds reach the driver."""
    counts = df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("v")).agg(F.count("*").alias("n"))
    placed = scratch.write(counts.orderBy("v").withColumn("at", F.monotonically_increasing_id()), f"values_{name}")
    part = F.shiftright("at", 33)
    held = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.sum("n").alias("n")).collect()}
    total, before, at = sum(held.values()), {}, 0
    for p in sorted(held):
        before[p], at = at, at + held[p]
    if not total:
        return []
    inside = Window.partitionBy("p").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    base = F.element_at(F.create_map(*(F.lit(x) for kv in before.items() for x in kv)), F.col("p"))
    ends = placed.withColumn("p", part).withColumn("end", F.sum("n").over(inside) + base)
    wanted = F.array(*(F.lit(max(1, math.ceil(s * total))) for s in shares))
    hit = F.exists(wanted, lambda w: (w <= F.col("end")) & (w > F.col("end") - F.col("n")))
    bounds = [r["v"] for r in ends.where(hit).select("v").collect()]
    scratch.drop(f"values_{name}")
    return bounds


def quantised(df: DataFrame, dims: list[str], bits: int, scratch: Scratch) -> list[Column]:
    """Cell number of each dimension: how many quantile bounds lie at or
    below the value."""
    kinds = dict(df.dtypes)
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    numbers = [d for d in dims if kinds[d] != "string"]
    row = df.agg(*(F.percentile_approx(F.col(d).cast("double"), shares, 10_000).alias(d) for d in numbers)).first() \
        if numbers else {}
    cells = []
    for d in dims:
        text = kinds[d] == "string"
        value = F.col(d) if text else F.col(d).cast("double")
        bounds = string_bounds(df, d, shares, scratch) if text else row[d] or []
        cells.append(sum((F.when(value >= F.lit(b), 1).otherwise(0) for b in sorted(set(bounds))), F.lit(0)))
    return cells


def hilbert_shards(df: DataFrame, dims: list[str], ties: list[str], shards: int, bits: int = BITS,
                   scratch: Scratch | None = None) -> DataFrame:
    """``df`` with hilbert (long), shard (int) and slot (long): runs of equal
    length, at most one row apart, of the rows in curve order (then by
    ``ties``)."""
    scratch = scratch or Scratch(df.sparkSession, "hilbert")
    cells = quantised(df, dims, bits, scratch)
    indexed = df.withColumns({f"__cell{i}": c for i, c in enumerate(cells)}).withColumn(
        "hilbert", hilbert_index([F.col(f"__cell{i}") for i in range(len(cells))], bits)).drop(
        *(f"__cell{i}" for i in range(len(cells))))
    placed = scratch.write(
        indexed.orderBy("hilbert", *ties).withColumn("__at", F.monotonically_increasing_id()), "sorted")
    part, inside = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = {r["p"]: r["n"] for r in placed.groupBy(part.cast("int").alias("p")).agg(
        F.count("*").alias("n")).collect()}        # one row per sort partition
    total, before, at = sum(counts.values()), [], 0
    for p in sorted(counts):
        before.append((p, at))
        at += counts[p]
    base = df.sparkSession.createDataFrame(before, "__part int, __before long")
    rank = F.col("__before") + inside
    return (placed.join(base, part.cast("int") == F.col("__part"))
            .withColumn("__rank", rank)
            .withColumn("shard", F.expr(f"cast((__rank * {shards}) div {max(1, total)} as int)"))
            .withColumn("slot", F.expr(f"__rank - (shard * {total}L + {shards - 1}) div {shards}"))
            .drop("__at", "__part", "__before", "__rank"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard with files in curve order, whose column ranges
    prune scans in every dimension."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Documents on a curve over language, source and size: doc_id, size,
    text_crc32, law, shard, slot, grown_shard, hilbert.  The law is ``rows``:
    shard counts are at most one apart."""
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("lang"),
                       F.col("source").alias("source"), (F.length(text) + 1).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"))
    out = hilbert_shards(slim, ["lang", "source", "size"], ["text_crc32", "doc_id", "source", "lang"], shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "hilbert")
