"""Exact top-k inner product search by tiled matrix products.

Queries are numbered and taken in blocks of at most ``BLOCK_BYTES`` (a block
goes to the driver as one Arrow table and is broadcast: its size is bounded by
construction; a scan of the candidates serves a whole block), candidates
stream through the tasks in tiles of at most ``TILE`` vectors.  A tile's product with the
block is reduced to each query's best k at once; a task merges its tiles, and
the tasks' lists are merged in two levels, by groups of tasks and then per
query, with ranked windows.  Every candidate is scored against every query of
the stated set; nothing is pruned.

Components are turned into floor(scale * x) as integers.  Products are formed
in double precision where the tile's magnitudes prove them exact (below
2**53), else in Python's integers.  Ties go to the smaller id.

Null vectors and vectors that hold null or non-finite components take no
part; a component is non-finite if its multiple by the scale is.  Vectors of different lengths do not meet.  Candidates are all rows but
those with the query's own id; repeated rows are candidates of their own, and
repeated query rows are one query, and rows of one id with
different vectors ask together.  Fewer than k candidates: all of them.  A
score outside 64 bits is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, ranked

BLOCK_BYTES = 1 << 25       # of query components that one scan serves
TILE = 4096
CHUNK = 256                 # queries that are multiplied at a time
MERGE_GROUP = 64            # tasks whose lists are merged first


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column of one length as a double matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _quantise(v: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(v.astype(np.float64) * scale)


def _usable(vec: Column, scale: int) -> Column:
    return vec.isNotNull() & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x * float(scale)) == float("inf")))


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products as int64."""
    big = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if big < 2.0 ** 53:
        return (q @ c.T).astype(np.int64)
    to_int = np.frompyfunc(int, 1, 1)
    return (to_int(q) @ to_int(c).T).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int):
    """Row by row the k best of (score descending, id ascending), as arrays
    (row, id, score).  ``ids`` is sorted; ``own`` holds the rows' own ids."""
    rows, cols = scores.shape
    mine = ids[None, :] == own[:, None]
    if cols > 4 * k + 8:
        low = np.where(mine, np.iinfo(np.int64).min, scores)
        cut = np.partition(low, cols - k, axis=1)[:, cols - k]
        r, c = np.nonzero((low >= cut[:, None]) & ~mine)
    else:
        r, c = np.nonzero(~mine)
    s = scores[r, c]
    order = np.lexsort((c, ~s, r))      # ~s falls as s rises, for all of 64 bits
    r, c, s = r[order], c[order], s[order]
    first = np.searchsorted(r, np.arange(rows))
    keep = np.arange(len(r)) - first[r] < k
    return r[keep], ids[c[keep]], s[keep]


def _merge(a, b, n: int, k: int):
    """The k best per row of two lists (row, id, score)."""
    if a is None:
        return b
    r, i, s = (np.concatenate(x) for x in zip(a, b))
    order = np.lexsort((i, ~s, r))
    r, i, s = r[order], i[order], s[order]
    first = np.searchsorted(r, np.arange(n))
    keep = np.arange(len(r)) - first[r] < k
    return r[keep], i[keep], s[keep]


def _search_block(cands: DataFrame, q_ids: np.ndarray, q: np.ndarray, k: int, scale: int) -> DataFrame:
    """Each task's lists (query_id, vec_id, score, task) for a query block."""
    block = cands.sparkSession.sparkContext.broadcast((q_ids, q))
    dim = q.shape[1]

    def run(batches):
        from pyspark import TaskContext
        qi, qm = block.value
        found = [None] * -(-len(qi) // CHUNK)
        for b in batches:
            for start in range(0, b.num_rows, TILE):
                t = b.slice(start, TILE)
                ids = t.column(0).to_numpy(zero_copy_only=False)
                c = _quantise(_matrix(t.column(1), dim), scale)
                order = np.argsort(ids, kind="stable")
                ids, c = ids[order], c[order]
                for j in range(len(found)):
                    part = slice(j * CHUNK, (j + 1) * CHUNK)
                    got = _best(_scores(qm[part], c), ids, qi[part], k)
                    found[j] = _merge(found[j], got, CHUNK, k)
        task = TaskContext.get().partitionId()
        for j, f in enumerate(found):
            if f is not None and len(f[0]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(qi[f[0] + j * CHUNK]), pa.array(f[1]), pa.array(f[2]),
                     pa.array(np.full(len(f[0]), task, np.int32))],
                    names=["query_id", "vec_id", "score", "task"])
    return cands.where(F.size("vec") == dim).mapInArrow(run, "query_id long, vec_id long, score long, task int")


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024,
          id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of each
    row that ``is_query`` selects."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "top_k")
    cands = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"),
                           is_query.alias("asks")).where(_usable(F.col("vec"), scale) & F.col("vec_id").isNotNull())
    queries = scratch.write(cands.where("asks").select("vec_id", "vec").distinct(), "queries")
    dims = sorted(r["d"] for r in queries.select(F.size("vec").alias("d")).distinct().collect())
    lists = None
    for dim in dims:
        of_dim = ranked(queries.where(F.size("vec") == dim), [F.col("vec_id"), F.col("vec")], scratch, f"queries_{dim}")
        for q_ids, q in _blocks(of_dim, dim, max(1, BLOCK_BYTES // (8 * max(1, dim)))):
            found = _search_block(cands.select("vec_id", "vec"), q_ids, _quantise(q, scale), k, scale)
            found.write.mode("append").parquet(scratch.path("lists"))
            lists = found.schema
    if lists is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    lists = spark.read.schema(lists).parquet(scratch.path("lists"))
    order = [F.desc("score"), F.asc("vec_id")]
    group = F.floor(F.col("task") / MERGE_GROUP)
    first = lists.withColumn("group", group).withColumn(
        "at", F.row_number().over(Window.partitionBy("query_id", "group").orderBy(*order))).where(F.col("at") <= k)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(
        F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _blocks(queries: DataFrame, dim: int, size: int):
    """The numbered query vectors in blocks of at most ``size``, one at a
    time."""
    n = queries.count()
    for lo in range(0, n, size):
        block = queries.where(F.col("at").between(lo, lo + size - 1)).select("vec_id", "vec").toArrow().combine_chunks()
        yield block.column(0).to_numpy(), np.concatenate(
            [_matrix(c, dim) for c in block.column(1).chunks] or [np.zeros((0, dim))])
