"""Per-row contributions of a tree ensemble (B2), path-dependent TreeSHAP.

For one tree the path-dependent expectation given a feature subset S is

    E[f | x_S] = sum_leaves v_L * prod_{g on the path of L} (o_g(x) if g in S else z_g)

where ``z_g`` is the product of cover ratios of the path's splits on
feature g and ``o_g(x)`` is 1 when x satisfies all of them.  Each leaf is
therefore a product game over its (at most depth) path features; its
Shapley values are

    phi_f = v_L (o_f - z_f) sum_s  s!(k-1-s)!/k!  e_s(f)

with ``e_s`` the coefficients of ``prod_{g != f} (z_g + o_g t)`` - a small
polynomial product.  Summed over leaves and trees (with the ensemble's tree
weights) this is exactly path-dependent TreeSHAP, and
``base + sum(phi) = prediction``.

Rows enter a leaf's values only by yes/no facts.  So a tree is cut into
subtrees that hang on few facts (the path's conditions per feature, the splits
below it), and the values of a subtree's leaves are summed in a table with a
column per combination; a row then takes one column per subtree.  Only leaves
that hang on more than ``TABLE_BITS`` facts are worked out row by row, for a
whole Arrow batch at once.

The forest is read from the saved MLlib model in groups of whole trees of at
most ``GROUP_NODES`` nodes (a larger tree is a group of its own).  A group is
packed into flat arrays and broadcast; the rows pass through one ``mapInArrow``
per group, which adds the group's contributions to an array column.  No row is
shuffled, and a task unfolds one tree at a time.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...session import ensure_checkpoint_dir
from .explain import contribution_rows

GROUP_NODES = 200_000
TABLE_BITS = 7
TABLE_BYTES = 32 << 20      # of a group's tables are kept for the next batch


def _node_table(spark, model) -> tuple[DataFrame, dict]:
    """(tree, id, left, right, feature, cut, categories, value, rows) of all
    nodes, and the trees' weights."""
    path = f"{ensure_checkpoint_dir(spark)}/treeshap_model_{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    data = spark.read.parquet(f"{path}/data")
    if "treeID" in data.columns:
        meta = spark.read.parquet(f"{path}/treesMetadata")
        if "treeID" not in meta.columns:       # tuple layout: (id, metadata, weight)
            meta = meta.select(F.col("_1").alias("treeID"), F.col("_3").alias("weights"))
        weights = {r["treeID"]: float(r["weights"])
                   for r in meta.select("treeID", "weights").collect()}
        nodes = data.select(F.col("treeID").alias("tree"), "nodeData.*")
    else:
        weights = {0: 1.0}
        nodes = data.withColumn("tree", F.lit(0))
    if type(model).__name__.startswith("RandomForest"):
        weights = {k: w / len(weights) for k, w in weights.items()}
    cat = F.col("split.numCategories") >= 0
    return nodes.select(
        "tree", "id", F.col("leftChild").alias("left"), F.col("rightChild").alias("right"),
        F.col("split.featureIndex").alias("feature"), cat.alias("categorical"),
        F.col("split.leftCategoriesOrThreshold").alias("cut"), F.col("prediction").alias("value"),
        F.col("rawCount").cast("double").alias("rows")), weights


def _groups(nodes: DataFrame, limit: int) -> list[list[int]]:
    """Runs of trees with at most ``limit`` nodes together, one at least."""
    out, held = [], limit + 1
    for r in nodes.groupBy("tree").count().orderBy("tree").collect():      # one row a tree
        if held + r["count"] > limit:
            out.append([])
            held = 0
        out[-1].append(r["tree"])
        held += r["count"]
    return out


@dataclass
class PackedTrees:
    """Trees as flat arrays over their nodes; a tree's nodes are a run that
    starts at its root, children are places in the arrays (-1: a leaf)."""
    start: np.ndarray
    weight: np.ndarray
    left: np.ndarray
    right: np.ndarray
    feature: np.ndarray
    cut: np.ndarray             # threshold, or the place of the categories
    value: np.ndarray
    share: np.ndarray           # of the parent's rows
    categories: list            # sorted arrays; None where the cut is a threshold
    kept: dict = field(default_factory=dict)
    kept_bytes: int = 0

    def leaves(self, k: int):
        """(value, share of the rows, conditions) of tree ``k``; a condition
        is (feature, goes left, cut, categories, share)."""
        for i, conds in self._below(int(self.start[k])):
            share = 1.0
            for *_, r in conds:
                share *= r
            yield float(self.value[i]), share, [self.condition(*c) for c in conds]

    def _below(self, root: int):
        """(leaf, conditions) under ``root``; a condition is (split, goes
        left, share)."""
        todo = [(root, ())]
        while todo:
            i, conds = todo.pop()
            if self.left[i] < 0:
                yield i, conds
            else:
                todo += [(child, (*conds, cond)) for child, cond in self._children(i)]

    def _children(self, i: int):
        for child, goes_left in ((int(self.left[i]), True), (int(self.right[i]), False)):
            yield child, (i, goes_left, float(self.share[child]))

    def condition(self, i: int, goes_left: bool, share: float) -> tuple:
        return int(self.feature[i]), goes_left, float(self.cut[i]), self.categories[i], share

    def _splits(self, root: int, most: int) -> list[int] | None:
        """The splits from ``root`` on down; None if there are over ``most``."""
        todo, out = [root], []
        while todo:
            i = todo.pop()
            if self.left[i] >= 0:
                out.append(i)
                if len(out) > most:
                    return None
                todo += [int(self.right[i]), int(self.left[i])]
        return out

    def subtrees(self, k: int):
        """:class:`_Subtree` objects that hold each leaf of tree ``k`` once;
        those of the first trees are kept, up to ``TABLE_BYTES``."""
        if k in self.kept:
            yield from self.kept[k]
            return
        made, size = [], 0
        todo = [(int(self.start[k]), ())]
        while todo:
            i, conds = todo.pop()
            facts = len({self.feature[c[0]] for c in conds})
            splits = self._splits(i, TABLE_BITS - facts) if facts <= TABLE_BITS else None
            if splits is None and self.left[i] >= 0:
                todo += [(child, (*conds, cond)) for child, cond in self._children(i)]
                continue
            part = _Subtree(self, i, conds, splits)
            size += part.size
            if made is not None:
                made.append(part)
                if self.kept_bytes + size > TABLE_BYTES:
                    made = None
            yield part
        if made is not None:
            self.kept[k] = made
            self.kept_bytes += size

    def goes_left(self, i: int, x: np.ndarray) -> np.ndarray:
        """Per row; ``x`` has a row per feature."""
        col = x[self.feature[i]]
        return col <= self.cut[i] if self.categories[i] is None else np.isin(col, self.categories[i])

    def base(self) -> float:
        return float(sum(self.weight[k] * sum(v * s for v, s, _ in self.leaves(k)) for k in range(len(self.start))))


def _pack(nodes: DataFrame, trees: list[int], weights: dict) -> PackedTrees:
    rows = nodes.where(F.col("tree").between(trees[0], trees[-1])).orderBy("tree", "id").collect()
    place = {(r["tree"], r["id"]): i for i, r in enumerate(rows)}
    inner = [r["left"] >= 0 for r in rows]
    left = np.array([place[r["tree"], r["left"]] if x else -1 for r, x in zip(rows, inner)])
    right = np.array([place[r["tree"], r["right"]] if x else -1 for r, x in zip(rows, inner)])
    share = np.ones(len(rows))
    for i, r in enumerate(rows):
        if inner[i]:
            for c in (left[i], right[i]):
                share[c] = rows[c]["rows"] / (r["rows"] or 1.0)
    seen: dict = {}
    for i, r in enumerate(rows):
        seen.setdefault(r["tree"], i)
    return PackedTrees(
        np.array([seen[t] for t in trees]), np.array([weights.get(t, 1.0) for t in trees]), left, right,
        np.array([r["feature"] if x else -1 for r, x in zip(rows, inner)]),
        np.array([r["cut"][0] if x and not r["categorical"] else 0.0 for r, x in zip(rows, inner)]),
        np.array([r["value"] for r in rows], float), share,
        [np.array(sorted(r["cut"])) if x and r["categorical"] else None for r, x in zip(rows, inner)])


def _shapley(value: float, met: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Values (a row per feature of the path) of a leaf for each column of
    ``met``: 1 where it meets the feature's conditions; ``z``: their shares."""
    k, n = met.shape
    wts = np.array([math.factorial(s) * math.factorial(k - 1 - s) / math.factorial(k)
                    for s in range(k)])
    out = np.empty((k, n))
    for i in range(k):
        # coefficients of prod_{g != f} (z_g + o_g t), per row
        coef = np.zeros((k, n))
        coef[0] = 1.0
        deg = 0
        for j in range(k):
            if j == i:
                continue
            nxt = coef * z[j]
            nxt[1:deg + 2] += coef[0:deg + 1] * met[j]
            coef = nxt
            deg += 1
        out[i] = value * (met[i] - z[i]) * (wts[:, None] * coef).sum(axis=0)
    return out


class _Subtree:
    """The leaves under a node.  Its facts are the path's conditions, joined
    per feature, and the splits below; without a table (one leaf then) the
    facts are more than ``TABLE_BITS``."""

    def __init__(self, forest: PackedTrees, node: int, conds: tuple, splits: list[int] | None):
        self.forest, self.path, self.splits = forest, {}, splits or []
        for i, goes_left, _ in conds:
            self.path.setdefault(int(forest.feature[i]), []).append((i, goes_left))
        used = {int(forest.feature[i]) for i in self.splits}
        self.features = sorted({*self.path, *used})
        self.table, self.value, self.z = None, 0.0, None
        if splits is None:
            self.value, self.z = float(forest.value[node]), self._shares(conds, list(self.path))
            self.size = 0
            return
        bits = len(self.path) + len(self.splits)
        facts = (np.arange(1 << bits) >> np.arange(bits)[:, None] & 1).astype(bool)
        at = {f: facts[j] for j, f in enumerate(self.path)}
        left = {i: facts[len(self.path) + j] for j, i in enumerate(self.splits)}
        self.table = np.zeros((len(self.features), 1 << bits))
        for leaf, more in forest._below(node):
            met = dict(at)
            for i, goes_left, _ in more:
                f = int(forest.feature[i])
                own = left[i] if goes_left else ~left[i]
                met[f] = met[f] & own if f in met else own
            if met:
                z = self._shares((*conds, *more), list(met))
                phi = _shapley(float(forest.value[leaf]), np.array(list(met.values()), float), z)
                self.table[[self.features.index(f) for f in met]] += phi
        self.size = self.table.nbytes

    def _shares(self, conds, features: list[int]) -> np.ndarray:
        z = np.ones(len(features))
        for i, _, share in conds:
            z[features.index(int(self.forest.feature[i]))] *= share
        return z

    def nodes(self) -> list[int]:
        return [i for conds in self.path.values() for i, _ in conds] + self.splits

    def add(self, left: dict, out: np.ndarray) -> None:
        """Adds the values to ``out`` (a row per feature); ``left`` tells for
        each split which rows go left."""
        if not self.features:
            return
        met = []
        for conds in self.path.values():
            m = None
            for i, goes_left in conds:
                own = left[i] if goes_left else ~left[i]
                m = own if m is None else m & own
            met.append(m)
        if self.table is None:
            for f, phi in zip(self.path, _shapley(self.value, np.array(met, float), self.z)):
                out[f] += phi
            return
        column = np.zeros(out.shape[1], np.uint8)
        for j, m in enumerate([*met, *(left[i] for i in self.splits)]):
            column |= m.view(np.uint8) << np.uint8(j)
        column = column.astype(np.intp)
        for f, values in zip(self.features, self.table):
            out[f] += values[column]


def _add_tree(forest: PackedTrees, k: int, x: np.ndarray, out: np.ndarray) -> None:
    left: dict = {}
    for part in forest.subtrees(k):
        # neighbours share their path
        left = {i: left[i] if i in left else forest.goes_left(i, x) for i in part.nodes()}
        part.add(left, out)


def _with_group(rows: DataFrame, packed, n_features: int) -> DataFrame:
    """``rows`` with the contributions of a broadcast group of trees added to
    ``__phi``; ``__x`` holds the features."""
    at_x, at_phi = rows.columns.index("__x"), rows.columns.index("__phi")

    def run(batches):
        forest = packed.value
        for b in batches:
            if not b.num_rows:
                continue
            x, phi = (b.column(i).flatten().to_numpy(zero_copy_only=False).reshape(-1, n_features).T.copy()
                      for i in (at_x, at_phi))
            for k, w in enumerate(forest.weight):
                part = np.zeros_like(phi)
                _add_tree(forest, k, x, part)
                phi += w * part
            cols = list(b.columns)
            cols[at_phi] = pa.ListArray.from_arrays(
                np.arange(0, phi.size + 1, n_features, dtype=np.int32), pa.array(phi.T.reshape(-1)))
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)
    return rows.mapInArrow(run, rows.schema)


def tree_contributions(df: DataFrame, model, features, keys, groups: dict | None = None,
                       group_nodes: int = GROUP_NODES) -> DataFrame:
    """Long table ``(keys..., feature, phi, value)`` plus one ``__base__``
    row per input row holding the expected value (so that phi sums to the
    prediction).  With ``groups`` (feature -> group) a row per group: see
    :func:`explain.contribution_rows`."""
    spark, feats = df.sparkSession, list(features)
    nodes, weights = _node_table(spark, model)
    array = T.ArrayType(T.DoubleType())
    rows = df.select(*keys, F.array(*(F.col(f).cast("double") for f in feats)).cast(array).alias("__x"),
                     F.array_repeat(F.lit(0.0), len(feats)).cast(array).alias("__phi"))
    base = 0.0
    for trees in _groups(nodes, group_nodes):
        packed = _pack(nodes, trees, weights)
        base += packed.base()
        rows = _with_group(rows, spark.sparkContext.broadcast(packed), len(feats))
    at = {f: i for i, f in enumerate(feats)}
    return contribution_rows(rows, {f: F.col("__phi")[at[f]] for f in feats}, {f: F.col("__x")[at[f]] for f in feats},
                             keys, groups, base)
