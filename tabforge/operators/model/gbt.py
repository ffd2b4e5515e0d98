"""Gradient-boosted regression trees (M7), grown from blocks of binned rows.

MLlib's boosting keeps one object per row, a list of integers among them, and
walks these objects once per level of every tree.  :class:`BlockGBTRegressor`
grows the same trees - MLlib's own split candidates, its gain, its order of
categories and ties, its leaf values - from compact blocks: a byte (two above
256 bins) per row and feature, and the row's residual.  A level is one pass
over the blocks; a task sends back count, sum and sum of squares of the
residuals per (node, feature, bin), tasks are added in the order of their
partitions.  The driver holds these sums for at most ``SUMS_BYTES`` of nodes at
a time, never rows.  The result is an MLlib model.

Splits of one gain that part a node's rows alike may stand for each other, as
they may in two runs of MLlib: sums are rounded in the order they are added.

Options that MLlib draws rows or features for, weights and a validation column
go to MLlib's own fit, and so do fewer than ``LEAST_ROWS`` rows: there a pass
over its objects takes less time than starting Python tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import functions as F

LEAST_ROWS = 1_000_000
SUMS_BYTES = 2 << 20        # of the nodes of one pass
PARTS_AT_ONCE = 64          # tasks' sums that are added together
EPSILON = 2.0 ** -52        # MLlib's: a child of less impurity is not split


class _Binning:
    """MLlib's split candidates: per feature the thresholds, or None and the
    number of categories."""

    def __init__(self, thresholds: list, bins: list[int]):
        self.thresholds, self.bins = thresholds, bins
        self.first = np.concatenate([[0], np.cumsum(bins)])
        self.dtype = np.dtype(np.uint8 if max(bins) <= 256 else np.uint16)

    def blocks(self, batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(self.bins))
            out = np.empty((len(self.bins), b.num_rows), self.dtype)
            for f, cuts in enumerate(self.thresholds):
                if cuts is not None:
                    out[f] = np.searchsorted(cuts, x[:, f])
                    continue
                code = x[:, f].astype(np.int64)
                if len(code) and (code.min() < 0 or code.max() >= self.bins[f]):
                    raise ValueError(f"feature {f} has a category outside 0..{self.bins[f] - 1}")
                out[f] = code
            label = b.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary()), pa.array([label.tobytes()], pa.binary())],
                                             names=["bins", "label"])


class _Tree:
    """Nodes in the order they were made; a leaf is its own child."""

    def __init__(self, width: int):
        self.feature, self.child, self.value = [0], [[0, 0]], [0.0]
        self.left = [np.zeros(width, bool)]     # bins that go left
        self.depth, self.width = 0, width

    def split(self, node: int, feature: int, left: np.ndarray, depth: int) -> list[int]:
        new = [len(self.feature), len(self.feature) + 1]
        self.feature[node], self.child[node] = feature, new
        self.left[node] = left
        for i in new:
            self.feature.append(0)
            self.child.append([i, i])
            self.value.append(0.0)
            self.left.append(np.zeros(self.width, bool))
        self.depth = depth + 1
        return new

    def frozen(self) -> tuple:
        """(feature, child by 2 * node + goes right, goes right by node * width + bin, width, depth, value)"""
        return (np.array(self.feature), np.array(self.child).ravel(), ~np.array(self.left).ravel(), self.width, self.depth,
                np.array(self.value))


def _nodes(tree: tuple, bins: np.ndarray) -> np.ndarray:
    """Where the rows of a block end up."""
    feature, child, right, width, depth, _ = tree
    n = bins.shape[1]
    node, row, flat = np.zeros(n, np.intp), np.arange(n), bins.ravel()
    for _ in range(depth):
        b = flat.take(feature.take(node) * n + row)
        node = child.take(2 * node + right.take(node * width + b))
    return node


def _block(block, binning: _Binning) -> tuple[np.ndarray, np.ndarray]:
    rest = np.frombuffer(block[1])
    return np.frombuffer(block[0], binning.dtype).reshape(len(binning.bins), len(rest)), rest


def _sums(blocks, tree: tuple, slots: np.ndarray, n_slots: int, factor: float, binning: _Binning):
    """(3, nodes, bins of all features): count, sum and sum of squares of
    ``factor`` times the residuals; None without rows."""
    out, width = None, max(binning.bins)
    for block in blocks:
        bins, rest = _block(block, binning)
        slot, y = slots[_nodes(tree, bins)], factor * rest
        if (slot < 0).any():
            at = np.flatnonzero(slot >= 0)
            slot, y, bins = slot[at], y[at], bins[:, at]
        if out is None:
            out = np.zeros((3, n_slots, binning.first[-1]))
        base, y2 = slot * width, y * y
        for f, k in enumerate(binning.bins):
            at, run = base + bins[f], slice(binning.first[f], binning.first[f + 1])
            for part, w in zip(out, (None, y, y2)):
                part[:, run] += np.bincount(at, w, n_slots * width).reshape(n_slots, width)[:, :k]
    return out


def _added(parts) -> bytes:
    """The sum of (partition, sums), in the order of the partitions."""
    total = None
    for _, z in sorted(parts):
        v = np.frombuffer(z)
        total = v.copy() if total is None else total + v
    return total.tobytes()


def _pass(state, tree: tuple, slots: np.ndarray, n_slots: int, factor: float, binning: _Binning) -> np.ndarray:
    def run(part, blocks):
        got = _sums(blocks, tree, slots, n_slots, factor, binning)
        if got is not None:
            yield part, got.tobytes()
    parts = state.mapPartitionsWithIndex(run)
    n = state.getNumPartitions()
    if n > PARTS_AT_ONCE:
        groups = -(-n // PARTS_AT_ONCE)
        parts = (parts.map(lambda p: (p[0] // PARTS_AT_ONCE, p)).groupByKey(groups)
                 .map(lambda g: (g[0], _added(g[1]))))
    return np.frombuffer(_added(parts.collect())).reshape(3, n_slots, -1)


def _less(block, tree: tuple, weight: float, binning: _Binning):
    """The block with ``weight`` times the tree's predictions taken off."""
    bins, rest = _block(block, binning)
    return block[0], (rest - weight * tree[5].take(_nodes(tree, bins))).tobytes()


def _impurity(n, s, q):
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n == 0, 0.0, (q - s * s / n) / n)


class _Node:
    def __init__(self, stats, at: int):
        self.stats, self.at = stats, at         # (count, sum, sum of squares), place in the tree
        self.impurity = float(_impurity(*stats)) if stats is not None else None
        self.leaf_impurity, self.split, self.children, self.gain = self.impurity, None, None, None

    def predict(self) -> float:
        return float(self.stats[1] / self.stats[0]) if self.stats[0] else 0.0


def _best(node: _Node, sums: np.ndarray, binning: _Binning, least_rows: int, least_gain: float):
    """(gain, feature, bins or categories that go left, left stats, right
    stats) of the best split, the first of equal ones; None without one."""
    best = None
    for f, k in enumerate(binning.bins):
        if k < 2:
            continue
        h, order = sums[:, binning.first[f]:binning.first[f + 1]], np.arange(k)
        if binning.thresholds[f] is None:
            with np.errstate(divide="ignore", invalid="ignore"):
                order = np.argsort(np.where(h[0] > 0, h[1] / h[0], np.inf), kind="stable")
            h = h[:, order]
        run = np.cumsum(h, axis=1)
        total, left = run[:, -1], run[:, :-1]
        right = total[:, None] - left
        if node.stats is None:
            node.stats, node.impurity = total, float(_impurity(*total))
        n = left[0] + right[0]
        gain = node.impurity - left[0] / n * _impurity(*left) - right[0] / n * _impurity(*right)
        gain[(left[0] < least_rows) | (right[0] < least_rows) | (gain < least_gain)] = -np.inf
        s = int(np.argmax(gain))
        if gain[s] > (-np.inf if best is None else best[0]):
            best = float(gain[s]), f, order[:s + 1], left[:, s], right[:, s]
    return best


def _grow(state, factor: float, depth: int, least_rows: int, least_gain: float, binning: _Binning) -> tuple[_Node, _Tree]:
    tree = _Tree(max(binning.bins))
    root = _Node(None, 0)
    todo, at_once = [root], max(1, SUMS_BYTES // (24 * int(binning.first[-1])))
    for level in range(depth):
        frozen, made = tree.frozen(), []
        for k in range(0, len(todo), at_once):
            part = todo[k:k + at_once]
            slots = np.full(len(frozen[0]), -1)
            slots[[n.at for n in part]] = np.arange(len(part))
            sums = _pass(state, frozen, slots, len(part), factor, binning)
            for j, node in enumerate(part):
                best = _best(node, sums[:, j], binning, least_rows, least_gain)
                node.leaf_impurity = node.impurity if best else -1.0
                if not best or best[0] <= 0:
                    continue
                node.gain, f, left, *stats = best
                node.split = f, left
                goes = np.zeros(tree.width, bool)
                goes[left] = True
                node.children = [_Node(s, i) for s, i in zip(stats, tree.split(node.at, f, goes, level))]
                made += [c for c in node.children if abs(c.impurity) >= EPSILON]
        todo = made
        if not todo:
            break
    held = [root]
    while held:
        node = held.pop()
        if node.stats is not None:
            tree.value[node.at] = node.predict()
        held += node.children or []
    return root, tree


class BlockGBTRegressor(GBTRegressor):
    """``GBTRegressor`` whose fit reads blocks of binned rows."""

    def _plain(self) -> bool:
        return (self.getFeatureSubsetStrategy() in ("all", "auto") and self.getSubsamplingRate() == 1.0
                and self.getLossType() == "squared" and self.getMaxDepth() > 0 and self.getMinWeightFractionPerNode() == 0.0
                and not self.isSet("weightCol") and not self.isSet("validationIndicatorCol"))

    def _fit(self, dataset):
        binning = self._binning(dataset) if self._plain() else None
        return super()._fit(dataset) if binning is None else self._fit_blocks(dataset, binning)

    def _binning(self, dataset) -> _Binning | None:
        """The candidates that MLlib's own fit would find; None for few rows."""
        self._transfer_params_to_java()
        jvm = dataset.sparkSession.sparkContext._jvm
        module = lambda path, name: getattr(getattr(path, f"{name}$"), "MODULE$")
        est, ml = self._java_obj, jvm.org.apache.spark.ml
        schema = est.transformSchema(dataset._jdf.schema())
        nominal = module(ml.util, "MetadataUtils").getCategoricalFeatures(schema.apply(self.getFeaturesCol()))
        boosting = est.getOldBoostingStrategy(nominal, jvm.org.apache.spark.mllib.tree.configuration.Algo.Regression())
        rows = module(ml.util, "DatasetUtils").extractInstances(est, dataset._jdf, jvm.scala.Option.apply(None))
        meta = module(ml.tree.impl, "DecisionTreeMetadata").buildMetadata(rows, boosting.treeStrategy(), 1,
                                                                           self.getFeatureSubsetStrategy())
        if meta.numExamples() < LEAST_ROWS:
            return None
        splits = module(ml.tree.impl, "RandomForest").findSplits(rows, meta, self.getSeed())
        bins = list(meta.numBins())
        cuts = [None if nominal.contains(f) else np.array([s.threshold() for s in splits[f]]) for f in range(len(bins))]
        return _Binning(cuts, bins)

    def _fit_blocks(self, dataset, binning: _Binning):
        state = (dataset.select(F.col(self.getLabelCol()).cast("double"), vector_to_array(self.getFeaturesCol()))
                 .mapInArrow(binning.blocks, "bins binary, label binary").rdd
                 .map(lambda r: (bytes(r[0]), bytes(r[1]))).persist(StorageLevel.MEMORY_AND_DISK))
        trees, weights, old = [], [], None
        for m in range(self.getMaxIter()):
            # the loss' slope is twice the residual
            root, tree = _grow(state, 2.0 if m else 1.0, self.getMaxDepth(), self.getMinInstancesPerNode(),
                               self.getMinInfoGain(), binning)
            if old is not None:
                old.unpersist()
            trees.append(root)
            weights.append(self.getStepSize() if m else 1.0)
            if m + 1 < self.getMaxIter():
                old, state = state, _taken_off(state, tree.frozen(), weights[-1], binning)
        state.unpersist()
        return self._mllib_model(trees, weights, binning, dataset.sparkSession.sparkContext)

    def _mllib_model(self, trees, weights, binning: _Binning, sc):
        jvm, gateway = sc._jvm, sc._gateway
        tree, n = jvm.org.apache.spark.ml.tree, len(binning.bins)
        tree_model = jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel

        def doubles(values):
            out = gateway.new_array(gateway.jvm.double, len(values))
            for i, v in enumerate(values):
                out[i] = float(v)
            return out

        def made(node):
            """(node of the model, whether it is a leaf)"""
            stats = jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator(doubles(node.stats), int(node.stats[0]))
            if node.children is None:
                return tree.LeafNode(node.predict(), float(node.leaf_impurity), stats), True
            (left, a), (right, b) = (made(c) for c in node.children)
            if a and b and left.prediction() == right.prediction():
                return tree.LeafNode(left.prediction(), node.impurity, stats), True
            f, goes = node.split
            if binning.thresholds[f] is None:
                split = tree.CategoricalSplit(f, doubles(goes), binning.bins[f])
            else:
                split = tree.ContinuousSplit(f, float(binning.thresholds[f][len(goes) - 1]))
            return tree.InternalNode(node.predict(), node.impurity, node.gain, left, right, split, stats), False
        array = gateway.new_array(tree_model, len(trees))
        for i, root in enumerate(trees):
            array[i] = tree_model(made(root)[0], n)
        model = jvm.org.apache.spark.ml.regression.GBTRegressionModel(self.uid, array, doubles(weights), n)
        model.setParent(self._java_obj)
        self._java_obj.copyValues(model, jvm.org.apache.spark.ml.param.ParamMap())
        return self._copyValues(GBTRegressionModel(model))


def _taken_off(state, tree: tuple, weight: float, binning: _Binning):
    return state.map(lambda b: _less(b, tree, weight, binning)).persist(StorageLevel.MEMORY_AND_DISK)
