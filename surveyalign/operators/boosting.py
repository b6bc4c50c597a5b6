"""One softmax ensemble of boosted trees, grown level by level from distributed histograms.

A round grows one tree per class on the gradients and curvatures of the joint softmax loss. Every
level is one Spark job for all classes: the tasks tally their rows by class, node, feature and bin,
the tallies are added per class, and each class's best splits, a few numbers, come back. Tallies are
whole numbers (gradients in units of 2 ** -24), so a model does not depend on how rows lie in tasks.
Rows of equal bins share their margins: they enter a tally once, with the sum of their gradients,
which is taken once a round. Features of few bins are tallied together and told apart afterwards.
Rows that fill a single block have no other tallies to wait for: their task goes through a run of
rounds by the same steps.

The loop runs on an RDD of packed blocks: what a round changes, the margins of the rows, stays
beside them in the executors, and the many short jobs need no query planning.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyalign.session import materialize, shared_dir

BINS = 256               # distinct cut points of a feature, at most
TASK_ROWS = 50_000       # distinct training rows per block
UNIT = float(1 << 24)
CUT_LINEAGE = 25         # rounds between checkpoints of the margins, and rounds of a single block per job

#: Fixed values, the customary defaults of softmax boosting: weight penalty, least curvature of a child, least gain of a split.
PENALTY, MIN_CURVATURE, MIN_GAIN = 1.0, 1.0, 1e-6

_KEEP = BINS - 1         # a cut that sends every row to the left


@dataclass
class SoftmaxTrees:
    """Complete trees per round and class: node k has the children 2k + 1 (value <= threshold) and 2k + 2."""

    feature: np.ndarray      # [round, class, node]
    threshold: np.ndarray    # [round, class, node]
    value: np.ndarray        # [round, class, leaf], learning rate included

    def margins(self, x: np.ndarray) -> np.ndarray:
        """[row, class] sums of the leaves that the rows of raw features reach."""
        depth = int(math.log2(self.value.shape[2]))
        out = np.zeros((self.value.shape[1], len(x)))
        by_feature, rows = x.T.ravel(), np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            for c, start in enumerate(feature * len(x)):
                at = np.zeros(len(x), np.int64)
                for _ in range(depth):
                    right = by_feature.take(start.take(at) + rows) > threshold[c].take(at)
                    at = 2 * at + 1 + right
                out[c] += value[c].take(at - value.shape[1] + 1)
        return np.ascontiguousarray(out.T)

    def probabilities(self, features: Column) -> Column:
        """Column of class probabilities from a column of feature arrays; equal rows of a batch are scored once."""
        @F.pandas_udf("array<double>")
        def score(vectors: pd.Series) -> pd.Series:
            if not len(vectors):
                return pd.Series([], dtype=object)
            distinct, which = np.unique(np.array(vectors.tolist(), np.float64), axis=0, return_inverse=True)
            return pd.Series(list(softmax(self.margins(distinct))[which.ravel()]))
        return score(features)

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(r, c, self.feature[r, c].tolist(), self.threshold[r, c].tolist(), self.value[r, c].tolist())
                for r in range(len(self.value)) for c in range(self.value.shape[1])]
        return spark.createDataFrame(rows, "round int, class int, feature array<int>, threshold array<double>, value array<double>")

    @classmethod
    def from_frame(cls, frame: DataFrame) -> "SoftmaxTrees":
        rows = frame.orderBy("round", "class").collect()   # one row per round and class
        shape = (rows[-1]["round"] + 1, rows[-1]["class"] + 1, -1) if rows else (0, 0, 1)
        return cls(*(np.array([r[c] for r in rows], kind).reshape(shape) for c, kind in (("feature", np.int64), ("threshold", float), ("value", float))))


def softmax(margins: np.ndarray) -> np.ndarray:
    raised = np.exp(margins - margins.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


def cut_points(rows: DataFrame, n_features: int) -> list[np.ndarray]:
    """Ascending cut points per feature, the largest value last: all distinct values, or quantiles if they are too many."""
    values = rows.select(F.posexplode("vector").alias("feature", "v")).distinct()
    values = materialize(values, "values")
    counts = dict(values.groupBy("feature").count().collect())   # one row per feature
    few = [f for f, n in counts.items() if n <= BINS]
    cuts = {f: [] for f in range(n_features)}
    for r in values.where(F.col("feature").isin(few)).collect():
        cuts[r["feature"]].append(r["v"])
    many = [f for f, n in counts.items() if n > BINS]
    if many:
        points = [(i + 1) / BINS for i in range(BINS)]
        tall = rows.select(F.posexplode("vector").alias("feature", "v")).where(F.col("feature").isin(many))
        for r in tall.groupBy("feature").agg(F.percentile_approx("v", points, 10_000).alias("cuts"), F.max("v").alias("top")).collect():
            cuts[r["feature"]] = [*r["cuts"], r["top"]]
    return [np.unique(np.array(cuts[f] or [0.0])) for f in range(n_features)]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= TASK_ROWS:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks()


def _blocks(rows: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """Stored blocks of arrays as bytes: distinct bins [feature, place], then place, label and weight of the rows in order of their place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            x = chunk.column("vector").combine_chunks().flatten().to_numpy().reshape(chunk.num_rows, len(cuts))
            bins = np.stack([np.minimum(np.searchsorted(c, x[:, f], side="left"), len(c) - 1) for f, c in enumerate(cuts)], axis=1).astype(np.uint8)
            distinct, place = np.unique(bins, axis=0, return_inverse=True)
            place = place.ravel()
            order = np.argsort(place, kind="stable")
            fields = (np.ascontiguousarray(distinct.T), place[order].astype(np.int32), chunk.column("label").to_numpy()[order].astype(np.uint8),
                      chunk.column("weight").to_numpy()[order].astype(np.float64))
            yield pa.record_batch([pa.array([a.tobytes()], pa.binary()) for a in fields], ["bins", "place", "label", "weight"])
    parts = max(1, math.ceil(rows.count() / TASK_ROWS))
    return materialize(rows.repartition(parts, "vector").mapInArrow(run, "bins binary, place binary, label binary, weight binary"), "blocks")


def _joint(sizes: list[int]) -> list[list[int]]:
    """Features in groups whose bins have at most ``BINS`` combinations."""
    groups = []
    for f in sorted(range(len(sizes)), key=lambda f: -sizes[f]):
        for group in groups:
            if math.prod(sizes[g] for g in group) * sizes[f] <= BINS:
                group.append(f)
                break
        else:
            groups.append([f])
    return groups


def _positions(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """[class, row] place among the nodes of level ``depth``; ``bins`` is [feature, row], ``feature`` and ``cut`` are [class, node]."""
    n = bins.shape[1]
    by_feature, rows, out = bins.ravel(), np.arange(n), np.zeros((len(feature), n), np.int64)
    for c, (start, last) in enumerate(zip(feature * n, cut.astype(np.uint8))):
        at = out[c]
        for level in range(depth):
            node = at + (1 << level) - 1
            at = 2 * at + (by_feature.take(start.take(node) + rows) > last.take(node))
        out[c] = at
    return out


def _gradients(sizes: list[int]):
    """Of a block what its tallies need: bins, combined bins of each group, gradients and curvatures [class, row] in units."""
    def run(block):
        bins, place, label, weight, margins = block
        first = np.flatnonzero(np.diff(place, prepend=-1))
        gradient, curvature = (np.zeros(margins.T.shape) for _ in range(2))
        for c, share in enumerate(softmax(margins).T):
            share = share[place]
            gradient[c] = np.add.reduceat(np.rint((share - (label == c)) * weight * UNIT), first)
            curvature[c] = np.add.reduceat(np.rint(np.maximum(2 * share * (1 - share), 1e-16) * weight * UNIT), first)
        codes = [np.ravel_multi_index(tuple(bins[g].astype(np.int64)), [sizes[f] for f in g]).astype(np.uint8) for g in _joint(sizes)]
        return bins, codes, *(v.astype(np.int32 if np.abs(v).max(initial=0) < 1 << 31 else np.int64) for v in (gradient, curvature))
    return run


def _tally(sizes: list[int], feature: np.ndarray, cut: np.ndarray, depth: int):
    """Per class the whole-number sums [node, bin of any feature, (gradient, curvature)] of a task."""
    groups, nodes = _joint(sizes), 1 << depth
    starts = np.cumsum([0, *sizes])

    def run(blocks) -> Iterator[tuple[int, np.ndarray]]:
        totals = {}
        for bins, codes, *sums in blocks:
            for c, at in enumerate(_positions(bins, feature, cut, depth)):
                weights = [v[c].astype(np.float64) for v in sums]
                for i, (group, code) in enumerate(zip(groups, codes)):
                    size = math.prod(sizes[f] for f in group)
                    cell = at * size + code
                    found = np.stack([np.bincount(cell, w, nodes * size) for w in weights]).astype(np.int64)
                    totals[c, i] = totals[c, i] + found if (c, i) in totals else found
        for c in sorted({c for c, _ in totals}):
            whole = np.zeros((nodes, starts[-1], 2), np.int64)
            for i, group in enumerate(groups):
                cube = totals[c, i].reshape(2, nodes, *[sizes[f] for f in group])
                for axis, f in enumerate(group, 2):
                    other = tuple(a for a in range(2, cube.ndim) if a != axis)
                    whole[:, starts[f]:starts[f + 1]] = np.moveaxis(cube.sum(axis=other), 0, -1)
            yield c, whole
    return run


def _best(sizes: list[int]):
    """Of tallies [node, bin, sum] the best split per node: (feature, cut, left sums, right sums)."""
    def run(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        whole = sums[:, :sizes[0]].sum(axis=1)
        n = len(sums)
        gain, feature, cut, left = np.full(n, MIN_GAIN), np.zeros(n, np.int64), np.full(n, _KEEP), whole.copy()
        first = 0
        for f, size in enumerate(sizes):
            below = sums[:, first:first + size].cumsum(axis=1)[:, :-1]
            first += size
            if size < 2:
                continue
            (gl, hl), (gr, hr) = (np.moveaxis(v / UNIT, -1, 0) for v in (below, whole[:, None] - below))
            g, h = (whole / UNIT).T
            won = gl ** 2 / (hl + PENALTY) + gr ** 2 / (hr + PENALTY) - (g ** 2 / (h + PENALTY))[:, None]
            won[(hl < MIN_CURVATURE) | (hr < MIN_CURVATURE)] = -np.inf
            top = won.argmax(axis=1)
            better = won[np.arange(n), top] > gain
            gain[better], feature[better], cut[better] = won[better, top[better]], f, top[better]
            left[better] = below[better, top[better]]
        return feature, cut, left, whole - left
    return run


@dataclass
class _Plan:
    sizes: list[int]
    classes: int
    depth: int
    rate: float

    def grow(self, splits) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(feature, cut, leaves) of one round; ``splits(feature, cut, level)`` lists the best splits of each class."""
        nodes = (1 << self.depth) - 1
        feature, cut = np.zeros((self.classes, nodes), np.int64), np.full((self.classes, nodes), _KEEP)
        leaves = np.zeros((self.classes, 1 << self.depth))
        for level in range(self.depth):
            span = slice((1 << level) - 1, (1 << (level + 1)) - 1)
            for c, (f, k, left, right) in splits(feature, cut, level):
                feature[c, span], cut[c, span] = f, k
                if level == self.depth - 1:
                    both = np.stack([left, right], axis=1).reshape(-1, 2) / UNIT
                    leaves[c] = -self.rate * both[:, 0] / (both[:, 1] + PENALTY)
        return feature, cut, leaves

    def alone(self, rounds: int):
        """So many rounds of a single block: its trees, then the block with its new margins."""
        def run(blocks):
            for block in blocks:
                def splits(feature, cut, level):
                    sums = np.stack([v for _, v in _tally(self.sizes, feature, cut, level)([ready])])
                    found = _best(self.sizes)(sums.reshape(-1, *sums.shape[2:]))
                    return enumerate(zip(*(v.reshape(self.classes, -1, *v.shape[1:]) for v in found)))
                trees = []
                for _ in range(rounds):
                    ready = _gradients(self.sizes)(block)
                    trees.append(self.grow(splits))
                    block = _moved(*trees[-1], self.depth)(block)
                yield trees
                yield block
        return run


def fit_softmax_trees(rows: DataFrame, n_features: int, n_classes: int, rounds: int = 200, depth: int = 6, learning_rate: float = 0.1) -> SoftmaxTrees:
    """Fit on ``rows`` (vector array<double>, label from 0, weight), best with one row per distinct (vector, label).

    Features have up to ``BINS`` cut points: every distinct value, or quantiles. The driver holds
    the trees and, per level, one split per class and node. Without rows all leaves are 0. A lost
    executor costs the rounds since the last checkpoint, ``CUT_LINEAGE`` at most.
    """
    spark = rows.sparkSession
    cuts = cut_points(rows, n_features)
    sizes = [len(c) for c in cuts]
    stored = _blocks(rows, cuts)
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_dir(spark, "margins"))

    def unpacked(row):
        bins = np.frombuffer(row["bins"], np.uint8).reshape(n_features, -1)
        rows = np.frombuffer(row["place"], np.int32), np.frombuffer(row["label"], np.uint8), np.frombuffer(row["weight"])
        return bins, *rows, np.zeros((bins.shape[1], n_classes))

    plan = _Plan(sizes, n_classes, depth, learning_rate)
    state: RDD = stored.rdd.map(unpacked).persist(StorageLevel.MEMORY_AND_DISK)
    trees = []
    if stored.count() == 1:
        held = state
        while len(trees) < rounds:
            run = state.mapPartitions(plan.alone(min(CUT_LINEAGE, rounds - len(trees)))).persist(StorageLevel.MEMORY_AND_DISK)
            run.checkpoint()
            trees += run.filter(lambda x: isinstance(x, list)).collect()[0]   # one run of trees
            held.unpersist()
            held, state = run, run.filter(lambda x: not isinstance(x, list))
        held.unpersist()
    else:
        parts, older = state.getNumPartitions(), None
        for r in range(rounds):
            ready = state.map(_gradients(sizes)).persist(StorageLevel.MEMORY_AND_DISK)

            def splits(feature, cut, level):
                sums = ready.mapPartitions(_tally(sizes, feature, cut, level))
                if parts > 1:
                    sums = sums.reduceByKey(np.add, min(parts, n_classes))
                return sums.mapValues(_best(sizes)).collect()   # one entry per class
            trees.append(plan.grow(splits))
            ready.unpersist()
            if older is not None:
                older.unpersist()
            if r + 1 < rounds:
                older, state = state, state.map(_moved(*trees[-1], depth)).persist(StorageLevel.MEMORY_AND_DISK)
                if (r + 1) % CUT_LINEAGE == 0:
                    state.checkpoint()
        state.unpersist()
    feature, cut, value = (np.array([t[i] for t in trees]) for i in range(3))
    edges = np.full((n_features, BINS), np.inf)
    for f, points in enumerate(cuts):
        edges[f, :len(points) - 1] = points[:-1]
    return SoftmaxTrees(feature, edges[feature, cut], value)


def _moved(feature: np.ndarray, cut: np.ndarray, leaves: np.ndarray, depth: int):
    def run(block):
        bins, *rows, margins = block
        return bins, *rows, margins + np.take_along_axis(leaves, _positions(bins, feature, cut, depth), 1).T
    return run
