"""Softmax boosting of several classes at once, and many such fits in step with one another.

Feature values become bin numbers once, cut at quantiles. A round grows one tree per fit and class, level by level: a
task adds up gradients and second derivatives of its rows per (open node, feature, bin), the sums of all tasks meet in a
tree of additions, and the driver, which sees sums and never rows, picks the splits. A grid times its folds is one run:
every fit has its own trees and its own margins, and all of them read a row in the same pass, so a search over many
settings takes as many jobs as its longest fit. Fits that differ in the number of rounds alone are one fit, read early.

Rows lie in blocks of ``BLOCK_ROWS``, many blocks to a task, and carry their margins from round to round. Every
``REPLAY`` rounds the margins are computed anew from the blocks and all trees so far, which keeps the lineage short
without a checkpoint: a lost executor costs at most that many rounds of its own blocks.

What is open at a time is bounded: nodes are taken in groups of at most ``CELLS`` sums, one job a group.

Bins are cut over all rows of the table, left-out folds included; labels of those rows are never read by their fit.

Defined cases: a missing feature value or weight and a negative weight are errors of the caller; without rows, or with
rows of one class, every row is given the first class, or that one; rows of weight 0 do not train and are scored.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

BLOCK_ROWS, TASK_ROWS = 4096, 65_536
CELLS = 2_000_000
REPLAY = 20


@dataclass(frozen=True)
class Setting:
    """One fit. Rows whose fold is ``without`` do not train it."""

    rounds: int = 200
    depth: int = 6
    rate: float = 0.1
    without: int | None = None


@dataclass
class Forest:
    """Trees one behind another in flat arrays: a child's place (the right one is next to it; -1: leaf), the feature and
    the last bin that goes left, the leaf's value, and each tree's first node."""

    first: np.ndarray
    left: np.ndarray
    column: np.ndarray
    bin: np.ndarray
    value: np.ndarray

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """Places of the nodes that rows end in, shape (trees, rows)."""
        at = np.repeat(self.first[:, None], len(bins), axis=1)
        row = np.arange(len(bins))
        while True:
            left = self.left[at]
            inner = left >= 0
            if not inner.any():
                return at
            at = np.where(inner, left + (bins[row, np.maximum(self.column[at], 0)] > self.bin[at]), at)


@dataclass
class Growing:
    """The trees of a round while they grow."""

    trees: int
    left: list[int] = field(default_factory=list)
    column: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def __post_init__(self) -> None:
        for _ in range(self.trees):
            self.node(0.0)

    def node(self, value: float) -> int:
        for store, x in ((self.left, -1), (self.column, -1), (self.bin, -1), (self.value, value)):
            store.append(x)
        return len(self.left) - 1

    def frozen(self) -> Forest:
        return Forest(np.arange(self.trees), np.array(self.left), np.array(self.column, np.int32), np.array(self.bin, np.int32), np.array(self.value))


def bin_edges(df: DataFrame, features: str, bins: int) -> list[np.ndarray]:
    """Per feature the distinct quantiles that part its values into at most ``bins`` bins; a value on an edge is below it."""
    steps = [i / bins for i in range(1, bins)]
    values = df.select(F.posexplode(vector_to_array(features)).alias("i", "v"))
    found = values.groupBy("i").agg(F.percentile_approx("v", steps, 10_000).alias("q")).orderBy("i").collect()  # a row per feature
    return [np.unique(np.array(r["q"], float)) for r in found]


def blocks(df: DataFrame, edges: Sequence[np.ndarray], features: str, label: str, weight: str | None, fold: str | None) -> RDD:
    """Blocks of (bins, labels, weights, folds); a task holds about ``TASK_ROWS`` rows whatever the table's size."""
    columns = df.select(
        vector_to_array(features).alias("x"), F.col(label).cast("int").alias("y"),
        (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"),
        (F.col(fold) if fold else F.lit(-1)).cast("int").alias("fold"),
    )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK_ROWS):
                part = batch.iloc[at : at + BLOCK_ROWS]
                x = np.stack(part["x"].to_numpy())
                codes = np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(edges)], axis=1).astype(np.int16)
                whole = (codes, part["y"].to_numpy(), part["w"].to_numpy(), part["fold"].to_numpy())
                yield pd.DataFrame({"block": [pickle.dumps(whole)]})

    tasks = max(1, math.ceil(df.count() / TASK_ROWS))
    return columns.repartition(tasks).mapInPandas(cut, "block binary").rdd.map(lambda r: pickle.loads(r[0]))


def gradients(margin: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the log loss by margins of shape (fits, classes, rows). The second one is doubled,
    which bounds the softmax's curvature from above and keeps steps from overshooting."""
    p = np.exp(margin - margin.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    hit = np.arange(margin.shape[1])[:, None] == y[None, :]
    return (p - hit) * w, 2.0 * p * (1.0 - p) * w


def node_sums(block: tuple, forest: Forest, slots: np.ndarray, n_slots: int, without: np.ndarray, n_bins: int) -> np.ndarray:
    """Sums of both derivatives per (open node, feature, bin) over a block's rows, shape (2, slots, features, bins)."""
    (codes, y, w, fold), margin = block
    fits, classes, n = margin.shape
    trains = (without[:, None] != fold) * w  # (fits, rows)
    g, h = gradients(margin, y, trains[:, None, :])
    slot = slots[forest.leaves(codes)].reshape(fits, classes, n)
    used = (slot >= 0) & (trains > 0)[:, None, :]
    slot, g, h, row = slot[used], g[used], h[used], np.broadcast_to(np.arange(n), used.shape)[used]
    out = np.empty((2, n_slots, codes.shape[1], n_bins))
    for i in range(codes.shape[1]):
        key = slot * n_bins + codes[row, i]
        for k, x in enumerate((g, h)):
            out[k, :, i] = np.bincount(key, x, n_slots * n_bins).reshape(n_slots, n_bins)
    return out


def best_splits(sums: np.ndarray, reg: float, min_child: float) -> tuple[np.ndarray, ...]:
    """Per open node: gain, feature and bin of its best split (ties: first feature, then first bin) and the sums
    (gradient, second derivative) of its left side and of the whole."""
    left = np.cumsum(sums, axis=3)
    whole = left[:, :, :, -1:]
    right = whole - left
    score = lambda s: s[0] ** 2 / (s[1] + reg)
    gain = score(left) + score(right) - score(whole)
    gain[(left[1] < min_child) | (right[1] < min_child)] = 0.0
    flat = gain[:, :, :-1].reshape(len(gain), -1) if gain.shape[2] > 1 else np.zeros((len(gain), 1))
    best = (flat >= flat.max(axis=1, keepdims=True) * (1 - 1e-9)).argmax(axis=1)  # ties do not hang on the order of sums
    width = max(1, gain.shape[2] - 1)
    at = np.arange(len(gain))
    return flat[at, best], best // width, best % width, left[:, at, best // width, best % width], whole[:, at, 0, 0]


class Ensemble:
    """A fitted run of settings over one table: its trees, margins and gains."""

    def __init__(self, settings: Sequence[Setting], classes: int, edges: Sequence[np.ndarray]):
        self.settings, self.classes, self.edges = list(settings), classes, edges
        self.rounds: list[Forest] = []
        self.gain = np.zeros((len(self.settings), len(edges)))
        self.splits = np.zeros((len(self.settings), len(edges)), int)

    def margins(self, codes: np.ndarray, rounds: int | None = None, start: np.ndarray | None = None, since: int = 0) -> np.ndarray:
        """Margins (fits, classes, rows) after the given number of rounds."""
        total = np.zeros((len(self.settings), self.classes, len(codes))) if start is None else start.copy()
        for forest in self.rounds[since:rounds]:
            total += forest.value[forest.leaves(codes)].reshape(total.shape)
        return total

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(self.edges)], axis=1)

    def importance(self, fit: int = 0) -> np.ndarray:
        """Mean gain per split of each feature, as shares of 1."""
        mean = self.gain[fit] / np.maximum(self.splits[fit], 1)
        return mean / (mean.sum() or 1.0)

    def transform(self, df: DataFrame, fit: int = 0, rounds: int | None = None, features: str = "features") -> DataFrame:
        """Adds ``prediction``, the class of the largest margin (ties: the smaller code)."""
        return self.predictions(df, [(fit, rounds)], features).drop("point")

    def predictions(self, df: DataFrame, points: Sequence[tuple[int, int]], features: str = "features") -> DataFrame:
        """Each row once per point, a (fit, rounds): ``point`` (its number) and ``prediction`` beside the row's columns."""
        models, edges = [self.only(fit, rounds) for fit, rounds in points], self.edges

        @F.pandas_udf("array<double>")
        def predict(x: pd.Series) -> pd.Series:
            if x.empty or not edges:
                return pd.Series([[0.0] * len(models)] * len(x))
            codes = models[0].binned(np.stack(x.to_numpy()))
            return pd.Series(list(np.stack([m.classify(codes) for m in models], axis=1)))

        return df.select("*", F.posexplode(predict(vector_to_array(features))).alias("point", "prediction"))

    def classify(self, codes: np.ndarray) -> np.ndarray:
        """Class of the largest margin of the first fit (ties: the smaller code)."""
        parts = [self.margins(codes[at : at + BLOCK_ROWS])[0].argmax(axis=0) for at in range(0, len(codes), BLOCK_ROWS)]
        return np.concatenate(parts).astype(float)

    def only(self, fit: int, rounds: int | None = None) -> Ensemble:
        """The same trees of one fit alone."""
        own = Ensemble([self.settings[fit]], self.classes, self.edges)
        own.rounds = [Forest(f.first[fit * self.classes : (fit + 1) * self.classes], f.left, f.column, f.bin, f.value) for f in self.rounds[:rounds]]
        own.gain, own.splits = self.gain[fit : fit + 1], self.splits[fit : fit + 1]
        return own


def fit_together(
    train: DataFrame, settings: Sequence[Setting], classes: int, features: str = "features", label: str = "label_id",
    weight: str | None = None, fold: str | None = None, bins: int = 64, reg: float = 1.0, min_child: float = 1.0,
    read_at: Sequence[int] = (),
) -> tuple[Ensemble, dict[int, pd.DataFrame]]:
    """Fit all settings in step.

    After each number of rounds in ``read_at``: counts (fit, label, prediction, n) of the rows that the fit left out.
    """
    edges = bin_edges(train, features, bins)
    run = Ensemble(settings, classes, edges)
    if not edges or classes < 2:
        return run, {}
    n_bins = max(len(e) for e in edges) + 1
    without = np.array([-2 if s.without is None else s.without for s in settings])
    level = StorageLevel.MEMORY_AND_DISK
    base = blocks(train, edges, features, label, weight, fold).persist(level)
    depth = max(2, math.ceil(math.log(max(2, base.getNumPartitions()), 8)))

    def start(block: tuple) -> tuple:
        return block, np.zeros((len(settings), classes, len(block[0])))

    state, kept, read = base.map(start), [], {}
    for number in range(max(s.rounds for s in settings)):
        growing, open_nodes = Growing(len(settings) * classes), [
            (tree, tree) for tree in range(len(settings) * classes) if number < settings[tree // classes].rounds
        ]
        for at_depth in range(max(s.depth for s in settings)):
            open_nodes = [(node, tree) for node, tree in open_nodes if at_depth < settings[tree // classes].depth]
            step, following = max(1, CELLS // (len(edges) * n_bins)), []
            forest = growing.frozen()
            for at in range(0, len(open_nodes), step):
                group = open_nodes[at : at + step]
                slots = np.full(len(forest.left), -1)
                slots[[node for node, _ in group]] = np.arange(len(group))
                sums = _added(state, forest, slots, len(group), without, n_bins, depth)
                gain, column, cut, left, whole = best_splits(sums, reg, min_child)
                for i, (node, tree) in enumerate(group):
                    fit = tree // classes
                    leaf = lambda s: -settings[fit].rate * s[0] / (s[1] + reg)  # noqa: B023, E731
                    if at_depth == 0:
                        growing.value[node] = leaf(whole[:, i])
                    if gain[i] <= 1e-9:
                        continue
                    run.gain[fit, column[i]] += gain[i]
                    run.splits[fit, column[i]] += 1
                    sides = (left[:, i], whole[:, i] - left[:, i])
                    children = [growing.node(leaf(s)) for s in sides]
                    growing.left[node], growing.column[node], growing.bin[node] = children[0], int(column[i]), int(cut[i])
                    following += [(child, tree) for child, s in zip(children, sides) if s[1] >= 2 * min_child]
            open_nodes = following
            if not open_nodes:
                break
        run.rounds.append(growing.frozen())
        done = len(run.rounds)
        state = _advanced(base, state, run, done).persist(level)
        if done in read_at:
            read[done] = _left_out(state, without, classes)
        kept.append(state)
        if len(kept) > REPLAY:  # the last replay and what follows from it stay
            kept.pop(0).unpersist()
    for old in (*kept, base):
        old.unpersist()
    return run, read


def _added(state: RDD, forest: Forest, slots: np.ndarray, n_slots: int, without: np.ndarray, n_bins: int, depth: int) -> np.ndarray:
    def own(part: Iterator[tuple]) -> Iterator[np.ndarray]:
        total = None
        for block in part:
            sums = node_sums(block, forest, slots, n_slots, without, n_bins)
            total = sums if total is None else total + sums
        if total is not None:
            yield total

    return state.mapPartitions(own).treeReduce(np.add, depth)


def _advanced(base: RDD, state: RDD, run: Ensemble, done: int) -> RDD:
    """Margins after the newest round: from those before it, or, every ``REPLAY`` rounds, from the blocks and all trees."""
    own = Ensemble(run.settings, run.classes, run.edges)
    if done % REPLAY == 0:
        own.rounds = list(run.rounds)
        return base.map(lambda block: (block, own.margins(block[0])))
    own.rounds = run.rounds[-1:]
    return state.map(lambda held: (held[0], own.margins(held[0][0], start=held[1])))


def _left_out(state: RDD, without: np.ndarray, classes: int) -> pd.DataFrame:
    """Rows per (fit, label, prediction) over each fit's left-out fold."""

    def count(part: Iterator[tuple]) -> Iterator[np.ndarray]:
        total = np.zeros((len(without), classes, classes), int)
        for (_, y, _, fold), margin in part:
            guess = margin.argmax(axis=1)
            for fit, own in enumerate(without[:, None] == fold):
                np.add.at(total[fit], (y[own], guess[fit, own]), 1)
        yield total

    total = state.mapPartitions(count).treeReduce(np.add)
    fit, y, guess = np.nonzero(total)
    return pd.DataFrame({"point": fit, "label": y.astype(float), "prediction": guess.astype(float), "n": total[fit, y, guess]})


class SoftmaxBoosting:
    """One setting with the interface of an estimator: ``fit`` gives a model with ``transform`` and ``importance``."""

    def __init__(self, rounds: int = 200, depth: int = 6, rate: float = 0.1, weight: str | None = None, classes: int | None = None):
        self.setting, self.weight, self.classes = Setting(rounds, depth, rate), weight, classes

    def fit(self, train: DataFrame) -> Ensemble:
        classes = self.classes or int(train.agg(F.max("label_id")).first()[0] or 0) + 1
        return fit_together(train, [self.setting], classes, weight=self.weight)[0]
