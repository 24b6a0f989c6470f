"""Lines, forests and boosting of MLlib's definition over many training sets at once: values are binned once, a
level of every training set is one job, and histograms are sums in NumPy over blocks of rows.

What is fitted is what ``RandomForestRegressor`` and ``GBTRegressor`` fit (bins, gains, Poisson bootstrap, a third of
the features at each node of a forest, residuals doubled after the first round); their thousands of jobs for small
trees, one after the other for each training set, are not needed for it."""

from __future__ import annotations

import math
import pickle
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.rdd import RDD
from pyspark.sql import DataFrame

#: Rows of a block; a task holds one at a time.
BLOCK = 131_072
#: Rows that are worth a task of their own, and rows of a task once every core has one.
LEAST_ROWS, TASK_ROWS = 25_000, 500_000
#: Points that a block's values of a feature are summed up in, each of the same number of rows.
POINTS = 8192
#: Bits of a word of bins: features that fit share it, and one count over words serves them all.
WORD_BITS = 10
#: Rows of ten features (fewer of more) up to which one task boosts a whole training set; beyond, each level is a job over all tasks. Both give the same trees.
WHOLE_ROWS = 6_000_000
#: Rounds of boosting after which residuals are worked out anew from the first, so that lineage stays short.
REBUILD = 20


@dataclass
class Words:
    """Where the bins of a feature lie: its word, its shift in it, and the bits of its mask."""

    sizes: list[int]
    at: list[tuple[int, int, int]]

    @classmethod
    def of(cls, bins: Sequence[int]) -> Words:
        """For features with so many bins; one of a single bin has no place (word -1)."""
        sizes: list[int] = []
        at = [(-1, 0, 0)] * len(bins)
        for f in sorted(range(len(bins)), key=lambda f: -bins[f]):
            if (bits := (bins[f] - 1).bit_length()) == 0:
                continue
            word = next((w for w, s in enumerate(sizes) if s + bits <= WORD_BITS), len(sizes))
            if word == len(sizes):
                sizes.append(0)
            at[f] = (word, sizes[word], bits)
            sizes[word] += bits
        return cls(sizes, at)

    def pack(self, codes: np.ndarray, kind: type = np.uint16) -> np.ndarray:
        """Words by rows, from the bins (features, rows)."""
        out = np.zeros((len(self.sizes), codes.shape[1]), kind)
        for (w, shift, bits), c in zip(self.at, codes, strict=True):
            if bits:
                out[w] |= c.astype(kind) << kind(shift)
        return out

    def histogram(self, words: np.ndarray, node: np.ndarray | None, nodes: int, width: int, weights: Sequence[np.ndarray | None]) -> np.ndarray:
        """(weights, nodes, features, width): for each of the weights (None: 1) its sums by node, feature and bin."""
        out = np.zeros((len(weights), nodes, len(self.at), width))
        place = np.zeros(words.shape[1], np.intp) if node is None else node.astype(np.intp)
        if alone := [f for f, (word, _, _) in enumerate(self.at) if word < 0]:
            for x, weight in enumerate(weights):
                out[x, :, alone, 0] = np.bincount(place, weight, nodes)
        for w, size in enumerate(self.sizes):
            key = words[w].astype(np.intp, copy=False)
            if node is not None:
                key = key + (place << size)
            for x, weight in enumerate(weights):
                sums = np.bincount(key, weight, nodes << size)
                for f, (word, shift, bits) in enumerate(self.at):
                    if word == w:
                        own = sums.reshape(nodes, -1, 1 << bits, 1 << shift).sum((1, 3))
                        out[x, :, f, : min(width, own.shape[1])] = own[:, :width]
        return out


class Tree:
    """A tree as arrays in the order of a heap. A node without a split hands all rows to the left."""

    def __init__(self, depth: int):
        self.depth = depth
        self.feature = np.full((1 << depth) - 1, -1)
        self.bin = np.zeros((1 << depth) - 1, int)
        self.gain = np.zeros((1 << depth) - 1)
        self.value = np.zeros((2 << depth) - 1)

    @classmethod
    def of(cls, parts: dict) -> Tree:
        """From its ``vars``; results of tasks hold no classes of this module."""
        tree = cls.__new__(cls)
        tree.__dict__.update(parts)
        return tree

    def grow(self, level: int, splits: tuple[np.ndarray, ...]) -> None:
        feature, most, gain, own, left, right = splits
        start, k = (1 << level) - 1, 1 << level
        if level == 0:
            self.value[0] = own[0]
        split = feature >= 0
        if level:
            split &= np.repeat(self.feature[(start - 1) // 2 : start] >= 0, 2)  # below a leaf nothing is split
        self.feature[start : start + k], self.bin[start : start + k], self.gain[start : start + k] = np.where(split, feature, -1), most, np.where(split, gain, 0)
        below = 2 * start + 1
        mine = self.value[start : start + k]
        self.value[below : below + 2 * k : 2] = np.where(split, left, mine)
        self.value[below + 1 : below + 2 * k : 2] = np.where(split, right, mine)

    def node(self, codes: np.ndarray, level: int) -> np.ndarray:
        """Each row's place in the level, from 0."""
        place = np.zeros(codes.shape[1], np.uint8)
        for lv in range(level):
            go = np.zeros(codes.shape[1], bool)
            for j in range(1 << lv):
                f = self.feature[(1 << lv) - 1 + j]
                if f >= 0:
                    up = codes[f] > self.bin[(1 << lv) - 1 + j]
                    go |= up if lv == 0 else up & (place == j)
            place = (place << 1) | go
        return place

    def predict(self, codes: np.ndarray) -> np.ndarray:
        return self.value[(1 << self.depth) - 1 :][self.node(codes, self.depth)]


@dataclass
class Ensemble:
    """Trees with their weights, and the thresholds their bins stand for."""

    trees: list[Tree]
    weights: list[float]
    thresholds: list[np.ndarray]
    each: bool

    def predict_codes(self, codes: np.ndarray) -> np.ndarray:
        return sum((w * t.predict(codes) for w, t in zip(self.weights, self.trees, strict=True)), np.zeros(codes.shape[1]))

    def predict(self, values: np.ndarray) -> np.ndarray:
        """Of rows by features."""
        return self.predict_codes(coded(self.thresholds, values.T))

    def importances(self) -> np.ndarray:
        """Gains by feature, their sum 1; the trees of a forest count alike, those of boosting by their gains."""
        total = np.zeros(len(self.thresholds))
        for t in self.trees:
            own = np.bincount(t.feature[t.feature >= 0], t.gain[t.feature >= 0], len(total))
            total += own / own.sum() if self.each and own.sum() > 0 else own
        return total / total.sum() if total.sum() > 0 else total


def summed_up(values: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and their counts (None: 1 each); beyond ``POINTS``, as many groups of about equal counts by their largest value."""
    if counts is None:
        v, c = np.unique(values, return_counts=True)
        c = c.astype(float)
    else:
        v, where = np.unique(values, return_inverse=True)
        c = np.bincount(where, counts, len(v))
    if len(v) <= POINTS:
        return v, c
    group = ((np.cumsum(c) - c / 2) / c.sum() * POINTS).astype(int)
    last = np.flatnonzero(np.append(np.diff(group), 1))
    return v[last], np.diff(np.cumsum(c)[last], prepend=0)


def thresholds(values: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """MLlib's: between all values if they are few, else where counts come nearest to equal parts."""
    middle = (values[:-1] + values[1:]) / 2
    if len(values) <= bins:
        return middle
    stride, out, seen = counts.sum() / bins, [], counts[0]
    target = stride
    for k in range(1, len(values)):
        before, seen = seen, seen + counts[k]
        if abs(before - target) < abs(seen - target):
            out.append(middle[k - 1])
            target += stride
    return np.array(out[: bins - 1])


def coded(cuts: list[np.ndarray], values: np.ndarray) -> np.ndarray:
    """Bins (features, rows): how many thresholds lie below."""
    return np.stack([np.searchsorted(t, x) for t, x in zip(cuts, values, strict=True)]).astype(np.uint8)


def best_splits(n: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of rows and sums of labels (nodes, features, bins): feature (-1 for none), largest bin to the left, gain in squares,
    own mean, the children's means."""
    nodes, _, width = n.shape
    k = np.arange(nodes)
    total_n, total_s = n[:, 0].sum(1), s[:, 0].sum(1)
    with np.errstate(all="ignore"):
        own = np.where(total_n > 0, total_s / total_n, 0.0)
        ln, ls = n.cumsum(2)[:, :, :-1], s.cumsum(2)[:, :, :-1]
        rn, rs = total_n[:, None, None] - ln, total_s[:, None, None] - ls
        gain = ls**2 / ln + rs**2 / rn - (total_s**2 / total_n)[:, None, None]
        gain[~((ln >= 1) & (rn >= 1))] = -np.inf
        best = gain.reshape(nodes, -1).argmax(1)
        f, b = best // (width - 1), best % (width - 1)
        g = gain[k, f, b]
        left, right = ls[k, f, b] / ln[k, f, b], rs[k, f, b] / rn[k, f, b]
    return np.where(g > 0, f, -1), b, g, own, left, right


def poisson_table() -> np.ndarray:
    """Draws of Poisson's with mean 1 by a number of 16 bits."""
    chance = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])
    return np.searchsorted(chance, (np.arange(65_536) + 0.5) / 65_536).astype(np.uint8)


@dataclass
class Training:
    """Binned rows: base has (fit, block number, tested, bins, label), made from the rows as they are. moments by fold, of features and label.
    Fit i trains on the folds before i and is tested on fold i."""

    base: RDD
    raw: RDD
    moments: dict[int, tuple[int, np.ndarray, np.ndarray]]
    fits: list[int]
    thresholds: dict[int, list[np.ndarray]]
    rows: int
    tasks: int
    bins: int

    def words(self) -> dict[int, Words]:
        return {i: Words.of([len(t) + 1 for t in self.thresholds[i]]) for i in self.fits}

    def unpersist(self) -> None:
        self.base.unpersist()
        self.raw.unpersist()


def moments_of(x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, means and squares about the means of columns; exactly 0 for a variable that is constant."""
    z = x - x[:, :1]
    off = z.mean(1, keepdims=True)
    z -= off
    return x.shape[1], (x[:, :1] + off)[:, 0], z @ z.T


def moments_together(parts: Sequence[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
    n, mean, squares = parts[0]
    for m, other, more in parts[1:]:
        d = other - mean
        squares = squares + more + np.outer(d, d) * (n * m / (n + m))
        n, mean = n + m, mean + d * (m / (n + m))
    return n, mean, squares


@dataclass
class Line:
    """A straight line through features."""

    coefficients: np.ndarray
    intercept: float

    def predict(self, values: np.ndarray) -> np.ndarray:
        """Of rows by features."""
        return values @ self.coefficients + self.intercept


def line(moments: tuple[int, np.ndarray, np.ndarray], ridge: float) -> Line:
    """What ``LinearRegression`` solves with this regParam: normal equations of variables in deviations, the ridge in those of the label."""
    n, mean, squares = moments
    std = np.sqrt(np.diag(squares) / n)
    if std[-1] == 0:
        return Line(np.zeros(len(std) - 1), float(mean[-1]))
    by = np.where(std > 0, std, 1)
    r = squares / n / np.outer(by, by)
    slopes = np.linalg.solve(r[:-1, :-1] + ridge / std[-1] * np.eye(len(std) - 1), r[:-1, -1]) * std[-1] / by[:-1]
    return Line(slopes, float(mean[-1] - slopes @ mean[:-1]))


def lines(t: Training, ridge: float) -> dict[int, Line]:
    """The line of each fit."""
    return {i: line(moments_together([m for fold, m in sorted(t.moments.items()) if fold < i]), ridge) for i in t.fits}


def line_scores(t: Training, fitted: dict[int, Line], name: str) -> dict[tuple[str, int], float]:
    """R2 of each fit's line on the rows it is tested on."""
    out = {}
    for i in t.fits:
        if i in t.moments:
            n, mean, squares = t.moments[i]
            away = np.append(-fitted[i].coefficients, 1.0)
            with np.errstate(all="ignore"):
                out[name, i] = float(1 - (away @ squares @ away + n * (away @ mean - fitted[i].intercept) ** 2) / squares[-1, -1])
    return out


def prepared(df: DataFrame, features: Sequence[str], fits: Sequence[int], rows: int, order: Sequence[str], bins: int = 32) -> Training:
    """df: features, ``label`` and ``fold``, about so many rows; those with an unknown feature are left out. order: the order within a task, whose last
    names the row."""
    spark, names, block = df.sparkSession, list(features), BLOCK
    tasks = max(min(spark.sparkContext.defaultParallelism, -(-rows // LEAST_ROWS)), -(-rows // TASK_ROWS), 1)
    dealt = df.na.drop(subset=names).select(*order, *[df[c].cast("double") for c in names], df["label"].cast("double"), df["fold"].cast("double"))
    dealt = dealt.repartition(tasks, order[-1]).sortWithinPartitions(*order).select(*names, "label", "fold")

    def blocks(batches):
        import pandas as pd

        held, n = [], 0

        def cut():
            return pd.DataFrame({"block": [pickle.dumps(np.concatenate(held, axis=1), 5)]})

        for b in batches:
            held.append(b.to_numpy(float).T)
            n += held[-1].shape[1]
            if n >= block:
                yield cut()
                held, n = [], 0
        if held:
            yield cut()

    raw = dealt.mapInPandas(blocks, "block binary").rdd.map(lambda r: pickle.loads(r[0])).persist(StorageLevel.MEMORY_AND_DISK)
    width = len(names)

    def points(x):
        for fold in np.unique(x[-1]):
            own = x[:, x[-1] == fold]
            for f in range(width):
                yield (int(fold), f), [summed_up(own[f])]
            yield (int(fold), width), [moments_of(own[:-1])]

    def merged(parts):
        if len(parts[0]) == 3:
            return moments_together(parts)
        return summed_up(np.concatenate([v for v, _ in parts]), np.concatenate([c for _, c in parts]))

    found = raw.flatMap(points).reduceByKey(lambda a, b: [merged(a + b)] if len(a) + len(b) > 16 else a + b, tasks).mapValues(merged).collectAsMap()
    moments = {fold: m for (fold, f), m in found.items() if f == width}
    cuts = {i: [thresholds(*merged([p for (fold, g), p in sorted(found.items(), key=lambda x: x[0]) if g == f and fold < i]), bins) for f in range(width)] for i in fits}

    def binned(task: int, xs: Iterator[np.ndarray]):
        for number, x in enumerate(xs):
            for i in cuts:
                for tested, mask in ((False, x[-1] < i), (True, x[-1] == i)):
                    if mask.any():
                        yield i, (task, number), tested, coded(cuts[i], x[:width, mask]), x[-2, mask]

    return Training(raw.mapPartitionsWithIndex(binned).persist(StorageLevel.MEMORY_AND_DISK), raw, moments, list(fits), cuts, rows, tasks, bins)


def _sums(at: Words, tree: Tree, level: int, width: int, codes: np.ndarray, words: np.ndarray, y: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
    """Rows and sums of labels of a level of a tree, by node, feature and bin. rows: those of the first level, where known."""
    if level == 0 and rows is not None:
        return np.concatenate([rows, at.histogram(words, None, 1, width, (y,))])
    return at.histogram(words, tree.node(codes, level) if level else None, 1 << level, width, (None, y))


def boosted(t: Training, rounds: int, depth: int, step: float) -> dict[int, Ensemble]:
    """Boosting of each fit: small training sets whole in a task each, of larger ones each level is a job."""
    train = t.base.filter(lambda x: not x[2])
    if t.rows * len(next(iter(t.thresholds.values()), ())) <= WHOLE_ROWS * 10:
        at, width = t.words(), t.bins

        def whole(x) -> tuple[int, list[Tree]]:
            i, parts = x[0], [[codes, at[x[0]].pack(codes), y] for _, codes, y in sorted(x[1], key=lambda p: p[0])]
            rows = [at[i].histogram(words, None, 1, width, (None,)) for _, words, _ in parts]
            trees: list[Tree] = []
            for k in range(rounds):
                tree = Tree(depth)
                for level in range(depth):
                    tree.grow(level, best_splits(*sum(_sums(at[i], tree, level, width, codes, words, y * (2 if k else 1), n) for (codes, words, y), n in zip(parts, rows, strict=True))))
                for p in parts:
                    p[2] = p[2] - (step if k else 1.0) * tree.predict(p[0])
                trees.append(tree)
            return i, trees

        grown = dict(train.map(lambda x: (x[0], (x[1], x[3], x[4]))).groupByKey(len(t.fits)).map(whole).map(lambda x: (x[0], [vars(tree) for tree in x[1]])).collect())
        grown = {i: [Tree.of(v) for v in x] for i, x in grown.items()}
    else:
        grown = _by_level(t, train, rounds, depth, step)
    return {i: Ensemble(trees, [step if k else 1.0 for k in range(rounds)], t.thresholds[i], False) for i, trees in grown.items()}


def _by_level(t: Training, train: RDD, rounds: int, depth: int, step: float) -> dict[int, list[Tree]]:
    """The trees of each fit; a level of all fits is one job, residuals are kept from round to round."""
    at, width = t.words(), t.bins
    grown: dict[int, list[Tree]] = {i: [] for i in t.fits}
    train = train.map(lambda x: (x[0], x[3], x[4]))
    state = train

    def less(trees: dict[int, list[tuple[float, Tree]]]):
        def apply(x):
            i, codes, y = x
            for w, tree in trees[i]:
                y = y - w * tree.predict(codes)
            return i, codes, y

        return apply

    def sums(trees: dict[int, Tree], level: int, factor: float):
        def run(xs):
            total: dict = {}
            for i, codes, y in xs:
                total[i] = total.get(i, 0) + _sums(at[i], trees[i], level, width, codes, at[i].pack(codes), factor * y)
            return list(total.items())

        return run

    for k in range(rounds):
        old = state
        if k:
            weighted = {i: [(step if j else 1.0, tree) for j, tree in enumerate(x)] for i, x in grown.items()}
            state = train.map(less(weighted)) if k % REBUILD == 0 else old.map(less({i: x[-1:] for i, x in weighted.items()}))
            state.persist(StorageLevel.MEMORY_AND_DISK)
        trees = {i: Tree(depth) for i in t.fits}
        for level in range(depth):
            total: dict = {}
            for i, part in state.mapPartitions(sums(trees, level, 2.0 if k else 1.0)).collect():
                total[i] = total.get(i, 0) + part
            for i, both in total.items():
                trees[i].grow(level, best_splits(*both))
            if level == 0 and old is not train:
                old.unpersist()
        for i, tree in trees.items():
            grown[i].append(tree)
    if state is not train:
        state.unpersist()
    return grown


def forests(t: Training, trees: int, depth: int, seed: int) -> dict[int, Ensemble]:
    """A forest of each fit: a level of all trees is one job, each tree's split is chosen where its sums meet."""
    at, wide = t.words(), t.bins
    features = len(next(iter(t.thresholds.values())))
    some = -(-features // 3)
    grown = {(i, k): Tree(depth) for i in t.fits for k in range(trees)}

    def among(i: int, k: int, level: int) -> np.ndarray:
        """The features that each node of a level may split by, some at random."""
        rank = np.random.default_rng((seed, i, k, level)).random((1 << level, features)).argsort(1)
        return np.sort(rank[:, :some], 1)

    for level in range(depth):

        def run(xs, level=level):
            table, total = poisson_table().astype(float), {}
            for i, block, tested, codes, y in xs:
                if tested:
                    continue
                words = at[i].pack(codes, np.intp)
                for k in range(trees):
                    weight = table[np.random.default_rng((seed, i, k, *block)).integers(0, 65_536, len(y), np.uint16)]
                    node, pick = grown[i, k].node(codes, level) if level else None, among(i, k, level)[None, :, :, None]
                    both = np.take_along_axis(at[i].histogram(words, node, 1 << level, wide, (weight, weight * y)), pick, 2)
                    total[i, k] = total[i, k] + both if (i, k) in total else both
            return list(total.items())

        def split(x, level=level):
            (i, k), (n, s) = x
            pick = among(i, k, level)
            f, *rest = best_splits(n, s)
            return (i, k), (np.where(f >= 0, pick[np.arange(len(f)), f], -1), *rest)

        for key, splits in t.base.mapPartitions(run).reduceByKey(np.add, min(t.tasks, 64)).map(split).collect():
            grown[key].grow(level, splits)
    return {i: Ensemble([grown[i, k] for k in range(trees)], [1 / trees] * trees, t.thresholds[i], True) for i in t.fits}


def scores(t: Training, models: dict[str, dict[int, Ensemble]]) -> dict[tuple[str, int], float]:
    """R2 of each model and fit on the rows it is tested on."""
    def errors(x):
        i, _, _, codes, y = x
        middle = models[next(iter(models))][i].trees[0].value[0]
        d = y - middle
        for name in models:
            e = y - models[name][i].predict_codes(codes)
            yield (name, i), np.array([len(y), d.sum(), d @ d, e @ e])

    total: dict = defaultdict(float)
    for key, part in t.base.filter(lambda x: x[2]).flatMap(errors).collect():
        total[key] = total[key] + part
    with np.errstate(all="ignore"):
        return {key: float(1 - e / (dd - d * d / n)) for key, (n, d, dd, e) in total.items()}
