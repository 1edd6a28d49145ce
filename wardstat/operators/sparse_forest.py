"""Importances of a random forest over one-hot encoded rows that are never made
wide (#115).

Spark's trees keep a row as an int a feature, zeros too: 7,200 levels are 29 KB
a row, read again at each level, and every tree looks at 85 features of a node
for each row of it.  Here a row is a number a column: the bin of a numeric, or
the place of the one that its text column has among the features.  It is the
same forest otherwise: bags of Poisson(1) counts, the square root of all
features drawn for each node, Gini gain, numerics cut into 32 bins at most,
levels down to the depth asked for, leaves of one prediction joined, importances
by gain and weight and normalised a tree.  Cuts come from the counts of all
rows (Spark's from about 10,000 drawn rows, so that a rare level may have none).

* Rows are packed in blocks of ``BLOCK_ROWS``, written once as a table.  A
  block's bags come from its number and the tree's, so no pass stores them, and
  a lost task is done again with the same ones.
* A pass a level: each task walks its rows down the trees and counts, of each
  open node's drawn features, the ones of a text level (its zeros are the rest
  of the node) and the bins of a numeric.  A tree's counts of all tasks are
  added on one of the executors, which finds the best splits; the driver sees a
  row a node.
* A task's counts do not depend on its rows: nodes x drawn features, and trees
  are counted in groups that stay under ``COUNT_BYTES``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col_of
from ..session import cut_lineage
from .ranges import running_sums

BLOCK_ROWS = 32768
BINS = 32
#: most values a numeric column that the driver sees; between them, rows are counted only
VALUES = 1024
COUNT_BYTES = 256 * 1024 * 1024


# --- rows as blocks ----------------------------------------------------------
def thresholds(values, counts) -> np.ndarray:
    """Splits ``x <= t`` of a column from its sorted values and their counts:
    all, or ``BINS - 1`` of about equal counts, as Spark's trees choose them."""
    if len(values) <= BINS:
        return np.array(values[:-1], float)
    found, stride, at = [], sum(counts) / BINS, counts[0]
    target = stride
    for before, n in zip(values, counts[1:]):
        if abs(at - target) < abs(at + n - target):
            found.append(before)
            target += stride
        at += n
    return np.array(found[:BINS - 1], float)


def column_thresholds(df: DataFrame, numeric) -> list:
    """The thresholds of each numeric column, from the counts of all its values;
    of a column with more than ``VALUES`` of them, even steps of the counts."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("c"), col_of(x).cast("double").alias("x")) for i, x in enumerate(numeric)])).alias("p"))
    counts = cut_lineage(long.groupBy("p.c", "p.x").agg(F.count(F.lit(1)).alias("n")).withColumn("one", F.lit(1)), "value_counts")
    step = lambda c: F.floor(c * VALUES / F.col("all_n"))                          # noqa: E731
    seen = running_sums(counts, ["c"], "x", ["n", "one"]).where(
        (F.col("all_one") <= VALUES) | (F.col("cum_one") == F.col("all_one")) | (step(F.col("cum_n")) > step(F.col("cum_n") - F.col("n"))))
    found: list = [[] for _ in numeric]
    for r in seen.select("c", "x", "cum_n").orderBy("c", "x").collect():             # VALUES a column at most
        found[r["c"]].append((r["x"], r["cum_n"]))
    return [thresholds([x for x, _ in f], np.diff([0, *[n for _, n in f]]).tolist()) for f in found]


def encode_blocks(rows: DataFrame, numeric, places, label: str, cuts, width: int, tasks: int) -> DataFrame:
    """``(id, n, cells, y)``: blocks of rows, a column after the other."""
    numeric, places, kind = list(numeric), list(places), np.int16 if width < 32767 else np.int32

    def block(number, parts):
        cells = np.concatenate([p for p, _ in parts], axis=1)
        y = np.concatenate([p for _, p in parts])
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([len(y)], pa.int64()),
                                           pa.array([cells.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], ["id", "n", "cells", "y"])

    def run(batches):
        number, parts, held = TaskContext.get().partitionId() << 32, [], 0
        for b in batches:
            for at in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(at, BLOCK_ROWS)
                cells = np.empty((len(numeric) + len(places), part.num_rows), kind)
                for i, (c, cut) in enumerate(zip(numeric, cuts)):
                    x = part[c].to_numpy(zero_copy_only=False).astype(float)
                    if np.isnan(x).any():
                        raise ValueError(f"null or NaN in {c}")
                    cells[i] = np.searchsorted(cut, x, "left")
                for i, c in enumerate(places, len(numeric)):
                    cells[i] = part[c].fill_null(-1).to_numpy(zero_copy_only=False)
                if part[label].null_count:
                    raise ValueError("null label")
                if held + part.num_rows > BLOCK_ROWS:
                    yield block(number, parts)
                    number, parts, held = number + 1, [], 0
                parts.append((cells, part[label].to_numpy(zero_copy_only=False).astype(np.uint8)))
                held += part.num_rows
        if held:
            yield block(number, parts)

    table = rows.select(*[col_of(c) for c in numeric], *[col_of(c) for c in places], col_of(label)).repartition(tasks)
    return cut_lineage(table.mapInArrow(run, "id long, n long, cells binary, y binary"), "blocks")


# --- a level -----------------------------------------------------------------
class Level:
    """What a pass over a level needs to know, for some of the trees: the splits
    of the levels above (``path``: column, and the range of its values that goes
    right, by tree and node), the open nodes and the features drawn for each."""

    def __init__(self, trees, path, nodes, drawn, column, numerics, seed, bagged):
        self.trees, self.path, self.nodes, self.drawn, self.column = trees, path, nodes, drawn, column
        self.numerics, self.seed, self.bagged = numerics, seed, bagged

    def shape(self, i: int) -> tuple[int, int, np.ndarray]:
        """Nodes, features a node, and the (node, feature) pairs of numerics."""
        drawn = self.drawn[i]
        return *drawn.shape, np.argwhere(drawn < self.numerics)

    def arrive(self, i: int, cells, n: int, rows):
        """The rows that come to this level, and their node of it."""
        node = np.zeros(len(rows), np.int32)
        for column, low, high in self.path:
            c = column[i][node]
            if len(c) and c.min() < 0:                                 # these ended in a leaf
                on = np.flatnonzero(c >= 0)
                rows, node, c = rows[on], node[on], c[on]
            v = cells[c * np.int32(n) + rows]
            node = 2 * node + ((v > low[i][node]) & (v <= high[i][node]))
        return rows, node

    def count(self, i: int, block: int, n: int, cells, y) -> np.ndarray:
        """Counts of a block in tree ``i``, by label: of the nodes, of the ones of
        the drawn features, of the bins of the drawn numerics."""
        m, k, pairs = self.shape(i)
        size = 2 * m + 2 * m * k + 2 * BINS * len(pairs)
        weight = np.ones(n, np.uint8)
        if self.bagged:
            weight = np.random.Generator(np.random.PCG64([self.seed, block, self.trees[i]])).poisson(1.0, n).astype(np.uint8)
        rows, node = self.arrive(i, cells, n, np.flatnonzero(weight).astype(np.int32))
        place = np.full(1 << len(self.path), -1, np.int32)
        place[self.nodes[i]] = np.arange(m, dtype=np.int32)
        node = place[node]
        if len(node) and node.min() < 0:
            on = np.flatnonzero(node >= 0)
            rows, node = rows[on], node[on]
        label, weight = y[rows].astype(np.int32), weight[rows]
        drawn, width = self.drawn[i], len(self.column)
        none = 255 if k < 255 else 65535 if k < 65535 else -1
        slot = np.full((m, width + 1), none, np.uint8 if none == 255 else np.uint16 if none > 0 else np.int32)
        np.put_along_axis(slot, drawn.astype(np.int64), np.arange(k, dtype=slot.dtype)[None, :], axis=1)
        slot = slot.ravel()                                            # place -1, no level, is the column left empty
        asked = np.zeros((m, int(self.column.max()) + 1), bool)
        asked[np.arange(m)[:, None], self.column[drawn]] = True
        pair = np.zeros((m, max(self.numerics, 1)), np.int32)
        pair[pairs[:, 0], drawn[pairs[:, 0], pairs[:, 1]]] = np.arange(len(pairs), dtype=np.int32)
        at, by = [2 * node + label], [weight]
        for c in np.flatnonzero(asked.any(axis=0)):
            of, r, lab, w = node, rows, label, weight
            if asked[:, c].mean() < 0.5:                               # few nodes have drawn a feature of this column
                on = np.flatnonzero(asked[:, c][node])
                of, r, lab, w = of[on], r[on], lab[on], w[on]
            v = cells[c * n:(c + 1) * n][r]
            if c < self.numerics:
                on = slice(None) if asked[:, c].mean() < 0.5 else np.flatnonzero(asked[:, c][of])
                at.append(2 * (m + m * k + pair[of[on], c] * BINS + v[on]) + lab[on])
            else:
                s = slot[of * np.int64(width + 1) + v]
                on = np.flatnonzero(s != none)
                at.append(2 * (m + of[on] * np.int64(k) + s[on]) + lab[on])
            by.append(w[on])
        return np.bincount(np.concatenate(at), np.concatenate(by), size)

    def best(self, i: int, counts) -> np.ndarray:
        """A row a node: feature, bin, gain, counts of both labels, and those that
        go right.  Without a gain the feature is -1."""
        m, k, pairs = self.shape(i)
        whole = counts[:2 * m].reshape(m, 2).astype(float)
        right = counts[2 * m:2 * m + 2 * m * k].reshape(m, k, 2).astype(float)
        gain, cut = _gain(whole[:, None, :], right), np.zeros((m, k))
        if len(pairs):
            node, s = pairs.T
            bins = counts[2 * m + 2 * m * k:].reshape(len(pairs), BINS, 2).astype(float)
            over = whole[node][:, None, :] - bins.cumsum(axis=1)[:, :-1]
            g = _gain(whole[node][:, None, :], over)
            b = g.argmax(axis=1)
            row = np.arange(len(pairs))
            gain[node, s], cut[node, s], right[node, s] = g[row, b], b, over[row, b]
        s, row = gain.argmax(axis=1), np.arange(m)
        g = gain[row, s]
        return np.column_stack([np.where(g > 0, self.drawn[i][row, s], -1), cut[row, s], g, whole, right[row, s]])


def _impurity(counts):
    n = counts.sum(axis=-1)
    return 1 - (counts * counts).sum(axis=-1) / np.maximum(n * n, 1)


def _gain(whole, right):
    """Gini gain of a split; -1 where a side has no rows."""
    left = whole - right
    n, r = whole.sum(axis=-1), right.sum(axis=-1)
    gain = _impurity(whole) - (n - r) / np.maximum(n, 1) * _impurity(left) - r / np.maximum(n, 1) * _impurity(right)
    return np.where((r > 0) & (r < n), gain, -1.0)


def _pass(blocks: DataFrame, level: Level, tasks: int) -> dict:
    """tree -> ``Level.best`` of its counts over all blocks."""
    kind = np.int16 if len(level.column) < 32767 else np.int32

    def count(batches):
        sums = [0] * len(level.trees)
        for b in batches:
            for number, n, cells, y in zip(b["id"].to_pylist(), b["n"].to_pylist(), b["cells"], b["y"]):
                cells, y = np.frombuffer(cells.as_buffer(), kind), np.frombuffer(y.as_buffer(), np.uint8)
                for i in range(len(level.trees)):
                    got = level.count(i, number, n, cells, y)
                    sums[i] = sums[i] + got.astype(np.int32)
        for i, s in enumerate(sums):
            if not isinstance(s, int):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([s.tobytes()], pa.binary())], ["tree", "counts"])

    def best(batches):
        sums: dict = {}
        for b in batches:
            for i, c in zip(b["tree"].to_pylist(), b["counts"]):
                sums[i] = sums.get(i, 0) + np.frombuffer(c.as_buffer(), np.int32).astype(np.int64)
        for i, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([level.best(i, s).tobytes()], pa.binary())], ["tree", "best"])

    counted = blocks.mapInArrow(count, "tree int, counts binary").repartition(tasks, "tree")
    return {level.trees[r["tree"]]: np.frombuffer(r["best"]).reshape(-1, 7) for r in counted.mapInArrow(best, "tree int, best binary").collect()}


# --- the forest --------------------------------------------------------------
def grow(blocks: DataFrame, column: np.ndarray, numerics: int, trees: int, depth: int, seed: int, drawn: int, bagged: bool = True) -> np.ndarray:
    """Importance of each feature; ``column``: the blocks' column of a feature."""
    width, tasks = len(column), blocks.sparkSession.sparkContext.defaultParallelism
    rng = np.random.Generator(np.random.PCG64(seed))
    kind = np.int16 if width < 32767 else np.int32
    limit = np.iinfo(kind).max
    open_ = np.ones((trees, 1), bool)
    guess = [np.zeros((trees, 1), np.uint8)]                           # prediction of the nodes of each level
    path, levels = [], []
    while len(path) < depth and open_.any():
        shape = open_.shape
        place, bins, gain, rows = np.full(shape, -1), np.zeros(shape, int), np.zeros(shape), np.zeros(shape)
        child, guessed = np.zeros((*shape, 2), bool), np.zeros((*shape, 2), np.uint8)
        todo = [t for t in range(trees) if open_[t].any()]
        while todo:
            some, nodes, picks, size = [], [], [], 0
            while todo and (not some or size + 8 * int(open_[todo[0]].sum()) * (drawn + 1) <= COUNT_BYTES):
                t = todo.pop(0)
                nodes.append(np.flatnonzero(open_[t]))
                picks.append(np.sort([rng.choice(width, drawn, replace=False, shuffle=False) for _ in nodes[-1]], axis=1).astype(kind))
                some.append(t)
                size += 8 * len(nodes[-1]) * (drawn + 1)
            level = Level(some, [tuple(x[some] for x in p) for p in path], nodes, picks, column, numerics, seed, bagged)
            found = _pass(blocks, level, min(tasks, len(some)))
            for t, at in zip(some, nodes):
                f, cut, g, n0, n1, r0, r1 = found[t].T
                place[t, at], bins[t, at], gain[t, at], rows[t, at] = f, cut, g, n0 + n1
                if not path:
                    guess[0][t, at] = n1 > n0
                sides = np.stack([np.stack([n0 - r0, n1 - r1], -1), np.stack([r0, r1], -1)], -2)
                child[t, at] = (f >= 0)[:, None] & (_impurity(sides) > np.finfo(float).eps)
                guessed[t, at] = sides[..., 1] > sides[..., 0]
        levels.append((place, gain, rows))
        text = place >= numerics
        path.append((np.where(place >= 0, column[place], -1).astype(np.int32),
                     np.where(text, place - 1, bins).astype(kind), np.where(text, place, limit).astype(kind)))
        open_ = child.reshape(trees, -1)
        guess.append(guessed.reshape(trees, -1))
    return _importance(levels, guess, trees, width)


def _importance(levels, guess, trees: int, width: int) -> np.ndarray:
    """Gain times rows of the splits that stay when leaves of one prediction
    are joined, normalised for each tree, then for the forest."""
    below, total = None, np.zeros((trees, width))
    for l in range(len(levels) - 1, -1, -1):
        place, gain, rows = levels[l]
        split, kids = place >= 0, guess[l + 1].reshape(trees, -1, 2)
        joined = split & (kids[..., 0] == kids[..., 1])
        if below is not None:
            joined &= ~below.reshape(trees, -1, 2).any(axis=-1)
        guess[l] = np.where(joined, kids[..., 0], guess[l])
        below = split & ~joined
        tree, node = np.nonzero(below)
        np.add.at(total, (tree, place[tree, node]), gain[tree, node] * rows[tree, node])
    each = total.sum(axis=1, keepdims=True)
    out = np.divide(total, each, out=np.zeros_like(total), where=each > 0).sum(axis=0)
    return out / out.sum() if out.any() else out


def importances(rows: DataFrame, numeric, places: dict, label: str, n: int, trees: int = 100, depth: int = 10, seed: int = 42,
                drawn: int | None = None, bagged: bool = True) -> np.ndarray:
    """Importance of each feature of a forest over ``n`` rows: the numerics
    first, then for each column of ``places`` (name -> number of features) its
    levels, of which a row holds the place among all features, or null.  The
    label is 0 or 1."""
    numeric, cores = list(numeric), rows.sparkSession.sparkContext.defaultParallelism
    column = np.concatenate([np.arange(len(numeric)), np.repeat(np.arange(len(places)) + len(numeric), list(places.values()))]).astype(np.int32)
    tasks = cores * max(1, min(4, math.ceil(n / BLOCK_ROWS / cores)))
    blocks = encode_blocks(rows, numeric, places, label, column_thresholds(rows, numeric), len(column), tasks)
    return grow(blocks, column, len(numeric), trees, depth, seed, drawn or math.ceil(math.sqrt(len(column))), bagged)
