"""Random forests on counts of very many terms. Rows stay sparse, trees grow level by level, and only the sums of open nodes travel.

Spark's forests hold each row's columns in full, four bytes each: 400 KB for a row of 100,000 terms of which it has 500.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .terms import runs, summed

#: Counts above the last bin count as it. Rows that a task holds in full at a time, and sums that it holds before it adds them up.
BINS, STEP, HELD = 32, 256, 1 << 21
#: Orders of the columns that the nodes of a level draw from.
ORDERS = 4
#: Distribution of Poisson's law of mean 1, by which a row is drawn for a tree.
_POISSON = np.cumsum([np.exp(-1.0)] + [np.exp(-1.0) / float(np.prod(np.arange(1, i + 1))) for i in range(1, 12)])
_TABLE = np.searchsorted(_POISSON, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


class Trees(NamedTuple):
    """Nodes of all trees, the roots first: the column that is asked, the least count that goes to the right, and the left child, which the right
    one follows. A column of -1 has no split."""

    column: np.ndarray
    cut: np.ndarray
    left: np.ndarray


class Level(NamedTuple):
    """What a level asks for: the nodes that are open, which of the level's orders of columns each follows and the place where its columns start
    there, and the places of the columns in each order."""

    nodes: np.ndarray
    order: np.ndarray
    start: np.ndarray
    place: np.ndarray


def drawn(rows: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """How often each row is drawn for each tree, by a hash."""
    with np.errstate(over="ignore"):
        x = rows.astype(np.uint64)[:, None] * np.uint64(trees) + np.arange(trees, dtype=np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return _TABLE[x >> np.uint64(48)]


def reached(dense: np.ndarray, forest: Trees, trees: int, depth: int) -> np.ndarray:
    """The node of each tree at which each row of counts (all columns) stands."""
    n = len(dense)
    row, at = np.repeat(np.arange(n), trees), np.tile(np.arange(trees), n)
    flat, size = dense.ravel(), dense.shape[1]
    for _ in range(depth):
        column = forest.column[at]
        inner = column >= 0
        here = at[inner]
        at[inner] = forest.left[here] + (flat[row[inner] * size + column[inner]] >= forest.cut[here])
    return at.reshape(n, trees)


def level_sums(ends: np.ndarray, column: np.ndarray, count: np.ndarray, label: np.ndarray, rows: np.ndarray, forest: Trees, level: Level, index: np.ndarray, dense: np.ndarray, trees: int, depth: int, width: int, classes: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (open node, place among its columns or width for all, count, class) and how many rows they have, of a few rows. index has the number of
    each open node, -1 for others."""
    n, size = len(ends) - 1, dense.shape[1]
    own = np.repeat(np.arange(n), np.diff(ends))
    cell = own * size + column
    flat = dense.ravel()
    flat[cell] = count
    at = reached(dense[:n], forest, trees, depth)
    flat[cell] = 0
    open_, w = index[at], drawn(rows, trees, seed).astype(np.int64)
    r, t = np.nonzero((open_ >= 0) & (w > 0))
    open_, w = open_[r, t], w[r, t]
    # in the level's orders, in which a node's columns follow each other; the first ones stand at the end once more, as the order goes round
    orders, stride = len(level.place), size + width
    place = level.place[:, column]
    key = (own * orders + np.arange(orders)[:, None]) * stride + place
    again = place < width
    count = np.tile(count, orders)
    key, count = np.concatenate([key.ravel(), key[again] + size]), np.concatenate([count, count[again.ravel()]])
    order = np.argsort(key)
    key, count = key[order], count[order]
    from_ = (r * orders + level.order[open_]) * stride + level.start[open_]
    lo = np.searchsorted(key, from_)
    many = np.searchsorted(key, from_ + width) - lo
    which = np.repeat(np.arange(len(r)), many)
    entry = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
    node = open_[which]
    offset = key[entry] - from_[which]
    made = ((node * (width + 1) + offset) * BINS + count[entry]) * classes + label[r[which]]
    total = ((open_ * (width + 1) + width) * BINS) * classes + label[r]
    return summed(np.concatenate([made, total]), np.concatenate([w[which], w]))


def best_splits(key: np.ndarray, number: np.ndarray, level: Level, weight: np.ndarray, width: int, least: int = 2) -> pd.DataFrame:
    """The best split by Gini's impurity of each node that has one, from the sums of all rows; equals go to the smaller column and count.

    Only counts above 0 have sums of their own: the left side is what a node's total leaves.
    """
    classes, size = len(weight), level.place.shape[1]
    key, number = summed(key, number)
    slot, starts = runs(key // classes)
    sums = np.zeros((len(slot), classes), np.int64)
    np.add.at(sums, (np.repeat(np.arange(len(slot)), np.diff(np.append(starts, len(key)))), key % classes), number)
    unit, bin_ = slot // BINS, slot % BINS
    node, offset = unit // (width + 1), unit % (width + 1)
    whole = offset == width
    at = np.zeros(len(level.nodes), np.int64)
    at[node[whole]] = np.flatnonzero(whole)
    sums_of = sums[at[node]]
    # what has this count or a higher one: sums from the end of each node's column
    back = np.cumsum(sums[::-1], axis=0)[::-1]
    _, first = runs(unit)
    after = np.append(first[1:], len(unit))
    past = np.vstack([back, np.zeros((1, classes), np.int64)])[np.repeat(after, after - first)]
    right = back - past
    left = sums_of - right

    def impurity(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = n * weight
        total = w.sum(axis=1)
        return 1 - ((w / np.maximum(total, 1e-300)[:, None]) ** 2).sum(axis=1), total

    (i, w), (il, wl), (ir, wr) = map(impurity, (sums_of, left, right))
    gain = np.round(i - (il * wl + ir * wr) / np.maximum(w, 1e-300), 12)
    ok = ~whole & (left.sum(axis=1) >= least) & (right.sum(axis=1) >= least) & (gain > 0)
    column = np.argsort(level.place, axis=1)[level.order[node], (level.start[node] + offset) % size]
    order = np.flatnonzero(ok)[np.lexsort((bin_[ok], column[ok], -gain[ok], node[ok]))]
    order = order[runs(node[order])[1]]
    more = lambda n: ((n > 0).sum(axis=1) > 1) & (n.sum(axis=1) >= 2 * least)
    return pd.DataFrame({"node": level.nodes[node[order]], "column": column[order], "cut": bin_[order], "gain": gain[order], "weight": w[order], "left": more(left[order]), "right": more(right[order])})


def importances(rows: DataFrame, size: int, weights: dict[int, float], trees: int, depth: int, per_row: float, seed: int = 42, width: int | None = None) -> np.ndarray:
    """The importance of each of size columns in a forest on rows(row, label, columns, counts), as shares of 1: a tree's gains times the weights of
    the nodes, in shares of the tree, in the mean over trees.

    Each tree draws each row by Poisson's law of mean 1. Each node chooses among the root of all columns: a random stretch of one of a few
    orders of all columns that each level shuffles anew, so each column has the same chance. A job for each level sends the sums
    of open nodes' columns to tasks that each find the best splits of some nodes; the driver holds the nodes.
    per_row is about how many columns a row has.
    """
    labels = sorted(weights)
    weight, width = np.array([weights[c] for c in labels]), min(size, width or int(np.ceil(np.sqrt(size))))
    spark, n = rows.sparkSession, rows.count()
    # of about so many sums a level, a task that finds splits holds a million or two
    parts = max(spark.sparkContext.defaultParallelism, int(n * trees * (1 + per_row * width / size) / HELD) + 1)
    forest = Trees(np.full(trees, -1, np.int64), np.zeros(trees, np.int64), np.zeros(trees, np.int64))
    root, open_, rng, found = np.arange(trees), np.arange(trees), np.random.default_rng(seed), np.zeros((trees, size), np.float64)
    for d in range(depth):
        if not len(open_):
            break
        place = rng.permuted(np.tile(np.arange(size), (ORDERS, 1)), axis=1)
        level = Level(open_, rng.integers(0, ORDERS, len(open_)), rng.integers(0, size, len(open_)), place)
        best = _splits(rows, forest, level, labels, weight, trees, d, width, parts, seed)
        tree = root[best["node"].to_numpy()]
        np.add.at(found, (tree, best["column"].to_numpy()), (best["gain"] * best["weight"]).to_numpy())
        a, m = len(forest.column), len(best)
        for held, value in zip(forest, (best["column"], best["cut"], a + 2 * np.arange(m)), strict=True):
            held[best["node"].to_numpy()] = value
        forest = Trees(*(np.concatenate([held, np.full(2 * m, fill, np.int64)]) for held, fill in zip(forest, (-1, 0, 0), strict=True)))
        root = np.concatenate([root, np.repeat(tree, 2)])
        open_ = a + np.flatnonzero(best[["left", "right"]].to_numpy().ravel())
    total = found.sum(axis=1, keepdims=True)
    found = (found / np.where(total > 0, total, 1)).sum(axis=0)
    return found / found.sum() if found.sum() > 0 else found


def _splits(rows: DataFrame, forest: Trees, level: Level, labels: list[int], weight: np.ndarray, trees: int, depth: int, width: int, parts: int, seed: int) -> pd.DataFrame:
    held = rows.sparkSession.sparkContext.broadcast((forest, level))
    size, classes, nodes = level.place.shape[1], len(labels), len(level.nodes)
    # keys of a part follow each other
    unit = (width + 1) * BINS * classes
    cuts = -(-np.arange(parts + 1) * nodes // parts) * unit

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, level = held.value
        dense, own, many = np.zeros((STEP, size), np.uint8), [], 0
        index = np.full(len(forest.column), -1, np.int64)
        index[level.nodes] = np.arange(nodes)

        def sent(key: np.ndarray, number: np.ndarray) -> Iterator[pa.RecordBatch]:
            at = np.searchsorted(key, cuts)
            for p in np.flatnonzero(np.diff(at)):
                k, m = key[at[p] : at[p + 1]], number[at[p] : at[p + 1]]
                # differences of keys in order have many zero bytes, which Spark's compression takes away
                steps = np.diff(k, prepend=0)
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([steps.tobytes()], pa.binary()), pa.array([m.astype(np.int32).tobytes()], pa.binary())], names=["part", "keys", "numbers"])

        for b in batches:
            for a in range(0, len(b), STEP):
                x = b.slice(a, STEP)
                columns, counts = x.column("columns"), x.column("counts")
                ends = np.asarray(columns.offsets, np.int64)
                ends = ends - ends[0]
                label = np.searchsorted(labels, x.column("label").to_numpy())
                own.append(level_sums(ends, columns.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy().astype(np.int64), label, x.column("row").to_numpy(), forest, level, index, dense, trees, depth, width, classes, seed))
                many += len(own[-1][0])
                if many > HELD:
                    own = [summed(*map(np.concatenate, zip(*own, strict=True)))]
                    many = len(own[0][0])
                    if many > HELD // 2:
                        yield from sent(*own[0])
                        own, many = [], 0
        if own:
            yield from sent(*summed(*map(np.concatenate, zip(*own, strict=True))))

    def best(table: pa.Table) -> pa.Table:
        _, level = held.value
        key = np.concatenate([np.cumsum(np.frombuffer(x, np.int64)) for x in table.column("keys").to_pylist()])
        number = np.concatenate([np.frombuffer(x, np.int32) for x in table.column("numbers").to_pylist()]).astype(np.int64)
        return pa.Table.from_pandas(best_splits(key, number, level, weight, width), preserve_index=False)

    made = rows.mapInArrow(sums, "part int, keys binary, numbers binary").repartition(parts, "part")
    out = made.groupBy("part").applyInArrow(best, "node long, column long, cut long, gain double, weight double, left boolean, right boolean").toPandas().sort_values("node")
    held.unpersist()
    return out
