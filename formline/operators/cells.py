"""Random forests on cells: rows with the same bins of their features and the same class are one cell with a count.

A forest looks at a row only through the bins of its features (``BINS`` at most, cut at quantiles of the training rows), so a fold's rows are folded once into
(class, bins) cells, and every tree of every feature list is grown on counts. A row-wise bootstrap gives each row a Poisson(1) weight for each tree; the weights of the n rows
of a cell add up to Poisson(n), which is drawn once. Splits follow MLlib: Gini gain, a random subset of features a node, at least ``min_leaf`` weights on both sides,
votes by the leaves' class shares. Every row counts, in training and in scoring; the rows are read twice whatever the number of forests.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.session import stored

BINS, CHUNK = 32, 500_000


def subset_size(subset: str, features: int, trees: int) -> int | None:
    """Features a node may choose from, by MLlib's names; None for a name unknown here."""
    named = {"sqrt": math.ceil(math.sqrt(features)), "log2": max(1, math.ceil(math.log2(features))), "onethird": math.ceil(features / 3), "all": features}
    named["auto"] = named["all"] if trees == 1 else named["sqrt"]
    return named.get(subset)


def fold_edges(folded: DataFrame, features: Sequence[str], label: str, n: int) -> tuple[list[list[np.ndarray]], int]:
    """Cuts of each fold's features, at quantiles of the rows it trains on (a value belongs to the bin before a cut it equals), and the number of classes."""
    shares = [i / BINS for i in range(1, BINS)]
    cuts = [F.percentile_approx(F.when(F.col("fold") < i, F.col(f).cast("double")), shares, 10_000).alias(f"c{i}_{k}") for i in range(n) for k, f in enumerate(features)]
    row = folded.agg(F.max(label).alias("top"), *cuts).first()
    return [[np.unique(np.array(row[f"c{i}_{k}"] or [], "float64")) for k in range(len(features))] for i in range(n)], int(row["top"]) + 1


def fold_cells(folded: DataFrame, features: Sequence[str], label: str, edges: list[list[np.ndarray]], classes: int) -> DataFrame:
    """(i, code, train, test): rows of each class and bins (``code``, see ``unpacked``) that round i trains on and is tested on."""
    names = list(features)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def cells() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            fold, y = rows["fold"].to_numpy().astype("int64"), rows[label].to_numpy().astype("int64")
            values = [rows[f].to_numpy() for f in names]
            for i, cuts in enumerate(edges):
                used = fold <= i
                code = y[used]
                for cut, value in zip(cuts, values):
                    code = code * BINS + np.searchsorted(cut, value[used], side="left")
                found, count = np.unique(code * 2 + (fold[used] == i), return_counts=True)
                if len(found):
                    yield pa.record_batch({"i": pa.array(np.full(len(found), i, "int32")), "code": found >> 1, "test": (found & 1).astype(bool), "n": count.astype("int64")})

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= CHUNK:
                yield from cells()
                held.clear()
        if held:
            yield from cells()

    parts = folded.select("fold", label, *[F.col(f).cast("double").alias(f) for f in names]).mapInArrow(codes, "i int, code long, test boolean, n long")
    return parts.groupBy("i", "code").agg(F.sum(F.when(F.col("test"), 0).otherwise(F.col("n"))).alias("train"), F.sum(F.when(F.col("test"), F.col("n")).otherwise(0)).alias("test"))


def unpacked(code: np.ndarray, features: int) -> tuple[np.ndarray, np.ndarray]:
    """(class, bins by feature) of cells."""
    return code >> (5 * features), np.stack([(code >> (5 * (features - 1 - f))) & (BINS - 1) for f in range(features)])


def first_features(code: np.ndarray, train: np.ndarray, test: np.ndarray, features: int, of: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cells of the first ``features`` of ``of`` features."""
    few, at = np.unique(code >> (5 * (of - features)), return_inverse=True)
    return few, *(np.bincount(at, weights=x, minlength=len(few)).astype("int64") for x in (train, test))


class Tree:
    """Nodes in the order they were opened: feature (-1 for a leaf), bin up to which rows go left, the left child (the right one follows it), class shares."""

    def __init__(self, classes: int) -> None:
        self.feature, self.bin, self.left, self.shares = [-1], [0], [0], [np.zeros(classes)]

    def opened(self) -> int:
        for held, new in ((self.feature, -1), (self.bin, 0), (self.left, 0), (self.shares, self.shares[0])):
            held.append(new)
        return len(self.feature) - 1

    def votes(self, bins: np.ndarray) -> np.ndarray:
        """Class shares of each cell's leaf."""
        feature, cut, left = (np.array(x) for x in (self.feature, self.bin, self.left))
        node, cells = np.zeros(bins.shape[1], "int64"), np.arange(bins.shape[1])
        while (feature[node] >= 0).any():
            f = feature[node]
            node = np.where(f >= 0, left[node] + (bins[np.maximum(f, 0), cells] > cut[node]), node)
        return np.stack(self.shares)[node]


def grow(y: np.ndarray, bins: np.ndarray, weight: np.ndarray, classes: int, depth: int, min_leaf: int, subset: int, rng: np.random.Generator) -> Tree:
    """One tree on weighted cells, level by level."""
    tree, known = Tree(classes), weight > 0
    y, bins, weight = y[known], bins[:, known], weight[known].astype("float64")
    at = np.zeros(len(y), "int64")  # place of the cell's node among the open ones
    nodes = [0]
    for level in range(depth + 1):
        total = np.bincount(at * classes + y, weights=weight, minlength=len(nodes) * classes).reshape(len(nodes), classes)
        rows = total.sum(1)
        for node, t, r in zip(nodes, total, rows):
            tree.shares[node] = t / max(r, 1.0)
        if level == depth or not len(y):
            return tree
        gini = lambda t, r: 1.0 - (t * t).sum(-1) / np.maximum(r * r, 1.0)
        gains = np.full((len(nodes), len(bins), BINS), -1.0)
        asked = rng.permuted(np.tile(np.arange(len(bins)), (len(nodes), 1)), axis=1)[:, :subset]
        for f in range(len(bins)):
            left = np.bincount((at * BINS + bins[f]) * classes + y, weights=weight, minlength=len(nodes) * BINS * classes).reshape(len(nodes), BINS, classes).cumsum(1)
            right = total[:, None] - left
            n_left, n_right = left.sum(2), right.sum(2)
            gain = gini(total, rows)[:, None] - (n_left * gini(left, n_left) + n_right * gini(right, n_right)) / np.maximum(rows, 1.0)[:, None]
            may = (asked == f).any(1)[:, None] & (n_left >= max(min_leaf, 1)) & (n_right >= max(min_leaf, 1))
            gains[:, f] = np.where(may, gain, -1.0)
        best = gains.reshape(len(nodes), -1).argmax(1)
        feature, cut = best // BINS, best % BINS
        splits = gains.reshape(len(nodes), -1)[np.arange(len(nodes)), best] > 1e-12
        place, opened = np.full(len(nodes), -1), []
        for k in np.flatnonzero(splits).tolist():
            place[k] = len(opened)
            children = [tree.opened(), tree.opened()]
            tree.feature[nodes[k]], tree.bin[nodes[k]], tree.left[nodes[k]] = int(feature[k]), int(cut[k]), children[0]
            opened += children
        goes = splits[at]
        y, bins, weight, at = y[goes], bins[:, goes], weight[goes], at[goes]
        at = place[at] + (bins[feature[at], np.arange(len(at))] > cut[at])
        nodes = opened
    return tree


def forest_accuracy(code: np.ndarray, train: np.ndarray, test: np.ndarray, features: int, classes: int, trees: int, depth: int, min_leaf: int, subset: int, seed: Sequence[int]) -> tuple[float | None, float | None]:
    """Train and test accuracy (None without such rows) of one forest."""
    y, bins = unpacked(code, features)
    cells, at = np.unique(code & ((1 << 5 * features) - 1), return_inverse=True)  # votes are the same for all classes
    _, asked = unpacked(cells, features)
    votes = np.zeros((len(cells), classes))
    for k in range(trees):
        rng = np.random.default_rng([*seed, k])
        votes += grow(y, bins, rng.poisson(train), classes, depth, min_leaf, subset, rng).votes(asked)
    hit = votes.argmax(1)[at] == y
    return tuple(float(n[hit].sum() / n.sum()) if n.sum() else None for n in (train, test))


def nested_accuracies(folded: DataFrame, ordered: Sequence[str], label: str, n: int, trees: int, depth: int, min_leaf: int, subsets: Sequence[int], seed: int, most: int) -> list[list[tuple]] | None:
    """(train, test) accuracy of the forest of each round, for the first 1, 2, ... of the features; None if a round has more than ``most`` cells."""
    edges, classes = fold_edges(folded, ordered, label, n)
    if classes << (5 * len(ordered) + 1) >= 1 << 62:
        return None
    cells = stored(fold_cells(folded, ordered, label, edges, classes), "cells")
    if max([r["count"] for r in cells.groupBy("i").count().collect()], default=0) > most:
        return None
    out: list[list[tuple]] = [[] for _ in ordered]
    for i in range(n):
        found = cells.filter(F.col("i") == i).select("code", "train", "test").toArrow()
        code, train, test = (found[c].to_numpy().astype("int64") for c in ("code", "train", "test"))
        for size in range(1, len(ordered) + 1):
            out[size - 1].append(forest_accuracy(*first_features(code, train, test, size, len(ordered)), size, classes, trees, depth, min_leaf, subsets[size - 1], [seed, i, size]))
    return out
