"""Boosted trees for several classes at once (M06): softmax, histograms of gradient and hessian, second-order leaves.

A round grows one tree a class on the same probabilities p: gradient p - [y is the class], hessian p * (1 - p). Features are cut at fixed edges into
bins once (bin 0 holds missing numbers, which go left). A level is one pass for the trees of all classes: tasks fold their rows into sums of
gradient and hessian by (class, node, feature, bin), and those cells, whose number the call bounds, are added up before anything leaves the cluster. The driver
takes of each node the best cut by gain G_l ** 2 / (H_l + l2) + G_r ** 2 / (H_r + l2) - G ** 2 / (H + l2); a leaf is -rate * G / (H + l2). Gains count to
nine digits, equal ones go to the first feature and cut, so the order in which tasks add up decides nothing.

Rows are bins and class only; the margins of finished rounds are written with them every ``keep`` rounds and otherwise computed again from the trees.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline.session import stored

FLAT_LEVELS = 4  # deeper trees are walked row by row

@dataclass
class Tree:
    """A complete binary tree: node i has children 2 i + 1 and 2 i + 2; a bin at most ``cut`` goes left; feature -1 is a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The node of each row of ``bins``; fastest when a feature's bins lie side by side (order F)."""
        return self._look_up(bins, np.arange(len(self.feature)))

    def values(self, bins: np.ndarray) -> np.ndarray:
        return self._look_up(bins, self.value)

    def _look_up(self, bins: np.ndarray, of: np.ndarray) -> np.ndarray:
        levels = len(self.feature).bit_length() - 1
        if levels > FLAT_LEVELS:
            return of[self._walked(bins, levels)]
        # every node is asked for all rows: few whole columns cost less than one look-up a row and level
        path, here = np.zeros(len(bins), dtype=np.uint8), {0: np.ones(len(bins), dtype=bool)}
        for level in range(levels):
            bit = np.zeros(len(bins), dtype=bool)
            for node in range((1 << level) - 1, (2 << level) - 1):
                if self.feature[node] < 0:
                    here[2 * node + 1], here[2 * node + 2] = here[node], np.zeros(len(bins), dtype=bool)
                    continue
                right = (bins[:, self.feature[node]] > self.cut[node]) & here[node]
                bit |= right
                here[2 * node + 1], here[2 * node + 2] = here[node] & ~right, right
            path = (path << 1) | bit
        return of[self._ends(levels)].take(path.astype(np.intp), mode="clip")

    def _ends(self, levels: int) -> np.ndarray:
        """By path from the root (a bit a level, 1 is right): the node where it stops; a leaf passes its rows on to the left."""
        out = np.zeros(1 << levels, dtype=np.int64)
        for path in range(1 << levels):
            for level in range(levels - 1, -1, -1):
                if self.feature[out[path]] >= 0:
                    out[path] = 2 * out[path] + 1 + (path >> level & 1)
        return out

    def _walked(self, bins: np.ndarray, levels: int) -> np.ndarray:
        at = np.zeros(len(bins), dtype=np.int64)
        for _ in range(levels):
            f = self.feature[at]
            left = bins[np.arange(len(bins)), np.maximum(f, 0)] <= self.cut[at]
            at = np.where(f >= 0, 2 * at + np.where(left, 1, 2), at)
        return at


@dataclass
class Boosted:
    features: list[str]
    edges: Mapping[str, Sequence[float]]
    classes: int
    rounds: list[list[Tree]] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    def margins(self, bins: np.ndarray, start: int = 0) -> np.ndarray:
        out = np.zeros((len(bins), self.classes), order="F")
        for trees in self.rounds[start:]:
            for k, t in enumerate(trees):
                out[:, k] += t.values(bins)
        return out


def quantile_edges(df: DataFrame, features: Sequence[str], bins: int = 32) -> dict[str, list[float]]:
    """Cut points that spread the rows evenly over at most ``bins`` bins."""
    probs = [i / bins for i in range(1, bins)]
    found = df.agg(*[F.array_sort(F.array_distinct(F.percentile_approx(F.col(f).cast("double"), probs, 100 * bins))).alias(f) for f in features]).first()
    return {f: list(found[f] or []) for f in features}


def bin_of(x: Column, edges: Sequence[float]) -> Column:
    """0 for a missing number, else 1 + the number of edges below it."""
    x = x.cast("double")
    below = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]).cast("array<double>"), lambda e: e < x))
    return F.when(x.isNull() | F.isnan(x), 0).otherwise(1 + below)


def binned(df: DataFrame, model: Boosted, keep: Sequence[str]) -> DataFrame:
    return df.select(*keep, F.array(*[bin_of(F.col(f), model.edges[f]) for f in model.features]).alias("_bins"))


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(kind)


def _bins(column: pa.Array, model: Boosted) -> np.ndarray:
    """Bins by row, in the smallest numbers that hold them, a feature's side by side."""
    return np.asfortranarray(_matrix(column, np.min_scalar_type(max(len(e) for e in model.edges.values()) + 1)))


def _level(rows: DataFrame, model: Boosted, done: int, growing: list[Tree], depth: int) -> tuple[np.ndarray, float]:
    """Sums of gradient and hessian by (class, node of the level, feature, bin), and the log loss before this round, from one pass."""
    first, nodes = (1 << depth) - 1, 1 << depth
    classes, features = model.classes, len(model.features)
    width = max(len(e) for e in model.edges.values()) + 2
    shape = (classes, nodes, features, width)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, loss = np.zeros((2, int(np.prod(shape)))), 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, y = _bins(batch.column("_bins"), model), batch.column("y").to_numpy()
            p = softmax(_matrix(batch.column("_m"), np.float64) + model.margins(bins, done))
            loss -= float(np.log(np.maximum(p[np.arange(len(y)), y], 1e-15)).sum())
            for k in range(classes):
                at = growing[k].leaves(bins) - first
                here = at >= 0  # rows in an earlier leaf have settled
                g, h = (p[:, k] - (y == k))[here], (p[:, k] * (1 - p[:, k]))[here]
                node, size, first_cell = at[here] * width, nodes * width, k * nodes * features * width
                part = sums[:, first_cell:first_cell + nodes * features * width].reshape(2, nodes, features, width)
                for f in range(features):
                    cell = node + bins[here, f]
                    for i, v in enumerate((g, h)):
                        part[i, :, f] += np.bincount(cell, weights=v, minlength=size).reshape(nodes, width)
        used = np.flatnonzero(sums[1])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(sums[0, used], loss)), pa.array(np.append(sums[1, used], 0.0))], names=["cell", "g", "h"])

    out, loss = np.zeros((2, int(np.prod(shape)))), 0.0
    for r in rows.mapInArrow(fold, "cell long, g double, h double").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
        if r["cell"] < 0:
            loss = r["g"]
        else:
            out[:, r["cell"]] = r["g"], r["h"]
    return out.reshape(2, *shape), loss


def best_cut(g: np.ndarray, h: np.ndarray, l2: float, least: float) -> tuple[int, int] | None:
    """(feature, cut) of the best gain of a node's cells by (feature, bin), or None where no cut gains."""
    total_g, total_h = g[0].sum(), h[0].sum()
    gl, hl = g.cumsum(axis=1)[:, :-1], h.cumsum(axis=1)[:, :-1]
    gr, hr = total_g - gl, total_h - hl
    gain = np.round(gl ** 2 / (hl + l2) + gr ** 2 / (hr + l2) - total_g ** 2 / (total_h + l2), 9)
    gain = np.where((hl >= least) & (hr >= least), gain, -np.inf)
    at = int(gain.argmax())
    return divmod(at, gain.shape[1]) if gain.flat[at] > 0 else None


def boost(df: DataFrame, features: Sequence[str], label: str, rounds: int = 100, depth: int = 3, rate: float = 0.1, l2: float = 1.0,
          least: float = 1.0, classes: int = 3, edges: Mapping[str, Sequence[float]] | None = None, keep: int = 20) -> Boosted:
    """Fit on the rows of ``df`` with a label 0 .. classes - 1; ``losses`` of the model holds the log loss before each round and after the last."""
    model = Boosted(list(features), edges or quantile_edges(df, features), classes)
    zero = F.array(*[F.lit(0.0)] * classes)
    rows = stored(binned(df.filter(F.col(label).isNotNull()), model, [F.col(label).cast("int").alias("y")]).withColumn("_m", zero), "bins")
    n, done = rows.count(), 0
    if not n:
        raise ValueError("no row has a label")
    for _ in range(rounds):
        size = (1 << (depth + 1)) - 1
        trees = [Tree(np.full(size, -1), np.zeros(size, dtype=np.int64), np.zeros(size)) for _ in range(classes)]
        for level in range(depth):
            sums, loss = _level(rows, model, done, trees, level)
            if level == 0:
                model.losses.append(loss / n)
            for k, t in enumerate(trees):
                for node in range(1 << level):
                    g, h = sums[0, k, node], sums[1, k, node]
                    at = (1 << level) - 1 + node
                    if not h[0].sum():
                        continue
                    leaf = lambda a, b: -rate * a / (b + l2)
                    cut = best_cut(g, h, l2, least)
                    if cut is None:
                        t.value[at] = leaf(g[0].sum(), h[0].sum())
                        continue
                    t.feature[at], t.cut[at] = f, c = cut
                    if level == depth - 1:  # the cells of the last cut hold the sums of both leaves
                        gl, hl = g[f, :c + 1].sum(), h[f, :c + 1].sum()
                        t.value[2 * at + 1], t.value[2 * at + 2] = leaf(gl, hl), leaf(g[f].sum() - gl, h[f].sum() - hl)
        model.rounds.append(trees)
        if len(model.rounds) - done >= keep:
            rows, done = stored(_with_margins(rows, model, done), "margins"), len(model.rounds)
    model.losses.append(_level(rows, model, done, [Tree(np.full(1, -1), np.zeros(1, dtype=np.int64), np.zeros(1))] * classes, 0)[1] / n)
    return model


def _with_margins(rows: DataFrame, model: Boosted, done: int) -> DataFrame:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch.column("_m"), np.float64) + model.margins(_bins(batch.column("_bins"), model), done)
                yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("_bins"), pa.array(list(m), pa.list_(pa.float64()))], names=["y", "_bins", "_m"])

    return rows.mapInArrow(add, "y int, _bins array<int>, _m array<double>")


def predict_boosted(model: Boosted, df: DataFrame) -> DataFrame:
    """``df`` plus p_h, p_d, p_a and pred (the most probable class, ties to the smaller one)."""
    bins = F.array(*[bin_of(F.col(f), model.edges[f]) for f in model.features])

    @F.arrow_udf("array<double>")
    def probabilities(b: pa.Array) -> pa.Array:
        if not len(b):
            return pa.array([], pa.list_(pa.float64()))
        return pa.array(list(softmax(model.margins(_bins(b, model)))), pa.list_(pa.float64()))

    out = df.withColumn("_p", probabilities(bins))
    named = {c: F.col("_p")[i] for i, c in enumerate(("p_h", "p_d", "p_a"))}
    return out.withColumns({**named, "pred": F.array_position("_p", F.array_max("_p")).cast("int") - 1}).drop("_p")


def leaf_rows(model: Boosted, number: int) -> list[tuple[int, int, int, int, float]]:
    """(class, node, feature, cut, value) of the used nodes of one round's trees; feature -1 is a leaf."""
    out = []
    for k, t in enumerate(model.rounds[number]):
        used = {0}
        for i in range(len(t.feature)):
            if i in used:
                out.append((k, i, int(t.feature[i]), int(t.cut[i]), float(t.value[i])))
                if t.feature[i] >= 0:
                    used |= {2 * i + 1, 2 * i + 2}
    return out
