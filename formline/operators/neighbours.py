"""Exact k nearest neighbours by pivots and triangle inequalities.

Rows with equal vectors are one point. Each point belongs to the cell of its nearest pivot; a cell over ``rows_per_cell`` gets pivots of its own from among its
points until none is larger, so no dense region makes a large task (up to MAX_PIVOTS, beyond which cells grow with the data). The points of a
cell meet first, so each knows its k-th distance there; the cell's radius and the k + 1 points nearest to each pivot give another bound, and the smaller one counts. Then
a point asks each further cell in which something could be nearer: neither its distance to the pivot less the radius, nor to the plane between the two pivots, exceeds its bound.
So every neighbour meets its point, and distances are computed between a cell's points and those who ask it only.

A cell's own points are held, the others pass by in batches; per point the best k + 1 (distance, id) stay. Distances are sums of squared
differences in the order of the components, so ties are exact and go to the smaller id. Cells are dealt to tasks by their number, not by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from formline.session import stored

MAX_PIVOTS, PAIRS = 4096, 1 << 21
CELLS_PER_TASK, PAIRS_PER_TASK = 4, 1 << 27
BEST = "array<struct<d:double,id:long>>"  # squared distances


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a and b, summed component by component."""
    out = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        out += (a[:, i, None] - b[None, :, i]) ** 2
    return out


def spread(points: DataFrame, pairs: int) -> DataFrame:
    """The rows in tasks of about PAIRS_PER_TASK distances; small files are no measure of this work."""
    return points.repartition(max(1, -(-pairs // PAIRS_PER_TASK)))


def in_cells(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``points`` (point, x, ids) with their cell and distance to its pivot."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, PAIRS // len(pivots))
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                d = squared(_matrix(some.column("x")), pivots)
                cell = d.argmin(axis=1)
                own = np.sqrt(d[np.arange(len(d)), cell])
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(cell.astype(np.int32)), pa.array(own)], names=[*some.schema.names, "cell", "d"])

    return points.mapInArrow(run, "point long, x array<double>, ids array<long>, cell int, d double")


def choose_pivots(points: DataFrame, rows_per_cell: int) -> tuple[DataFrame, np.ndarray]:
    """The points in cells of at most ``rows_per_cell``, and the pivots. Pivots are points with the smallest hashes."""
    mark = F.xxhash64("x")
    n = points.count()
    first = min(MAX_PIVOTS, max(1, -(-2 * n // rows_per_cell)))
    pivots = np.array([r["x"] for r in points.select("x", mark.alias("h")).orderBy("h", "x").limit(first).collect()])
    while True:
        placed = stored(in_cells(spread(points, n * len(pivots)), pivots), "cells")
        large = placed.groupBy("cell").count().filter(F.col("count") > rows_per_cell)
        room = MAX_PIVOTS - len(pivots)
        split = large.orderBy(F.desc("count"), "cell").limit(max(1, room // 4)).withColumn("more", F.least(F.ceil(2 * F.col("count") / rows_per_cell), F.lit(room)))
        picked = placed.join(split, "cell").withColumn("_rn", F.row_number().over(W.partitionBy("cell").orderBy(mark, "x"))).filter(F.col("_rn") <= MAX_PIVOTS)
        more = [r["x"] for r in picked.filter("_rn <= more and d > 0").select("x").collect()] if room else []  # bounded by MAX_PIVOTS
        if not more:
            return placed, pivots
        pivots = np.concatenate([pivots, np.array(more[:room])])


def reach_of_cells(placed: DataFrame, pivots: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """By cell: its radius, and a bound on the distance of the k-th neighbour of any of its points."""
    rank = F.row_number().over(W.partitionBy("cell").orderBy("d"))
    near = placed.select("cell", "d").withColumn("_rn", rank).filter(F.col("_rn") <= k + 1)
    radius, close = np.full(len(pivots), -1.0), np.full((len(pivots), k + 1), np.inf)
    for r in placed.groupBy("cell").agg(F.max("d").alias("d")).collect():
        radius[r["cell"]] = r["d"]
    for r in near.collect():  # k + 1 numbers a pivot
        close[r["cell"], r["_rn"] - 1] = r["d"]
    bound = np.full(len(pivots), np.inf)
    for i in np.flatnonzero(radius >= 0):
        between = np.sqrt(squared(pivots[i:i + 1], pivots))[0]
        reach = np.sort((radius[i] + between[:, None] + close).ravel())
        bound[i] = reach[k] if k < len(reach) else np.inf
    return radius, bound


def asking(inside: DataFrame, pivots: np.ndarray, radius: np.ndarray, bound: np.ndarray) -> DataFrame:
    """(cell, at, x): each point for every further cell in which it may have a neighbour."""
    between = np.sqrt(squared(pivots, pivots)) if len(pivots) <= 2048 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, PAIRS // len(pivots))
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                d2 = squared(_matrix(some.column("x")), pivots)
                cell = some.column("cell").to_numpy()
                gap = between[cell] if between is not None else np.sqrt(squared(pivots[cell], pivots))
                own = d2[np.arange(len(cell)), cell]
                with np.errstate(divide="ignore", invalid="ignore"):
                    plane = np.nan_to_num((d2 - own[:, None]) / (2 * gap), nan=0.0, posinf=0.0)
                slack = np.minimum(np.sqrt(some.column("reach").to_numpy()), bound[cell])[:, None] * (1 + 1e-9) + 1e-12
                may = (np.sqrt(d2) - radius <= slack) & (plane <= slack) & (radius >= 0)
                may[np.arange(len(cell)), cell] = False
                row, to = np.nonzero(may)
                out = some.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), out.column("at"), out.column("x")], names=["cell", "at", "x"])

    return inside.mapInArrow(run, "cell int, at long, x array<double>")


def best_of(d: np.ndarray, ids: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``keep`` smallest (d, id) of each row, in order; ``ids`` by row or for all rows."""
    ids = np.broadcast_to(ids, d.shape)
    if d.shape[1] > keep:
        edge = np.partition(d, keep - 1, axis=1)[:, keep - 1]
        row, col = np.nonzero(d <= edge[:, None])
    else:
        row, col = (x.ravel() for x in np.indices(d.shape))
    order = np.lexsort((ids[row, col], d[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    row, col, place = (x[place < keep] for x in (row, col, place))
    out_d, out_i = np.full((len(d), keep), np.inf), np.full((len(d), keep), np.iinfo(np.int64).max)
    out_d[row, place], out_i[row, place] = d[row, col], ids[row, col]
    return out_d, out_i


def _lists(d: np.ndarray, ids: np.ndarray) -> pa.Array:
    """(d, id) by row, nearest first, without the empty places."""
    used = d < np.inf
    ends = np.concatenate([[0], np.cumsum(used.sum(axis=1))]).astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array(d[used]), pa.array(ids[used])], names=["d", "id"])
    return pa.ListArray.from_arrays(pa.array(ends), pairs)


class Cell:
    """One cell's own points."""

    def __init__(self, key: int, keep: int) -> None:
        self.key, self.keep, self.own, self.rows = key, keep, [], None

    def add(self, rows: pa.RecordBatch) -> None:
        self.own.append(rows)

    def close(self) -> None:
        if self.rows is None:
            self.rows = pa.Table.from_batches(self.own).combine_chunks().to_batches()[0]
            ids = self.rows.column("ids")
            self.x, self.flat = _matrix(self.rows.column("x")), ids.flatten().to_numpy()
            self.count = np.diff(ids.offsets.to_numpy())

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best squared distances and ids among the own points, by row of ``x``."""
        self.close()
        out_d, out_i = np.full((len(x), self.keep), np.inf), np.full((len(x), self.keep), np.iinfo(np.int64).max)
        wide = max(self.keep, PAIRS // 256)  # a very large cell is passed in parts, and so are those who ask
        ends = np.concatenate([[0], np.cumsum(self.count)])
        for a in range(0, len(self.x), wide):
            b = min(a + wide, len(self.x))
            flat, count = self.flat[ends[a]:ends[b]], self.count[a:b]
            step = max(1, PAIRS // max(1, len(flat)))
            for at in range(0, len(x), step):
                d = squared(x[at:at + step], self.x[a:b])
                if (count != 1).any():
                    d = np.repeat(d, count, axis=1)
                d, ids = best_of(d, flat, self.keep)
                both = np.concatenate([out_d[at:at + step], d], axis=1), np.concatenate([out_i[at:at + step], ids], axis=1)
                out_d[at:at + step], out_i[at:at + step] = best_of(*both, self.keep)
        return out_d, out_i


def _met_inside(keep: int):
    """Rows in the order of cells -> each point with its best in its own cell."""
    def result(cell: Cell) -> pa.RecordBatch:
        d, ids = cell.nearest(_matrix(pa.concat_arrays([r.column("x") for r in cell.own])))
        cols = [cell.rows.column(c) for c in ("point", "x", "ids", "cell")]
        return pa.RecordBatch.from_arrays([*cols, pa.array(d[:, -1]), _lists(d, ids)], names=["point", "x", "ids", "cell", "reach", "best"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell: Cell | None = None
        for batch in batches:
            keys = batch.column("cell").to_numpy()
            cut = np.flatnonzero(np.concatenate([[True], np.diff(keys) != 0])) if len(keys) else []
            for a, b in zip(cut, [*cut[1:], len(keys)]):
                if cell is None or cell.key != keys[a]:
                    if cell is not None:
                        yield result(cell)
                    cell = Cell(int(keys[a]), keep)
                cell.add(batch.slice(a, b - a))
        if cell is not None:
            yield result(cell)

    return run


def _met_outside(keep: int):
    """Rows in the order of (cell, guest) -> each guest with its best in that cell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell: Cell | None = None
        for batch in batches:
            keys, guest = batch.column("cell").to_numpy(), batch.column("guest").to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(np.concatenate([[True], (np.diff(keys) != 0) | (guest[1:] != guest[:-1])])) if len(keys) else []
            for a, b in zip(cut, [*cut[1:], len(keys)]):
                if cell is None or cell.key != keys[a]:
                    cell = Cell(int(keys[a]), keep)
                rows = batch.slice(a, b - a)
                if guest[a]:
                    yield pa.RecordBatch.from_arrays([rows.column("at"), _lists(*cell.nearest(_matrix(rows.column("x"))))], names=["at", "best"])
                else:
                    cell.add(rows)

    return run


def exact_neighbours(rows: DataFrame, k: int, rows_per_cell: int = 2_000) -> DataFrame:
    """(id, nn): the ``k`` nearest other rows of each of ``rows`` (id long and unique, x array<double> of one length, no nulls) as (d, id), nearest first."""
    first = F.row_number().over(W.partitionBy("x").orderBy("id"))
    members = rows.select("id", "x").withColumn("_rn", first).filter(F.col("_rn") <= k + 1)
    points = members.groupBy("x").agg(F.min("id").alias("point"), F.array_sort(F.collect_list("id")).alias("ids")).select("point", "x", "ids")
    points = stored(points, "points")
    if points.isEmpty():
        return rows.select("id", F.array().cast("array<struct<d:double,id:bigint>>").alias("nn")).limit(0)
    placed, pivots = choose_pivots(points, rows_per_cell)
    radius, bound = reach_of_cells(placed, pivots, k)
    tasks = -(-len(pivots) // CELLS_PER_TASK)
    cells = placed.select("cell", "point", "x", "ids").repartition(tasks, "cell").sortWithinPartitions("cell")
    inside = cells.mapInArrow(_met_inside(k + 1), f"point long, x array<double>, ids array<long>, cell int, reach double, best {BEST}")
    inside = stored(inside.withColumn("at", F.monotonically_increasing_id()), "inside")
    asked = asking(spread(inside.select("at", "x", "cell", "reach"), inside.count() * len(pivots)), pivots, radius, bound)
    both = inside.select("cell", F.lit(False).alias("guest"), F.lit(None).cast("long").alias("at"), "x", "ids").unionByName(
        asked.withColumns({"guest": F.lit(True), "ids": F.array().cast("array<long>")}))
    outside = both.repartition(tasks, "cell").sortWithinPartitions("cell", "guest").mapInArrow(_met_outside(k + 1), f"at long, best {BEST}")
    each = inside.select("at", "point", "best").unionByName(outside, allowMissingColumns=True)
    best = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k + 1)
    found = each.groupBy("at").agg(F.max("point").alias("point"), F.transform(best, lambda c: F.struct(F.sqrt(c["d"]).alias("d"), c["id"].alias("id"))).alias("nn"))
    by_x = found.join(points.select("point", "x"), "point").select("x", "nn")
    # the list holds one more than wanted, as a row is its own nearest
    return rows.select("id", "x").join(by_x, "x").select("id", F.slice(F.filter("nn", lambda c: c["id"] != F.col("id")), 1, k).alias("nn"))
