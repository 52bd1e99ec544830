"""Nearest-neighbour mutual information between a number and a class.

Of n rows with numbers x and classes y, each row has the distance d to its k-th nearest other row of its class (k at most the class's
other rows) and the number m of rows of any class nearer than d, itself included; rows at distance 0 count where d is 0. The estimate is
psi(n) + mean psi(k) - mean psi(class size) - mean psi(m), zero at least. Rows of a class with one row take no part. Nearer means by more than the rounding
of the numbers (2 ** -48 of their size), so the k-th neighbour itself is never counted.

Rows collapse to cells (feature, class, value) with counts first, so ties cost nothing. Cells are range-partitioned by (feature, value):
no range holds much more than its share, whatever one feature, class or value holds. Each range gets the k cells of each class before and after it (a
halo, carried over ranges that hold fewer), so neighbours are found inside the ranges. Radii reach further than halos; they are counted
as two look-ups of a running count, ordered in ranges with the offsets of the ranges before them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from formline.operators.ledger import last_n_before
from formline.session import stored

ROWS_PER_RANGE = 250_000
SLACK = 2.0 ** -48


def digamma(m: Column) -> Column:
    """psi of a positive whole number: the asymptotic series at m + 8, stepped down."""
    m = m.cast("double")
    z = m + 8.0
    steps = sum((1.0 / (m + float(i)) for i in range(1, 8)), 1.0 / m)
    q = 1.0 / (z * z)
    return F.log(z) - 0.5 / z - q * (1.0 / 12 - q * (1.0 / 120 - q * (1.0 / 252 - q / 240))) - steps


def ranged(df: DataFrame, order: Sequence[str], rows_per_range: int, name: str) -> DataFrame:
    """``df`` written in ranges of about ``rows_per_range`` rows of the given order, with their number as ``_range``."""
    first = stored(df, name)
    ranges = max(1, -(-first.count() // rows_per_range))
    return stored(first.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), name)


def _kth_distance(around: Column, x: Column, wanted: Column) -> Column:
    """Distance at which the cells ``around`` hold ``wanted`` rows."""
    by_distance = F.array_sort(F.transform(around, lambda c: F.struct(F.abs(c["x"] - x).alias("d"), c["n"].alias("n"))))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("d"))
    walk = F.aggregate(by_distance, none, lambda s, c: F.when(s["n"] >= wanted, s).otherwise(F.struct((s["n"] + c["n"]).alias("n"), c["d"].alias("d"))))
    return walk["d"]


def neighbour_radii(cells: DataFrame, k: int) -> DataFrame:
    """``cells`` (feature, y, x, n, size of the class, _range) plus wanted (k or fewer) and d, the distance of the k-th neighbour."""
    keys = ["feature", "y"]
    before = last_n_before(cells, keys, "_range", "x", ["x", "n"], k, out="_before")
    turned = cells.select(*keys, (-F.col("_range")).alias("_range"), (-F.col("x")).alias("back"), "x", "n")
    after = last_n_before(turned, keys, "_range", "back", ["x", "n"], k, out="_after").withColumn("_range", -F.col("_range"))
    item = F.struct("x", "n")
    inside = W.partitionBy(*keys, "_range").orderBy("x")
    near = cells.withColumns({"_left": F.collect_list(item).over(inside.rowsBetween(-k, -1)), "_right": F.collect_list(item).over(inside.rowsBetween(1, k))})
    near = near.join(before, [*keys, "_range"], "left").join(after, [*keys, "_range"], "left")
    none = F.array().cast("array<struct<x:double,n:bigint>>")
    halo = lambda c: F.coalesce(F.transform(c, lambda r: F.struct(r["x"].alias("x"), r["n"].alias("n"))), none)
    own = F.array(F.struct(F.col("x"), (F.col("n") - 1).alias("n")))
    around = F.concat(own, "_left", "_right", halo("_before"), halo("_after"))
    near = near.withColumn("wanted", F.least(F.lit(k).cast("long"), F.col("size") - 1))
    return near.withColumn("d", _kth_distance(around, F.col("x"), F.col("wanted"))).drop("_left", "_right", "_before", "_after")


def rows_within(cells: DataFrame, rows_per_range: int) -> DataFrame:
    """feature, n, size, wanted of each of ``cells`` (with d), and m, the rows of any class nearer than d."""
    radius = F.greatest(F.col("d") - (F.abs("x") + F.col("d")) * SLACK, F.lit(0.0))
    about = F.struct("y", "x", "n", "size", "wanted")
    points = cells.groupBy("feature", F.col("x").alias("v")).agg(F.sum("n").alias("held")).select(
        "feature", "v", F.lit(1).alias("kind"), "held", F.lit(None).cast(cells.select(about.alias("c")).schema["c"].dataType).alias("c"))
    # the rows up to the upper end, less the rows below the lower end
    ends = F.array(F.struct((F.col("x") - radius).alias("v"), F.lit(0).alias("kind")), F.struct((F.col("x") + radius).alias("v"), F.lit(2).alias("kind")))
    asked = cells.select("feature", about.alias("c"), F.explode(ends).alias("e")).select("feature", "e.v", "e.kind", F.lit(0).cast("long").alias("held"), "c")
    rows = points.unionByName(asked).select("*", F.col("c.y").alias("_y"), F.col("c.x").alias("_x"))
    rows = ranged(rows, ["feature", "v", "kind", "_y", "_x"], rows_per_range, "mi-counts")
    totals = rows.groupBy("feature", "_range").agg(F.sum("held").alias("held"))
    earlier = F.sum("held").over(W.partitionBy("feature").orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    offsets = totals.select("feature", "_range", F.coalesce(earlier, F.lit(0)).alias("_offset"))
    inside = W.partitionBy("feature", "_range").orderBy("v", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    run = rows.withColumn("_run", F.sum("held").over(inside)).filter("kind <> 1").join(offsets, ["feature", "_range"])
    signed = (F.col("_run") + F.col("_offset")) * (F.col("kind") - 1)
    found = run.groupBy("feature", "c").agg(F.sum(signed).alias("m"))
    return found.select("feature", "c.n", "c.size", "c.wanted", "m")


def knn_mutual_information(df: DataFrame, features: Sequence[str], label: str, k: int = 3, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """(feature, mi) in nats between each of ``features`` and ``label``. Null, NaN and infinite numbers and null labels are left out."""
    long = df.select(F.col(label).alias("y"), *[F.col(f).cast("double").alias(f) for f in features]).unpivot(["y"], list(features), "feature", "x")
    usable = F.col("y").isNotNull() & F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf"))
    cells = long.filter(usable).groupBy("feature", "y", "x").agg(F.count(F.lit(1)).alias("n"))
    cells = ranged(cells, ["feature", "x", "y"], rows_per_range, "mi-cells")
    sizes = cells.groupBy("feature", "y").agg(F.sum("n").alias("size")).filter("size > 1")
    found = rows_within(neighbour_radii(cells.join(sizes, ["feature", "y"]), k), rows_per_range)
    total = F.sum("n")
    mean = lambda c: F.sum(F.col("n") * digamma(F.col(c))) / total
    return found.groupBy("feature").agg(F.greatest(digamma(total) + mean("wanted") - mean("size") - mean("m"), F.lit(0.0)).alias("mi"))
