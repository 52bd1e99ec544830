import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from formline.operators import information as inf


def psi(m):
    x = 0.0
    while m < 200:
        x -= 1.0 / m
        m += 1
    return x + math.log(m) - 0.5 / m - 1 / (12 * m ** 2) + 1 / (120 * m ** 4)


def plain(x, y, k):
    """The estimator row by row."""
    keep = [i for i in range(len(x)) if sum(b == y[i] for b in y) > 1]
    x, y = np.array([x[i] for i in keep]), np.array([y[i] for i in keep])
    terms = []
    for i in range(len(x)):
        mine = np.flatnonzero(y == y[i])
        w = min(k, len(mine) - 1)
        d = np.sort(np.abs(x[mine[mine != i]] - x[i]))[w - 1]
        near = np.abs(x - x[i]) < d if d > 0 else x == x[i]
        terms.append(psi(w) - psi(len(mine)) - psi(int(near.sum())))
    return max(0.0, psi(len(x)) + float(np.mean(terms)))


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(11)
    n = 700
    y = rng.integers(0, 3, size=n)
    y[:2] = 7, 8  # classes with one row
    cols = {"linked": y + rng.normal(size=n), "free": rng.normal(size=n) * 1e6, "ties": rng.integers(0, 6, size=n).astype(float), "hot": np.where(rng.random(n) < 0.4, 5.0, rng.normal(size=n)), "far": np.where(y == 2, 1e9, 0.0) + rng.random(n)}
    rows = [(int(y[i]), *[float(c[i]) for c in cols.values()]) for i in range(n)]
    df = spark.createDataFrame(rows, "y int, " + ", ".join(f"{c} double" for c in cols)).repartition(5)
    return df, y, cols


@pytest.mark.parametrize("k,rows_per_range", [(3, 250_000), (3, 60), (1, 30)])
def test_equals_plain_version_whatever_the_ranges(numbers, k, rows_per_range):
    df, y, cols = numbers
    got = {r["feature"]: r["mi"] for r in inf.knn_mutual_information(df, list(cols), "y", k, rows_per_range).collect()}
    assert set(got) == set(cols)
    for c, x in cols.items():
        assert got[c] == pytest.approx(plain(x, y, k), abs=1e-9), c


def test_ranges_hold_no_more_than_their_share(numbers):
    df, _, cols = numbers
    cells = df.select(F.lit("f").alias("feature"), "y", F.col("hot").alias("x")).groupBy("feature", "y", "x").count()
    sizes = [r["count"] for r in inf.ranged(cells, ["feature", "x", "y"], 50, "t").groupBy("_range").count().collect()]
    assert max(sizes) <= 2 * 50 and sum(sizes) == cells.count()


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, 1.0), (1, None), (1, float("nan")), (1, 2.0), (2, float("inf")), (1, 2.0)], "y int, x double")
    assert [r["mi"] for r in inf.knn_mutual_information(df, ["x"], "y").collect()] == [pytest.approx(0.0)]
    assert inf.knn_mutual_information(df.limit(0), ["x"], "y").collect() == []
