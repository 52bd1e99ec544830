import re

import numpy as np
import pytest

from formline.operators import neighbours as nb


def brute(ids, x, k):
    out = {}
    for i, a in zip(ids, x):
        d = [(float(np.sqrt(sum((p - q) ** 2 for p, q in zip(a, b)))), j) for j, b in zip(ids, x) if j != i]
        out[i] = sorted(d)[:k]
    return out


@pytest.mark.parametrize("rows_per_cell", [20_000, 60])
def test_neighbours_equal_brute_force(spark, rows_per_cell):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(200, 3)), rng.normal(size=(60, 3)) * 0.01 + 5, np.repeat([[1.0, 2.0, 3.0]], 70, axis=0), rng.integers(0, 3, size=(60, 3)).astype(float)])  # spread, dense, equal and tied rows
    ids = rng.permutation(len(x)).tolist()
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in zip(ids, x)], "id long, x array<double>").repartition(4)
    got = {r["id"]: [(c["d"], c["id"]) for c in r["nn"]] for r in nb.exact_neighbours(df, 4, rows_per_cell).collect()}
    want = brute(ids, x, 4)
    assert set(got) == set(want)
    for i in ids:
        assert [c[1] for c in got[i]] == [c[1] for c in want[i]] and np.allclose([c[0] for c in got[i]], [c[0] for c in want[i]], atol=1e-12)


def test_no_cell_is_larger_than_its_share(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(300, 2)), rng.normal(size=(600, 2)) * 1e-3])  # two thirds in one spot
    points = spark.createDataFrame([(i, [float(c) for c in v], [i]) for i, v in enumerate(x)], "point long, x array<double>, ids array<long>")
    placed, pivots = nb.choose_pivots(points, 100)
    assert max(r["count"] for r in placed.groupBy("cell").count().collect()) <= 100 and len(pivots) < 200


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [0.0]), (3, [4.0])], "id long, x array<double>")
    got = {r["id"]: [(c["d"], c["id"]) for c in r["nn"]] for r in nb.exact_neighbours(df, 5).collect()}
    assert got == {1: [(0.0, 2), (4.0, 3)], 2: [(0.0, 1), (4.0, 3)], 3: [(4.0, 1), (4.0, 2)]}
    assert nb.exact_neighbours(df.limit(0), 5).collect() == []


def test_cells_are_dealt_by_their_number_and_points_ask_few_of_them(spark):
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(4_000, 3)))], "id long, x array<double>")
    near = nb.exact_neighbours(rows, 5, 100)
    plan = near._jdf.queryExecution().toString()
    tasks = {int(n) for n in re.findall(r"hashpartitioning\(cell#\d+, (\d+)\)", plan)}
    assert tasks and min(tasks) >= 4_000 / 100 / nb.CELLS_PER_TASK  # 4,000 points are few bytes, but not one task
    points = spark.createDataFrame([(i, [float(c) for c in v], [i]) for i, v in enumerate(rng.normal(size=(4_000, 3)))], "point long, x array<double>, ids array<long>")
    placed, pivots = nb.choose_pivots(points, 100)
    radius, bound = nb.reach_of_cells(placed, pivots, 5)
    reach = [(r["point"], r["x"], r["cell"], 0.01) for r in placed.select("point", "x", "cell").collect()]
    asked = nb.asking(spark.createDataFrame(reach, "at long, x array<double>, cell int, reach double"), pivots, radius, bound)
    assert 0 < asked.count() < 4 * len(reach)  # a point's own bound counts, not its cell's
