import numpy as np
from pyspark.sql import functions as F

from formline.operators import cells as ce
from formline.operators import training as tr


def rows(spark, n):
    noise = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 1000
    out = spark.range(n).withColumns({"match_id": F.col("id"), "match_date": F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") / 20).cast("int")), "a": noise(1), "b": noise(2), "c": F.round(noise(3), 1)})
    return out.withColumn("y", F.when(noise(4) < 0.2, 1).when(F.col("b") + F.col("c") / 2 > 0.75, 2).otherwise(0))


def test_cells_count_every_row_of_each_round(spark):
    folded = tr.with_folds(rows(spark, 600), ["a", "c"], "y", 3)
    edges, classes = ce.fold_edges(folded, ["a", "c"], "y", 3)
    got = {(r["i"], r["code"]): (r["train"], r["test"]) for r in ce.fold_cells(folded, ["a", "c"], "y", edges, classes).collect()}
    want = {}
    for r in folded.collect():
        for i in range(3):
            if r["fold"] <= i:
                code = (r["y"] * 32 + int((edges[i][0] < r["a"]).sum())) * 32 + int((edges[i][1] < r["c"]).sum())
                train, test = want.get((i, code), (0, 0))
                want[i, code] = (train + (r["fold"] < i), test + (r["fold"] == i))
    assert classes == 3 and got == want
    assert all(len(e) <= 31 for cut in edges for e in cut)


def test_a_tree_of_counts_splits_as_a_tree_of_rows():
    rng = np.random.default_rng(7)
    bins, weight = rng.integers(0, 6, (3, 400)), rng.poisson(1, 400)
    y = np.where(rng.random(400) < 0.3, rng.integers(0, 3, 400), (bins[1] > 2) + (bins[2] > 3))

    def plain(at, depth):
        n = weight[at].sum()
        share = np.bincount(y[at], weights=weight[at], minlength=3) / n
        gini = lambda part: part.sum() and (weight[part].sum() * (1 - ((np.bincount(y[part], weights=weight[part], minlength=3) / max(weight[part].sum(), 1)) ** 2).sum()))
        best = (1e-9, None)
        for f in range(3):
            for b in range(6):
                left, right = at & (bins[f] <= b), at & (bins[f] > b)
                if min(weight[left].sum(), weight[right].sum()) >= 5:
                    gain = (gini(at) - gini(left) - gini(right)) / n
                    best = (gain, (left, right)) if gain > best[0] + 1e-12 else best
        if depth == 0 or best[1] is None:
            votes[at] = share
        else:
            for part in best[1]:
                plain(part, depth - 1)

    votes = np.zeros((400, 3))
    plain(np.ones(400, bool), 3)
    whole = ce.grow(y, bins, weight, 3, 3, 5, 3, rng).votes(bins)
    assert np.allclose(whole, votes)
    code = ((y * 32 + bins[0]) * 32 + bins[1]) * 32 + bins[2]
    found, at = np.unique(code, return_inverse=True)
    folded = ce.grow(*ce.unpacked(found, 3), np.bincount(at, weights=weight), 3, 3, 5, 3, rng).votes(bins)
    assert np.allclose(folded, votes)


def test_ablation_on_cells_scores_as_on_rows(spark):
    data, p = rows(spark, 6000), tr.ForestParams(trees=20, depth=5)
    on_rows, on_cells = (tr.ablation(data, ["a", "b", "c"], "y", 3, p, cell_rows=n) for n in (10**9, 0))
    assert [r[:2] for r in on_cells] == [r[:2] for r in on_rows] == [(1, "a"), (2, "b"), (3, "c")]
    for cell, row in zip(on_cells, on_rows):
        assert abs(cell[2] - row[2]) < 0.02 and abs(cell[3] - row[3]) < 0.02
    assert on_cells[2][2] > on_cells[1][2] + 0.03 > on_cells[0][2] + 0.06
    assert tr.ablation(data.repartition(5), ["a", "b", "c"], "y", 3, p, cell_rows=0) == on_cells  # whatever the partitions


def test_many_cells_go_back_to_rows(spark, monkeypatch):
    monkeypatch.setattr(tr, "CELLS", 10)
    data, p = rows(spark, 400), tr.ForestParams(trees=3, depth=2)
    assert tr.ablation(data, ["a", "b"], "y", 2, p, cell_rows=0) == tr.ablation(data, ["a", "b"], "y", 2, p)
