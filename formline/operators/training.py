"""MLlib training over temporal folds.

Loops here run over grids, folds, classes and features, never over rows; each fit is one
distributed job on a table written once to the shared folder.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LogisticRegression, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline.operators import cells
from formline.operators.evaluation import CLASSES, hit, row_log_loss, time_series_folds
from formline.operators.neighbours import exact_neighbours
from formline.session import stored

# Fixed values.
SEED = 42
LEAK_DEPTH, LEAK_GAP = 3, 0.3
CELL_ROWS, CELLS = 2_000_000, 4_000_000


@dataclass(frozen=True)
class ForestParams:
    trees: int = 100
    depth: int = 10
    min_leaf: int = 5
    subset: str = "sqrt"
    extra: Mapping[str, object] = field(default_factory=dict)


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    """Feature vector; rows with a missing feature are left to the caller to fill or drop."""
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="error").transform(df)


def forest(label: str, p: ForestParams = ForestParams(), weight: str | None = None, seed: int = SEED) -> RandomForestClassifier:
    est = RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=p.trees, maxDepth=p.depth,
                                 minInstancesPerNode=p.min_leaf, featureSubsetStrategy=p.subset, seed=seed, **p.extra)
    return est.setWeightCol(weight) if weight else est


def logistic(label: str, weight: str | None = None, reg: float = 0.0) -> LogisticRegression:
    est = LogisticRegression(labelCol=label, featuresCol="features", maxIter=100, regParam=reg)
    return est.setWeightCol(weight) if weight else est


def boosted(label: str, rounds: int = 20, depth: int = 3, seed: int = SEED) -> OneVsRest:
    """Boosted trees for three classes: one binary booster per class."""
    return OneVsRest(classifier=GBTClassifier(maxIter=rounds, maxDepth=depth, seed=seed), labelCol=label, featuresCol="features")


def predict(model, df: DataFrame) -> DataFrame:
    """``pred`` and, where the model gives them, ``p_h, p_d, p_a``."""
    out = model.transform(df)
    cols = {"pred": F.col("prediction").cast("int")}
    if "probability" in out.columns:
        arr = vector_to_array("probability")
        cols |= {n: arr[i] for i, n in enumerate(("p_h", "p_d", "p_a"))}
    drop = [c for c in ("prediction", "rawPrediction", "probability") if c in out.columns]
    return out.withColumns(cols).drop(*drop)


def importances(model, features: Sequence[str]) -> list[tuple[str, float]]:
    """(feature, importance), most important first; ties by name."""
    values = model.featureImportances.toArray()
    return sorted(zip(features, map(float, values)), key=lambda x: (-x[1], x[0]))


def fold_scores(df: DataFrame, estimator, label: str, n: int) -> list[dict[str, float]]:
    """Train and test accuracy of each expanding-window fold; ``df`` carries ``fold`` and ``features``."""
    out = []
    for i in range(n):
        model = estimator.fit(df.filter(F.col("fold") < i))
        scored = predict(model, df.filter(F.col("fold") <= i)).withColumn("test", F.col("fold") == i)
        row = scored.agg(F.avg(F.when(~F.col("test"), hit(label))).alias("train"), F.avg(F.when(F.col("test"), hit(label))).alias("test")).first()
        out.append({"fold": i, "train": row["train"], "test": row["test"]})
    return out


def cross_validate(df: DataFrame, estimator, label: str, n: int = 5) -> dict[str, float]:
    return summary(fold_scores(df, estimator, label, n))


def summary(scores: Sequence[Mapping[str, float]]) -> dict[str, float]:
    n, test = len(scores), [s["test"] for s in scores]
    mean = sum(test) / n
    return {"mean": mean, "std": (sum((t - mean) ** 2 for t in test) / n) ** 0.5, "train": sum(s["train"] for s in scores) / n}


def grid_search(df: DataFrame, grid: Sequence[ForestParams], label: str, n: int = 3) -> list[dict[str, object]]:
    """Grid points by mean test accuracy over expanding-window folds, best first."""
    rows = [{"params": p, **cross_validate(df, forest(label, p), label, n)} for p in grid]
    return sorted(rows, key=lambda r: (-r["mean"], r["params"].trees, r["params"].depth))


def with_folds(df: DataFrame, features: Sequence[str], label: str, n: int) -> DataFrame:
    keep = ["match_id", "match_date", label, *features]
    # the borders of the folds take several passes, and none may compute the features again
    return stored(time_series_folds(stored(df.select(*keep), "fold-rows"), n), "folds")


def out_of_fold(df: DataFrame, estimator, n: int) -> DataFrame:
    """Predictions of each fold by the model trained on everything before it."""
    out = None
    for i in range(n):
        part = predict(estimator.fit(df.filter(F.col("fold") < i)), df.filter(F.col("fold") == i))
        out = part if out is None else out.unionByName(part)
    return out


# --- calibration and stacking -------------------------------------------------------------------

def fit_calibrator(scores: DataFrame, label: str, probs: Sequence[str] = ("p_h", "p_d", "p_a")) -> list:
    """One isotonic map per class. Equal scores are merged first (mean target, count as weight): same fit, less data."""
    models = []
    for c, p in zip(CLASSES, probs):
        merged = scores.groupBy(F.col(p).alias("features")).agg(
            F.avg((F.col(label) == c).cast("double")).alias("label"), F.count(F.lit(1)).cast("double").alias("weight"))
        models.append(IsotonicRegression(weightCol="weight").fit(merged))
    return models


def calibrate(df: DataFrame, models: Sequence, probs: Sequence[str] = ("p_h", "p_d", "p_a")) -> DataFrame:
    """Isotonic probabilities renormalised to one; uniform where all are zero."""
    out = df
    for m, p in zip(models, probs):
        out = m.setFeaturesCol(p).setPredictionCol(f"_{p}").transform(out)
    total = sum((F.col(f"_{p}") for p in probs[1:]), F.col(f"_{probs[0]}"))
    out = out.withColumns({f"cal_{p}": F.when(total > 0, F.col(f"_{p}") / total).otherwise(1.0 / len(probs)) for p in probs})
    return out.drop(*[f"_{p}" for p in probs])


def stack(base: Sequence[DataFrame], label: str, key: str = "match_id") -> tuple[DataFrame, LogisticRegression]:
    """Out-of-fold probabilities of several models side by side, and the meta learner to fit on them."""
    wide, cols = None, []
    for i, df in enumerate(base):
        names = [f"m{i}_{p}" for p in ("p_h", "p_d", "p_a")]
        part = df.select(key, *([label] if i == 0 else []), *[F.col(p).alias(n) for p, n in zip(("p_h", "p_d", "p_a"), names)])
        wide = part if wide is None else wide.join(part, key)
        cols += names
    return assemble(wide, cols), logistic(label)


# --- class balance ------------------------------------------------------------------------------

def _unit(*parts: Column) -> Column:
    """Uniform [0, 1) from a hash, the same for the same row on every run."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 30)) / float(1 << 30)


def oversample(df: DataFrame, features: Sequence[str], label: str, minority: int, key: str, copies: int = 1, k: int = 5,
               seed: int = SEED) -> DataFrame:
    """Synthetic minority rows on the segment to one of the ``k`` nearest neighbours (exact, of features scaled by their deviations).

    Rows with a missing feature are left out; a row without neighbours gives none.
    """
    rows = df.filter(F.col(label) == minority).select(F.col(key).alias("id"), F.array(*[F.col(f).cast("double") for f in features]).alias("v"))
    rows = stored(rows.filter(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c))), "minority")
    spread = rows.agg(*[F.stddev_pop(F.col("v")[i]).alias(f"s{i}") for i in range(len(features))]).first()
    scaled = F.array(*[F.col("v")[i] / F.lit(float(s or 1.0)) for i, s in enumerate(spread)])
    near = exact_neighbours(rows.select("id", scaled.alias("x")), k).filter(F.size("nn") > 0)
    each = near.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    pick = F.get("nn", F.pmod(F.xxhash64("id", "copy", F.lit(seed)), F.size("nn").cast("long")).cast("int"))["id"]
    ends = each.select("id", "copy", pick.alias("other")).join(rows, "id").join(rows.toDF("other", "w"), "other")
    step = _unit(F.col("id"), F.col("copy"), F.lit(seed + 1))
    synth = ends.select("id", "copy", F.zip_with("v", "w", lambda a, b: a + (b - a) * step).alias("y"))
    return synth.select(F.col("id").alias(key), "copy", *[F.col("y")[i].alias(f) for i, f in enumerate(features)], F.lit(minority).alias(label))


def undersample_centroids(df: DataFrame, features: Sequence[str], label: str, target: int, keep: Sequence[int] = (),
                          seed: int = SEED) -> DataFrame:
    """Each class not in ``keep`` is replaced by ``target`` cluster centres. A fit costs rows x target per round."""
    out = df.filter(F.col(label).isin(*keep)).select(*features, label) if keep else None
    for c in CLASSES:
        if c in keep:
            continue
        data = stored(assemble(df.filter(F.col(label) == c).select(*features), features), "majority")
        placed = KMeans(k=target, seed=seed, maxIter=20).fit(data).transform(data)
        # the centres are means of the placed rows, so they never pass the driver
        part = placed.groupBy("prediction").agg(*[F.avg(f).alias(f) for f in features]).select(*features, F.lit(c).alias(label))
        out = part if out is None else out.unionByName(part)
    return out


# --- probes -------------------------------------------------------------------------------------

def leak_probe(df: DataFrame, features: Sequence[str], label: str, n: int = 3, depth: int = LEAK_DEPTH) -> list[tuple]:
    """(feature, train, cv, gap, suspicious) of a shallow tree on each feature alone."""
    folded = with_folds(df, features, label, n)
    out = []
    for f in features:
        tree = DecisionTreeClassifier(labelCol=label, featuresCol="features", maxDepth=depth, seed=SEED)
        cv = cross_validate(assemble(folded.select("fold", label, f).dropna(), [f]), tree, label, n)
        gap = cv["train"] - cv["mean"]
        out.append((f, cv["train"], cv["mean"], gap, int(gap > LEAK_GAP)))
    return out


def eliminate(df: DataFrame, features: Sequence[str], label: str, keep: int, core: Sequence[str] = (),
              p: ForestParams = ForestParams(trees=20, depth=5)) -> list[str]:
    """Recursive elimination by forest importance; ``core`` features always stay."""
    data, left = stored(df.select(label, *features).dropna(), "rfe"), list(features)
    while len(left) > keep:
        ranked = importances(forest(label, p).fit(assemble(data, left)), left)
        loose = [f for f, _ in reversed(ranked) if f not in core]
        if not loose:
            break
        left.remove(loose[0])
    return left


def ablation(df: DataFrame, ordered: Sequence[str], label: str, n: int = 3,
             p: ForestParams = ForestParams(trees=20, depth=5), cell_rows: int = CELL_ROWS) -> list[tuple[int, str, float, float]]:
    """(size, added feature, mean, std) of nested feature lists.

    More than ``cell_rows`` rows are folded into cells first (see ``cells``): the same forests with other random numbers, on counts. Where the features make too many cells,
    or ``p`` has settings of MLlib's own, MLlib fits rows whatever their number.
    """
    folded = with_folds(df, ordered, label, n).dropna()
    found, sizes = None, range(1, len(ordered) + 1)
    subsets = [cells.subset_size(p.subset, i, p.trees) for i in sizes]
    if not p.extra and None not in subsets and folded.count() > cell_rows:
        found = cells.nested_accuracies(folded, ordered, label, n, p.trees, p.depth, p.min_leaf, subsets, SEED, CELLS)
    out = []
    for i in sizes:
        if found is None:
            cv = cross_validate(assemble(folded, ordered[:i]), forest(label, p), label, n)
        else:
            cv = summary([{"train": train, "test": test} for train, test in found[i - 1]])
        out.append((i, ordered[i - 1], cv["mean"], cv["std"]))
    return out


def evaluate(pred: DataFrame, label: str) -> DataFrame:
    return pred.agg(F.count(F.lit(1)).alias("n"), F.avg(hit(label)).alias("accuracy"),
                    F.avg(row_log_loss(F.col(label), [F.col(p) for p in ("p_h", "p_d", "p_a")])).alias("log_loss"))
