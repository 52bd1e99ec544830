"""Temporal splits, classification metrics and significance.

Predictions are rows ``actual, pred`` with class codes 0/1/2 and probabilities ``p_h, p_d, p_a``.
Metrics are algebra on class counts, so facts are read once and only k x k cells travel.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from formline.functions.scalar import clip
from formline.operators.ordered import running_counts, with_cut_positions
from formline.session import stored

T, ID = "match_date", "match_id"
CLASSES = (0, 1, 2)
PROBS = ("p_h", "p_d", "p_a")
# Fixed values.
LOG_EPS = 1e-15
THRESHOLDS = (("random", 1 / 3), ("minimum", 0.436), ("good", 0.50), ("excellent", 0.55))
COMPOSITES = {"wide": (0.3, 0.2), "quick": (0.3, 0.15), "bench": (0.2, 0.15)}


# --- splits -----------------------------------------------------------------------------------

def split_by_date(df: DataFrame, cutoff: str) -> DataFrame:
    return df.withColumn("part", F.when(F.col(T) < F.lit(cutoff).cast("date"), "train").otherwise("test"))


def split_with_gap(df: DataFrame, train_end: str, test_start: str) -> DataFrame:
    """Rows between the two dates belong to neither side."""
    return df.withColumn("part", F.when(F.col(T) <= F.lit(train_end).cast("date"), "train")
                         .when(F.col(T) >= F.lit(test_start).cast("date"), "test").otherwise("gap"))


def split_by_season(df: DataFrame, train: Sequence[int], test: Sequence[int]) -> DataFrame:
    return df.withColumn("part", F.when(F.col("season").isin(*train), "train").when(F.col("season").isin(*test), "test"))


def last_n_split(df: DataFrame, n: int) -> DataFrame:
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    first_test = F.array(F.greatest(total - n + 1, F.lit(1)))
    cut = with_cut_positions(df, T, ID, first_test, "_cut")
    return cut.withColumn("part", F.when(F.col("_cut") >= 1, "test").otherwise("train")).drop("_cut")


def time_series_folds(df: DataFrame, n: int, out: str = "fold") -> DataFrame:
    """Expanding-window folds. ``fold`` i is tested in round i and trained on in every later round;
    -1 marks rows that are only ever trained on. Test size is floor(N / (n + 1))."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    size = F.floor(total / (n + 1))
    starts = F.array(*[total - (n - i) * size + 1 for i in range(n)])
    return with_cut_positions(df, T, ID, starts, out).withColumn(out, F.col(out) - 1)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """``weight`` = N / (k * n_class). The class table is k rows."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    shape = counts.agg(F.struct(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("k")).alias("s")).scalar()
    weights = counts.select(label, (shape["n"] / (shape["k"] * F.col("_n"))).alias("weight"))
    return df.join(F.broadcast(weights), label)


# --- combining models -------------------------------------------------------------------------

def hard_vote(preds: Sequence[Column]) -> Column:
    """Most voted class; the smallest class wins a tie."""
    votes = [sum((F.when(p == c, 1).otherwise(0) for p in preds), F.lit(0)) for c in CLASSES]
    best = F.greatest(*votes)
    return F.when(votes[0] == best, 0).when(votes[1] == best, 1).otherwise(2)


def arg_max(p: Sequence[Column]) -> Column:
    best = F.greatest(*p)
    return F.when(p[0] == best, 0).when(p[1] == best, 1).otherwise(2)


def soft_vote(probs: Sequence[Sequence[Column]]) -> list[Column]:
    return [sum((m[c] for m in probs[1:]), probs[0][c]) / len(probs) for c in range(3)]


def cascade(p_draw: Column, p_home: Column, threshold: float) -> tuple[Column, list[Column]]:
    """Draw detector first, then home or away among the rest."""
    rest = 1 - p_draw
    side = F.when(p_home >= 0.5, 0).otherwise(2)
    return F.when(p_draw >= threshold, 1).otherwise(side), [rest * p_home, p_draw, rest * (1 - p_home)]


# --- metrics ----------------------------------------------------------------------------------

def confusion(pred: DataFrame, classes: Sequence[int] = CLASSES) -> DataFrame:
    """(actual, pred, n) over the full class grid."""
    grid = F.array(*[F.struct(F.lit(a).alias("actual"), F.lit(p).alias("pred")) for a in classes for p in classes])
    cells = pred.groupBy("actual", "pred").agg(F.count(F.lit(1)).alias("n"))
    have = cells.agg(F.map_from_entries(F.collect_list(F.struct(F.struct("actual", "pred"), "n"))).alias("m"))
    return have.select("m", F.inline(grid)).select(
        "actual", "pred", F.coalesce(F.try_element_at("m", F.struct("actual", "pred")), F.lit(0)).alias("n"))


def class_report(matrix: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) per class plus macro and weighted means; 0/0 is 0."""
    per = matrix.select(F.inline(F.array(
        F.struct(F.col("actual").alias("c"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("actual") == F.col("pred"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("pred").alias("c"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("long").alias("hit"))))).groupBy("c").agg(*[F.sum(x).alias(x) for x in ("support", "predicted", "hit")])
    zero = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    per = per.select(F.col("c").cast("string").alias("label"), zero(F.col("hit"), F.col("predicted")).alias("precision"),
                     zero(F.col("hit"), F.col("support")).alias("recall"), "support")
    per = per.withColumn("f1", zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    cols = ("precision", "recall", "f1")
    mean = per.agg(*[F.avg(c).alias(c) for c in cols], F.sum("support").alias("support")).withColumn("label", F.lit("macro"))
    weighted = per.agg(*[zero(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in cols],
                       F.sum("support").alias("support")).withColumn("label", F.lit("weighted"))
    return per.unionByName(mean).unionByName(weighted)


def hit(actual: str = "actual", pred: str = "pred") -> Column:
    return (F.col(actual) == F.col(pred)).cast("double")


def accuracy_by_part(pred: DataFrame, part: str) -> DataFrame:
    return pred.groupBy(part).agg(F.count(F.lit(1)).alias("n"), F.avg(hit()).alias("accuracy"))


def gap_and_composite(pred: DataFrame, part: str = "part") -> DataFrame:
    """Train accuracy, test accuracy, their gap and the penalised composites."""
    acc = lambda p: F.avg(F.when(F.col(part) == p, hit()))
    out = pred.agg(acc("train").alias("train"), acc("test").alias("test")).withColumn("gap", F.col("train") - F.col("test"))
    return out.withColumns({f"composite_{k}": F.col("test") - lam * F.greatest(F.lit(0.0), F.col("gap") - tau)
                            for k, (lam, tau) in COMPOSITES.items()})


def row_log_loss(actual: Column, probs: Sequence[Column], eps: float = LOG_EPS) -> Column:
    """-ln of the probability of the true class, clipped and renormalised."""
    safe = [clip(p, eps, 1 - eps) for p in probs]
    own = F.when(actual == 0, safe[0]).when(actual == 1, safe[1]).when(actual == 2, safe[2])
    return -F.log(own / sum(safe[1:], safe[0]))


def roc_auc(df: DataFrame, label: Column, score: str) -> DataFrame:
    """Exact rank-sum AUC with tied scores sharing their rank. Rows collapse to distinct scores first."""
    counts = df.groupBy(F.col(score).alias("value")).agg(
        F.sum(label.cast("long")).alias("pos"), F.sum((~label).cast("long")).alias("neg"))
    run = running_counts(stored(counts, "scores"), "value", ["neg"])
    return run.agg(F.try_divide(F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0)),
                                F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))


def baselines(df: DataFrame, label: str) -> DataFrame:
    """uniform, majority, distribution-weighted and home-always accuracies, and which thresholds each beats."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n")
    one = counts.agg((F.lit(1.0) / F.count(F.lit(1))).alias("uniform"), (F.max("n") / total).alias("majority"),
                     F.try_divide(F.sum(F.col("n").cast("double") * F.col("n")), total.cast("double") * total).alias("weighted"),
                     (F.coalesce(F.sum(F.when(F.col(label) == 0, F.col("n"))), F.lit(0)) / total).alias("home_always"))
    names = ("uniform", "majority", "weighted", "home_always")
    out = one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names])))
    return out.withColumns({f"beats_{n}": (F.col("value") > v).cast("int") for n, v in THRESHOLDS})


# --- significance -----------------------------------------------------------------------------

def bootstrap_scores(df: DataFrame, hit_a: Column, hit_b: Column, n: int, seed: int) -> DataFrame:
    """(replicate, a, b): accuracies of two models on ``n`` paired resamples of the rows.

    Accuracy and its paired difference depend only on the four counts of (a right?, b right?).
    Resampling N rows with replacement is one multinomial draw of N over those four cells, so the
    rows are counted once and each replicate costs four numbers, whatever N is.
    """
    x, y = hit_a.cast("int"), hit_b.cast("int")
    cells = df.agg(F.array(*[F.count(F.when((x == i) & (y == j), 1)) for i in (0, 1) for j in (0, 1)]).alias("c")).scalar()

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for rep, c in zip(part["id"], part["c"]):
                counts = np.asarray(c, dtype=np.int64)
                total = counts.sum()
                got = np.random.default_rng([seed, int(rep)]).multinomial(total, counts / total)
                out.append((int(rep), (got[2] + got[3]) / total, (got[1] + got[3]) / total))
            yield pd.DataFrame(out, columns=["replicate", "a", "b"])

    return df.sparkSession.range(n).withColumn("c", cells).mapInPandas(draw, "replicate long, a double, b double")


def bootstrap_summary(scores: DataFrame) -> DataFrame:
    """95 % intervals of a, b and a - b, overlap share of the two intervals, and Cohen's d."""
    both = scores.withColumn("d", F.col("a") - F.col("b"))
    # ``scores`` holds one row per replicate, so the exact percentile is bounded.
    ci = [F.percentile(c, F.lit(p)).alias(f"{c}_{t}") for c in ("a", "b", "d") for p, t in ((0.025, "lo"), (0.975, "hi"))]
    one = both.agg(*ci, F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"),
                   F.sqrt((F.var_pop("a") + F.var_pop("b")) / 2).alias("pooled"))
    inter = F.greatest(F.lit(0.0), F.least("a_hi", "b_hi") - F.greatest("a_lo", "b_lo"))
    union = F.greatest("a_hi", "b_hi") - F.least("a_lo", "b_lo")
    return one.withColumns({"overlap_pct": F.try_divide(inter * 100, union),
                            "cohens_d": F.try_divide(F.abs(F.col("mean_a") - F.col("mean_b")), F.col("pooled"))})


DRAWS_PER_TASK = 8_000_000  # weights of a bootstrap that one task draws


def poisson_limits(most: int = 20) -> list[int]:
    """Of 2 ** 32 equal draws, how many give at most 0, 1, 2, ... for a Poisson law of mean one."""
    share, total, out = math.exp(-1), 0.0, []
    for i in range(most):
        total += share
        out.append(min(int(total * 2 ** 32), 2 ** 32 - 1))
        share /= i + 1
    return [x for i, x in enumerate(out) if i == 0 or x > out[i - 1]]


def poisson_cells(df: DataFrame, key: str, n: int, seed: int, by: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """(replicate, *by, w, *sums): weighted counts and sums of the rows of ``df`` in each of ``n`` bootstrap replicates.

    A row's weight in a replicate is a Poisson(1) draw from md5(seed:key:replicate / 4), eight hex digits each, so any engine gives the same one wherever
    the row lies, and no row is drawn by the driver. Only classes ``by`` travel: a row is folded into its replicates before the shuffle.
    """
    rows = df.select(F.col(key).cast("string").alias("_key"), *by, *[c.cast("double").alias(f"_{s}") for s, c in sums.items()])
    # a row makes ``n`` draws, so the rows are spread by their draws and not by their bytes
    rows = rows.repartition(max(1, -(-df.count() * n // DRAWS_PER_TASK)))
    groups = rows.withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(-(-n // 4) - 1))))
    drawn = groups.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), "_key", F.col("_g").cast("string"))))

    def weight(i: int) -> Column:
        u = F.substring("_h", 8 * i + 1, 8)  # eight hex digits stand in the order of their number
        w = F.when(u < f"{poisson_limits()[0]:08x}", 0)
        for m, limit in enumerate(poisson_limits()[1:], 1):
            w = w.when(u < f"{limit:08x}", m)
        return F.struct((F.col("_g") * 4 + i).alias("replicate"), w.otherwise(len(poisson_limits())).alias("_w"))

    each = drawn.select(*by, *[f"_{s}" for s in sums], F.inline(F.array(*[weight(i) for i in range(4)]))).filter((F.col("_w") > 0) & (F.col("replicate") < n))
    return each.groupBy("replicate", *by).agg(F.sum("_w").alias("w"), *[F.sum(F.col("_w") * F.col(f"_{s}")).alias(s) for s in sums])


def replicate_scores(cells: DataFrame, actual: str = "actual", pred: str = "pred", loss: str = "loss") -> DataFrame:
    """(replicate, accuracy, macro_f1, log_loss) from cells of (replicate, actual, pred, w, loss)."""
    is_ = lambda c, k: F.col(c) == k
    total = F.sum("w")
    weight = lambda where: F.sum(F.when(where, F.col("w")).otherwise(0))
    f1 = [F.coalesce(F.try_divide(2 * weight(is_(actual, k) & is_(pred, k)), weight(is_(actual, k)) + weight(is_(pred, k))), F.lit(0.0)) for k in CLASSES]
    return cells.groupBy("replicate").agg((weight(F.col(actual) == F.col(pred)) / total).alias("accuracy"), (sum(f1[1:], f1[0]) / len(CLASSES)).alias("macro_f1"), (F.sum(loss) / total).alias("log_loss"))


def score_intervals(scores: DataFrame, metrics: Sequence[str], level: float = 0.95) -> DataFrame:
    """(metric, mean, std, lo, hi) over the replicates."""
    low = (1 - level) / 2
    long = scores.unpivot(["replicate"], list(metrics), "metric", "v")
    return long.groupBy("metric").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.percentile("v", F.lit(low)).alias("lo"), F.percentile("v", F.lit(1 - low)).alias("hi"))


def paired_t(folds: DataFrame, a: str, b: str) -> DataFrame:
    d = F.col(a) - F.col(b)
    one = folds.agg(F.count(d).alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("sd"))
    return one.select("n", "mean_diff", F.try_divide(F.col("mean_diff"), F.col("sd") / F.sqrt(F.col("n").cast("double"))).alias("t"),
                      (F.col("n") - 1).alias("df"))


def run_spread(runs: DataFrame, metric: str) -> DataFrame:
    one = runs.agg(F.count(metric).alias("runs"), F.min(metric).alias("min"), F.max(metric).alias("max"),
                   F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"))
    return one.withColumns({"lo": F.col("mean") - 2 * F.col("std"), "hi": F.col("mean") + 2 * F.col("std")})


# Bands of the batch-against-replay difference.
IMPACT_BANDS = (("Negligible", 0.005), ("Small", 0.01), ("Moderate", 0.02))
IMPACT_REST = "Large"
FLAT_SLOPE = 0.001


def compare_runs(batch: DataFrame, replay: DataFrame) -> DataFrame:
    """One row each of accuracy and log_loss -> differences, impact band, leakage estimate."""
    out = batch.select(F.struct("accuracy", "log_loss").alias("b")).withColumn(
        "r", replay.select(F.struct("accuracy", "log_loss")).scalar())
    diff = F.col("b.accuracy") - F.col("r.accuracy")
    band = F.lit(IMPACT_REST)
    for name, limit in reversed(IMPACT_BANDS):
        band = F.when(F.abs(diff) < limit, name).otherwise(band)
    return out.select(diff.alias("accuracy_diff"), (F.col("b.log_loss") - F.col("r.log_loss")).alias("log_loss_diff"),
                      band.alias("impact"), F.greatest(F.lit(0.0), diff).alias("leakage_estimate"))


def daily_trend(daily: DataFrame, t: str = T, value: str = "accuracy") -> DataFrame:
    """Slope of the daily value over the day index, and days beyond one std of the mean. One row per day."""
    st = daily.agg(F.struct(F.avg(value).alias("m"), F.stddev_pop(value).alias("s")).alias("x")).scalar()
    idx = daily.withColumns({"i": (F.row_number().over(W.orderBy(t)) - 1).cast("double"), "_x": st})
    out = idx.agg(F.regr_slope(F.col(value), F.col("i")).alias("slope"), F.count(F.lit(1)).alias("days"),
                  F.count(F.when(F.col(value) < F.col("_x.m") - F.col("_x.s"), 1)).alias("weak_days"),
                  F.count(F.when(F.col(value) > F.col("_x.m") + F.col("_x.s"), 1)).alias("strong_days"))
    return out.withColumn("direction", F.when(F.abs("slope") < FLAT_SLOPE, "Stable")
                          .when(F.col("slope") > 0, "Improving").otherwise("Declining"))


def gate(df: DataFrame, value: str, baseline: float, tolerance: float) -> DataFrame:
    diff = F.col(value) - baseline
    return df.withColumn("status", F.when(diff > 0, "improved").when(diff >= -tolerance, "maintained").otherwise("regressed"))
