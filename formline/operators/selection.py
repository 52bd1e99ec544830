"""Redundancy analysis and feature selection (R family).

Scores come from one aggregate over the facts; loops on the driver only ever see k-sized results.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from formline.functions.scalar import safe_corr
from formline.operators.ordered import ranks_by_row
from formline.session import stored

MIN_VARIANCE = 1e-10  # fixed value


def column_pairs(cols: Sequence[str]) -> list[tuple[str, str]]:
    return list(combinations(cols, 2))


def _rows(one: DataFrame, rows: list[Column]) -> DataFrame:
    return one.select(F.inline(F.array(*rows)))


def target_correlation(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    one = df.agg(*[safe_corr(F.col(f), F.col(label)).alias(f) for f in features])
    return _rows(one, [F.struct(F.lit(f).alias("feature"), F.col(f).alias("r")) for f in features])


def rank_scores(scores: DataFrame, by: Column) -> DataFrame:
    """One row per feature, so the global rank is over k rows."""
    return scores.withColumn("rank", F.row_number().over(W.orderBy(F.desc(by), F.asc("feature"))))


def pearson_pairs(df: DataFrame, cols: Sequence[str], others: Sequence[str] | None = None) -> DataFrame:
    """(f1, f2, r) for all pairs of ``cols``, or for ``cols`` x ``others``; a single pass."""
    pairs = column_pairs(cols) if others is None else [(a, b) for a in cols for b in others]
    one = df.agg(*[safe_corr(F.col(a), F.col(b)).alias(f"{a}|{b}") for a, b in pairs])
    return _rows(one, [F.struct(F.lit(a).alias("f1"), F.lit(b).alias("f2"), F.col(f"{a}|{b}").alias("r")) for a, b in pairs])


def spearman_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(f1, f2, rho) over the rows without a null; all columns are ranked in one pass."""
    rows = stored(df.select(*cols).dropna().withColumn("_row", F.monotonically_increasing_id()), "spearman")
    return pearson_pairs(ranks_by_row(rows, "_row", cols, ""), cols).withColumnRenamed("r", "rho")


def strongest_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(f1, f2, r): the larger size of Pearson's and Spearman's correlation of each pair."""
    both = pearson_pairs(df, cols).join(spearman_pairs(df, cols), ["f1", "f2"])  # one row a pair
    return both.select("f1", "f2", F.greatest(F.coalesce(F.abs("r"), F.lit(0.0)), F.coalesce(F.abs("rho"), F.lit(0.0))).alias("r"))


def cross_block_keep(df: DataFrame, new: Sequence[str], base: Sequence[str], limit: float = 0.75) -> DataFrame:
    """Largest |r| of each new column against the baseline block, and whether it is kept."""
    r = pearson_pairs(df, new, base)
    return r.groupBy(F.col("f1").alias("feature")).agg(F.max(F.abs("r")).alias("max_r")).withColumn(
        "keep", (F.coalesce("max_r", F.lit(0.0)) < limit).cast("int"))


def group_correlation(pairs: DataFrame, groups: Mapping[str, str]) -> DataFrame:
    """Mean off-diagonal |r| inside each named group of columns."""
    item = F.create_map(*[F.lit(x) for kv in groups.items() for x in kv])
    g = pairs.withColumns({"g1": item[F.col("f1")], "g2": item[F.col("f2")]}).filter("g1 = g2")
    return g.groupBy(F.col("g1").alias("grp")).agg(F.avg(F.abs("r")).alias("mean_r"), F.count("r").alias("pairs"))


def greedy_prune(pairs: Sequence[tuple[str, str, float]], score: Mapping[str, float], limit: float) -> list[str]:
    """Of each pair above the limit, strongest first, drop the less informative column still in play."""
    dropped: set[str] = set()
    strong = [p for p in pairs if p[2] is not None and abs(p[2]) >= limit]
    for a, b, _ in sorted(strong, key=lambda p: (-abs(p[2]), p[0], p[1])):
        if a not in dropped and b not in dropped:
            dropped.add(min((a, b), key=lambda c: (score.get(c, 0.0), c)))
    return [c for c in score if c not in dropped]


def anova_f(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """One-way F per feature from per-class counts, sums and sums of squares."""
    long = df.select(F.col(label).alias("_y"), *[F.col(f).cast("double").alias(f) for f in features]).unpivot(
        ["_y"], list(features), "feature", "x").filter(F.col("x").isNotNull())
    cls = long.groupBy("feature", "_y").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    tot = cls.groupBy("feature").agg(
        F.sum("n").alias("n_all"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("v")).alias("within"),
        F.collect_list(F.struct("n", "m")).alias("classes"))  # one entry a class
    mean = F.aggregate("classes", F.lit(0.0), lambda acc, c: acc + c["n"] * c["m"] / F.col("n_all"))
    between = F.aggregate(F.transform("classes", lambda c: F.col("n_all") * 0.0 + c["n"] * (c["m"] - F.col("mean")) * (c["m"] - F.col("mean"))), F.lit(0.0), lambda acc, x: acc + x)
    tot = tot.withColumn("mean", mean)
    f = F.try_divide(between / (F.col("k") - 1), F.col("within") / (F.col("n_all") - F.col("k")))
    return tot.select("feature", f.alias("f"))


def mutual_information(df: DataFrame, features: Sequence[str], label: str, bins: int = 10) -> DataFrame:
    """Binned mutual information (equal-width bins between min and max), in nats."""
    bounds = df.agg(*[F.min(f).cast("double").alias(f"{f}_lo") for f in features],
                    *[F.max(f).cast("double").alias(f"{f}_hi") for f in features])
    cut = df.withColumn("_s", bounds.select(F.struct("*")).scalar())

    def bin_of(f):
        lo, hi = F.col("_s")[f"{f}_lo"], F.col("_s")[f"{f}_hi"]
        at = F.floor(F.try_divide((F.col(f) - lo) * bins, hi - lo))
        return F.when(F.col(f).isNotNull(), F.coalesce(F.least(at, F.lit(bins - 1)), F.lit(0)))

    long = cut.select(F.col(label).alias("y"), *[bin_of(f).alias(f) for f in features]).unpivot(
        ["y"], list(features), "feature", "b").filter("b is not null and y is not null")
    cells = long.groupBy("feature", "b", "y").agg(F.count(F.lit(1)).alias("n"))
    by = lambda *c: F.sum("n").over(W.partitionBy("feature", *c))
    joint = cells.withColumns({"nb": by("b"), "ny": by("y"), "nt": by()})
    term = F.col("n") / F.col("nt") * F.log(F.col("n").cast("double") * F.col("nt") / (F.col("nb").cast("double") * F.col("ny")))
    return joint.groupBy("feature").agg(F.sum(term).alias("mi"))


def variance_filter(df: DataFrame, features: Sequence[str], limit: float = MIN_VARIANCE) -> DataFrame:
    one = df.agg(*[F.var_samp(f).alias(f) for f in features])
    out = _rows(one, [F.struct(F.lit(f).alias("feature"), F.col(f).alias("variance")) for f in features])
    return out.withColumn("keep", (F.coalesce("variance", F.lit(0.0)) >= limit).cast("int"))
