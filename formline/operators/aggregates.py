"""Aggregations (A family). Everything is a partial-then-final aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.window import Window as W

from formline.functions.scalar import clip
from formline.operators.ordered import narrow, quantile_row

# Fixed values.
NEW_ENTITY_GAMES = 76
SEASON_GAMES = 380
MIN_GAMES_OWN_MEAN, MIN_GAMES_QUALITY = 5, 10
QUALITY_LOW, QUALITY_HIGH = 0.7, 1.3
METRIC_DEFAULTS = {"goals": 1.2, "xg": 1.3, "shots": 12.0, "corners": 5.0, "form": 1.0}


def value_share(df: DataFrame, col: str) -> DataFrame:
    counts = df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    # one row a value by now, so the total is their sum and the source is read once
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))


def group_mean(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    return df.groupBy(key).agg(*[F.avg(c).alias(f"mean_{c}") for c in cols])


def side_stats(long: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per entity: mean, sample std and count at each venue, and the overall mean."""
    aggs = []
    for c in cols:
        for v, tag in (("H", "home"), ("A", "away")):
            own = F.when(F.col("venue") == v, F.col(c))
            aggs += [F.avg(own).alias(f"{c}_{tag}_mean"), F.stddev_samp(own).alias(f"{c}_{tag}_std"),
                     F.count(own).alias(f"{c}_{tag}_n")]
        aggs.append(F.avg(c).alias(f"{c}_mean"))
    return long.groupBy("ent").agg(F.count("res").alias("games"), *aggs)


def grand_mean(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mean of two column means (not the pooled mean when null counts differ)."""
    return df.agg(((F.avg(a) + F.avg(b)) / 2).alias("grand_mean"))


def appearances(long: DataFrame, new_below: int = NEW_ENTITY_GAMES) -> DataFrame:
    """Games with a result of each entity in the log."""
    return long.groupBy("ent").agg(F.count("res").alias("games")).withColumn(
        "is_new", (F.col("games") < new_below).cast("int"))


def points_table(long: DataFrame, as_of=None) -> DataFrame:
    df = long if as_of is None else long.filter(F.col("match_date") < as_of)
    res = F.col("res")
    return df.groupBy("season", "ent").agg(
        F.count(res).alias("games"), F.count_if(res == 1).alias("wins"), F.count_if(res == 0).alias("draws"), F.count_if(res == -1).alias("losses"),
        F.coalesce(F.sum("points"), F.lit(0)).alias("points"), F.coalesce(F.sum(F.col("gf") - F.col("ga")), F.lit(0)).alias("goal_diff"))


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, mean, std, min, quartiles, max, nulls and zeros per column (long form)."""
    df = narrow(df, cols)
    aggs = []
    for c in cols:
        aggs += [F.count(c).alias(f"{c}|n"), F.avg(c).alias(f"{c}|mean"), F.stddev_samp(c).alias(f"{c}|std"),
                 F.min(c).cast("double").alias(f"{c}|min"), F.max(c).cast("double").alias(f"{c}|max"),
                 F.count(F.when(F.col(c).isNull(), 1)).alias(f"{c}|nulls"),
                 F.count(F.when(F.col(c) == 0, 1)).alias(f"{c}|zeros")]
    one = df.agg(*aggs).withColumn("_q", quantile_row(df, cols, [0.25, 0.5, 0.75]).select(F.struct("*")).scalar())
    stats = ("n", "mean", "std", "min", "max", "nulls", "zeros")
    rows = [F.struct(F.lit(c).alias("col"), *[F.col(f"`{c}|{s}`").alias(s) for s in stats],
                     *[F.col(f"_q.{c}_q{i}").alias(n) for i, n in enumerate(("q25", "q50", "q75"))]) for c in cols]
    return one.select(F.inline(F.array(*rows)))


def null_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in cols])
    rows = [F.struct(F.lit(c).alias("col"), F.col(c).alias("nulls"),
                     F.try_divide(F.col(c) * 100.0, F.col("_n")).alias("pct")) for c in cols]
    return one.select(F.inline(F.array(*rows)))


def date_extent(df: DataFrame, by: Sequence[str], t: str = "match_date") -> DataFrame:
    out = df.groupBy(*by).agg(F.min(t).alias("first_day"), F.max(t).alias("last_day"), F.countDistinct(t).alias("days"),
                              F.count(F.lit(1)).alias("n"))
    return out.withColumn("span", F.date_diff("last_day", "first_day"))


def period_counts(df: DataFrame, fmt: str, t: str = "match_date") -> DataFrame:
    return df.groupBy(F.date_format(t, fmt).alias("period")).agg(F.count(F.lit(1)).alias("n"))


def season_completeness(long: DataFrame, by: Sequence[str], expected: int = SEASON_GAMES) -> DataFrame:
    out = long.groupBy(*by).agg(F.sum((F.col("venue") == "H").cast("int")).alias("n"), F.countDistinct("ent").alias("entities"))
    return out.withColumns({"gap": F.col("n") - expected, "complete": (F.col("n") == expected).cast("int")})


def expected_density(df: DataFrame, per_year: int = SEASON_GAMES, t: str = "match_date") -> DataFrame:
    out = df.agg(F.date_diff(F.max(t), F.min(t)).alias("days"), F.count(F.lit(1)).alias("actual"))
    want = F.col("days") / 365.25 * per_year
    return out.withColumns({"expected": want, "density": F.try_divide(F.col("actual").cast("double"), want)})


def mode_value(df: DataFrame, col: str) -> DataFrame:
    """Most frequent value and its share; the smallest value wins a tie."""
    return value_share(df, col).orderBy(F.desc("n"), F.asc("value")).limit(1)


def sum_sq_shares(df: DataFrame, col: str) -> DataFrame:
    return value_share(df, col).agg(F.sum(F.col("share") * F.col("share")).alias("expected_accuracy"))


def side_accuracy(pred: DataFrame) -> DataFrame:
    """Accuracy credited to both entities of each contest."""
    both = pred.select(F.explode(F.array("home", "away")).alias("ent"), (F.col("actual") == F.col("pred")).cast("int").alias("hit"))
    return both.groupBy("ent").agg(F.count(F.lit(1)).alias("n"), F.avg("hit").alias("accuracy"))


def daily_accuracy(pred: DataFrame, loss=None) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n"), F.avg((F.col("actual") == F.col("pred")).cast("double")).alias("accuracy")]
    if loss is not None:
        aggs.append(F.avg(loss).alias("log_loss"))
    return pred.groupBy("match_date").agg(*aggs)


def selection_frequency(runs: DataFrame, selected: str = "selected") -> DataFrame:
    """Share of the runs that chose each feature. The runs themselves count under a null feature, so one pass gives both."""
    marked = F.concat(F.array(F.lit(None).cast("string")), F.coalesce(F.filter(selected, lambda f: f.isNotNull()), F.array().cast("array<string>")))
    counts = runs.select(F.explode(marked).alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    total = F.max(F.when(F.col("feature").isNull(), F.col("n"))).over(W.partitionBy())  # one row a feature
    return counts.withColumn("frequency", F.col("n") / total).filter("feature is not null")


def weighted_mean(df: DataFrame, key: str, value, weight) -> DataFrame:
    return df.groupBy(key).agg(F.try_divide(F.sum(value * weight), F.sum(weight)).alias("weighted_mean"))


def trend_recent_vs_old(hist: DataFrame, keys: Sequence[str], order: str, value: str, recent: int = 3) -> DataFrame:
    """Mean of the last 3 entries against the mean of the first max(1, n - 3)."""
    newest = W.partitionBy(*keys).orderBy(F.desc(order))
    last = (hist.select(*keys, order, value).withColumn("_rn", F.row_number().over(newest))
            .filter(F.col("_rn") <= recent).groupBy(*keys).agg(F.sum(value).alias("_ls"), F.count(value).alias("_ln")))
    every = hist.groupBy(*keys).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"), F.min_by(value, order).alias("_f"))
    out = every.join(last, list(keys))
    older = F.when(F.col("_n") > recent, (F.col("_s") - F.col("_ls")) / (F.col("_n") - recent)).otherwise(F.col("_f"))
    return out.select(*keys, (F.col("_ls") / F.col("_ln")).alias("recent"), older.cast("double").alias("older")).withColumn(
        "trend", F.when(F.col("recent") > F.col("older"), "improving").otherwise("declining"))


def coef_variation(df: DataFrame, keys: Sequence[str], value: str, stable_below: float = 0.05) -> DataFrame:
    out = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    cv = F.try_divide(F.col("std"), F.col("mean"))
    return out.withColumns({"cv": cv, "stable": (cv < stable_below).cast("int")})


def mix(pred: DataFrame) -> DataFrame:
    """Actual against predicted class counts and shares in one pass."""
    both = pred.select(F.inline(F.array(
        F.struct(F.col("actual").alias("value"), F.lit(1).alias("a"), F.lit(0).alias("p")),
        F.struct(F.col("pred").alias("value"), F.lit(0).alias("a"), F.lit(1).alias("p")))))
    out = both.groupBy("value").agg(F.sum("a").alias("actual_n"), F.sum("p").alias("pred_n"))
    total = F.sum("actual_n").over(W.partitionBy())
    return out.withColumns({"actual_share": F.col("actual_n") / total, "pred_share": F.col("pred_n") / total})


def robust_value(stats: DataFrame, league: DataFrame, metric: str) -> DataFrame:
    """Entity mean from five games on, else the league mean, else the constant."""
    own = F.when(F.col("games") >= MIN_GAMES_OWN_MEAN, F.col(f"{metric}_mean"))
    return stats.withColumn("robust", F.coalesce(own, league.scalar(), F.lit(METRIC_DEFAULTS.get(metric, 0.0))))


def quality_multiplier(stats: DataFrame, league: DataFrame, metric: str) -> DataFrame:
    ratio = clip(F.try_divide(F.col(f"{metric}_mean"), league.scalar()), QUALITY_LOW, QUALITY_HIGH)
    return stats.withColumn("multiplier", F.when(F.col("games") >= MIN_GAMES_QUALITY, F.coalesce(ratio, F.lit(1.0))).otherwise(1.0))
