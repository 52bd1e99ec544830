"""Joins on composite keys, coverage and pair statistics (J family)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from formline.operators.ledger import as_of, attach_sides, sums_before
from formline.operators.ordered import running_counts
from formline.operators.shape import first_per_key
from formline.session import stored

MATCH_KEY = ("match_date", "home", "away")
COVERAGE_GATE = 0.95  # fixed value


def join_on_match(left: DataFrame, right: DataFrame, keys: Sequence[str] = MATCH_KEY, how: str = "left") -> DataFrame:
    """Typed composite-key join; only the columns the right side adds are carried."""
    return left.join(right.select(*keys, *[c for c in right.columns if c not in left.columns]), list(keys), how)


def join_dimension(df: DataFrame, mapping: DataFrame, col: str, source: str, target: str) -> DataFrame:
    """Replace ``col`` through a mapping table and keep what is unmapped. Spark picks the join by size."""
    names = mapping.select(F.col(source).alias(col), F.col(target).alias("_mapped"))
    return df.join(names, col, "left").withColumn(col, F.coalesce("_mapped", col)).drop("_mapped")


def join_first_pair(df: DataFrame, dim: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Join against the first row per key of ``dim`` in a stated order. The date is ignored: use ``as_of`` to be leak-free."""
    return df.join(first_per_key(dim, keys, order), list(keys), "left")


def coverage(left: DataFrame, right: DataFrame, keys: Sequence[str], gate: float = COVERAGE_GATE) -> DataFrame:
    """Matched, left-only and right-only distinct keys, the match rate and the gate, in one grouping."""
    tagged = (left.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r"))
              .unionByName(right.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r"))))
    seen = tagged.groupBy(*keys).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    both = F.sum(F.col("l") * F.col("r"))
    out = seen.agg(both.alias("matched"), F.sum(F.col("l") * (1 - F.col("r"))).alias("left_only"),
                   F.sum((1 - F.col("l")) * F.col("r")).alias("right_only"))
    rate = F.try_divide(F.col("matched").cast("double"), F.col("matched") + F.col("left_only"))
    return out.withColumn("match_rate", rate).withColumn("passed", (F.col("match_rate") >= gate).cast("int"))


def pair_difference_stats(state: DataFrame, order: str, value: str) -> DataFrame:
    """Mean, population std, min and max of ``value_i - value_j`` over all pairs i < j by ``order``.

    No pair is formed. With positions k = 0..n-1, each value counts (n-1-2k) times in the sum of
    differences, and the squares add up to n^2 times the variance. The extremes compare each value
    with the running extremes before it.
    """
    counts = state.select(F.col(order).alias("_k"), F.col(value).cast("double").alias("_v"), F.lit(1).alias("one"))
    placed = running_counts(stored(counts, "state"), "_k", ["one"]).withColumn("pos", F.col("one_before"))
    n = F.count(F.lit(1))
    # the square of all differences is n times the centred second moment, which var_pop merges without cancelling
    sums = placed.agg(n.cast("double").alias("n"), F.avg("_v").alias("m"), F.var_pop("_v").alias("v"),
                      F.avg(F.col("_v") * F.col("pos")).alias("mp"))
    blocks = placed.withColumn("_blk", F.floor(F.col("pos") / 4096))
    carry = blocks.groupBy("_blk").agg(F.max("_v").alias("mx"), F.min("_v").alias("mn"))
    prev = W.orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
    carry = carry.select("_blk", F.max("mx").over(prev).alias("mx"), F.min("mn").over(prev).alias("mn"))
    inside = W.partitionBy("_blk").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    run = blocks.join(carry, "_blk").withColumns({
        "hi": F.greatest("mx", F.max("_v").over(inside)), "lo": F.least("mn", F.min("_v").over(inside))})
    ends = run.agg(F.max(F.col("hi") - F.col("_v")).alias("max"), F.min(F.col("lo") - F.col("_v")).alias("min"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    mean = F.try_divide(F.col("n") * ((F.col("n") - 1) * F.col("m") - 2 * F.col("mp")), pairs)
    square = F.try_divide(F.col("n") * F.col("n") * F.col("v"), pairs)
    return (sums.select(pairs.cast("long").alias("pairs"), mean.alias("mean"),
                        F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("std"))
            .withColumn("_e", ends.select(F.struct("min", "max")).scalar()).select("pairs", "mean", "std", "_e.*"))


# Conditions assumed where no reading exists.
WEATHER_DEFAULTS = {"temperature": 15.0, "precipitation": 0.0, "wind_speed": 10.0, "humidity": 70.0}


def join_weather(df: DataFrame, places: DataFrame, readings: DataFrame, on: str) -> DataFrame:
    """Place of the home side -> (place, day) readings -> defaults where unmatched."""
    placed = df.join(places, on, "left")
    out = placed.join(readings, ["place", "match_date"], "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in WEATHER_DEFAULTS.items() if c in readings.columns})


__all__ = ["MATCH_KEY", "as_of", "attach_sides", "coverage", "join_dimension", "join_first_pair", "join_on_match",
           "join_weather", "pair_difference_stats", "sums_before"]
