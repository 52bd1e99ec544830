"""Normalisers (N family): statistics fitted on one set, applied to another.

``fit`` is any DataFrame; pass the rows before the cut-off to stay leak-free, or the table itself
to reproduce a global fit. Fitted numbers enter the projection as one scalar subquery, so the
facts are never shuffled or joined.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline.functions.scalar import clip
from formline.operators.ordered import narrow, quantile_row

# Fixed values of the reference normalisers.
NEUTRAL = 0.5
TINY = 1e-6
Z_EPSILON = 1e-8
Z_CLIP = 3.0
IQR_CLIP = 2.0
QUARTILE_SIGMA = 0.675
DEFAULT_STATS = {
    "elo_diff": {"mean": 0.0, "std": 150.0, "min": -400.0, "max": 400.0},
    "form_diff": {"mean": 0.0, "std": 1.5, "min": -3.0, "max": 3.0},
    "goals_diff": {"mean": 0.0, "std": 1.0, "min": -3.0, "max": 3.0},
    "xg_diff": {"mean": 0.0, "std": 1.0, "min": -3.0, "max": 3.0},
    "shots_diff": {"mean": 0.0, "std": 8.0, "min": -20.0, "max": 20.0},
    "corners_diff": {"mean": 0.0, "std": 3.0, "min": -8.0, "max": 8.0},
}
STATIC_RANGES = {"elo_diff": (-400.0, 400.0), "form_diff": (-3.0, 3.0), "goals_diff": (-2.0, 2.0),
                 "xg_diff": (-2.0, 2.0), "shots_diff": (-10.0, 10.0), "corners_diff": (-5.0, 5.0)}


def fit(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row of moments and bounds for all columns, in one aggregate."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.min(x).alias(f"{c}_min"), F.max(x).alias(f"{c}_max"), F.avg(x).alias(f"{c}_mean"),
                 F.stddev_samp(x).alias(f"{c}_std"), F.max(F.abs(x)).alias(f"{c}_absmax")]
    return df.agg(*aggs)


def scalar_stats(stats: DataFrame) -> Column:
    return stats.select(F.struct("*").alias("_s")).scalar()


def _apply(df: DataFrame, stats: DataFrame, cols: Sequence[str], rule, suffix: str) -> DataFrame:
    st = df.withColumn("_st", scalar_stats(stats))
    return st.withColumns({c + suffix: rule(c, F.col(c).cast("double"), F.col("_st")) for c in cols}).drop("_st")


def min_max(df: DataFrame, stats: DataFrame, cols: Sequence[str], suffix: str = "_norm") -> DataFrame:
    """(x - min) / (max - min); a constant column becomes 0.5."""
    def rule(c, x, s):
        span = s[f"{c}_max"] - s[f"{c}_min"]
        return F.when(span > 0, (x - s[f"{c}_min"]) / span).otherwise(NEUTRAL)
    return _apply(df, stats, cols, rule, suffix)


def max_scale(df: DataFrame, stats: DataFrame, cols: Sequence[str], suffix: str = "_norm") -> DataFrame:
    return _apply(df, stats, cols, lambda c, x, s: F.when(s[f"{c}_max"] > 0, x / s[f"{c}_max"]).otherwise(0.0), suffix)


def fixed_range(x: Column, lo: float, hi: float, clipped: bool = True) -> Column:
    value = (x - lo) / (hi - lo)
    return clip(value, 0.0, 1.0) if clipped else value


def symmetric(df: DataFrame, stats: DataFrame, cols: Sequence[str], suffix: str = "_norm") -> DataFrame:
    """(x / max|x| + 1) / 2."""
    def rule(c, x, s):
        return F.when(s[f"{c}_absmax"] > 0, (x / s[f"{c}_absmax"] + 1) / 2).otherwise(NEUTRAL)
    return _apply(df, stats, cols, rule, suffix)


def fit_iqr(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Quartiles, std, and the bounds of the clipped scaled value."""
    df = narrow(df, cols)
    q = quantile_row(df, cols, [0.25, 0.75])
    st = q.withColumn("_m", scalar_stats(fit(df, cols)))
    outs = {}
    for c in cols:
        q25, iqr = F.col(f"{c}_q0"), F.col(f"{c}_q1") - F.col(f"{c}_q0")
        scaled = lambda v: clip(F.try_divide(v - q25, iqr), -IQR_CLIP, IQR_CLIP)
        # Scaling and clipping are monotone, so their extremes are those of the column itself.
        outs |= {f"{c}_q25": q25, f"{c}_iqr": iqr, f"{c}_std": F.col(f"_m.{c}_std"),
                 f"{c}_lo": scaled(F.col(f"_m.{c}_min")), f"{c}_hi": scaled(F.col(f"_m.{c}_max"))}
    return st.select(*[v.alias(k) for k, v in outs.items()])


def iqr_robust(df: DataFrame, stats: DataFrame, cols: Sequence[str], suffix: str = "_norm") -> DataFrame:
    """(x - q25)/iqr clipped to +-2, then min-max; no spread gives 0.5 everywhere."""
    def rule(c, x, s):
        flat = (s[f"{c}_std"] <= TINY) | (s[f"{c}_iqr"] <= TINY)
        scaled = clip(F.try_divide(x - s[f"{c}_q25"], s[f"{c}_iqr"]), -IQR_CLIP, IQR_CLIP)
        span = s[f"{c}_hi"] - s[f"{c}_lo"]
        return F.when(flat, NEUTRAL).otherwise(F.when(span > 0, (scaled - s[f"{c}_lo"]) / span).otherwise(F.when(x.isNotNull(), NEUTRAL)))
    return _apply(df, stats, cols, rule, suffix)


def fit_median_iqr(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    df = narrow(df, cols)
    q = quantile_row(df, cols, [0.25, 0.5, 0.75])
    st = q.withColumn("_m", scalar_stats(fit(df, cols)))
    outs = {}
    for c in cols:
        outs |= {f"{c}_med": F.col(f"{c}_q1"), f"{c}_iqr": F.col(f"{c}_q2") - F.col(f"{c}_q0"),
                 f"{c}_min": F.col(f"_m.{c}_min"), f"{c}_max": F.col(f"_m.{c}_max")}
    return st.select(*[v.alias(k) for k, v in outs.items()])


def robust_min_max(df: DataFrame, stats: DataFrame, cols: Sequence[str], suffix: str = "_norm") -> DataFrame:
    """Median/IQR scaling (unit scale when the IQR is 0) followed by min-max of the scaled column."""
    def rule(c, x, s):
        scale = F.when(s[f"{c}_iqr"] > 0, s[f"{c}_iqr"]).otherwise(1.0)
        z = lambda v: (v - s[f"{c}_med"]) / scale
        span = z(s[f"{c}_max"]) - z(s[f"{c}_min"])
        return F.when(span > 0, (z(x) - z(s[f"{c}_min"])) / span).otherwise(NEUTRAL)
    return _apply(df, stats, cols, rule, suffix)


def z_to_unit(x: Column, mean: Column, std: Column) -> Column:
    return clip((x - mean) / (std + Z_EPSILON), -Z_CLIP, Z_CLIP) / (2 * Z_CLIP) + 0.5


def z_clip(df: DataFrame, stats: DataFrame, cols: Sequence[str], suffix: str = "_norm") -> DataFrame:
    return _apply(df, stats, cols, lambda c, x, s: z_to_unit(x, s[f"{c}_mean"], s[f"{c}_std"]), suffix)


def auto(df: DataFrame, stats: DataFrame, cols: Sequence[str], suffix: str = "_norm") -> DataFrame:
    """constant -> 0.5; sin/cos columns -> (x+1)/2; non-negative -> min-max; else clipped z."""
    def rule(c, x, s):
        if c.endswith(("_sin", "_cos")):
            free = (x + 1) / 2
        else:
            lo, hi = s[f"{c}_min"], s[f"{c}_max"]
            free = F.when(lo >= 0, (x - lo) / (hi - lo + Z_EPSILON)).otherwise(z_to_unit(x, s[f"{c}_mean"], s[f"{c}_std"]))
        return F.when(s[f"{c}_min"] == s[f"{c}_max"], NEUTRAL).otherwise(free)
    return _apply(df, stats, cols, rule, suffix)


def p99_cap(df: DataFrame, fit_on: DataFrame, cols: Sequence[str], suffix: str = "_norm") -> DataFrame:
    q = quantile_row(narrow(fit_on, cols), cols, [0.99])
    return _apply(df, q, cols, lambda c, x, s: clip(F.try_divide(x, s[f"{c}_q0"]), 0.0, 1.0), suffix)


def dynamic(x: Column, stats: Column, method: str) -> Column:
    """Map a difference to [0, 1] from population statistics of all rating differences."""
    mean, std, lo, hi = (stats[k] for k in ("mean", "std", "min", "max"))
    if method == "z_score":
        return F.when(std > TINY, clip(((x - mean) / std + 2) / 4, 0.0, 1.0)).otherwise(NEUTRAL)
    if method == "min_max":
        return F.when(hi - lo > TINY, clip((x - lo) / (hi - lo), 0.0, 1.0)).otherwise(NEUTRAL)
    if method == "robust":
        q25, iqr = mean - QUARTILE_SIGMA * std, 2 * QUARTILE_SIGMA * std
        return F.when(iqr > TINY, (clip((x - q25) / iqr, -2.0, 3.0) + 2) / 5).otherwise(NEUTRAL)
    raise ValueError(method)


def with_default_stats(stats: Column, metric: str) -> Column:
    """Dynamic statistics where present, else the fixed defaults of the metric."""
    base: Mapping[str, float] = DEFAULT_STATS[metric]
    return F.struct(*[F.coalesce(stats[k].cast("double"), F.lit(v)).alias(k) for k, v in base.items()])


def standard(df: DataFrame, stats: DataFrame, cols: Sequence[str], suffix: str = "_norm") -> DataFrame:
    """(x - mean) / std with the population std, constant columns become 0."""
    def rule(c, x, s):
        return F.coalesce(F.try_divide(x - s[f"{c}_mean"], s[f"{c}_pop"]), F.when(x.isNotNull(), 0.0))
    return _apply(df, stats, cols, rule, suffix)


def fit_standard(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_pop")]
    return df.agg(*aggs)


def fill_mean(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    st = (fit_on if fit_on is not None else df).agg(*[F.avg(c).alias(c) for c in cols])
    out = df.withColumn("_st", scalar_stats(st))
    return out.withColumns({c: F.coalesce(F.col(c), F.col("_st")[c]) for c in cols}).drop("_st")


def fill_median(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    st = quantile_row(narrow(fit_on if fit_on is not None else df, cols), cols, [0.5])
    out = df.withColumn("_st", scalar_stats(st))
    return out.withColumns({c: F.coalesce(F.col(c), F.col("_st")[f"{c}_q0"]) for c in cols}).drop("_st")
