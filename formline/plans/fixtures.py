"""Derived inputs several queries share: pseudo-predictions and side tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.functions.scalar import CLASS_CODE, code
from formline.sources.contests import contests

# A deterministic pseudo-model: integer weights per class, normalised; smallest label wins ties.


def predictions(spark, d, shots: bool = False) -> DataFrame:
    w = [F.lit(1) + F.col("match_id") % k for k in (7, 3, 5)]
    total = w[0] + w[1] + w[2]
    pred = F.when((w[0] >= w[1]) & (w[0] >= w[2]), 0).when(w[1] >= w[2], 1).otherwise(2)
    return contests(spark, d, shots=shots).withColumns({
        "actual": code(F.col("result"), CLASS_CODE), "pred": pred,
        "p_h": w[0] / total, "p_d": w[1] / total, "p_a": w[2] / total})


def unplayed(spark, d) -> DataFrame:
    """The contest log with every seventh game not played yet."""
    m = contests(spark, d)
    return m.withColumns({c: F.when(F.col("match_id") % 7 != 0, F.col(c)) for c in ("result", "home_goals", "away_goals")})


PRED_SQL = """,
 wts as (select *, 1 + match_id % 7 wh, 1 + match_id % 3 wd, 1 + match_id % 5 wa from contests),
 preds as (select *, case result when 'H' then 0 when 'D' then 1 else 2 end actual,
   case when wh >= wd and wh >= wa then 0 when wd >= wa then 1 else 2 end pred,
   wh / cast(wh + wd + wa as double) p_h, wd / cast(wh + wd + wa as double) p_d, wa / cast(wh + wd + wa as double) p_a
   from wts)"""
