"""The contest log built from orders, customers and order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formline.functions.scalar import SEASON_START_MONTH, season_start
from formline.operators.shape import to_long

# Fixed values: (column, multiplier, gap) of each bookmaker price.
BOOKS = (
    ("B365H", 31, 29), ("B365D", 41, 29), ("B365A", 43, 29),
    ("PSH", 37, 17), ("PSD", 47, 17), ("PSA", 53, 17),
    ("BWH", 59, 13), ("BWD", 61, 13), ("BWA", 67, 13),
    ("WHH", 71, 11), ("WHD", 73, 11), ("WHA", 79, 11),
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def season_days(first: int | None = None, last: int | None = None) -> dict[str, str | None]:
    """``start`` and ``end`` of the seasons first to last (both inclusive, None: open), for ``contests``."""
    start = None if first is None else f"{first}-{SEASON_START_MONTH:02d}-01"
    end = None if last is None else f"{last + 1}-{SEASON_START_MONTH - 1:02d}-31"  # July
    return {"start": start, "end": end}


def line_measures(spark: SparkSession, folder: str) -> DataFrame:
    """Per order: quantity and line count on odd (home) and even (away) line numbers."""
    lines = table(spark, folder, "lineitem")
    odd = F.col("l_linenumber") % 2 == 1
    return lines.groupBy(F.col("l_orderkey").alias("match_id")).agg(
        F.sum(F.when(odd, F.col("l_quantity"))).alias("home_shots"),
        F.sum(F.when(~odd, F.col("l_quantity"))).alias("away_shots"),
        F.sum(F.when(odd, 1).otherwise(0)).alias("home_corners"),
        F.sum(F.when(odd, 0).otherwise(1)).alias("away_corners"),
    )


def contests(spark: SparkSession, folder: str, shots: bool = False, odds: bool = False, start: str | None = None,
             end: str | None = None) -> DataFrame:
    """One row per contest. The line-level measures cost a join and are opt-in.

    ``start`` and ``end`` (inclusive days) filter the stored time itself, so they reach the scan.
    """
    orders = table(spark, folder, "orders")
    kind = orders.schema["o_orderdate"].dataType.simpleString()
    if start is not None:
        orders = orders.filter(F.col("o_orderdate") >= F.lit(start).cast(kind))
    if end is not None:
        orders = orders.filter(F.col("o_orderdate") < F.date_add(F.lit(end).cast("date"), 1).cast(kind))
    pools = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("int").alias("pool"))
    base = F.floor("o_totalprice").cast("long") % 3
    margin = 1 + F.col("o_orderkey") % 3
    slot = F.col("o_custkey") % 20
    key = F.col("o_orderkey")
    date = F.to_date("o_orderdate")
    cols = [
        key.alias("match_id"), date.alias("match_date"), season_start(date).alias("season"), F.col("pool"),
        (F.col("pool") * 100 + slot).alias("home"),
        (F.col("pool") * 100 + (slot + 1 + key % 19) % 20).alias("away"),
        F.when(F.col("o_orderstatus") == "F", "H").when(F.col("o_orderstatus") == "O", "A").otherwise("D").alias("result"),
        (base + F.when(F.col("o_orderstatus") == "F", margin).otherwise(0)).alias("home_goals"),
        (base + F.when(F.col("o_orderstatus") == "O", margin).otherwise(0)).alias("away_goals"),
        F.when(key % 23 != 0, base + (key % 97).cast("double") / 50).alias("home_xg"),
        F.when(key % 23 != 0, base + (key % 89).cast("double") / 50).alias("away_xg"),
    ]
    if odds:
        cols += [F.when(key % gap != 0, F.lit(1.2) + ((key * mult) % 480).cast("double") / 100).alias(name)
                 for name, mult, gap in BOOKS]
    out = orders.join(pools, "o_custkey").select(*cols)
    if shots:
        out = out.join(line_measures(spark, folder), "match_id", "left")
    return out


def contests_long(spark: SparkSession, folder: str, shots: bool = False) -> DataFrame:
    return to_long(contests(spark, folder, shots=shots))
