"""League position as of a day.

The running table of one season is a small ordered list. It is rebuilt from a (season, entity,
day) ledger that streams through in day order in Arrow batches, holding only one number per
entity, so neither the facts nor a season's table for every day are ever materialised.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.operators.history import TABLE_SPAN, UNSEEN_POSITION
from formline.operators.ledger import attach_sides

_OUT = pa.schema([("pool", pa.int64()), ("season", pa.int32()), ("day", pa.int32()), ("ent", pa.int64()),
                  ("position", pa.int64()), ("ranked", pa.int64())])


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    season_key, day = None, None
    table: list[tuple[int, int]] = []  # (-points, entity), ordered
    points: dict[int, int] = {}
    pending: list[tuple[int, int]] = []

    def settle() -> None:
        for ent, pts in pending:
            if ent in points:
                del table[bisect_left(table, (-points[ent], ent))]
            points[ent] = points.get(ent, 0) + pts
            insort(table, (-points[ent], ent))
        pending.clear()

    for batch in batches:
        rows = batch.to_pydict()
        position, ranked = [], []
        for key, when, ent, pts in zip(zip(rows["pool"], rows["season"]), rows["day"], rows["ent"], rows["pts"]):
            if key != season_key:
                table.clear(), points.clear(), pending.clear()
                season_key, day = key, when
            elif when != day:
                settle()
                day = when
            seen = ent in points
            position.append(bisect_left(table, (-points[ent], ent)) + 1 if seen else None)
            ranked.append(len(table))
            pending.append((ent, pts))
        yield pa.RecordBatch.from_pydict(
            {"pool": rows["pool"], "season": rows["season"], "day": rows["day"], "ent": rows["ent"],
             "position": position, "ranked": ranked}, schema=_OUT)


def standings_before(long: DataFrame, keys: Sequence[str] = ("pool", "season")) -> DataFrame:
    """Ledger (pool, season, match_date, ent): position among the entities seen before the day, and how many there are."""
    days = long.groupBy(*keys, "match_date", "ent").agg(F.sum("points").cast("long").alias("pts"))
    typed = days.select(F.col("pool").cast("long").alias("pool"), F.col("season").cast("int").alias("season"),
                        F.unix_date("match_date").alias("day"), "ent", "pts")
    ordered = typed.repartition(*keys).sortWithinPartitions(*keys, "day", "ent")
    out = ordered.mapInArrow(_positions, "pool long, season int, day int, ent long, position long, ranked long")
    return out.withColumn("match_date", F.date_from_unix_date("day")).drop("day")


def positions_before(matches: DataFrame, long: DataFrame) -> DataFrame:
    """Home and away position before the match day, and (away - home + 20) / 40."""
    ledger = standings_before(long).select("ent", "season", "match_date", "position", "ranked")
    out = attach_sides(matches, ledger, ["position", "ranked"], also=["season"])
    pos = {s: F.coalesce(f"{s}_position", F.lit(UNSEEN_POSITION)).cast("long") for s in ("home", "away")}
    value = (pos["away"] - pos["home"] + TABLE_SPAN) / (2.0 * TABLE_SPAN)
    return out.withColumns({
        "home_position": pos["home"], "away_position": pos["away"],
        "position_value": F.when(F.coalesce("home_ranked", F.lit(0)) == 0, 0.5).otherwise(value),
    }).drop("home_ranked", "away_ranked")
