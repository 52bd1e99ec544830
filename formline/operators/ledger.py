"""Day ledgers: the skew-safe base of every strictly-before feature.

All rows of one key and one day share the same strict past. So facts are first folded to one
row per (key, day) with map-side partial aggregation, the running frame is computed on that
small ledger, and the answer is joined back on (key, day). A key that owns a third of all facts
costs one ledger row per day it was active, and its facts stay spread over the (key, day) hash.

Two kinds of past are served:
* sums and counts, over all days before or over a span of days before (``sums_before``);
* the last ``n`` rows, kept as a bounded array (``last_n_before``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from formline.functions.scalar import tail
from formline.session import stored

RANGE_ROWS = 1_000_000  # rows of one key that one ordered pass may hold


def day_sums(df: DataFrame, keys: Sequence[str], t: str, aggs: Mapping[str, Column]) -> DataFrame:
    """One row per (keys, day); ``aggs`` are additive aggregates."""
    return df.groupBy(*keys, t).agg(*[a.alias(n) for n, a in aggs.items()])


def sums_before(df: DataFrame, keys: Sequence[str], t: str, aggs: Mapping[str, Column],
                spans: Mapping[str, int | None] | None = None) -> DataFrame:
    """Ledger (keys, t, name...) of additive aggregates over strictly earlier days.

    ``spans`` maps a name suffix to a number of days (``[t-days, t)``) or None (all days before).
    A day without any earlier row holds NULL for sums.
    """
    spans = {"": None} if spans is None else spans
    days = day_sums(df, keys, t, aggs)
    by_day = W.partitionBy(*keys).orderBy(F.unix_date(t))
    cols = []
    for suffix, span in spans.items():
        frame = by_day.rangeBetween(W.unboundedPreceding if span is None else -span, -1)
        cols += [F.sum(n).over(frame).alias(n + suffix) for n in aggs]
    return days.select(*keys, t, *cols)


def day_tails(df: DataFrame, keys: Sequence[str], t: str, id: str, cols: Sequence[str], n: int, only: str | None = None) -> DataFrame:
    """(keys, t, tail): the last ``n`` rows of each key and day, oldest first.

    The rank filter is evaluated on the map side as well, so at most ``n`` rows per key, day and
    map task reach the shuffle. With ``only``, rows where that column is null leave their day in the ledger, but stand in no tail.
    """
    missing = [] if only is None else [F.col(only).isNull()]
    latest = W.partitionBy(*keys, t).orderBy(*missing, F.desc(id))
    have = [c for c in dict.fromkeys([*cols, *([] if only is None else [only])]) if c not in (t, id, *keys)]
    top = df.select(*keys, t, id, *have).withColumn("_rn", F.row_number().over(latest)).filter(F.col("_rn") <= n)
    item = F.struct(F.col(id).alias("id"), *[F.col(c) for c in cols])
    if only is not None:  # collect_list passes over nulls
        item = F.when(F.col(only).isNotNull(), item)
    return top.groupBy(*keys, t).agg(F.array_sort(F.collect_list(item)).alias("tail"))


def last_n_before(df: DataFrame, keys: Sequence[str], t: str, id: str, cols: Sequence[str], n: int,
                  out: str = "past", only: str | None = None) -> DataFrame:
    """Ledger (keys, t, out): the last ``n`` rows strictly before day ``t``, oldest first.

    Every ledger day holds at least one row, so ``n`` earlier days are always enough. With ``only``, rows
    where that column is null still have their day in the ledger but are no history themselves.
    """
    days = day_tails(df, keys, t, id, cols, n, only)
    if only is None:
        return _merged(days, keys, t, (-n, -1), n, out)
    # days with rows are numbered; a day without looks back from the number it has reached
    full = F.size("tail") > 0
    days = days.withColumn("_i", F.sum(full.cast("long")).over(W.partitionBy(*keys).orderBy(t)))
    by_number = W.partitionBy(*keys).orderBy("_i")
    before = F.collect_list("tail").over(by_number.rangeBetween(-n, -1))
    up_to = F.collect_list("tail").over(by_number.rangeBetween(1 - n, 0))
    merged = days.select(*keys, t, F.flatten(F.when(full, before).otherwise(up_to)).alias("_all"))
    return merged.select(*keys, t, tail(F.col("_all"), n).alias(out))


def _merged(days: DataFrame, keys: Sequence[str], t: str, rows: tuple[int, int], n: int, out: str) -> DataFrame:
    frame = W.partitionBy(*keys).orderBy(t).rowsBetween(*rows)
    # The list is a column of its own before it is cut, so it is built once.
    merged = days.select(*keys, t, F.flatten(F.collect_list("tail").over(frame)).alias("_all"))
    return merged.select(*keys, t, tail(F.col("_all"), n).alias(out))


def last_n_state(df: DataFrame, keys: Sequence[str], t: str, id: str, cols: Sequence[str], n: int,
                 out: str = "state", cluster: Sequence[str] | None = None) -> DataFrame:
    """Like ``last_n_before`` but including day ``t``: the state once the day is over.

    ``cluster`` names fewer keys to place the ledger by, when later steps work on those.
    """
    days = day_tails(df, keys, t, id, cols, n)
    if cluster:
        days = days.repartition(*cluster)
    return _merged(days, keys, t, (-(n - 1), 0), n, out)


def day_ranges(df: DataFrame, keys: Sequence[str], t: str, id: str, rows: int = RANGE_ROWS, out: str = "_t") -> DataFrame:
    """``df`` plus ``out``, a finer time: the day, or (day, range of ids) once some key has a day of more than ``rows`` rows.

    Ranges follow the order of ids, so (key, out) in order is (key, day, id) in order, and as many are cut as the largest day
    needs. Days within ``rows`` stay one range. Ids are numbers or times; equal ids share a range, null ids stand in the first.
    """
    days = df.groupBy(*keys, t).agg(F.count(F.lit(1)).alias("_n"))
    largest = days.agg(F.max("_n").alias("n")).first()["n"] or 0
    if largest <= rows:
        return df.withColumn(out, F.col(t))
    parts = -(-largest // rows)
    probs = [i / parts for i in range(1, parts)]
    hot = days.filter(F.col("_n") > rows).select(*keys, t)
    edges = df.select(*keys, t, id).join(hot, [*keys, t], "left_semi").groupBy(*keys, t).agg(
        F.array_distinct(F.percentile_approx(id, probs, 20 * parts)).alias("_edges"))
    edges = stored(edges, "day-ranges")  # a sketch may come out different when it runs again, and all readers must cut at the same places
    below = F.coalesce(F.size(F.filter("_edges", lambda e: e < F.col(id))), F.lit(0))
    return df.join(edges, [*keys, t], "left").withColumn(
        out, F.struct(F.col(t).alias("day"), F.greatest(below, F.lit(0)).alias("range"))).drop("_edges")


def last_rows_before(df: DataFrame, keys: Sequence[str], t: str, id: str, cols: Sequence[str], n: int,
                     out: str = "past", rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` plus the last ``n`` rows before each row in (t, id) order, same day included.

    The carry from earlier days comes from the ledger; only rows of one key and one day (or one id range of a day
    of more than ``rows`` rows, which inherits the tail of the range before it) are ordered together.
    """
    df = day_ranges(df, keys, t, id, rows)
    carry = last_n_before(df, keys, "_t", id, cols, n, out="_carry")
    item = F.struct(F.col(id).alias("id"), *[F.col(c) for c in cols])
    frame = W.partitionBy(*keys, "_t").orderBy(id).rowsBetween(-n, -1)
    today = df.withColumn("_today", F.collect_list(item).over(frame))
    joined = today.join(carry, [*keys, "_t"], "left")
    # Most rows are the only one of their day and take the carried list as it is.
    full = F.concat("_carry", "_today")
    past = F.when(F.size("_today") == 0, F.col("_carry")).otherwise(tail(full, n))
    return joined.withColumn(out, past).drop("_carry", "_today", "_t")


def attach(df: DataFrame, ledger: DataFrame, keys: Sequence[str], t: str) -> DataFrame:
    return df.join(ledger, [*keys, t], "left")


def attach_sides(df: DataFrame, ledger: DataFrame, cols: Sequence[str], t: str = "match_date",
                 also: Sequence[str] = ()) -> DataFrame:
    """Ledger of (ent, t) joined for both sides of each contest, without reshaping the facts."""
    out = df
    for side in ("home", "away"):
        part = ledger.select(F.col("ent").alias(side), t, *also, *[F.col(c).alias(f"{side}_{c}") for c in cols])
        out = out.join(part, [side, t, *also], "left")
    return out


def as_of(df: DataFrame, states: DataFrame, by: Sequence[str], t: str, cols: Sequence[str],
          allow_equal: bool = False) -> DataFrame:
    """Latest state row per key before (or at) each row's time; one state per key and time.

    Only the distinct (key, time) pairs of ``df`` take part in the ordered step; the facts
    themselves are joined by equality afterwards. With timestamps the ordered step runs inside
    (key, day), and what a day inherits comes from a ledger of each day's last state.
    """
    asked = df.select(*by, t).distinct()
    known = states.select(*by, t, F.struct(*cols).alias("_v"))
    if df.schema[t].dataType.typeName().startswith("timestamp"):
        day = F.to_date(t).alias("_d")
        ends = known.groupBy(*by, day).agg(F.max_by("_v", t).alias("_c"))
        days = asked.select(*by, day).distinct()
        carried = _latest(days, ends, by, "_d", "_c", False).withColumnRenamed("_last", "_carry")
        inside = _latest(asked.withColumn("_d", F.to_date(t)), known.withColumn("_d", F.to_date(t)), [*by, "_d"], t, "_v", allow_equal)
        found = inside.join(carried, [*by, "_d"]).select(*by, t, F.coalesce("_last", "_carry").alias("_last"))
    else:
        found = _latest(asked, known, by, t, "_v", allow_equal)
    return df.join(found.select(*by, t, "_last.*"), [*by, t], "left")


def _latest(asked: DataFrame, known: DataFrame, by: Sequence[str], t: str, value: str, allow_equal: bool) -> DataFrame:
    """``asked`` (by, t) plus ``_last``: the value of the latest known row."""
    left = asked.withColumn("_side", F.lit(1 if allow_equal else 0))
    right = known.select(*by, t, F.col(value).alias("_v")).withColumn("_side", F.lit(0 if allow_equal else 1))
    merged = right.unionByName(left, allowMissingColumns=True).withColumn("_asked", F.col("_v").isNull())
    frame = W.partitionBy(*by).orderBy(t, "_side").rowsBetween(W.unboundedPreceding, 0)
    return merged.withColumn("_last", F.last("_v", ignorenulls=True).over(frame)).filter("_asked").select(*by, t, "_last")
