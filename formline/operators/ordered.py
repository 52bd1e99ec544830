"""Global order without a global sort task: exact quantiles, ranks and row numbers.

Rows are counted and cut into as many near-equal buckets as their number needs (about ``SMALL`` rows
each, so one bucket is the plain ordered pass); edges come from a mergeable quantile sketch. Bucket
totals are one row a bucket, so their running sum is cheap, and the exact order is resolved inside
each bucket in parallel. The sketch only places the cuts; results are exact.

Edges are fetched once (one number a bucket) and used as constants: a sketch may come out a
little different when it runs again, and every branch of a plan must cut at the same places.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from formline.session import stored

SMALL = 500_000  # rows one ordered pass may hold


def buckets_for(rows: int, small: int) -> int:
    return max(1, -(-rows // max(1, small)))


def cut_points(df: DataFrame, col: str, buckets: int) -> Column:
    """Sorted bucket edges of ``col`` as a constant array of at most ``buckets - 1`` values."""
    probs = [i / buckets for i in range(1, buckets)]
    kind = df.schema[col].dataType
    if not probs:
        return F.array().cast(f"array<{kind.simpleString()}>")
    edges = df.agg(F.array_distinct(F.percentile_approx(F.col(col), probs, 10 * buckets)).alias("e")).first()["e"]
    return F.array(*[F.lit(e) for e in edges or []]).cast(f"array<{kind.simpleString()}>")


def with_bucket(df: DataFrame, col: str, edges: Column, buckets: int, out: str = "_b") -> DataFrame:
    """``df`` plus the number of edges below each value, looked up in two hops of about the root of ``buckets`` steps."""
    if buckets == 1:
        return df.withColumn(out, F.lit(0))
    v, step = F.col(col), max(1, round(buckets ** 0.5))
    below = lambda arr: F.size(F.filter(arr, lambda e: e < v))
    coarse = df.withColumn("_edges", edges).withColumn(
        "_c", below(F.filter("_edges", lambda e, i: (i % step) == step - 1)) * step)
    return coarse.withColumn(out, F.col("_c") + below(F.slice("_edges", F.col("_c") + 1, step))).drop("_edges", "_c")


def running_counts(counts: DataFrame, value: str, sums: Sequence[str], keys: Sequence[str] = (), small: int = SMALL) -> DataFrame:
    """``counts`` plus ``<s>_before`` for each summed column: total over all smaller values.

    ``counts`` has one row per (keys, value), already written (see ``stored``): it is passed over
    several times. Keys name a small set of series (columns, folds). The order is resolved bucket by bucket,
    in buckets of about ``small`` rows of all series together.
    """
    buckets = buckets_for(counts.count(), small)
    cut = with_bucket(counts, value, cut_points(counts, value, buckets), buckets)
    inside = W.partitionBy(*keys, "_b").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    if buckets == 1 and not keys:
        # nothing stands before the only bucket, and a join on its constant number would be a cross join
        out = cut.withColumns({f"_o_{s}": F.lit(0) for s in sums})
    else:
        totals = cut.groupBy(*keys, "_b").agg(*[F.sum(s).alias(s) for s in sums])
        before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
        offsets = totals.select(*keys, "_b", *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"_o_{s}") for s in sums])
        out = cut.join(offsets, [*keys, "_b"])
    return out.withColumns({
        f"{s}_before": F.col(f"_o_{s}") + F.coalesce(F.sum(s).over(inside), F.lit(0)) for s in sums
    }).drop("_b", *[f"_o_{s}" for s in sums])


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(col, p, q): linear-interpolated quantiles, the same rule as ``percentile``.

    ``percentile`` keeps every distinct value of the input in one task. Here a sketch brackets each
    wanted rank; one aggregate counts what lies below each bracket, and only the values inside one,
    about one in 250 a probability, are grouped and ordered in buckets. No pass copies or shuffles the rows.
    """
    accuracy = 1_000
    eps = 2.0 / accuracy
    low, high = [max(0.0, p - eps) for p in probs], [min(1.0, p + eps) for p in probs]
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    sketch = numbers.agg(*[F.struct(
        F.count(c).alias("total"), F.min(c).alias("vmin"), F.max(c).alias("vmax"),
        F.percentile_approx(c, low, accuracy).alias("lo"), F.percentile_approx(c, high, accuracy).alias("hi")).alias(c) for c in cols]).first()
    # (rank, low edge, high edge) per column and probability: len(cols) * len(probs) constants.
    brackets = {}
    for c in cols:
        st = sketch[c]
        for k, p in enumerate(probs):
            if st["total"]:
                brackets[c, k] = ((st["total"] - 1) * p, st["vmin"] if low[k] <= 0 else st["lo"][k],
                                  st["vmax"] if high[k] >= 1 else st["hi"][k])

    if not brackets:
        return df.sparkSession.createDataFrame([], "col string, p double, q double")
    # What lies outside is counted where it is; only the few values inside a bracket leave their row.
    outside = []
    for c, k in brackets:
        _, lo, hi = brackets[c, k]
        x = F.col(c)
        outside.append(F.struct(F.count_if(x < lo).alias("skip"), F.max(F.when(x < lo, x)).alias("under"), F.min(F.when(x > hi, x)).alias("over")).alias(f"{c}|{k}"))
    ends = numbers.agg(*outside).first()
    held = [F.when(F.col(c).between(lo, hi), F.struct(F.lit(c).alias("col"), F.lit(k).alias("k"), F.col(c).alias("value"))) for (c, k), (_, lo, hi) in brackets.items()]
    cells = numbers.select(F.inline(F.array_compact(F.array(*held)))).groupBy("col", "k", "value").agg(F.count(F.lit(1)).alias("n"))
    # one row per column and probability: on few rows a wanted rank can be the neighbour of its bracket
    wanted = df.sparkSession.createDataFrame(
        [(c, k, float(probs[k]), float(rank), *ends[f"{c}|{k}"]) for (c, k), (rank, _, _) in brackets.items()], "col string, k int, p double, rank double, skip long, under double, over double")
    placed = running_counts(stored(cells, "quantile-cells"), "value", ["n"], keys=["col", "k"]).join(F.broadcast(wanted), ["col", "k"])
    start = F.col("skip") + F.col("n_before")
    inside = lambda at: F.max(F.when((start <= at) & (at < start + F.col("n")), F.col("value")))
    beyond = lambda at: F.when(at < F.first("skip"), F.first("under")).otherwise(F.first("over"))
    pick = lambda at: F.coalesce(inside(at), beyond(F.first(at)))
    both = placed.groupBy("col", "k", "p", "rank").agg(pick(F.floor("rank")).alias("a"), pick(F.ceil("rank")).alias("b"))
    return both.select("col", "p", (F.col("a") + (F.col("rank") - F.floor("rank")) * (F.col("b") - F.col("a"))).alias("q"))


def narrow(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The named columns as doubles, written once: input of operators that pass over it several times."""
    return stored(df.select(*[F.col(c).cast("double").alias(c) for c in cols]), "narrow")


def quantile_row(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """One row: ``<col>_q<i>`` for each column and each probability by position. ``df`` is passed over twice."""
    q = exact_quantiles(df, cols, probs)
    return q.agg(*[F.max(F.when((F.col("col") == c) & (F.col("p") == F.lit(float(p))), F.col("q"))).alias(f"{c}_q{i}")
                   for c in cols for i, p in enumerate(probs)])


def ranks_by_row(rows: DataFrame, row: str, cols: Sequence[str], suffix: str = "_rank") -> DataFrame:
    """(row, <col><suffix>...): the tie-averaged rank of each column over its non-null values; null for rows with nulls only.

    All columns are ranked together: one table of distinct (column, value), one ordered pass, one join back. ``rows`` is
    written (see ``stored``) and ``row`` names each of its rows once.
    """
    long = rows.select(row, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot([row], list(cols), "_c", "_v").filter(F.col("_v").isNotNull())
    counts = stored(long.groupBy("_c", "_v").agg(F.count(F.lit(1)).alias("n")), "ranks")
    ranked = running_counts(counts, "_v", ["n"], keys=["_c"]).select("_c", "_v", (F.col("n_before") + (F.col("n") + 1) / 2).alias("_r"))
    placed = long.join(ranked, ["_c", "_v"])
    return placed.groupBy(row).agg(*[F.max(F.when(F.col("_c") == c, F.col("_r"))).alias(c + suffix) for c in cols])


def average_ranks(df: DataFrame, cols: Sequence[str], suffix: str = "_rank") -> DataFrame:
    """``df`` plus the tie-averaged rank of each column over its non-null values."""
    rows = stored(df.withColumn("_row", F.monotonically_increasing_id()), "rank-rows")
    return rows.join(ranks_by_row(rows, "_row", cols, suffix), "_row", "left").drop("_row")


def _largest_day(df: DataFrame, t: str) -> tuple[object, int]:
    """The day with most rows and their number."""
    top = df.groupBy(t).agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.struct("n", t)).alias("d")).first()["d"]
    return (top[t], top["n"]) if top else (None, 0)


def with_row_number(df: DataFrame, t: str, id: str, out: str = "rn", small: int = SMALL) -> DataFrame:
    """Exact 1-based position in (t, id) order.

    Rows are ordered inside (day, id range). Ranges follow the ids of the largest day, about ``small`` of its rows each,
    so no task orders much more than that whatever one day holds. Offsets need one small ledger of days x id ranges.
    """
    day, n = _largest_day(df, t)
    buckets = buckets_for(n, small)
    cut = with_bucket(df, id, cut_points(df.filter(F.col(t).eqNullSafe(F.lit(day))), id, buckets), buckets)
    ledger = cut.groupBy(t, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy(t, "_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = ledger.select(t, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = W.partitionBy(t, "_b").orderBy(id)
    return (cut.join(offsets, [t, "_b"])
            .withColumn(out, (F.col("_o") + F.row_number().over(inside)).cast("long")).drop("_b", "_o"))


def keys_at_ranks(df: DataFrame, t: str, id: str, ranks: Column, small: int = SMALL) -> DataFrame:
    """(rank, t, id) of the rows at the given 1-based positions in (t, id) order.

    ``ranks`` is a short array. Days are counted first; only the days that hold a wanted position
    are looked into, and of their id ranges only those that hold one.
    """
    inside = lambda lo, n: F.filter("_ranks", lambda r: (r > lo) & (r <= lo + n))
    before = W.orderBy(t).rowsBetween(W.unboundedPreceding, -1)
    days = df.groupBy(t).agg(F.count(F.lit(1)).alias("_n")).withColumn("_o", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    hit = days.withColumn("_ranks", ranks).withColumn("_ranks", inside(F.col("_o"), F.col("_n"))).filter(F.size("_ranks") > 0)
    hit = stored(hit, "days")
    # At most one day, and below at most one cell, per wanted rank.
    rows = df.select(t, id).join(F.broadcast(hit.select(t, "_o", "_ranks")), t)
    buckets = buckets_for(hit.agg(F.sum("_n").alias("n")).first()["n"] or 0, small)
    cut = with_bucket(rows, id, cut_points(rows, id, buckets), buckets)
    cells = cut.groupBy(t, "_b").agg(F.count(F.lit(1)).alias("_n"), F.first("_o").alias("_o"), F.first("_ranks").alias("_ranks"))
    run = W.partitionBy(t).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("_o", F.col("_o") + F.coalesce(F.sum("_n").over(run), F.lit(0)))
    wanted = cells.withColumn("_ranks", inside(F.col("_o"), F.col("_n"))).filter(F.size("_ranks") > 0)
    near = cut.drop("_o", "_ranks").join(F.broadcast(wanted.select(t, "_b", "_o", "_ranks")), [t, "_b"])
    placed = near.withColumn("rank", F.col("_o") + F.row_number().over(W.partitionBy(t, "_b").orderBy(id)))
    return placed.filter(F.array_contains("_ranks", F.col("rank"))).select("rank", t, id)


def with_cut_positions(df: DataFrame, t: str, id: str, ranks: Column, out: str, small: int = SMALL) -> DataFrame:
    """``df`` plus how many of the wanted positions lie at or before each row. The rows are not shuffled."""
    found = keys_at_ranks(df, t, id, ranks, small=small)
    cuts = found.agg(F.array_sort(F.collect_list(F.struct(t, id))).alias("c")).scalar()
    here = F.struct(F.col(t), F.col(id))
    return df.withColumn("_cuts", cuts).withColumn(out, F.size(F.filter("_cuts", lambda c: c <= here))).drop("_cuts")
