"""Projection, reshaping and set operators (P, O and U families)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline.functions.scalar import points

MEASURES = ("xg", "shots", "corners")


def to_long(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Two rows per contest in one pass over the input."""
    have = [m for m in MEASURES if f"home_{m}" in df.columns]

    def side(own: str, other: str, venue: str) -> Column:
        gf, ga = F.col(f"{own}_goals"), F.col(f"{other}_goals")
        fields = [F.col(own).alias("ent"), F.col(other).alias("opp"), F.lit(venue).alias("venue"),
                  gf.alias("gf"), ga.alias("ga"), points(gf, ga).alias("points"),
                  F.signum((gf - ga).cast("double")).cast("int").alias("res")]
        for m in have:
            fields += [F.col(f"{own}_{m}").alias(m), F.col(f"{other}_{m}").alias(f"{m}_against")]
        return F.struct(*fields)

    keep = ["match_id", "match_date", "season", "pool", *extra]
    return df.select(*keep, F.inline(F.array(side("home", "away", "H"), side("away", "home", "A"))))


def to_wide(long: DataFrame, cols: Sequence[str], by: Sequence[str] = ("match_id",)) -> DataFrame:
    """Back to one row per contest with ``home_``/``away_`` prefixes; one shuffle."""
    aggs = []
    for prefix, venue in (("home", "H"), ("away", "A")):
        aggs += [F.max(F.when(F.col("venue") == venue, F.col(c))).alias(f"{prefix}_{c}") for c in cols]
    return long.groupBy(*by).agg(*aggs)


def side_diff(df: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """home minus away for every paired column (found by prefix when not named)."""
    if names is None:
        have = set(df.columns)
        names = [c[5:] for c in df.columns if c.startswith("home_") and f"away_{c[5:]}" in have]
    return df.withColumns({f"{n}_diff": F.col(f"home_{n}") - F.col(f"away_{n}") for n in names})


def existing(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in wanted if c in df.columns])


def columns_like(df: DataFrame, prefixes: Sequence[str] = (), keywords: Sequence[str] = (),
                 dtypes: Sequence[str] = ()) -> list[str]:
    return [name for name, kind in df.dtypes
            if (any(name.startswith(p) for p in prefixes) or any(k in name for k in keywords))
            and (not dtypes or kind in dtypes)]


def drop_listed(df: DataFrame, deny: Sequence[str]) -> DataFrame:
    return df.drop(*deny)


def rename_absent(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename a column only where its target does not exist yet."""
    return df.withColumnsRenamed({a: b for a, b in mapping.items() if a in df.columns and b not in df.columns})


def with_constants(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def drop_incomplete(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(cols))


def rows_missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    cond = F.col(cols[0]).isNull()
    for c in cols[1:]:
        cond = cond | F.col(c).isNull()
    return df.filter(cond)


def pair_flag(df: DataFrame, pairs: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """1 when the unordered pair is listed. ``pairs`` holds ``lo``/``hi``."""
    listed = pairs.select("lo", "hi").distinct().withColumn(out, F.lit(1))
    keyed = df.withColumns({"lo": F.least(a, b), "hi": F.greatest(a, b)})
    return keyed.join(listed, ["lo", "hi"], "left").withColumn(out, F.coalesce(out, F.lit(0))).drop("lo", "hi")


def fill(df: DataFrame, values: Mapping[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()})


def row_ffill(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fill a gap from the nearest earlier column of the same row."""
    return df.withColumns({c: F.coalesce(*[F.col(x) for x in reversed(cols[: i + 1])]) for i, c in enumerate(cols)})


def first_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def top_bottom(df: DataFrame, by: str, tie: str, k: int) -> DataFrame:
    """Both ends by ``by``; each side is a bounded top-k, never a full sort."""
    top = df.orderBy(F.desc(by), F.asc(tie)).limit(k).withColumn("side", F.lit("top"))
    low = df.orderBy(F.asc(by), F.asc(tie)).limit(k).withColumn("side", F.lit("bottom"))
    return top.unionByName(low)


def hash_sample(df: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """Repeatable sample: the same rows whatever the partitioning, for fractions down to 1e-18."""
    mark = F.conv(F.substring(_mark(key, seed), 1, 15), 16, 10).cast("long")  # 60 bits
    return df.filter(mark < int(fraction * (1 << 60)))


def _mark(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def sample_n(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows in the order of a seeded hash."""
    return df.withColumn("_mark", _mark(key, seed)).orderBy("_mark", key).limit(n).drop("_mark")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, chosen by a stated order; runs as a min-by so it combines map-side."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(pick.alias("_r")).select(*keys, "_r.*")


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def melt(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str = "metric", value: str = "value") -> DataFrame:
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        list(ids), list(cols), name, value)
