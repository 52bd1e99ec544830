"""Sinks (S08-S13): versioned tables, exports, reports and state snapshots."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def content_fingerprint(df: DataFrame) -> DataFrame:
    """One row: hash over schema and all rows, whatever their order or partitioning."""
    row = F.xxhash64(*[F.col(c) for c in df.columns])
    # Each row hash is folded to 31 bits and summed as a decimal of 30 digits, enough for 1e20 rows.
    body = df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(row).alias("x"), F.sum(F.pmod(row, F.lit(2147483647)).cast("decimal(20,0)")).alias("s"))
    text = F.concat_ws("|", F.lit(df.schema.simpleString()), *[F.col(c).cast("string") for c in ("n", "x", "s")])
    return body.select("n", F.substring(F.md5(text), 1, 8).alias("fingerprint"))


def text_fingerprint(df: DataFrame) -> DataFrame:
    """(n, fingerprint) over all rows as texts, in any order: sums of the md5 parts of each row, so other engines find the same. Nulls count as ``~``."""
    row = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in df.columns]))
    part = lambda i: F.sum(F.conv(F.substring(row, 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)")
    body = df.agg(F.count(F.lit(1)).alias("n"), *[part(i).alias(f"s{i}") for i in range(4)])
    return body.select("n", F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in ("n", "s0", "s1", "s2", "s3")])).alias("fingerprint"))


def write_versioned(df: DataFrame, base: str, stamp: str | None = None) -> str:
    """Write ``<base>/version=<stamp>_<hash>`` and a one-row pointer to it; returns the path.

    The pointer is written last, so a reader never follows it to a half-written version.
    """
    stamp = stamp or datetime.now(timezone.utc).strftime("%Y_%m_%d_%H%M%S")
    spark = df.sparkSession
    # computed once: the hash is taken of the written rows, which then get their name
    held = f"{base}/_writing-{uuid.uuid4().hex}"
    df.write.parquet(held)
    mark = content_fingerprint(spark.read.schema(df.schema).parquet(held)).first()["fingerprint"]
    path = f"{base}/version={stamp}_{mark}"
    at, to = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (held, path))
    files = to.getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(to, True)
    if not files.rename(at, to):
        raise OSError(f"{held} could not be renamed to {path}")
    spark.createDataFrame([(path,)], "path string").coalesce(1).write.mode("overwrite").json(f"{base}_latest")
    return path


def read_latest(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.parquet(spark.read.schema("path string").json(f"{base}_latest").first()["path"])


def split_export(df: DataFrame, features: list[str], target: str, base: str, key: str = "match_id") -> dict[str, str]:
    """Features, target and combined tables; the two narrow ones are cut from the written combined table."""
    paths = {k: f"{base}/{k}" for k in ("ml", "features", "target")}
    df.select(key, *features, target).write.mode("overwrite").parquet(paths["ml"])
    ml = df.sparkSession.read.parquet(paths["ml"])
    ml.select(key, *features).write.mode("overwrite").parquet(paths["features"])
    ml.select(key, target).write.mode("overwrite").parquet(paths["target"])
    return paths


def write_report(metrics: DataFrame, path: str) -> str:
    metrics.write.mode("overwrite").json(path)
    return path


def append_history(entry: DataFrame, path: str) -> str:
    """One more entry; earlier ones are not read or rewritten."""
    entry.write.mode("append").json(path)
    return path


def write_snapshot(state: DataFrame, path: str, as_of: str) -> str:
    """State table as of a day."""
    out = f"{path}/as_of={as_of}"
    state.write.mode("overwrite").parquet(out)
    return out


def load_snapshot(spark: SparkSession, path: str, as_of: str) -> DataFrame:
    return spark.read.parquet(f"{path}/as_of={as_of}")
