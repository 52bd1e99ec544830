"""Sources (S01-S07): typed scans; schemas are given, never inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formline.functions.scalar import unescape_hex

CONTEST_SCHEMA = T.StructType([
    T.StructField("match_id", T.LongType()), T.StructField("match_date", T.DateType()),
    T.StructField("season", T.IntegerType()), T.StructField("pool", T.IntegerType()),
    T.StructField("home", T.LongType()), T.StructField("away", T.LongType()),
    T.StructField("result", T.StringType()), T.StructField("home_goals", T.LongType()),
    T.StructField("away_goals", T.LongType()), T.StructField("home_xg", T.DoubleType()),
    T.StructField("away_xg", T.DoubleType())])

HISTORY_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()), T.StructField("model_name", T.StringType()),
    T.StructField("overall_metrics", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("cross_validation", T.MapType(T.StringType(), T.StructType([
        T.StructField("mean", T.DoubleType()), T.StructField("std", T.DoubleType()),
        T.StructField("scores", T.ArrayType(T.DoubleType()))]))),
    T.StructField("baseline_comparisons", T.MapType(T.StringType(), T.DoubleType()))])

# Where a page keeps its embedded JSON, tried in this order.
JSON_PATTERNS = (r"var datesData = JSON\.parse\('(.+?)'\);", r"JSON\.parse\('([^']+)'\)")

XG_RECORD = ("array<struct<id:string, datetime:string, h:struct<title:string>, a:struct<title:string>, "
             "goals:struct<h:string, a:string>, xG:struct<h:string, a:string>>>")


def read_contests(spark: SparkSession, path: str | Sequence[str], schema: T.StructType = CONTEST_SCHEMA,
                  date_format: str = "yyyy-MM-dd") -> DataFrame:
    """CSV with a header. Order is left to the windows that need it."""
    return spark.read.schema(schema).option("header", True).option("dateFormat", date_format).option(
        "nanValue", "").csv(path)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing doubles arrive as NaN from some writers; every aggregate here expects NULL."""
    return df.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n, kind in df.dtypes if kind in ("double", "float")})


def read_seasons(spark: SparkSession, path: str | Sequence[str], schema: T.StructType,
                 pattern: str = r"(\d{4}(?:-\d{4})?)[^/]*(?:/[^/]*)?$") -> DataFrame:
    """All season files in one scan; the season comes from the file path. A column a file lacks is NULL."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path).withColumn(
        "file_season", F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))


def read_mixed_seasons(spark: SparkSession, paths: Sequence[tuple[str, T.StructType]]) -> DataFrame:
    """Season groups whose headers differ, aligned by name."""
    parts = [read_seasons(spark, p, s) for p, s in paths]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def latest_file(spark: SparkSession, pattern: str) -> str:
    """The lexically last path that matches, from the file listing alone (no data is read)."""
    return max(spark.read.format("binaryFile").load(pattern).inputFiles())


def read_lookup(spark: SparkSession, path: str, value_type: str = "string") -> DataFrame:
    """Small JSON object file as a (key, value) dimension."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{value_type}>")).alias("key", "value"))


def read_json_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTORY_SCHEMA).json(path, multiLine=True)


def flatten_history(hist: DataFrame, metrics: Sequence[str], cv: Sequence[str], baselines: Sequence[str]) -> DataFrame:
    cols = [F.col("overall_metrics")[m].alias(f"overall_{m}") for m in metrics]
    for m in cv:
        cols += [F.col("cross_validation")[m]["mean"].alias(f"cv_{m}_mean"), F.col("cross_validation")[m]["std"].alias(f"cv_{m}_std")]
    cols += [F.col("baseline_comparisons")[b].alias(f"baseline_{b}") for b in baselines]
    return hist.select("timestamp", "model_name", *cols)


def embedded_literal(html: Column, patterns: Sequence[str] = JSON_PATTERNS) -> Column:
    """First capture of the first pattern that matches."""
    return F.coalesce(*[F.nullif(F.regexp_extract(html, p, 1), F.lit("")) for p in patterns])


def embedded_json(pages: DataFrame, html: str, schema: str = XG_RECORD, patterns: Sequence[str] = JSON_PATTERNS) -> DataFrame:
    """Pages -> one row per record of the JSON array embedded in them (plain, hex-escaped, or both mixed)."""
    raw = embedded_literal(F.col(html), patterns)
    text = F.when(raw.contains("\\x"), unescape_hex(raw)).otherwise(raw)
    keep = [c for c in pages.columns if c != html]
    return pages.select(*keep, F.explode(F.from_json(text, schema)).alias("rec"))


def xg_records(records: DataFrame) -> DataFrame:
    """Embedded records to the typed xG log."""
    r = F.col("rec")
    return records.select(
        r["id"].alias("source_id"), F.try_to_timestamp(r["datetime"]).alias("ts"),
        r["h"]["title"].alias("home"), r["a"]["title"].alias("away"),
        r["goals"]["h"].cast("long").alias("home_goals"), r["goals"]["a"].cast("long").alias("away_goals"),
        r["xG"]["h"].cast("double").alias("home_xg"), r["xG"]["a"].cast("double").alias("away_xg"))


def profile_files(df: DataFrame, unit: Column, t: str, season: str) -> DataFrame:
    """Rows, columns, entity columns, date span and seasons per file (or any unit derived from the file path)."""
    width, sides = len(df.columns), int({"home", "away"} <= set(df.columns))
    return df.groupBy(unit.alias("file")).agg(
        F.count(F.lit(1)).alias("n"), F.lit(width).alias("columns"), F.lit(sides).alias("has_entities"), F.min(t).alias("first_day"), F.max(t).alias("last_day"),
        F.array_join(F.array_sort(F.collect_set(F.col(season).cast("string"))), ",").alias("seasons"))
