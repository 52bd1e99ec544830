"""Structured Streaming twins of the stateful operators (T family)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.window import Window as W

from formline.session import scratch
from formline.streaming.processors import BothSides, BucketLast, BucketPairs, Carrying, DayBarrier, EloState, LastN, PairCount

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PARTITIONS = "spark.sql.shuffle.partitions"


def replay(df: DataFrame, slices: Sequence[Column], rows_per_file: int = 500_000, path: str | None = None) -> DataFrame:
    """A stored log as a stream: slice after slice, each one micro-batch, cut into files of ``rows_per_file`` rows by the largest slice.

    Slices given to a ``path`` of an earlier call come after the ones already there.
    """
    spark = df.sparkSession
    path = path or scratch(spark, "replay")
    counts = df.agg(*[F.count_if(where).alias(f"n{i}") for i, where in enumerate(slices)]).first() if slices else [0]
    files = max(1, -(-max(counts) // rows_per_file))
    for where in slices:
        df.filter(where).repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def run(stream: DataFrame, mode: str = "append", at: str | None = None, partitions: int | None = None) -> DataFrame:
    """Drain a stream into files under the shared folder and read the result.

    With ``at``, a folder of the caller's, a later call goes on where the one before it stopped: same state, new input only, all output.
    ``partitions``: of the state, for a new stream (the session's setting by default); a stream that goes on keeps its own.
    """
    spark = stream.sparkSession
    at = at or scratch(spark, "stream")
    writer = (stream.writeStream.format("parquet").outputMode(mode).option("path", f"{at}/out")
              .option("checkpointLocation", f"{at}/state").trigger(availableNow=True))
    held = spark.conf.get(PARTITIONS)
    spark.conf.set(PARTITIONS, partitions or held)
    try:
        q = writer.start()  # works on a copy of the session's settings
    finally:
        spark.conf.set(PARTITIONS, held)
    _finish(q)
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def state_of(spark: SparkSession, at: str, variable: str, batch: int | None = None, operator: int = 0) -> DataFrame:
    """The keyed state that a stream run at ``at`` held after micro-batch ``batch`` (its last one by default), read from its checkpoint.

    Nothing is computed again; a row is a key and one value (or one entry of a map) of the named state variable.
    """
    reader = spark.read.format("statestore").option("path", f"{at}/state").option("stateVarName", variable).option("operatorId", operator)
    held = (reader if batch is None else reader.option("batchId", batch)).load()
    values = ("user_map_key", "user_map_value") if "user_map_key" in held.columns else ("value",)
    return held.select("key.*", *[f"{v}.*" for v in values])


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    state = scratch(stream.sparkSession, "stream-state")
    q = (stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", state)
         .trigger(availableNow=True).start())
    _finish(q)


def _finish(q) -> None:
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def stateful(stream: DataFrame, keys: Sequence[str], processor: StatefulProcessor, out: str, time_mode: str = "None",
             initial: DataFrame | None = None, event_time: str = "") -> DataFrame:
    """Keyed state in the RocksDB store, so state size is bounded by local disk, not by memory.

    ``event_time`` names the column of ``out`` by which the watermark goes on to the operators behind this one.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    opening = None if initial is None else initial.groupBy(*keys)
    return stream.groupBy(*keys).transformWithStateInPandas(
        processor, outputStructType=out, outputMode="Append", timeMode=time_mode, initialState=opening, eventTimeColumnName=event_time)


def day_start(date: Column) -> Column:
    """The instant a calendar day starts in UTC, whatever the session's time zone."""
    return F.timestamp_seconds(F.unix_date(date).cast("long") * 86_400)


def in_order(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answered rows, rows that came after a later one of their key) of ``elo``, ``last_n`` or ``pair_counts``."""
    return answers.filter(~F.col("late")), answers.filter("late")


def elo(stream: DataFrame, opening: DataFrame | None = None) -> DataFrame:
    """``stream``: pool, ts, match_id, home, away, score. ``opening``: pool, ent, elo of a snapshot."""
    return stateful(stream, ["pool"], EloState(), EloState.OUT, initial=opening)


def last_n(stream: DataFrame, n: int = 5) -> DataFrame:
    """``stream``: ent, ts, match_id, venue, value."""
    return stateful(stream, ["ent"], LastN(n), LastN.OUT)


def pair_counts(stream: DataFrame) -> DataFrame:
    """``stream``: lo, hi, ts, match_id, home, result."""
    return stateful(stream, ["lo", "hi"], PairCount(), PairCount.OUT)


def day_barrier(stream: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """``stream``: ent, ts, day, match_id, venue, points, with ``ts`` = start of ``day`` (see ``day_start``).

    A day is released once the watermark has passed its end; for the last day of a closed log see ``end_of_log``.
    """
    return stateful(stream.withWatermark("ts", delay), ["ent"], DayBarrier(), DayBarrier.OUT, time_mode="EventTime")


def end_of_log(rows: DataFrame) -> DataFrame:
    """One row that stands two days after the last one and names no match: it closes the last day."""
    last = rows.agg(F.max("day").alias("d"))
    day = F.col("d") + 2
    known = {"ent": F.lit(0), "ts": F.timestamp_seconds(day.cast("long") * 86_400), "day": day}
    return last.filter("d is not null").select(*[known.get(c, F.lit(None)).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])


def split_late(stream: DataFrame, t: str, delay: str) -> tuple[DataFrame, DataFrame]:
    """(on time, late): a row is late when it is older than the highest time of earlier batches minus ``delay``.

    Each batch writes its own folder and its own high mark, so a repeated batch overwrites itself.
    """
    spark = stream.sparkSession
    base = scratch(spark, "late")
    marks = f"{base}/marks"

    def each(batch: DataFrame, i: int) -> None:
        high = F.lit(None).cast("timestamp")
        if i > 0:
            seen = spark.read.parquet(marks).filter(F.col("batch") < i)
            high = seen.agg(F.max("high").alias("h")).scalar()
        late = F.coalesce(F.col(t) < high - F.expr(f"interval {delay}"), F.lit(False))
        batch.withColumn("late", late).write.mode("overwrite").parquet(f"{base}/rows/batch={i}")
        batch.agg(F.max(t).alias("high")).write.mode("overwrite").parquet(f"{marks}/batch={i}")

    run_batches(stream, each)
    rows = spark.read.parquet(f"{base}/rows").drop("batch")
    return rows.filter("not late").drop("late"), rows.filter("late").drop("late")


def windowed_counts(df: DataFrame, t: str, keys: Sequence[str], size: str, slide: str | None = None) -> DataFrame:
    """Rows per event-time window; the same plan for a table and for a stream."""
    win = F.window(t, size, slide) if slide else F.window(t, size)
    return df.groupBy(win, *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sliding_append(stream: DataFrame, t: str, days: int, delay: str = "0 seconds") -> DataFrame:
    """(start, n) of windows of ``days`` days that slide by one, in append mode: rows are counted by day, and only closed days go into the windows.

    State holds the open days and ``days`` numbers, however many rows come; each window leaves once, when the watermark has passed its end.
    """
    daily = stream.withWatermark(t, delay).groupBy(F.window(t, "1 day")).agg(F.count(F.lit(1)).alias("n"))
    return daily.groupBy(F.window(F.window_time("window"), f"{days} days", "1 day")).agg(F.sum("n").alias("n")).select(F.col("window.start").alias("start"), "n")


def closing_row(rows: DataFrame, t: str, days: int) -> DataFrame:
    """One row ``days`` days after the last one with no other value: it lets the watermark close every window before it, while its own stays open."""
    last = rows.agg((F.max(t) + F.expr(f"interval {days} days")).alias(t)).filter(F.col(t).isNotNull())
    return last.select(*[(F.col(t) if c == t else F.lit(None)).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])


def sessions_stream(stream: DataFrame, ent: str, t: str, gap: str) -> DataFrame:
    """(ent, start, n) of bursts, each once it is over; with a watermark on ``t`` in append mode state holds open bursts only."""
    s = F.session_window(t, gap)
    return stream.groupBy(s, ent).agg(F.count(F.lit(1)).alias("n")).select(
        ent, F.col("session_window.start").alias("start"), "n")


def sessions(df: DataFrame, ent: str, t: str, gap: str) -> DataFrame:
    """(ent, start, n): bursts separated by more than ``gap``.

    Rows are cut into (entity, day) pieces first; only the runs of each day, not the rows, meet in
    the per-entity step that joins runs across midnight.
    """
    limit = F.expr(f"interval {gap}")
    day = df.select(ent, t, F.to_date(t).alias("_d"))
    inside = W.partitionBy(ent, "_d").orderBy(t)
    new = F.coalesce((F.col(t) > F.lag(t).over(inside) + limit).cast("int"), F.lit(1))
    runs = (day.withColumn("_new", new).withColumn("_run", F.sum("_new").over(inside))
            .groupBy(ent, "_d", "_run").agg(F.min(t).alias("s"), F.max(t).alias("e"), F.count(F.lit(1)).alias("n")))
    across = W.partitionBy(ent).orderBy("s")
    fresh = F.coalesce((F.col("s") > F.lag("e").over(across) + limit).cast("int"), F.lit(1))
    return (runs.withColumn("_new", fresh).withColumn("_id", F.sum("_new").over(across))
            .groupBy(ent, "_id").agg(F.min("s").alias("start"), F.sum("n").alias("n")).select(ent, "start", "n"))


def sliding_counts(df: DataFrame, t: str, days: int) -> DataFrame:
    """Batch twin of a ``days``-long window sliding by one day: days are counted once, then spread."""
    daily = df.groupBy(F.to_date(t).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    starts = F.sequence(F.date_sub("d", days - 1), F.col("d"))
    return daily.select(F.explode(starts).alias("start"), "n").groupBy("start").agg(F.sum("n").alias("n"))


def prequential(stream: DataFrame, model, label: str) -> DataFrame:
    """Score a feature stream with a fitted model: predictions are stored before any outcome is used."""
    from formline.operators.training import predict

    scored = predict(model, stream)
    return run(scored.select("match_id", "match_date", F.col(label).alias("actual"), "pred", "p_h", "p_d", "p_a"))


BUCKETS = 64  # of entities, of games and of pairs, each one call of Python a micro-batch
GAME = "ts timestamp, pool long, match_id long, home long, away long, result string, score double"


def state_partitions(spark: SparkSession) -> int:
    """Partitions of a stream whose operators call Python: no more than cores (or buckets), as each partition costs every operator a worker and a commit of its store
    a micro-batch, however few rows there are."""
    return max(1, min(int(spark.conf.get(PARTITIONS)), spark.sparkContext.defaultParallelism, BUCKETS))


def game_features(stream: DataFrame, n: int = 5) -> DataFrame:
    """One query from games (``GAME`` and home_goals, away_goals, with a watermark on ts) to feature rows: means of each side's last ``n`` goals, the pair's meetings and
    both ratings, all before the game. Four stateful operators in a row, keyed by bucket of entities, bucket of games, bucket of pairs and pool; the watermark passes
    through them. Run it with ``state_partitions``."""
    goals = [F.struct(F.col(side).alias("ent"), F.lit(v).alias("venue"), F.col(f"{side}_goals").cast("double").alias("value")) for side, v in (("home", "H"), ("away", "A"))]
    sides = stream.select(*[c.split()[0] for c in GAME.split(", ")], F.inline(F.array(*goals)))
    names = lambda cols: [c.split()[0] for c in cols.split(", ")]
    # an entity, a game or a pair of its own as the key would cost a call of Python each
    bucket = lambda df, *keys: df.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)))
    side = f"{GAME}, venue string"
    formed = stateful(bucket(sides, "ent"), ["bucket"], BucketLast(n, names(side)), f"{side}, mean double, n int", "EventTime", event_time="ts")
    both = f"{GAME}, home_mean double, away_mean double"
    games = stateful(bucket(formed, "match_id"), ["bucket"], BothSides(names(GAME)), both, "EventTime", event_time="ts")
    paired = games.withColumns({"lo": F.least("home", "away"), "hi": F.greatest("home", "away")})
    cols = f"{both}, lo long, hi long"
    counts = "lo_wins long, hi_wins long, draws long, games long"
    met = stateful(bucket(paired, "lo", "hi"), ["bucket"], BucketPairs(names(cols)), f"{cols}, {counts}", "EventTime", event_time="ts")
    cols, ratings = f"{cols}, {counts}", "home_elo double, away_elo double"
    return stateful(met, ["pool"], Carrying(EloState(), names(ratings), names(cols)), f"{cols}, {ratings}", "EventTime", event_time="ts")


def daily_scores(scored: DataFrame) -> DataFrame:
    """(day, games, accuracy, log_loss) of scored rows (ts, actual, pred, p_h, p_d, p_a) of a stream with a watermark, each day once it is over."""
    from formline.operators.evaluation import PROBS, row_log_loss

    played = scored.filter(F.col("actual").isNotNull())
    loss = row_log_loss(F.col("actual"), [F.col(p) for p in PROBS])
    out = played.groupBy(F.window("ts", "1 day")).agg(F.count(F.lit(1)).alias("games"), F.avg((F.col("actual") == F.col("pred")).cast("double")).alias("accuracy"), F.avg(loss).alias("log_loss"))
    return out.select(F.to_date("window.start").alias("day"), "games", "accuracy", "log_loss")


def refresh_stats(stream: DataFrame, cols: Sequence[str], every: int) -> DataFrame:
    """(rows, <col>_mean, <col>_std, <col>_min, <col>_max) each time another ``every`` rows have arrived.

    A batch leaves one row a column: count, mean, squared deviations from that mean, ends. A refresh merges those rows (the deviations of the
    means from the common one are added), never the data, and nothing cancels. How far the refreshes have come is read from their folder.
    """
    spark = stream.sparkSession
    base = scratch(spark, "stats")

    def each(batch: DataFrame, i: int) -> None:
        aggs = [F.count(F.lit(1)).alias("rows")]
        for c in cols:
            x = F.col(c).cast("double")
            aggs.append(F.struct(F.count(x).alias("n"), F.avg(x).alias("m"), (F.var_pop(x) * F.count(x)).alias("q"), F.min(x).alias("lo"), F.max(x).alias("hi")).alias(c))
        batch.agg(*aggs).write.mode("overwrite").parquet(f"{base}/parts/batch={i}")
        parts = spark.read.parquet(f"{base}/parts").filter(F.col("batch") <= i)
        seen = parts.agg(F.sum("rows").alias("now"), F.sum(F.when(F.col("batch") < i, F.col("rows"))).alias("was")).first()
        step = (seen["now"] or 0) // every
        if step > (seen["was"] or 0) // every:
            n = {c: F.sum(F.col(c)["n"]) for c in cols}
            means = parts.agg(*[F.try_divide(F.sum(F.col(c)["n"] * F.col(c)["m"]), n[c]).alias(c) for c in cols]).select(F.struct("*")).scalar()
            with_mean = parts.withColumn("_m", means)
            out = [F.sum("rows").alias("rows")]
            for c in cols:
                part, mean = F.col(c), F.col("_m")[c]
                apart = F.sum(part["q"] + part["n"] * (part["m"] - mean) * (part["m"] - mean))
                out += [F.first(mean).alias(f"{c}_mean"), F.sqrt(F.try_divide(apart, n[c])).alias(f"{c}_std"), F.min(part["lo"]).alias(f"{c}_min"), F.max(part["hi"]).alias(f"{c}_max")]
            with_mean.agg(*out).write.mode("overwrite").parquet(f"{base}/stats/step={step}")

    run_batches(stream, each)
    return spark.read.parquet(f"{base}/stats").drop("step")


def enrich(stream: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Stream-static left join; Spark broadcasts the static side only when its size allows."""
    return stream.join(dim, key, "left")
