"""Rows that come in a later micro-batch than their time: marked, unanswered, without effect."""

from pyspark.sql import functions as F

from formline.streaming import twins as st


def log(spark):
    """40 games, an hour apart; games 5 to 9 arrive last."""
    rows = spark.range(40).select(
        F.lit(1).cast("long").alias("pool"), (F.col("id") % 3).alias("home"), (F.col("id") % 3 + 3).alias("away"), (F.col("id") % 3).alias("lo"),
        (F.col("id") % 3 + 3).alias("hi"), (F.col("id") % 3).alias("ent"), F.lit("H").alias("venue"), F.col("id").alias("match_id"),
        F.timestamp_seconds(F.col("id") * 3600).alias("ts"), (F.col("id") % 2).cast("double").alias("score"),
        F.when(F.col("id") % 2 == 1, "H").otherwise("A").alias("result"), F.col("id").cast("double").alias("value"))
    behind = F.col("match_id").between(5, 9)
    return rows, behind


def check(spark, twin, answers):
    rows, behind = log(spark)
    got = st.run(twin(st.replay(rows, [~behind & (F.col("match_id") < 20), ~behind & (F.col("match_id") >= 20), behind])))
    want = st.run(twin(st.replay(rows.filter(~behind), [F.lit(True)])))
    played, late = st.in_order(got)
    cols = ["match_id", *answers]
    assert sorted(map(tuple, played.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    assert sorted(map(tuple, late.select(cols).collect())) == [(i, *[None] * len(answers)) for i in range(5, 10)]
    assert want.filter("late").count() == 0


def test_ratings(spark):
    check(spark, st.elo, ["home_elo", "away_elo"])


def test_last_values(spark):
    check(spark, lambda s: st.last_n(s, 3), ["mean", "n"])


def test_pairs(spark):
    check(spark, st.pair_counts, ["lo_wins", "hi_wins", "draws", "games"])
