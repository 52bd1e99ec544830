import hashlib
import math

from pyspark.sql import functions as F

from formline.operators import evaluation as ev


def test_limits_are_the_poisson_law():
    limits = ev.poisson_limits()
    shares = [b - a for a, b in zip([0, *limits], limits)]
    for m in range(8):
        assert abs(shares[m] / 2 ** 32 - math.exp(-1) / math.factorial(m)) < 1e-9
    assert limits == sorted(set(limits)) and limits[-1] < 2 ** 32


def test_weights_do_not_depend_on_the_partitioning(spark):
    rows = spark.range(600).select(F.col("id").alias("key"), (F.col("id") % 3).cast("int").alias("actual"), (F.col("id") % 2).cast("int").alias("pred"))
    one = ev.poisson_cells(rows.repartition(7), "key", 10, 1, ["actual", "pred"], {"loss": F.lit(0.5)})
    two = ev.poisson_cells(rows.orderBy(F.desc("key")).coalesce(1), "key", 10, 1, ["actual", "pred"], {"loss": F.lit(0.5)})
    got = sorted(map(tuple, one.collect()))
    assert got == sorted(map(tuple, two.collect()))
    assert {r[0] for r in got} == set(range(10)) and all(r[4] == 0.5 * r[3] for r in got)
    totals = [r["n"] for r in one.groupBy("replicate").agg(F.sum("w").alias("n")).collect()]
    assert all(480 < n < 720 for n in totals) and len(set(totals)) > 1
    assert got != sorted(map(tuple, ev.poisson_cells(rows, "key", 10, 2, ["actual", "pred"], {"loss": F.lit(0.5)}).collect()))


def test_intervals_cover_the_score_and_follow_the_sample_size(spark):
    small = spark.range(400).select("id", (F.col("id") % 3).cast("int").alias("actual"), F.when(F.col("id") % 10 < 7, F.col("id") % 3).otherwise((F.col("id") + 1) % 3).cast("int").alias("pred"))
    width = []
    for df in (small, small.crossJoin(spark.range(4).toDF("copy")).withColumn("id", F.col("id") * 4 + F.col("copy")).drop("copy")):
        cells = ev.poisson_cells(df, "id", 400, 3, ["actual", "pred"], {"loss": F.lit(1.0)})
        r = {x["metric"]: x for x in ev.score_intervals(ev.replicate_scores(cells), ["accuracy", "macro_f1", "log_loss"]).collect()}
        assert r["accuracy"]["lo"] < 0.7 < r["accuracy"]["hi"] and abs(r["accuracy"]["mean"] - 0.7) < 0.01 and r["log_loss"]["lo"] == r["log_loss"]["hi"] == 1.0
        width.append(r["accuracy"]["hi"] - r["accuracy"]["lo"])
    assert 1.6 < width[0] / width[1] < 2.4
    assert abs(width[0] - 2 * 1.96 * math.sqrt(0.21 / 400)) < 0.02


def test_draws_are_spread_over_tasks_by_their_number(spark):
    rows = spark.range(50_000).coalesce(1).select("id", (F.col("id") % 3).cast("int").alias("actual"), (F.col("id") % 2).cast("int").alias("pred"))
    text = ev.poisson_cells(rows, "id", 400, 1, ["actual", "pred"], {"loss": F.lit(1.0)})._jdf.queryExecution().toString()
    assert "RoundRobinPartitioning(3)" in text and "conv(" not in text


def test_weights_are_the_numbers_of_the_hex_digits(spark):
    limits = ev.poisson_limits()
    got = {r["replicate"]: r["w"] for r in ev.poisson_cells(spark.range(7, 8), "id", 200, 5, [], {"loss": F.lit(1.0)}).collect()}
    for replicate in range(200):
        u = int(hashlib.md5(f"5:7:{replicate // 4}".encode()).hexdigest()[replicate % 4 * 8:][:8], 16)
        assert got.get(replicate, 0) == sum(u >= x for x in limits)
