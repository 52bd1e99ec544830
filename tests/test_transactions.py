import os

import pytest
from pyspark.sql import functions as F

from formline.session import scratch
from formline.sources import transactions as tx


@pytest.fixture
def base(spark):
    return scratch(spark, "tx")


def values(df):
    return sorted(tuple(r) for r in df.collect())


def test_overwrite_append_and_earlier_versions(spark, base):
    df = spark.range(1000).select("id", (F.col("id") % 7).cast("string").alias("s"), F.when(F.col("id") % 3 == 0, F.col("id") / 4).alias("v"), F.array("id").alias("l"))
    one = tx.write_transaction(df.repartition(5), base)
    two = tx.write_transaction(df.filter("id < 10"), base, append=True)
    assert one["rows"] == 1000 and two["rows"] == 1010 and set(one["files"]) < set(two["files"]) and two["before"] == one["version"]
    assert tx.read_transaction(spark, base).count() == 1010 and values(tx.read_transaction(spark, base, one["version"]).drop("l")) == values(df.drop("l"))
    assert tx.read_transaction(spark, base).dtypes == df.dtypes
    three = tx.write_transaction(df.limit(0), base)
    assert three["rows"] == 0 and tx.read_transaction(spark, base).count() == 0


def test_fingerprint_follows_the_rows_only(spark, base):
    df = spark.range(500).select("id", (F.col("id") * 2).alias("b"))
    a = tx.write_transaction(df.repartition(7), base)["fingerprint"]
    assert a == tx.write_transaction(df.orderBy(F.desc("id")).coalesce(1), base)["fingerprint"]
    half = tx.write_transaction(df.filter("id >= 250"), base)
    assert a == tx.write_transaction(df.filter("id < 250"), base, append=True)["fingerprint"] != half["fingerprint"]
    assert a != tx.write_transaction(df.select(F.col("b").alias("id"), F.col("id").alias("b")), base)["fingerprint"]
    assert a != tx.write_transaction(df.withColumn("b", F.when(F.col("id") != 3, F.col("b"))), base)["fingerprint"]


@pytest.mark.parametrize("how", ["error", "killed"])
def test_a_failed_job_leaves_the_old_version(spark, base, how):
    good = spark.range(100).repartition(4)
    before = tx.write_transaction(good, base)

    def broken(batches):
        for batch in batches:
            if batch.num_rows and batch.column("id")[0].as_py() >= 75:
                if how == "killed":
                    os._exit(1)
                raise ValueError("this task fails")
            yield batch

    bad = spark.range(0, 100, 1, 4).mapInArrow(broken, "id long")
    for append in (False, True):
        with pytest.raises(Exception):
            tx.write_transaction(bad, base, append)
    assert tx.manifest(base) == before and values(tx.read_transaction(spark, base)) == values(good)


def test_no_version_yet(spark, base):
    with pytest.raises(FileNotFoundError):
        tx.read_transaction(spark, base)


def test_append_does_not_lose_a_version_published_meanwhile(spark, base):
    tx.write_transaction(spark.range(3), base)
    late = tx.Writer(base, spark.range(1).schema, False)
    now = tx.write_transaction(spark.range(5), base)
    with pytest.raises(RuntimeError):
        late.commit([])
    assert tx.manifest(base) == now
