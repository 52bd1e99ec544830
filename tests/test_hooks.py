import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from formline.operators import hooks as hk
from formline.plans import q_streams as q


def _count(state, batch):
    return state + batch.num_rows, pa.array(range(state, state + batch.num_rows), pa.int64())


def test_history_of_a_hot_key_comes_in_order_and_in_batches(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("ent"), (F.col("id") * 7919 % 30_011).alias("t"), "id").repartition(6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        def step(state, batch):
            n, largest = state
            return (n + batch.num_rows, max(largest, batch.num_rows)), pa.array([n + i if i % 2 else max(largest, batch.num_rows) for i in range(batch.num_rows)], pa.int64())

        out = hk.fold_history(rows, "ent", ["t"], [], lambda: 0, _count, "place", "long").collect()
        large = hk.fold_history(rows.filter("ent = -1"), "ent", ["t"], [], lambda: (0, 0), step, "v", "long").agg(F.max(F.when(F.col("v") <= 1000, F.col("v")))).first()[0]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    hot = sorted((r["t"], r["place"]) for r in out if r["ent"] == -1)
    assert [p for _, p in hot] == list(range(20_000)) and large <= 1000
    assert all(r["place"] == 0 for r in out if r["ent"] != -1)


def test_null_keys_and_empty_history(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), (1, 1)], "ent long, t int")
    assert sorted((str(r["ent"]), r["t"], r["n"]) for r in hk.fold_history(df, "ent", ["t"], [], lambda: 0, _count, "n", "long").collect()) == [("1", 1, 0), ("None", 1, 0), ("None", 2, 1)]
    assert hk.fold_history(df.limit(0), "ent", ["t"], [], lambda: 0, _count, "n", "long").collect() == []


RUNS = (q._run_columns, q._run_start, q._runs, lambda state: q._runs(state, None)[1])


@pytest.mark.parametrize("batch", [None, 2])
def test_table_function_schema_follows_input_and_options(spark, batch):
    df = spark.createDataFrame([("a", i, i, r) for i, r in enumerate([1, 1, 0, None, 0, 0, -1])] + [("b", 1, 1, None), (None, 0, 5, 1)], "ent string, match_date int, match_id short, res int")
    if batch:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        short = hk.table_function(df, ["ent"], ["match_date", "match_id"], *RUNS, name="runs_of_test")
        assert short.schema.simpleString() == "struct<ent:string,res:int,games:bigint,first_id:smallint,last_id:smallint>"
        assert sorted((str(r["ent"]), r["res"], r["games"], r["first_id"], r["last_id"]) for r in short.collect()) == [
            ("None", 1, 1, 5, 5), ("a", -1, 1, 6, 6), ("a", 0, 3, 2, 5), ("a", 1, 2, 0, 1)]
        df.createOrReplaceTempView("rows_of_test")
        in_sql = spark.sql("select * from runs_of_test(table(rows_of_test) partition by ent order by (match_date, match_id))")
        assert sorted(map(str, in_sql.collect())) == sorted(map(str, short.collect()))
        wide = hk.table_function(df, ["ent"], ["match_date", "match_id"], *RUNS, options={"at_least": 2, "days": True})
        assert wide.columns[-1] == "first_day" and sorted((r["ent"], r["games"], r["first_day"]) for r in wide.collect()) == [("a", 2, 0), ("a", 3, 2)]
    finally:
        if batch:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_table_function_without_rows(spark):
    df = spark.createDataFrame([], StructType([StructField(c, LongType()) for c in ("ent", "match_date", "match_id", "res")]))
    assert hk.table_function(df, ["ent"], ["match_date", "match_id"], *RUNS).collect() == []
