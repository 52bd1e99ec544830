from pyspark.sql import functions as F

from formline.session import scratch
from formline.streaming import twins as st


def test_a_stream_goes_on_where_it_stopped(spark):
    rows = spark.range(40).select((F.col("id") % 4).alias("ent"), F.timestamp_seconds(F.col("id") * 3600).alias("ts"), F.col("id").alias("match_id"), F.lit("H").alias("venue"), F.col("id").cast("double").alias("value"))
    early, late = F.col("match_id") < 25, F.col("match_id") >= 25
    whole = st.run(st.last_n(st.replay(rows, [early, late]), 3))
    log, at = scratch(spark, "log"), scratch(spark, "run")
    assert st.run(st.last_n(st.replay(rows, [early], path=log), 3), at=at).count() == 25
    resumed = st.run(st.last_n(st.replay(rows, [late], path=log), 3), at=at)
    assert sorted(map(tuple, resumed.collect())) == sorted(map(tuple, whole.collect()))
    assert {r["ent"]: r["items"] for r in st.state_of(spark, at, "last").collect()} == {e: [28.0 + e, 32.0 + e, 36.0 + e] for e in range(4)}
    assert {r["ent"]: r["items"][-1] for r in st.state_of(spark, at, "last", batch=0).collect()} == {0: 24.0, 1: 21.0, 2: 22.0, 3: 23.0}
