from pyspark.sql import functions as F

from formline.operators import training as tr


def test_features_are_computed_once_for_all_folds(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(120).select(F.col("id").alias("match_id"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 30).cast("int")).alias("match_date"),
                                   (F.col("id") % 3).cast("int").alias("y"), (F.col("id") / 7).alias("a"))
    costly = rows.mapInArrow(count, rows.schema)
    folded = tr.with_folds(costly, ["a"], "y", 3)
    assert sorted((r["fold"], r["count"]) for r in folded.groupBy("fold").count().collect()) == [(-1, 30), (0, 30), (1, 30), (2, 30)]
    assert seen.value == 120
