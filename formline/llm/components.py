"""Connected components by contraction: every round each node points at a neighbour, and the graph of the pointed-at
nodes is what remains. Rounds alternate between the smallest id (a star around its smallest member ends at once)
and the smallest keyed hash (a path shrinks by a share each round), so the rounds are logarithmic whatever the ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.session import stored


def components(edges: DataFrame) -> DataFrame:
    """node, component_id (smallest node reachable) for every node of ``edges`` (columns a, b: long, not null)."""
    left = stored(edges.select("a", "b").filter(F.col("a") != F.col("b")).distinct(), "edges")
    steps: list[DataFrame] = []
    while not steps or not left.isEmpty():
        k = len(steps)
        both = left.union(left.select("b", "a")).toDF("node", "to")
        rank = F.col("to") if k % 2 == 0 else F.xxhash64("to", F.lit(k))
        own = F.col("node") if k % 2 == 0 else F.xxhash64("node", F.lit(k))
        best = both.groupBy("node").agg(F.min(F.struct(rank.alias("rank"), "to")).alias("best"))
        step = stored(best.select("node", F.when(F.col("best.rank") < own, F.col("best.to")).otherwise(F.col("node")).alias("to")), "step")
        steps.append(step)
        a, b = step.toDF("a", "ra"), step.toDF("b", "rb")
        left = stored(left.join(a, "a").join(b, "b").filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    label = steps[-1].toDF("node", "label")
    for step in reversed(steps[:-1]):
        onward = label.toDF("to", "label")
        label = step.join(onward, "to", "left").select("node", F.coalesce("label", "to").alias("label"))
    label = stored(label, "labels")
    least = label.groupBy("label").agg(F.min("node").alias("component_id"))
    return label.join(least, "label").select("node", "component_id")
