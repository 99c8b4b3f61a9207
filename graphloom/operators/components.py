"""Connected components on DataFrames: least labels, with pointer jumping, in written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.written import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) of longs -> (id, label): the least id of each node's component.

    A hub's row is met by joins that adaptive execution splits and by aggregations with a
    map-side part, so no task holds a node's neighbours. Each round's labels are a written
    table; the rounds grow with the logarithm of the longest chain, about.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = materialize(both, "edges")
    labels = materialize(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "id"), "labels")
    total = None
    while True:
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if now is None or now == total:  # labels only ever fall
            return labels
        total = now
        near = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("label").alias("least"))
        step = labels.join(near, F.col("id") == F.col("a")).select("id", F.least("label", "least").alias("label"))
        over = labels.select(F.col("id").alias("via"), F.col("label").alias("further"))
        jumped = step.join(over, F.col("label") == F.col("via"), "left").select("id", F.coalesce(F.least("label", "further"), "label").alias("label"))
        labels = materialize(jumped, "labels")
