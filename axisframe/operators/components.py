"""Connected components of a graph given as links, by smallest labels with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisframe.workspace import materialize, remove_table


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): for every node that a link names, the smallest node of its component.

    Each round takes the smallest label among a node and its neighbours, then that label's own label; labels are written
    out after each round, so the plan stays short.  Null ends are left out, loops and repeated links do no harm.
    """
    one = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    both = materialize(one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialize(both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("low"))
        near = labels.join(seen, F.col("node") == F.col("a")).select("node", "label", F.least("label", "low").alias("low"))
        jump = near.join(labels.select(F.col("node").alias("low"), F.col("label").alias("further")), "low")
        after = materialize(jump.select("node", F.least("low", "further").alias("label"), F.col("label").alias("before")), "labels")
        remove_table(labels)
        labels = after.select("node", "label")
        if after.where("label <> before").isEmpty():
            return labels
