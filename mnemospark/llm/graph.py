"""Connected components by minimum labels with pointer jumping, every round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import release, table


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node that can be reached, for each node of an edge (columns a and b).

    Each round takes the smallest label among a node's neighbours and then follows that label to its
    own label, so that chains shrink by a factor and not by one. Labels only fall; it ends when none
    fell. No edges give no rows.
    """
    spark = edges.sparkSession
    both = table(spark, edges.select("a", "b").filter("a != b").union(edges.select(F.col("b"), F.col("a")).filter("a != b")).distinct(), "edges")
    labels = table(spark, both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = table(spark, lower.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        release(spark, labels)
        labels = after.select("node", "label")
        if after.filter("label < old").isEmpty():
            release(spark, both)
            return labels
