"""Segments of ordered rows: running totals that cross a threshold, and compactions of a transcript."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def threshold_segments(rows: DataFrame, key: str, order: str, size: str, threshold: float) -> DataFrame:
    """Adds segment (from 0): a row whose value reaches the threshold ends its segment, the next row begins one."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("segment", F.coalesce(F.count_if(F.col(size) >= threshold).over(before), F.lit(0)).cast("long"))


def compactions(rows: DataFrame, key: str = "transcript_id", order: str = "line") -> DataFrame:
    """Pairs every boundary with the first summary behind it; begin is the line after the summary used before.

    rows: boundary and summary (booleans). A boundary without a summary behind it gives nothing; of several with the
    same one, the first counts.
    """
    ahead = Window.partitionBy(key).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    at = F.first(F.when(F.col("summary"), F.col(order)), ignorenulls=True).over(ahead)
    pairs = rows.withColumn("summary_at", at).filter(F.col("boundary") & F.col("summary_at").isNotNull())
    pairs = pairs.groupBy(key, "summary_at").agg(F.min(order).alias("boundary_at"))
    last = F.lag("summary_at").over(Window.partitionBy(key).orderBy("boundary_at"))
    return pairs.select(key, (F.coalesce(last, F.lit(-1)) + 1).alias("begin"), "boundary_at", "summary_at")
