"""Views that evolve with a stream: the newest value of each topic, and a store without repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_by_topic(rows: DataFrame, topic: str = "topic", order: str = "ts", value: str = "value") -> DataFrame:
    """topic, value and order of its newest row; works on a table and, in update mode, on a stream."""
    return rows.groupBy(topic).agg(F.max_by(F.struct(value, order), order).alias("_v")).select(topic, f"_v.{value}", f"_v.{order}")


def once(rows: DataFrame, id_: str = "id", stamp: str | None = None, delay: str = "7 days") -> DataFrame:
    """Rows whose id wasn't there before. With a stamp, ids are forgotten after a delay; else never."""
    return rows.withWatermark(stamp, delay).dropDuplicatesWithinWatermark([id_]) if stamp else rows.dropDuplicates([id_])
