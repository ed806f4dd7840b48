"""The corpus of everything stored, as documents for search.

A document: doc_seq (total order), text, kind, id, ts, superseded, source, tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import date_tokens, search_tokens
from ..storage import table


def settles_across(topic: Column) -> Column:
    """Only a topic parsed from a sentence (it has a pipe) stands for the same thing in other briefs."""
    return F.coalesce(topic.contains("|"), F.lit(False))


def corpus(claims: DataFrame, supplements: DataFrame, lessons: DataFrame | None = None, dates: str = "off") -> DataFrame:
    """Claims and supplements of all briefs (brief_id: ordered name, pos, created_utc), then the lesson store.

    The first brief that holds an id speaks for it. Among the claims of one parsed topic all but the last are
    superseded, whichever brief they are in; an id met again doesn't count again.
    """
    null = F.lit(None).cast("string")
    lesson = F.coalesce(F.col("topic").startswith("lesson:"), F.lit(False))
    c = claims.select(
        F.lit(0).alias("part"), F.col("brief_id").alias("name"), "pos", F.lit(0).alias("bucket"), "text", F.when(lesson, "lesson").otherwise("claim").alias("kind"), "id",
        F.coalesce(F.nullif("ts", F.lit("")), "created_utc").alias("ts"), F.col("superseded_by").isNotNull().alias("superseded"), F.when(~lesson & settles_across(F.col("topic")), F.col("topic")).alias("settle"),
    )
    s = supplements.select(F.lit(0).alias("part"), F.col("brief_id").alias("name"), "pos", F.lit(1).alias("bucket"), "text", "kind", "id", F.col("created_utc").alias("ts"), F.lit(False).alias("superseded"), null.alias("settle"))
    rows = c.unionByName(s)
    if lessons is not None:
        rows = rows.unionByName(lessons.select(F.lit(1).alias("part"), F.lit("lessons").alias("name"), F.col("seq").cast("int").alias("pos"), F.lit(2).alias("bucket"), "text", F.lit("lesson").alias("kind"), "id", "ts", F.lit(False).alias("superseded"), null.alias("settle")))
    order = ("part", "name", "bucket", "pos")
    first = Window.partitionBy("bucket", "id").orderBy(*order)
    rows = rows.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1")
    # The last of each topic by aggregate and join, as a topic may be in any number of briefs.
    last = rows.filter("settle is not null").groupBy("settle").agg(F.max(F.struct(*order)).alias("_last"))
    rows = rows.join(last, "settle", "left").withColumn("superseded", F.col("superseded") | F.coalesce(F.struct(*order) < F.col("_last"), F.lit(False)))
    spelled = F.concat(search_tokens(F.col("text")), date_tokens(F.col("ts"), dates))
    return rows.select(F.struct(*order).alias("doc_seq"), "text", "kind", "id", "ts", "superseded", F.col("name").alias("source"), spelled.alias("tokens"))


def recency_rank(docs: DataFrame, order: str = "doc_seq") -> DataFrame:
    """id and recency (0 oldest to 1 newest) of the stamped documents; ties by order, of equal ids the last counts.

    A global rank without a global window: ranges of the stamp are counted, and ranks inside them are offset.
    """
    stamped = docs.filter(F.coalesce(F.col("ts"), F.lit("")) != "").select("id", F.col("ts").cast("string").alias("ts"), F.col(order).alias("o"))
    spark = docs.sparkSession
    # Written with the number of its range: ranges are sampled, and another sample after a loss would give other ones.
    placed = table(stamped.repartitionByRange(F.col("ts"), F.col("o")).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = [(r[0], r[1]) for r in placed.groupBy("part").count().orderBy("part").collect()]  # one row for each partition
    total, offsets = 0, []
    for part, n in sizes:
        offsets.append((part, total))
        total += n
    lookup = spark.createDataFrame(offsets or [(0, 0)], "part int, offset long")
    rank = F.row_number().over(Window.partitionBy("part").orderBy("ts", "o")) + F.col("offset")
    out = placed.join(F.broadcast(lookup), "part").withColumn("rank", rank)
    return out.groupBy("id").agg((F.lit(1.0) if total <= 1 else (F.max("rank") - 1) / F.lit(total - 1)).alias("recency"))
