"""Which statement holds: links of corrections, repeats, and supersession by topic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cues
from ..functions.text import casefold, content_id


def with_ids(items: DataFrame) -> DataFrame:
    """Adds id, and superseded_by and supersedes, both still NULL."""
    none = F.lit(None).cast("string")
    return items.withColumn("id", content_id(F.col("harvester"), F.coalesce("topic", "kind"), F.col("text"))).withColumns({"superseded_by": none, "supersedes": none})


def link_corrections(claims: DataFrame, group: str = "transcript_id") -> DataFrame:
    """Sets superseded_by of every claim that a correction of its group refutes (the first one does), and
    supersedes of the correction (its first claim).

    The theta join (a shared id or number, or two shared long words) becomes an equi-join on
    either, whose hits are counted a pair.
    """
    marks = lambda t: F.transform(F.array_distinct(cues.signature(t)), lambda x: F.concat(F.lit("#"), x))
    words = lambda t: F.transform(F.array_distinct(cues.long_words(t)), lambda x: F.concat(F.lit("w"), x))
    keyed = claims.select(F.col(group).alias("g"), "pos", "id", (F.col("harvester") == "retraction").alias("corrects"), F.explode(F.concat(marks(F.col("text")), words(F.col("text")))).alias("key"))
    r = keyed.filter("corrects").select("g", "key", F.col("pos").alias("r_pos"), F.col("id").alias("r_id"))
    c = keyed.filter("not corrects").select("g", "key", F.col("pos").alias("c_pos"), F.col("id").alias("c_id"))
    hits = r.join(c, ["g", "key"]).groupBy("g", "r_pos", "r_id", "c_pos", "c_id").agg(F.max(F.col("key").startswith("#")).alias("mark"), F.count("*").alias("n"))
    first = hits.filter("mark or n >= 2").groupBy("g", "c_pos", "c_id").agg(F.min(F.struct("r_pos", "r_id")).alias("r"))
    down = first.select(F.col("g").alias(group), F.col("c_pos").alias("pos"), F.col("r.r_id").alias("_down"))
    up = first.groupBy("g", "r.r_pos").agg(F.min(F.struct("c_pos", "c_id")).alias("c")).select(F.col("g").alias(group), F.col("r_pos").alias("pos"), F.col("c.c_id").alias("_up"))
    rows = claims.join(down, [group, "pos"], "left").join(up, [group, "pos"], "left")
    return rows.withColumn("superseded_by", F.coalesce("superseded_by", "_down")).withColumn("supersedes", F.coalesce("supersedes", "_up")).drop("_down", "_up")


def last_by_id(claims: DataFrame, group: str = "transcript_id") -> DataFrame:
    """The last of all claims with an id, in the place of that one."""
    w = Window.partitionBy(group, "id").orderBy(F.desc("pos"))
    return claims.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def supersede_by_topic(claims: DataFrame, group: str = "transcript_id") -> DataFrame:
    """The newest claim of a topic supersedes the one before it, and all earlier ones point at the newest.

    A pointer that the newest has from elsewhere (a correction) stays; one to a claim of its own topic goes.
    """
    w = Window.partitionBy(group, "topic").orderBy("pos")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    newest = F.col("_newest") == F.col("id")
    rows = claims.withColumn("_newest", F.last("id").over(whole)).withColumn("_before", F.lag("id").over(w))
    rows = rows.withColumn("_own", F.array_contains(F.collect_set("id").over(whole), F.col("superseded_by"))) if "superseded_by" in claims.columns else rows
    kept = F.when(F.coalesce(F.col("_own"), F.lit(False)), F.lit(None)).otherwise(F.col("superseded_by"))
    rows = rows.withColumn("superseded_by", F.when(newest, kept).otherwise(F.col("_newest")))
    return rows.withColumn("supersedes", F.when(newest & F.col("_before").isNotNull(), F.col("_before")).otherwise(F.col("supersedes"))).drop("_newest", "_before", "_own")


def resolve(claims: DataFrame, group: str = "transcript_id") -> DataFrame:
    """Repeats out, supersession in, and pos counted anew from 0."""
    rows = supersede_by_topic(last_by_id(claims, group), group)
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(group).orderBy("pos")) - 1)


def once_by_id(supplements: DataFrame, group: str = "transcript_id") -> DataFrame:
    """One supplement for each id: the place of the first, the rest from the last."""
    first = Window.partitionBy(group, "id")
    last = Window.partitionBy(group, "id").orderBy(F.desc("pos"))
    rows = supplements.withColumn("_first", F.min("pos").over(first)).withColumn("_rn", F.row_number().over(last)).filter("_rn = 1")
    rows = rows.withColumn("pos", F.col("_first")).drop("_first", "_rn")
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(group).orderBy("pos")) - 1)


def is_active() -> Column:
    return F.col("superseded_by").isNull()


def carry_lessons(claims: DataFrame, store: DataFrame, most: int = 10, group: str = "transcript_id", groups: DataFrame | None = None) -> DataFrame:
    """Adds to every group the newest lessons of the store that it doesn't hold; `store` has seq, text, ts and may have id.

    A session's own new lessons are stored first, so they take places among the newest `most`: with three of them and ten
    places, seven older ones are carried. groups: all there are, as one without a claim gets lessons, too. At most `most`
    lessons meet a group, so the store's side is bounded.
    """
    lesson = content_id("lesson", F.lit(""), F.col("text"))
    kept = store if "id" in store.columns else store.withColumn("id", lesson)
    newest = kept.orderBy(F.desc("seq")).limit(max(0, most)).select("id", F.col("text").alias("l_text"), F.col("ts").alias("l_ts"), "seq", casefold(F.col("text")).alias("l_key"))
    own = claims.filter(F.col("topic").startswith("lesson:"))
    known = own.select(F.col(group).alias("g"), casefold(F.col("text")).alias("l_key")).distinct()
    fresh = own.select(F.col(group).alias("g"), lesson.alias("id")).distinct().join(kept.select("id"), "id", "left_anti").groupBy("g").agg(F.count("*").alias("fresh"))
    every = claims.select(F.col(group).alias("g")) if groups is None else groups.select(F.col(group).alias("g"))
    last = claims.groupBy(F.col(group).alias("g")).agg(F.max("pos").alias("last"))
    every = every.distinct().join(last, "g", "left").join(fresh, "g", "left")
    # Places are given before those are left out that the group has; of equal texts the newest counts.
    placed = every.join(F.broadcast(newest.withColumn("place", F.row_number().over(Window.orderBy(F.desc("seq"))))))
    placed = placed.filter(F.col("place") <= most - F.coalesce("fresh", F.lit(0))).withColumn("_again", F.row_number().over(Window.partitionBy("g", "l_key").orderBy("place"))).filter("_again = 1")
    added = placed.join(known, ["g", "l_key"], "left_anti")
    place = F.row_number().over(Window.partitionBy("g").orderBy("place"))
    topic = F.concat(F.lit("lesson:"), F.substring("l_key", 1, 40))
    rows = added.select(F.col("g").alias(group), (F.coalesce("last", F.lit(-1)) + place).alias("pos"), F.col("l_text").alias("text"), topic.alias("topic"), F.lit("lessons").alias("harvester"), F.col("l_ts").alias("ts"), content_id("lessons", topic, F.col("l_text")).alias("id"))
    return claims.unionByName(rows, allowMissingColumns=True)
