"""Statistics of a brief store, where what can't be measured is NULL and never 0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KNOWN = ("atomic", "calibration", "lessons", "regex_floor", "retraction")


def summary(briefs: DataFrame, claims: DataFrame, lessons: DataFrame | None = None) -> DataFrame:
    """One row. briefs: brief_id, created_utc, budget (struct or NULL); claims: text, topic, harvester, confidence, superseded_by.

    Retractions are NULL unless some claim names a known extractor, budget sums are NULL unless a brief recorded
    one, the mean confidence is NULL without a marked claim, the number of lessons is NULL without a store.
    """
    correct = F.coalesce(F.col("topic").startswith("retraction"), F.lit(False)) | F.coalesce(F.col("harvester") == "retraction", F.lit(False))
    labelled = F.count_if(F.col("harvester").isin(*KNOWN))
    c = claims.agg(
        F.count("*").alias("claims_total"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("claim_chars_total"), F.when(labelled > 0, F.count_if(correct)).alias("retractions"), labelled.alias("labelled_claims"),
        F.count_if(F.coalesce("superseded_by", F.lit("")) != "").alias("superseded"), F.count("confidence").alias("marked_claims"), F.round(F.avg("confidence"), 3).alias("mean_confidence"),
        F.round(F.coalesce(F.count("confidence") / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)), 3).alias("marked_share"),
    )
    stamp = F.nullif("created_utc", F.lit(""))
    b = briefs.agg(
        F.count("*").alias("briefs"), F.min(stamp).alias("first_brief_utc"), F.max(stamp).alias("last_brief_utc"),
        F.sum(F.coalesce("budget.harvested_claims", F.when(F.col("budget").isNotNull(), 0))).alias("harvested_claims"), F.sum(F.coalesce("budget.dropped_items", F.when(F.col("budget").isNotNull(), 0))).alias("dropped_items"),
    )
    out = b.crossJoin(c).withColumn("claims_per_brief", F.round(F.coalesce(F.col("claims_total") / F.nullif(F.col("briefs"), F.lit(0)), F.lit(0.0)), 1))
    out = out.withColumn("budget_measurable", F.col("harvested_claims").isNotNull()).withColumn("retractions_measurable", F.col("labelled_claims") > 0)
    if lessons is None:
        return out.withColumn("lessons_total", F.lit(None).cast("long"))
    return out.crossJoin(lessons.agg(F.countDistinct("id").alias("lessons_total")))


def counts(rows: DataFrame, column: str, order: str, most: int = 0) -> DataFrame:
    """value, n, rank: how often each value occurs, most frequent first, ties by where it came first.

    Values are aggregated first; only `most` of them, or all where there are few, are ranked.
    """
    from pyspark.sql import Window

    per = rows.groupBy(F.coalesce(F.col(column), F.lit("?")).alias("value")).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    if most:
        per = per.orderBy(F.desc("n"), "first").limit(most)
    return per.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "first"))).select("value", "n", "rank")


def breakdown(claims: DataFrame, supplements: DataFrame, order: str = "at", topics: int = 10) -> DataFrame:
    """part (harvester, kind, topic), value, n, rank: by extractor and by kind, of which there are few, and the most frequent topics."""
    tagged = lambda part, rows: rows.select(F.lit(part).alias("part"), "value", "n", "rank")
    return tagged("harvester", counts(claims, "harvester", order)).unionByName(tagged("kind", counts(supplements, "kind", order))).unionByName(tagged("topic", counts(claims, "topic", order, topics)))


def report(row, parts=()) -> str:
    """The text form of a summary row and of rows of `breakdown`."""
    say = lambda x: "not measurable" if x is None else str(x)
    lines = ["Memory statistics", f"briefs: {row['briefs']} ({say(row['first_brief_utc'])} to {say(row['last_brief_utc'])})"]
    for name in ("claims_total", "claims_per_brief", "superseded", "retractions", "marked_claims", "marked_share", "mean_confidence", "harvested_claims", "dropped_items", "lessons_total"):
        lines.append(f"{name.replace('_', ' ')}: {say(row[name])}")
    for part, title in (("harvester", "by extractor"), ("kind", "supplements by kind"), ("topic", "most frequent topics")):
        own = sorted((p for p in parts if p["part"] == part), key=lambda p: p["rank"])
        lines += [f"{title}:"] * bool(own) + [f"  {label(p['value'])}: {p['n']}" for p in own]
    return "\n".join(lines)


def label(topic: str, most: int = 48) -> str:
    return topic if len(topic) <= most else topic[: most - 3] + "..."
