"""Selection under a budget of characters, and rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cues import live_state

KIND_WEIGHT = {"path": 0.7, "id": 0.8, "decision": 1.0}
TITLE = "# Brief"
MARKERS = (
    "## Marking what you claim\n\nWhere a statement can be checked, put its confidence right behind it: [C:NN%, basis: where it is from].\n"
    "A marker counts for the sentence in front of it. Leave opinions and plans unmarked; say what was wrong when you correct yourself."
)


def recency(index: Column, total: Column) -> Column:
    """0 for the oldest, 1 for the newest; the only one counts as newest."""
    return F.when(total <= 1, 1.0).otherwise(index / (total - 1))


def claim_score(confidence: Column, recent: Column, topic: Column, harvester: Column, active: Column) -> Column:
    base = 0.5 + 0.3 * F.coalesce(confidence, F.lit(0.5)) + 0.2 * recent
    kind = F.when(topic.startswith("retraction"), 2.0).when((harvester == "atomic") & confidence.isNull(), 0.75).otherwise(1.0)
    return base * kind * F.when(active, 1.0).otherwise(0.35)


def supplement_score(kind: Column, recent: Column) -> Column:
    weight = F.coalesce(F.create_map(*(F.lit(x) for kv in KIND_WEIGHT.items() for x in kv))[kind], F.lit(0.5))
    return 0.6 * weight * (0.5 + 0.2 * recent + 0.3)


def scored(items: DataFrame, group: str = "transcript_id") -> DataFrame:
    """Adds score and priority (1: kept longest); items of both buckets, pos from 0 inside each."""
    total = F.count("*").over(Window.partitionBy(group, "bucket"))
    rows = items.withColumn("_recent", recency(F.col("pos"), total))
    claim = claim_score(F.col("confidence"), F.col("_recent"), F.coalesce("topic", F.lit("")), F.col("harvester"), F.col("superseded_by").isNull())
    rows = rows.withColumn("score", F.when(F.col("bucket") == "claim", claim).otherwise(supplement_score(F.col("kind"), F.col("_recent")))).drop("_recent")
    # Rounded, so that a sum in another order can't change a tie.
    w = Window.partitionBy(group).orderBy(F.desc(F.round("score", 12)), "bucket", "pos")
    return rows.withColumn("priority", F.row_number().over(w))


def greedy(items: DataFrame, budget: int, group: str = "transcript_id", budgets: DataFrame | None = None) -> DataFrame:
    """Adds kept: items taken by priority while they fit; one that doesn't fit is skipped, smaller ones may follow.

    A fold over the items of one group, which is one brief, in Arrow batches: sorted rows stream by, and all that is held
    is the room that is left. budgets (group, budget) gives each group its own.
    """
    if budget <= 0 and budgets is None:
        return items.withColumn("kept", F.lit(True))

    def take(batches):
        import pyarrow as pa

        now, left = None, 0
        for b in batches:
            kept = []
            for g, cost, room in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if g != now:
                    now, left = g, room
                kept.append(cost <= left)
                left -= cost if cost <= left else 0
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(kept, pa.bool_())], names=[group, "priority", "kept"])

    rows = items if budgets is None else items.join(budgets.select(group, F.col("budget").alias("_room")), group)
    costs = rows.select(group, "priority", (F.length("text") + 1).alias("cost"), (F.lit(budget) if budgets is None else F.col("_room")).cast("long").alias("room"))
    kind = dict(costs.dtypes)
    taken = costs.repartition(group).sortWithinPartitions(group, "priority").mapInArrow(take, f"`{group}` {kind[group]}, priority {kind['priority']}, kept boolean")
    return items.join(taken, [group, "priority"])


def item_line(created: Column) -> Column:
    """The Markdown line of a claim."""
    day = F.substring(F.coalesce(F.nullif(F.col("ts"), F.lit("")), created, F.lit("")), 1, 10)
    marks = F.filter(
        F.array(
            F.when(F.col("confidence").isNull(), "unknown").otherwise(F.format_string("%.2f", "confidence")),
            F.when((day != "") & (day != F.substring(F.coalesce(created, F.lit("")), 1, 10)), F.concat(F.lit("recorded "), day)),
            F.when(live_state(F.col("text")), "VERIFY CURRENT"),
        ),
        lambda x: x.isNotNull(),
    )
    line = F.concat(F.lit("- ["), F.array_join(marks, " · "), F.lit("] "), F.col("text"), F.lit(" (topic: "), F.col("topic"), F.lit("; id: "), F.col("id"), F.lit(")"))
    return F.when(F.col("superseded_by").isNotNull(), F.concat(line, F.lit(" [superseded by: "), F.col("superseded_by"), F.lit("]"))).otherwise(line)


def with_sections(items: DataFrame, created: Column) -> DataFrame:
    """Adds section (1 active claims, 2 lessons, 3 superseded claims, 4-6 ids, paths, decisions) and line."""
    lesson = F.coalesce(F.col("topic").startswith("lesson:"), F.lit(False))
    kind = F.when(F.col("kind") == "id", 4).when(F.col("kind") == "path", 5).otherwise(6)
    section = F.when(F.col("bucket") == "supplement", kind).when(lesson, 2).when(F.col("superseded_by").isNotNull(), 3).otherwise(1)
    line = F.when(section.isin(1, 3), item_line(created)).otherwise(F.concat(F.lit("- "), F.col("text")))
    return items.withColumn("section", section).withColumn("line", line)


def header(created: str) -> str:
    return f"{TITLE}\n\n" + (f"recorded {created} (claims are as of this time unless a line says otherwise)\n\n" if created else "")


HEADS = {1: "## Claims\n", 2: "## Lessons\n", 3: "## Superseded Claims\n", 4: "### id\n", 5: "### path\n", 6: "### decision\n"}


def rendered_fit(items: DataFrame, budget: int, created: str, tail: str = "", group: str = "transcript_id") -> DataFrame:
    """The longest prefix by priority whose rendered text fits the budget; `tail` (the marker instruction) counts too.

    The length is additive: each item costs its line; a section's first item pays for the heading. So a running sum
    over the priority is the length for each prefix, and it only grows.
    """
    if budget <= 0:
        return items
    # Claims, with "- None" while there are none, are always there. The last blank line is taken away again.
    fixed = len(header(created)) + len("## Claims\n- None\n\n") - 1 + len(tail)
    w = Window.partitionBy(group).orderBy("priority").rowsBetween(Window.unboundedPreceding, 0)
    # A line is "- ", its text and more, and only "- None" is ever taken back: what is too long by this alone needs no line worked out.
    known = (F.col("bucket") == "supplement") | F.col("topic").isNotNull() & F.col("id").isNotNull()
    least = F.coalesce(F.when(known, F.length("text") + len("- \n")), F.lit(0))
    near = items.withColumn("_least", F.lit(fixed - len("- None\n")) + F.sum(least).over(w)).filter(F.col("_least") <= budget).drop("_least")
    rows = with_sections(near, F.lit(created))
    area = F.when(F.col("section") >= 4, 4).otherwise(F.col("section"))
    first = lambda *key: F.row_number().over(Window.partitionBy(group, *key).orderBy("priority")) == 1
    rows = rows.withColumn("_area", area).withColumn("_first", first("section")).withColumn("_first_area", first("_area"))
    head = F.when(~F.col("_first"), 0)
    for s, text in HEADS.items():
        extra = -len("- None\n") if s == 1 else 0 if s >= 4 else len("\n") + len(text)
        head = head.when(F.col("section") == s, len(text) if s >= 4 else extra)
    head = head + F.when(F.col("_first_area") & (F.col("_area") == 4), len("## Supplement\n\n")).otherwise(0)
    rows = rows.withColumn("rendered", F.lit(fixed) + F.sum(F.length("line") + 1 + head).over(w))
    return rows.filter(F.col("rendered") <= budget).drop("_area", "_first", "_first_area", "section", "line")


def render(items: DataFrame, created: str, tail: str = "", group: str = "transcript_id", groups: DataFrame | None = None) -> DataFrame:
    """One Markdown text for each group: active claims and superseded ones by confidence (none counts as sure), the rest in order.

    groups: all that there are, as one without items has a brief, too, which says so.
    """
    rows = with_sections(items, F.lit(created))
    key = F.when(F.col("section").isin(1, 3), F.struct((-F.coalesce("confidence", F.lit(1.0))).alias("c"), F.col("topic").alias("t"), F.col("id").alias("i"), F.lit(0).alias("p"))).otherwise(F.struct(F.lit(0.0).alias("c"), F.lit("").alias("t"), F.lit("").alias("i"), F.col("pos").alias("p")))
    per = rows.groupBy(group, "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), "line"))), lambda x: x["line"]), "\n").alias("body"))
    wide = per.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("section", "body"))).alias("b"))
    if groups is not None:
        wide = groups.select(group).distinct().join(wide, group, "left")
    part = lambda s: F.try_element_at(F.col("b"), F.lit(s))
    block = lambda s: F.coalesce(F.concat(F.lit(HEADS[s]), part(s), F.lit("\n\n")), F.lit(""))
    kinds = F.concat(*(F.coalesce(F.concat(F.lit(HEADS[s]), part(s), F.lit("\n")), F.lit("")) for s in (4, 5, 6)))
    text = F.concat(
        F.lit(header(created) + HEADS[1]), F.coalesce(part(1), F.lit("- None")), F.lit("\n\n"), block(2), block(3),
        F.when(F.length(kinds) > 0, F.concat(F.lit("## Supplement\n"), kinds, F.lit("\n"))).otherwise(""),
    )
    return wide.select(group, F.concat(F.rtrim(F.regexp_replace(text, r"\s+$", "")), F.lit("\n"), F.lit(tail)).alias("rendered"))


def budget_report(items: DataFrame, kept: DataFrame, budget: int, group: str = "transcript_id", rendered: DataFrame | None = None) -> DataFrame:
    """What a budget cost, for each group: NULL-free counts of one run. rendered (group, rendered) adds the size of what is shown."""
    all_ = items.groupBy(group).agg(F.count_if(F.col("bucket") == "claim").alias("harvested_claims"), F.count_if(F.col("bucket") == "supplement").alias("harvested_supplement"))
    left = kept.groupBy(group).agg(F.sum(F.length("text") + 1).alias("used_chars"), F.count_if(F.col("bucket") == "claim").alias("kept_claims"), F.count_if(F.col("bucket") == "supplement").alias("kept_supplement"))
    rows = all_.join(left, group, "left")
    if rendered is not None:
        rows = rendered.select(group, F.length("rendered").alias("rendered_chars")).join(rows, group, "left")
    rows = rows.fillna(0)
    dropped = F.col("harvested_claims") + F.col("harvested_supplement") - F.col("kept_claims") - F.col("kept_supplement")
    return rows.withColumn("dropped_items", dropped).withColumn("budget_chars", F.lit(budget))
