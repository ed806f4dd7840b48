"""Extractors: from units of transcripts to claims and supplements.

A unit is (transcript_id, unit_idx, role, text). Every extractor gives rows of ITEM: bucket (claim or
supplement), text, confidence, topic (claims), kind (supplements), harvester, span, and an ordinal that
tells the order inside its transcript and harvester. Nothing relies on the order of partitions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cues, grammar
from ..functions.text import SPACE, ahead, casefold, latin_words, let, normalized, strip
from ..storage import table

MARKER = r"\[C:\s*" + r"(\d{1,3})" + r"\s*%[^\]]*\]"


@dataclass(frozen=True)
class Options:
    """What extraction may be told."""

    marker: str = MARKER
    floor_paths: bool = True
    floor_ids: bool = True
    floor_decisions: bool = True
    lessons: bool = True
    anchor: str = "empty"  # off, empty (long units without a fact), always
    anchor_names: bool = False
    exact_fold: bool = False


def _items(rows: DataFrame, harvester: str, *, bucket: str = "claim", text="text", confidence=None, topic=None, kind=None, span=None, ordinal=()) -> DataFrame:
    null = F.lit(None).cast("string")
    order = F.array(*(F.col(o).cast("int") for o in ordinal))
    return rows.select(
        "transcript_id", "unit_idx", F.lit(bucket).alias("bucket"), F.col(text).alias("text"), (F.lit(None) if confidence is None else confidence).cast("double").alias("confidence"),
        (null if topic is None else topic).alias("topic"), (null if kind is None else kind).alias("kind"), F.lit(harvester).alias("harvester"), (null if span is None else span).alias("span"), order.alias("ordinal"),
    )


def _first_seen(rows: DataFrame, key: Column, *order: str) -> DataFrame:
    """The first row of each key in a transcript."""
    w = Window.partitionBy("transcript_id", key).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def assistant_units(units: DataFrame) -> DataFrame:
    return units.filter(F.col("role") == "assistant")


def correction_units(units: DataFrame) -> DataFrame:
    """The agent's words and those of people, who may correct it; tools and systems never speak here."""
    return units.filter(F.col("role").isin("assistant", "human", "user"))


# Marked statements.


def scoped_statements(text: Column, marker: str = MARKER) -> Column:
    """(statement, percent) of each marker: what stands before it, else what stands behind it."""
    blank = lambda s: ~s.rlike(r"(?U)[^\s\x1c-\x1f]")
    ends = r"(?U)(?<=[.!?…])\s+"
    tidy = lambda s: strip(F.regexp_replace(strip(s), "^[-•*—,;:.)（(]+|[-•*—,;:.)（(]+$", ""))

    def ahead(line: Column) -> Column:
        parts = F.filter(F.split(line, ends), lambda p: ~blank(p))
        return F.coalesce(tidy(F.coalesce(F.try_element_at(parts, F.lit(-1)), line)), F.lit(""))

    def behind(line: Column) -> Column:
        return tidy(F.coalesce(F.get(F.filter(F.split(line, ends), lambda p: ~blank(p)), 0), line))

    def scoped(x: Column, k: Column) -> Column:
        lines = F.filter(F.split(F.get(x["gaps"], k), "\n"), lambda x: ~blank(x))
        after = let(F.get(F.split(F.get(x["gaps"], k + 1), "\n"), 0), behind)
        said = let(let(F.try_element_at(lines, F.lit(-1)), ahead), lambda before: F.when(before != "", before).otherwise(after))
        return F.struct(said.alias("text"), F.get(x["marks"], k).alias("percent"))

    cut = F.struct(F.split(text, marker).alias("gaps"), F.regexp_extract_all(text, F.lit(marker), F.lit(1)).alias("marks"))
    found = let(cut, lambda x: F.when(F.size(x["marks"]) > 0, F.transform(F.sequence(F.lit(0), F.size(x["marks"]) - 1), lambda k: scoped(x, k))))
    return F.filter(F.coalesce(found, F.array().cast("array<struct<text:string,percent:string>>")), lambda s: s["text"] != "")


def claim_topic(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds topic: from the triple of a statement, else from its first words."""
    rows = grammar.with_triple(rows, text, "_t")
    return rows.withColumn("topic", F.coalesce(F.when(F.col("_t").isNotNull(), grammar.triple_topic(F.col("_t"))), grammar.slug_topic(F.col(text)))).drop("_t")


def calibration(units: DataFrame, options: Options = Options()) -> DataFrame:
    """One claim for each confidence marker of the agent."""
    rows = assistant_units(units).filter(F.col("text").rlike(options.marker))
    rows = rows.select("transcript_id", "unit_idx", F.col("text").alias("span"), F.posexplode(scoped_statements(F.col("text"), options.marker)).alias("k", "s"))
    rows = claim_topic(rows.select("transcript_id", "unit_idx", "span", "k", "s.text", "s.percent"))
    confidence = F.least(F.col("percent").cast("int"), F.lit(100)) / 100.0
    return _items(rows, "calibration", confidence=confidence, topic=F.col("topic"), span=F.col("span"), ordinal=("unit_idx", "k"))


# Paths, ids, decisions.

_PATH_END = "0-9A-Za-z._~@%+=:,-"
PATH = rf"(?U)(?<!\w)(?:[~.]?/[{_PATH_END}/]+|(?:[0-9A-Za-z_.-]+/)+[{_PATH_END}]+)"
_HEX = "[0-9A-Fa-f]"
UUID = rf"(?U)\b{_HEX}{{8}}-(?:{_HEX}{{4}}-){{3}}{_HEX}{{12}}\b"
HASH = rf"(?U)\b{_HEX}{{7,40}}\b"
ISSUE = ahead("#o", r"(?iU)#\d+\b|\bobs\s+#\d+\b")


def _cleaned(text: Column) -> Column:
    return F.regexp_replace(strip(text), "[.,;:]+$", "")


#: Of a text, whether something is left once it is cleaned; a filter on the cleaned text would be moved below it and clean twice.
_LEAVES = r"(?U)[^\s\x1c-\x1f.,;:]|[.,;:][\s\x1c-\x1f]+[.,;:]"


def regex_floor(units: DataFrame, options: Options = Options()) -> DataFrame:
    """Paths, ids that are no part of a path met so far, and units that decide something."""
    rows = assistant_units(units).select("transcript_id", "unit_idx", "text")

    def found(pattern: str, family: int) -> DataFrame:
        hits = rows.select("transcript_id", "unit_idx", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("k", "raw")).filter(F.col("raw").rlike(_LEAVES))
        return hits.select("transcript_id", "unit_idx", F.lit(family).alias("family"), "k", "raw", _cleaned(F.col("raw")).alias("clean"))

    paths = found(PATH, 0).filter(F.regexp_replace("raw", "^/+|/+$", "").contains("/"))
    paths = _first_seen(paths, normalized(F.col("clean")), "unit_idx", "k")
    if options.floor_paths and options.floor_ids:
        paths = table(paths, "paths")  # items, and what ids are held against
    out = []
    if options.floor_paths:
        out.append(_items(paths, "regex_floor", bucket="supplement", text="clean", kind=F.lit("path"), ordinal=("unit_idx", "family", "k")))
    if options.floor_ids:
        ids = found(UUID, 1).unionByName(found(HASH, 2)).unionByName(found(ISSUE, 3)).filter(~F.col("raw").rlike(r"^(?U)\d+$"))
        if options.floor_paths:
            p = paths.select(F.col("transcript_id").alias("p_id"), F.col("unit_idx").alias("p_unit"), F.col("clean").alias("p_text"))
            ids = ids.join(p, (F.col("transcript_id") == F.col("p_id")) & (F.col("p_unit") <= F.col("unit_idx")) & F.col("p_text").contains(F.col("raw")), "left_anti")
        ids = _first_seen(ids, normalized(F.col("clean")), "unit_idx", "family", "k")
        out.append(_items(ids, "regex_floor", bucket="supplement", text="clean", kind=F.lit("id"), ordinal=("unit_idx", "family", "k")))
    if options.floor_decisions:
        made = rows.filter(F.col("text").rlike(_LEAVES) & cues.is_decision(F.col("text"))).select("transcript_id", "unit_idx", F.lit(4).alias("family"), F.lit(0).alias("k"), _cleaned(F.col("text")).alias("clean"))
        made = _first_seen(made, normalized(F.col("clean")), "unit_idx")
        out.append(_items(made, "regex_floor", bucket="supplement", text="clean", kind=F.lit("decision"), ordinal=("unit_idx", "family", "k")))
    if not out:
        return _items(rows.filter("false").withColumn("k", F.lit(0)), "regex_floor", bucket="supplement", ordinal=("unit_idx", "k"))
    result = out[0]
    for x in out[1:]:
        result = result.unionByName(x)
    return result


# Corrections and lessons.


def retraction(units: DataFrame, options: Options = Options()) -> DataFrame:
    """Lines that overturn something and say what, from the agent and from people."""
    # Whole texts first, as most have no correction in any line.
    rows = correction_units(units).filter(cues.is_correction(F.col("text"))).select("transcript_id", "unit_idx", (F.col("role") != "assistant").alias("external"), F.posexplode(F.transform(F.split("text", r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), strip)).alias("k", "line"))
    rows = rows.filter(F.length("line").between(24, 360) & cues.is_correction(F.col("line")))
    floor = F.when(F.col("external"), 5).otherwise(4)
    rows = rows.filter((F.size(cues.signature(F.col("line"))) > 0) | (F.size(F.array_distinct(cues.long_words(F.col("line")))) >= floor))
    rows = _first_seen(rows, normalized(F.col("line")), "unit_idx", "k")
    return _items(rows, "retraction", text="line", topic=cues.correction_topic(F.col("line"), F.col("external")), ordinal=("unit_idx", "k"))


def lessons(units: DataFrame, options: Options = Options()) -> DataFrame:
    """Rules that the agent states about its own work."""
    rows = assistant_units(units) if options.lessons else assistant_units(units).filter("false")
    rows = rows.select("transcript_id", "unit_idx", F.col("text").alias("span"), F.posexplode(cues.lesson_bodies(F.col("text"))).alias("k", "body"))
    rows = _first_seen(rows, casefold(F.col("body")), "unit_idx", "k")
    return _items(rows, "lessons", text="body", topic=F.concat(F.lit("lesson:"), F.substring(casefold(F.col("body")), 1, 40)), span=F.col("span"), ordinal=("unit_idx", "k"))


# Unmarked facts.

ANCHOR_LEAST, ANCHOR_MOST, ANCHOR_NAMES = 200, 220, 8


def _anchor(text: Column, names: bool, sentences: Column | None = None) -> Column:
    """The opening sentence of a long unit, cut; NULL if there is none. sentences: those of the text, where they are known."""
    usable = F.filter(grammar.sentences(text) if sentences is None else sentences, lambda s: (F.size(latin_words(s)) >= grammar.LEAST_WORDS) & ~s.rlike(grammar.LIST_ITEM))
    head = F.when(F.length(text) >= ANCHOR_LEAST, F.substring(F.get(usable, 0), 1, ANCHOR_MOST))
    if not names:
        return head
    found = F.filter(F.regexp_extract_all(text, F.lit(grammar.NAME), F.lit(0)), lambda n: ~F.contains(casefold(head), casefold(n)))
    once = F.aggregate(found, F.array().cast("array<string>"), lambda a, n: F.when(F.exists(a, lambda x: casefold(x) == casefold(n)), a).otherwise(F.concat(a, F.array(n))))
    once = F.slice(once, 1, ANCHOR_NAMES)
    return F.when(F.size(once) > 0, F.concat(head, F.lit(" | "), F.array_join(once, ", "))).otherwise(head)


def factual_sentences(units: DataFrame, options: Options = Options()) -> DataFrame:
    """Assertions with a triple, in order: transcript_id, unit_idx, sent, part, text, topic; repeats included."""
    said = F.col("sentences") if "sentences" in units.columns else grammar.sentences(F.col("text"))
    rows = assistant_units(units).select("transcript_id", "unit_idx", F.posexplode(said).alias("sent", "sentence"))
    rows = rows.filter(~F.col("sentence").rlike(options.marker))
    rows = rows.select("transcript_id", "unit_idx", "sent", F.posexplode(grammar.factual_parts(F.col("sentence"))).alias("part", "text"))
    # A filter would be moved below the grammar's steps, and all of them written out in it again.
    some = F.explode(F.filter(F.array("triple"), lambda t: t.isNotNull()))
    rows = grammar.with_triple(rows, "text", "triple").select("transcript_id", "unit_idx", "sent", "part", "text", some.alias("triple"))
    return rows.withColumn("topic", grammar.triple_topic(F.col("triple")))


def atomic(units: DataFrame, options: Options = Options()) -> DataFrame:
    """Unmarked facts, one for each sentence, and an anchor for each long unit that gave none.

    A fact and an anchor with the same words suppress each other by order. The plan takes three steps (facts,
    anchors where a unit kept none, repeats among both), which differs from a fold over the units only if
    an anchor equals a later unit's only fact; options.exact_fold folds each transcript instead.
    """
    # Written once: the grammar is the heaviest part, and anchors and repeats both look at its results.
    units = table(assistant_units(units).select("transcript_id", "unit_idx", "role", "text", grammar.sentences(F.col("text")).alias("sentences")), "sentences") if options.anchor != "off" else units
    facts = table(factual_sentences(units, options).withColumn("key", normalized(F.col("text"))), "facts")
    if options.anchor == "off":
        kept = _first_seen(facts, F.col("key"), "unit_idx", "sent", "part")
        return _items(kept, "atomic", topic=F.col("topic"), ordinal=("unit_idx", "sent", "part"))
    # Not a filter, which would be moved below and hold the anchor again.
    some = F.explode(F.filter(F.array(_anchor(F.col("text"), options.anchor_names, F.col("sentences"))), lambda a: a.isNotNull()))
    anchors = units.select("transcript_id", "unit_idx", some.alias("text"))
    head = grammar.object_head(latin_words(F.col("text")))
    anchors = anchors.select("transcript_id", "unit_idx", F.lit(1 << 30).alias("sent"), F.lit(0).alias("part"), "text", F.concat(F.lit("context|"), F.when(head != "", head).otherwise("turn")).alias("topic"), normalized(F.col("text")).alias("key"))
    facts = facts.select(*anchors.columns)
    if options.exact_fold:
        kept = _folded(facts.withColumn("anchor", F.lit(False)).unionByName(anchors.withColumn("anchor", F.lit(True))), options.anchor == "always")
    else:
        if options.anchor == "empty":
            full = _first_seen(facts, F.col("key"), "unit_idx", "sent", "part").select("transcript_id", "unit_idx").distinct()
            anchors = anchors.join(full, ["transcript_id", "unit_idx"], "left_anti")
        kept = _first_seen(facts.unionByName(anchors), F.col("key"), "unit_idx", "sent", "part")
    return _items(kept, "atomic", topic=F.col("topic"), ordinal=("unit_idx", "sent", "part"))


def _folded(rows: DataFrame, always: bool) -> DataFrame:
    """The exact order-dependent rule, one transcript at a time."""

    def fold(frame):
        seen, kept, facts_of = set(), [], set()
        frame = frame.sort_values(["unit_idx", "sent", "part"])
        for k, r in zip(frame.index, frame.itertuples()):
            if r.key in seen or r.anchor and not always and r.unit_idx in facts_of:
                continue
            seen.add(r.key)
            kept.append(k)
            facts_of.add(r.unit_idx)
        return frame.loc[kept]

    return rows.groupBy("transcript_id").applyInPandas(fold, rows.schema)


#: By name, in the order in which their claims enter a brief. Register one's own here.
EXTRACTORS: dict[str, Callable[[DataFrame, Options], DataFrame]] = {"retraction": retraction, "atomic": atomic, "calibration": calibration, "regex_floor": regex_floor, "lessons": lessons}


def extractor(name: str) -> Callable[[DataFrame, Options], DataFrame]:
    return EXTRACTORS[name]


def harvest(units: DataFrame, names=tuple(EXTRACTORS), options: Options = Options(), enabled: bool = True) -> DataFrame:
    """All items of all transcripts, with `rank` (of the extractor) and `pos` (from 0, inside transcript and bucket)."""
    if not enabled:
        units = units.filter("false")
    parts = [extractor(n)(units, options).withColumn("rank", F.lit(k)) for k, n in enumerate(names)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    w = Window.partitionBy("transcript_id", "bucket").orderBy("rank", "ordinal")
    return rows.withColumn("pos", F.row_number().over(w) - 1)
