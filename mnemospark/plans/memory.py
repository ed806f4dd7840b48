"""The two paths end to end: transcripts to briefs, briefs to context."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from os import environ

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import budget as b
from ..operators.corpus import corpus, recency_rank
from ..operators.extract import EXTRACTORS, MARKER, Options, harvest
from ..operators.resolve import carry_lessons, link_corrections, once_by_id, resolve, with_ids
from ..sources.briefs import to_json
from ..storage import table
from ..operators.search import query_terms, recall, scored

_OFF = ("0", "false", "no", "off")


@dataclass
class Config:
    brief_dir: str = "~/.mnemospark/briefs"
    lessons_path: str = "~/.mnemospark/lessons.jsonl"
    lessons_in_brief: int = 10
    lessons_enabled: bool = True
    budget_chars: int = 12_000
    harvest_enabled: bool = True
    harvesters: list[str] = field(default_factory=lambda: list(EXTRACTORS))
    marker: str = MARKER
    redact: bool = True
    floor_decisions: bool = True
    floor_ids: bool = True
    floor_paths: bool = True

    @classmethod
    def from_file(cls, path: str) -> "Config":
        """Known names only; others are ignored."""
        from pathlib import Path

        given = json.loads(Path(path).read_text("utf-8"))
        known = {x.name for x in fields(cls)}
        return cls(**{k: v for k, v in given.items() if k in known})

    @classmethod
    def from_env(cls, env=environ) -> "Config":
        out = cls()
        out.brief_dir = env.get("MNEMOSPARK_BRIEF_DIR") or out.brief_dir
        out.lessons_path = env.get("MNEMOSPARK_LESSONS_PATH") or out.lessons_path
        out.harvest_enabled = env.get("MNEMOSPARK_HARVEST", "1").strip().lower() not in _OFF
        out.lessons_enabled = env.get("MNEMOSPARK_LESSONS", "1").strip().lower() not in _OFF
        try:
            out.budget_chars = max(0, int(env.get("MNEMOSPARK_BUDGET_CHARS", out.budget_chars)))
        except ValueError:
            pass  # a bad value counts as none
        return out

    def options(self) -> Options:
        return Options(marker=self.marker, floor_paths=self.floor_paths, floor_ids=self.floor_ids, floor_decisions=self.floor_decisions, lessons=self.lessons_enabled)


def build_items(units: DataFrame, config: Config = Config(), store: DataFrame | None = None) -> DataFrame:
    """Resolved claims and supplements of every transcript, before any budget."""
    items = table(with_ids(harvest(units, tuple(config.harvesters), config.options(), config.harvest_enabled)).withColumn("ts", F.lit(None).cast("string")), "items")
    claims = link_corrections(items.filter("bucket = 'claim'"))
    if config.lessons_enabled and store is not None:
        claims = carry_lessons(claims, store, config.lessons_in_brief, groups=units.select("transcript_id")).withColumn("bucket", F.lit("claim"))
    return table(resolve(claims).unionByName(once_by_id(items.filter("bucket = 'supplement'")), allowMissingColumns=True), "resolved")


def select_items(items: DataFrame, budget: int, created: str, tail: str = "") -> DataFrame:
    """What is kept: greedily by score first, then as many as fit once rendered. Recency is taken anew after the first cut."""
    if budget <= 0:
        return items
    kept = table(b.greedy(b.scored(items), budget).filter("kept").drop("kept", "priority", "score"), "kept")
    again = kept.withColumn("pos", F.row_number().over(Window.partitionBy("transcript_id", "bucket").orderBy("pos")) - 1)
    return b.rendered_fit(b.scored(again), budget, created, tail)


def briefs(units: DataFrame, created: str, config: Config = Config(), store: DataFrame | None = None) -> DataFrame:
    """transcript_id and rendered: the write path followed by the read path. A transcript without items has a brief, too."""
    groups = table(units.select("transcript_id").distinct(), "transcripts")
    return b.render(select_items(build_items(units, config, store), config.budget_chars, created), created, groups=groups)


def documents(units: DataFrame, created: str, config: Config = Config(), store: DataFrame | None = None, agent: str = "mnemospark", extras: DataFrame | None = None) -> DataFrame:
    """transcript_id and value: the brief of every transcript as JSON, with what its budget cost."""
    groups = table(units.select("transcript_id").distinct(), "transcripts")
    items = build_items(units, config, store)
    kept = select_items(items, config.budget_chars, created)
    kept = table(kept, "selected") if config.budget_chars > 0 else items
    report = b.budget_report(items, kept, config.budget_chars, rendered=b.render(kept, created, groups=groups)) if config.budget_chars > 0 else None
    return to_json(kept, created, report=report, groups=groups, agent=agent, extras=extras)


def context_payload(items: DataFrame, created: str, event: str = "SessionStart", budget: int = 0, groups: DataFrame | None = None) -> DataFrame:
    """transcript_id and payload (JSON); a session's start also gets the marker instruction, which the budget covers."""
    tail = "\n" + b.MARKERS + "\n" if event == "SessionStart" else ""
    fitted = b.rendered_fit(b.scored(items), budget, created, tail) if budget > 0 else items
    text = b.render(fitted, created, tail, groups=items if groups is None else groups)
    inner = F.struct(F.lit(event).alias("hookEventName"), F.col("rendered").alias("additionalContext"))
    return text.select("transcript_id", F.to_json(F.struct(inner.alias("hookSpecificOutput"))).alias("payload"))


def search(spark, claims: DataFrame, supplements: DataFrame, query: str, limit: int = 10, budget: int = 0, lessons: DataFrame | None = None) -> DataFrame:
    """Ranked rows for one query over the whole store."""
    docs = corpus(claims, supplements, lessons)
    return recall(scored(docs, query_terms(spark, {"q": query}), recency_rank(docs)), limit, budget)
