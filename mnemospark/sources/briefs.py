"""Brief documents: JSON files in, tables and JSON files out."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_id

VERSION = 1
CLAIM = "struct<id:string,text:string,confidence:double,topic:string,source_harvester:string,ts:string,source_span:string,superseded_by:string,supersedes:string>"
SUPPLEMENT = "struct<id:string,text:string,kind:string,source_harvester:string>"
BUDGET = "struct<budget_chars:int,used_chars:int,rendered_chars:int,kept_claims:int,kept_supplement:int,dropped_items:int,harvested_claims:int,harvested_supplement:int>"
SCHEMA = (
    f"schema_version int, created_utc string, source struct<agent:string,session:string,budget:{BUDGET}>, claims array<{CLAIM}>, supplement array<{SUPPLEMENT}>, "
    "open_threads array<string>, last_user_ask string, narrative array<string>, _broken string"
)
KINDS = ("decision", "id", "path")


def scan(spark: SparkSession, path: str) -> DataFrame:
    """All files that hold a JSON object, as statistics count them: brief_id (file name) and the fields, loosely."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("brief_id"), F.col("_metadata.file_modification_time").alias("modified"))
    parsed = F.from_json("value", SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    rows = files.select(parsed.alias("b"), "brief_id", "modified").filter("b is not null and b._broken is null")
    return rows.select("b.*", "brief_id", "modified").drop("_broken")


def strict(rows: DataFrame) -> DataFrame:
    """Those that recall and re-injection accept: version 1, both lists there, all required fields in them."""
    missing = lambda x, names: F.greatest(*(x[n].isNull() for n in names), F.lit(False))
    good = (F.col("schema_version") == VERSION) & F.col("claims").isNotNull() & F.col("supplement").isNotNull()
    good = good & ~F.exists("claims", lambda c: missing(c, ("id", "text", "topic", "source_harvester"))) & ~F.exists("supplement", lambda s: missing(s, ("text", "kind")) | ~s["kind"].isin(*KINDS))
    return rows.filter(good)


def newest(rows: DataFrame) -> DataFrame:
    """The brief modified last, of those given."""
    return rows.orderBy(F.desc("modified"), F.desc("brief_id")).limit(1)


def clamp(confidence: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))


def claims(rows: DataFrame) -> DataFrame:
    """One row for each claim: brief_id, pos, created_utc and its fields."""
    x = rows.select("brief_id", "created_utc", F.posexplode("claims").alias("pos", "c"))
    return x.select("brief_id", "created_utc", "pos", "c.id", "c.text", clamp(F.col("c.confidence")).alias("confidence"), "c.topic", F.col("c.source_harvester").alias("harvester"), "c.ts", F.col("c.source_span").alias("span"), "c.superseded_by", "c.supersedes")


def supplements(rows: DataFrame) -> DataFrame:
    x = rows.select("brief_id", "created_utc", F.posexplode("supplement").alias("pos", "s"))
    id_ = F.coalesce("s.id", content_id(F.coalesce("s.source_harvester", F.lit("regex_floor")), F.col("s.kind"), F.col("s.text")))
    return x.select("brief_id", "created_utc", "pos", id_.alias("id"), "s.text", "s.kind", F.col("s.source_harvester").alias("harvester"))


def to_json(items: DataFrame, created: str, group: str = "transcript_id", report: DataFrame | None = None, groups: DataFrame | None = None, agent: str | None = None, extras: DataFrame | None = None) -> DataFrame:
    """group and value: one JSON document for each brief. A brief's items are its own, budgeted list.

    report: rows of `budget_report`, kept in source.budget; groups: all there are, with items or without; extras: group and
    any of open_threads, narrative (lists), last_user_ask.
    """
    claim = F.struct("id", "text", "confidence", "topic", F.col("harvester").alias("source_harvester"), "ts", F.col("span").alias("source_span"), "superseded_by", "supersedes")
    item = F.struct("id", "text", "kind", F.col("harvester").alias("source_harvester"))
    pick = lambda bucket, x: F.transform(F.array_sort(F.collect_list(F.when(F.col("bucket") == bucket, F.struct("pos", x.alias("x"))))), lambda y: y["x"])
    per = items.groupBy(group).agg(pick("claim", claim).alias("claims"), pick("supplement", item).alias("supplement"))
    if groups is not None:
        kinds = dict(per.dtypes)
        per = groups.select(group).distinct().join(per, group, "left")
        per = per.select(group, *(F.coalesce(c, F.array().cast(kinds[c])).alias(c) for c in ("claims", "supplement")))
    source = [F.col(group).cast("string").alias("session")] + ([F.lit(agent).alias("agent")] if agent else [])
    if report is not None:
        names = ("budget_chars", "used_chars", "rendered_chars", "kept_claims", "kept_supplement", "dropped_items", "harvested_claims", "harvested_supplement")
        per = per.join(report.select(group, F.struct(*(n for n in names if n in report.columns)).alias("budget")), group, "left")
        source.append(F.col("budget"))
    more = [c for c in ("open_threads", "narrative", "last_user_ask") if extras is not None and c in extras.columns]
    if more:
        per = per.join(extras.select(group, *more), group, "left")
    doc = F.struct("claims", F.lit(created).alias("created_utc"), *more, F.lit(VERSION).alias("schema_version"), F.struct(*source).alias("source"), "supplement")
    return per.select(group, F.to_json(doc, {"ignoreNullFields": "true"}).alias("value"))


def write(briefs: DataFrame, path: str, mode: str = "append") -> None:
    """Documents of `to_json` as text files, one JSON object a line; the commit protocol makes it all or nothing."""
    briefs.select("value").write.mode(mode).text(path)


def write_private(path: str, text: str) -> str:
    """One file for its owner only, on the driver: a temporary file, flushed, then renamed."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, mode=0o700, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=folder, prefix=".brief-")
    try:
        with open(handle, mode="w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.chmod(temporary, 0o600)
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise
    return path


def problem_of(path: str, since: float | None = None) -> str | None:
    """Why a file can't count as the brief of a run that began at `since` (seconds), or None if it can: the gate before its
    transcript is put away."""
    if not os.path.isfile(path):
        return "no brief was written"
    if since is not None and os.path.getmtime(path) < since:
        return "the brief is older than the run"
    with open(path, "rb") as f:
        raw = f.read()
    if not raw.strip():
        return "the brief is empty"
    try:
        found = json.loads(raw)
    except ValueError as e:
        return f"the brief can't be read: {e}"
    if not isinstance(found, dict):
        return "the brief is no JSON object"
    lacking = sorted({"claims", "schema_version", "supplement"} - found.keys())
    return f"the brief lacks {', '.join(lacking)}" if lacking else None


def harden(folder: str) -> None:
    """Takes everyone else's rights away from a store that exists."""
    for root, _, files in os.walk(folder):
        os.chmod(root, 0o700)
        for f in files:
            os.chmod(os.path.join(root, f), 0o600)


def pretty(document: str) -> str:
    """The stored form: sorted keys, two blanks, a line break at the end."""
    return json.dumps(json.loads(document), indent=2, sort_keys=True, ensure_ascii=False) + "\n"


BEGIN, END = "<!-- memory:begin -->", "<!-- memory:end -->"


def managed_block(existing: str, markdown: str) -> str:
    """`existing` with the text between the markers replaced (from the first begin to the last end), or added at its end.

    Markers inside the new text are defused, so that doing it again changes nothing.
    """
    safe = markdown.replace(BEGIN, "[memory:begin]").replace(END, "[memory:end]").rstrip()
    block = f"{BEGIN}\n{safe}\n{END}\n"
    if BEGIN in existing and END in existing:
        head = existing[: existing.index(BEGIN)].rstrip("\n")
        rest = existing[existing.rindex(END) + len(END) :].lstrip("\n")
    else:
        head, rest = existing.rstrip("\n"), ""
    return head + ("\n\n" if head.strip() else "") + block + rest
