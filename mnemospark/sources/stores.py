"""Append-only stores: lessons, probes, and other sources that evaluation reads."""

from __future__ import annotations

import fcntl
import json
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import casefold, content_id


def lesson_id(text):
    return content_id("lesson", F.lit(""), text)


def read_lessons(spark: SparkSession, path: str) -> DataFrame:
    """seq, id, text, ts, session of a JSON-lines log; broken lines and those without an id are left out, of equal ids the first keeps its place and the last its values."""
    from .transcripts import read_lines

    rows = read_lines(spark, path).select("transcript_id", "line", F.from_json("value", "id string, text string, ts string, session string").alias("l"))
    rows = rows.filter(F.col("l.text").isNotNull() & F.col("l.id").isNotNull()).select(F.struct("transcript_id", "line").alias("at"), "l.id", "l.text", "l.ts", "l.session")
    return latest(rows, "at").withColumn("seq", F.col("at.line")).drop("at")


def latest(rows: DataFrame, order: str) -> DataFrame:
    """One row for each id: order of its first row, values of its last."""
    values = [c for c in rows.columns if c not in ("id", order)]
    per = rows.groupBy("id").agg(F.min(order).alias(order), F.max_by(F.struct(*values), order).alias("v"))
    return per.select("id", order, *(F.col(f"v.{c}") for c in values))


def new_lessons(store: DataFrame, batch: DataFrame) -> DataFrame:
    """The rows of a batch (seq, text, ...) whose id the store lacks, the first of each id."""
    rows = batch.withColumn("id", lesson_id(F.col("text"))).join(store.select("id"), "id", "left_anti")
    w = Window.partitionBy("id").orderBy("seq")
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def once_by_text(lessons: DataFrame) -> DataFrame:
    w = Window.partitionBy(casefold(F.col("text"))).orderBy("seq")
    return lessons.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def recent(lessons: DataFrame, limit: int) -> DataFrame:
    return lessons.orderBy(F.desc("seq")).limit(max(0, limit))


def append_private(path: str, rows: list[dict]) -> None:
    """Adds JSON lines under a lock; only the owner can read the file."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), mode=0o700, exist_ok=True)
    fd = os.open(path, os.O_APPEND | os.O_CREAT | os.O_WRONLY, 0o600)
    with os.fdopen(fd, "a", encoding="utf-8") as f:
        fcntl.flock(f, fcntl.LOCK_EX)
        f.writelines(json.dumps(r, ensure_ascii=False, sort_keys=True) + "\n" for r in rows)
        f.flush()
        os.fsync(f.fileno())


def append_units(path: str, units: list[dict]) -> int:
    """Adds units to a rolling transcript, which only its owner may read, as a file that was there before may be read no longer
    by others, either; the number added."""
    append_private(path, units)
    os.chmod(os.path.dirname(os.path.abspath(path)), 0o700)
    os.chmod(path, 0o600)
    return len(units)


def rotate(path: str, stamp: str) -> str | None:
    """Puts a harvested transcript away under a name of its own, so that the next one begins empty; None without a transcript."""
    if not os.path.exists(path):
        return None
    away = f"{path}.{stamp}.done"
    os.replace(path, away)
    return away


def lesson_row(text: str, ts: str | None = None, session: str | None = None) -> dict:
    """A line of the lesson log; its id is that of `lesson_id`."""
    import hashlib

    text = text.strip()
    folded = " ".join(text.lower().replace("ß", "ss").replace("ς", "σ").split())
    return {"id": hashlib.sha1(f"lesson||{folded}".encode()).hexdigest()[:16], "text": text, "ts": ts, "session": session}


def read_observations(spark: SparkSession, url: str, table: str = "observations", limit: int = 300, driver: str | None = None) -> DataFrame:
    """Newest titled records of a relational store by JDBC, the text of title and narrative; filter and limit go down to it."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    rows = (reader.option("driver", driver) if driver else reader).load()
    return observations(rows, limit)


def observations(rows: DataFrame, limit: int = 300) -> DataFrame:
    good = (F.coalesce("title", F.lit("")) != "") & (F.coalesce("narrative", F.lit("")) != "")
    return rows.filter(good).orderBy(F.desc("id")).limit(limit).select("id", "title", "narrative")


INSTANCE = (
    "question string, question_type string, answer string, answer_session_ids array<string>, haystack_session_ids array<string>, haystack_dates array<string>, "
    "haystack_sessions array<array<struct<role:string,content:string,has_answer:boolean>>>"
)


def read_instances(spark: SparkSession, path: str) -> DataFrame:
    """Questions with their sessions, from a JSON array or from JSON lines (which split; an array is read by one task)."""
    return spark.read.schema(INSTANCE).option("multiLine", True).json(path)


def instance_turns(instances: DataFrame, key: str = "question_id") -> DataFrame:
    """key, session, stamp, turn, role, content, has_answer: a row for each turn."""
    s = instances.select(key, "haystack_session_ids", "haystack_dates", F.posexplode("haystack_sessions").alias("k", "turns"))
    s = s.select(key, F.get("haystack_session_ids", F.col("k")).alias("session"), F.get("haystack_dates", F.col("k")).alias("stamp"), F.posexplode("turns").alias("turn", "t"))
    return s.select(key, "session", "stamp", "turn", "t.role", "t.content", F.coalesce("t.has_answer", F.lit(False)).alias("has_answer"))
