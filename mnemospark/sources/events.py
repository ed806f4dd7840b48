"""Streams of agent events, as lines of JSON or as one blob."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .transcripts import _kind, _parts, _string, parse


def lines_of(blobs: DataFrame) -> DataFrame:
    """run_id, line, value of blobs (run_id, value)."""
    return blobs.select("run_id", F.posexplode(F.split("value", r"\r?\n")).alias("line", "value")).filter(F.trim("value") != "")


def decoded(lines: DataFrame) -> DataFrame:
    return parse(lines).filter("parsed is not null").withColumn("type", _string(F.col("parsed"), "$.type"))


def agent_messages(lines: DataFrame) -> DataFrame:
    """run_id, line, role, text of every finished message of the agent."""
    v = F.col("parsed")
    rows = decoded(lines).filter((F.col("type") == "item.completed") & (_string(v, "$.item.type") == "agent_message"))
    text = F.coalesce(_string(v, "$.item.text"), _string(v, "$.item.content"), _parts(v, "$.item.content"))
    return rows.select("run_id", "line", F.lit("assistant").alias("role"), text.alias("text")).filter(F.trim("text") != "")


def runs(lines: DataFrame) -> DataFrame:
    """run_id, events, thread_id (the first), input_tokens, cached_input_tokens, output_tokens (the last), text_seen, parse_error."""
    v = F.col("parsed")
    rows = parse(lines).withColumn("type", _string(v, "$.type"))
    usage = F.when((F.col("type") == "turn.completed") & _kind(F.try_variant_get(v, "$.usage", "variant")).startswith("OBJECT"), F.struct(*(F.try_variant_get(v, f"$.usage.{k}", "long").alias(k) for k in ("input_tokens", "cached_input_tokens", "output_tokens"))))
    thread = F.when(F.col("type") == "thread.started", F.nullif(_string(v, "$.thread_id"), F.lit("")))
    rows = rows.select("run_id", "line", F.col("parsed").isNotNull().alias("ok"), usage.alias("usage"), thread.alias("thread"))
    out = rows.groupBy("run_id").agg(
        F.count_if("ok").alias("events"), F.min_by("thread", F.when(F.col("thread").isNotNull(), F.col("line"))).alias("thread_id"),
        F.max_by("usage", F.when(F.col("usage").isNotNull(), F.col("line"))).alias("usage"), F.count("*").alias("lines"),
    )
    return out.select("run_id", "events", "thread_id", "usage.*", (F.col("events") == 0).alias("parse_error"))
