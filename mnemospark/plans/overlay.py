"""Signals laid over the test conversations, whose invented prose has none: the same sentences in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.redact import redact


def _lines(*parts) -> "F.Column":
    return F.concat_ws("\n", *(F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in p)) for p in parts))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """transcript_id, unit_idx, role, text, as they would be read, secrets in."""
    c, t = F.col("conv_id"), F.col("turn")
    k = (c * 7 + t) % 3
    said = _lines(
        ("The retry ceiling is ", k, " [C:", 50 + (t * 13 + c) % 50, "%, basis: overlay]"),
        ("Note aside. The dashboard port is ", 3000 + k, " [C:90%]"),
        ("See /srv/app", c % 5, "/conf", t % 4, ".yaml and commit ", F.substring(F.md5((c * 1000 + t).cast("string").cast("binary")), 1, 8)),
        ("We decided to keep plan ", k, "."),
        ("I moved to City", k, " in 20", 10 + k, "."),
        ("I work at Plant", k, " now, is it open?"),
        ("Ticket #", 500 + k, " is 123e4567-e89b-12d3-a456-42661417400", k),
        (F.when(k == 2, "So next time always verify the token owner of run ").otherwise("LESSON: always verify the token owner before pushing run "), k),
    )
    asked = _lines(("Correction: the dashboard port is ", 4000 + k, ", not ", 3000 + k), ("mail user", c, "@example.com token = abcdef", 1000 + t), ("Исправление: порт панели ", 4000 + k, ", а не ", 3000 + k))
    told = _lines(("The system value is ", k, " [C:99%]"),)
    more = F.when(F.col("role") == "assistant", said).when(F.col("role") == "user", asked).otherwise(told)
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rows.select(c.alias("transcript_id"), t.cast("int").alias("unit_idx"), "role", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), more).alias("text"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, masked."""
    return conversations(spark, sf_dir).withColumn("text", redact(F.col("text")))


SQL = """
raw AS (
  SELECT conv_id AS transcript_id, CAST(turn AS INTEGER) AS unit_idx, role, coalesce(text, '') || chr(10) || CASE role
    WHEN 'assistant' THEN
      'The retry ceiling is ' || ((conv_id * 7 + turn) % 3) || ' [C:' || (50 + (turn * 13 + conv_id) % 50) || '%, basis: overlay]' || chr(10)
      || 'Note aside. The dashboard port is ' || (3000 + (conv_id * 7 + turn) % 3) || ' [C:90%]' || chr(10)
      || 'See /srv/app' || (conv_id % 5) || '/conf' || (turn % 4) || '.yaml and commit ' || substr(md5(CAST(conv_id * 1000 + turn AS VARCHAR)), 1, 8) || chr(10)
      || 'We decided to keep plan ' || ((conv_id * 7 + turn) % 3) || '.' || chr(10)
      || 'I moved to City' || ((conv_id * 7 + turn) % 3) || ' in 20' || (10 + (conv_id * 7 + turn) % 3) || '.' || chr(10)
      || 'I work at Plant' || ((conv_id * 7 + turn) % 3) || ' now, is it open?' || chr(10)
      || 'Ticket #' || (500 + (conv_id * 7 + turn) % 3) || ' is 123e4567-e89b-12d3-a456-42661417400' || ((conv_id * 7 + turn) % 3) || chr(10)
      || CASE (conv_id * 7 + turn) % 3 WHEN 2 THEN 'So next time always verify the token owner of run ' ELSE 'LESSON: always verify the token owner before pushing run ' END || ((conv_id * 7 + turn) % 3)
    WHEN 'user' THEN
      'Correction: the dashboard port is ' || (4000 + (conv_id * 7 + turn) % 3) || ', not ' || (3000 + (conv_id * 7 + turn) % 3) || chr(10)
      || 'mail user' || conv_id || '@example.com token = abcdef' || (1000 + turn) || chr(10) || 'Исправление: порт панели ' || (4000 + (conv_id * 7 + turn) % 3) || ', а не ' || (3000 + (conv_id * 7 + turn) % 3)
    ELSE 'The system value is ' || ((conv_id * 7 + turn) % 3) || ' [C:99%]' END AS text
  FROM conversations
)"""
