"""Transcripts: JSON lines of many shapes, into units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.redact import redact
from ..functions.text import strip

AUTHORS = ("assistant", "function", "human", "system", "tool", "user")


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _variant(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _string(v: Column, path: str) -> Column:
    """The value at a path if it is a string; else NULL. (A cast would turn objects into text.)"""
    return F.when(_kind(_variant(v, path)) == "STRING", F.try_variant_get(v, path, "string"))


def _parts(v: Column, path: str, deeper: bool = False) -> Column:
    """Texts of a list whose members are strings or objects with a text, joined by line breaks; NULL if none."""
    members = F.try_variant_get(v, path, "array<variant>")

    def text(x: Column) -> Column:
        own = F.when(_kind(x) == "STRING", x.cast("string")).otherwise(_string(x, "$.text"))
        if not deeper:
            return own
        nested = F.filter(F.transform(F.try_variant_get(x, "$.content", "array<variant>"), lambda y: _string(y, "$.text")), lambda y: y.isNotNull())
        return F.coalesce(own, _string(x, "$.content"), F.when(F.size(nested) > 0, F.array_join(nested, "\n")))

    found = F.filter(F.transform(members, text), lambda y: y.isNotNull())
    return F.when(F.size(found) > 0, F.array_join(found, "\n"))


def extract_text(v: Column) -> Column:
    """The text of a row; the first place that holds one decides, even if it is empty."""
    return F.coalesce(_string(v, "$.text"), _string(v, "$.content"), _string(v, "$.message"), _string(v, "$.message.content"), _parts(v, "$.message.content"))


def extract_message_text(v: Column) -> Column:
    """As evaluation reads rows: the message first, lists inside it too, the row's own text last."""
    return F.coalesce(_string(v, "$.message"), _string(v, "$.message.content"), _parts(v, "$.message.content", True), _string(v, "$.text"), _string(v, "$.content"))


def author(v: Column) -> Column:
    """Who wrote a row: any role of its message, else its role or type if that names an author."""
    named = lambda x: F.when(F.lower(x).isin(*AUTHORS), F.lower(x))
    return F.coalesce(F.lower(_string(v, "$.message.role")), named(_string(v, "$.role")), named(_string(v, "$.type")))


def parse(lines: DataFrame) -> DataFrame:
    """Adds parsed (NULL for broken JSON and for what isn't an object); column value."""
    v = F.try_parse_json("value")
    return lines.withColumn("parsed", F.when(_kind(v).startswith("OBJECT"), v))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """transcript_id (file), line, value: the lines of files, numbered; blank ones are left out.

    A file is read whole to number its lines, so it should fit a task; write larger ones as Parquet with a
    line column once, and start from `units`.
    """
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("transcript_id"), F.posexplode(F.split("value", "\n")).alias("line", "value"))
    return rows.filter(strip(F.col("value")) != "")


def units(lines: DataFrame, masked: bool = True) -> DataFrame:
    """transcript_id, unit_idx, role, text from transcript_id, line, value; rows without text are dropped."""
    rows = parse(lines).select("transcript_id", "line", F.coalesce(author(F.col("parsed")), F.lit("assistant")).alias("role"), extract_text(F.col("parsed")).alias("text"))
    rows = rows.filter(F.col("text") != "")
    index = F.row_number().over(Window.partitionBy("transcript_id").orderBy("line")) - 1
    return rows.select("transcript_id", index.alias("unit_idx"), "role", (redact(F.col("text")) if masked else F.col("text")).alias("text"))


def quality(lines: DataFrame) -> DataFrame:
    """transcript_id, total, skipped, usable, by_assistant, problem: what a scan met."""
    rows = parse(lines).withColumn("text", extract_text(F.col("parsed"))).withColumn("role", F.coalesce(author(F.col("parsed")), F.lit("assistant")))
    used = F.coalesce(F.col("text") != "", F.lit(False))
    out = rows.groupBy("transcript_id").agg(F.count("*").alias("total"), F.count_if(F.col("parsed").isNull()).alias("skipped"), F.count_if(used).alias("usable"), F.count_if(used & (F.col("role") == "assistant")).alias("by_assistant"))
    problem = F.when(F.col("skipped") == F.col("total"), "no usable rows").when((F.col("usable") > 0) & (F.col("by_assistant") == 0), "no assistant rows").when(F.col("skipped") > 0, "some rows skipped")
    return out.withColumn("problem", problem)
