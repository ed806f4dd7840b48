"""From raw documents to packed training batches: five stages, each one operator of mnemospark.llm.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return
the columns of `documents`, and any others, whatever their names; a null text goes with stage one, as it has no language.

Cases, for each stage: an empty table gives no rows. Rows that repeat a doc_id are judged one by one by language and quality, and are one
document for the other stages: near_duplicates keeps one row of it, substring_dedup cuts all alike, packing packs each.
Rows with a null doc_id are judged by language and quality, stay in near_duplicates and substring_dedup, and are
packed. An empty text has no language and goes. Very long texts are worked on whole. Ties go to the smallest doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm import langid, ngram_join, packing, paragraphs, rules
from mnemospark.llm.shared import prepare, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told with a score of 0.5 or more."""
    prepare(spark)
    return langid.keep_known(docs, langid.fit(docs))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that neither the base rule nor the learned decision list rejects."""
    prepare(spark)
    return rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near copies."""
    prepare(spark)
    return ngram_join.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages out of the texts; n_chars follows."""
    prepare(spark)
    out = paragraphs.remove(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches of at most 65,536 padded words in optimal length buckets."""
    prepare(spark)
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("substring_dedup", substring_dedup), ("packing", pack)]

#: The network and the decision list are learned, which SQL can't express. Tests hold the stages' operators against brute force, each by
#: itself, and run() against the five stages called one after the other.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
