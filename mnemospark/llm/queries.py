"""One query for each operator, over whole tables."""

from __future__ import annotations

from . import langid, lshforest, ngram_join, packing, paragraphs, pieces, rules, sharding, tokencount, warc
from .shared import prepare


def _documents(spark, sf_dir):
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _tokenizer(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark, sf_dir):
    return pieces.round_trip(_documents(spark, sf_dir), _tokenizer("piece_bpe_32k.model"))


def op2_packing(spark, sf_dir):
    return packing.pack(_documents(spark, sf_dir))


def op3_ngram_join(spark, sf_dir):
    return ngram_join.near_copies(_documents(spark, sf_dir))


def op4_token_counts(spark, sf_dir):
    return tokencount.token_counts(_documents(spark, sf_dir), _tokenizer("byte_bpe_50k.json"))


def op5_language_id(spark, sf_dir):
    return langid.identify(_documents(spark, sf_dir))


def op6_substring_dedup(spark, sf_dir):
    return paragraphs.spans(_documents(spark, sf_dir))


def op7_neighbours(spark, sf_dir):
    prepare(spark)
    return lshforest.neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_warc(spark, sf_dir):
    prepare(spark)
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_sharding(spark, sf_dir):
    return sharding.shard(_documents(spark, sf_dir))


def op10_quality_rules(spark, sf_dir):
    return rules.judge(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries():
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Brute force: all pairs that share a shingle are counted, and links are followed to their ends.
NGRAM_JOIN = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY ALL),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b, c = na.n AND c = nb.n AS same FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 90 * (na.n + nb.n - c)),
e AS (SELECT a, b, same FROM l UNION ALL SELECT b, a, same FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a, min(b) AS low FROM r GROUP BY ALL), k AS (SELECT a, count(*) AS n_similar, min(b) FILTER (same) AS twin FROM e GROUP BY ALL)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(n_similar, 0) AS n_similar, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id, least(d.doc_id, coalesce(twin, d.doc_id)) AS class_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN k ON k.a = d.doc_id LEFT JOIN c ON c.a = d.doc_id"""

WARC = """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT *, list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((((instr('0123456789abcdef', substr(hex, 5 * i // 4 + 1, 1)) - 1) * 16 + instr('0123456789abcdef', substr(hex, 5 * i // 4 + 2, 1)) - 1) >> CAST(3 - 5 * i % 4 AS INTEGER)) & 31 AS INTEGER) + 1, 1)), lambda x, y: x || y) AS payload_digest,
  max(page_id) OVER (PARTITION BY hex) AS keep FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keep THEN keep END AS refers_to FROM d"""


def oracle_sql():
    """Of the ten, two are plain SQL; the others rest on a library, on hashes, or on something learned."""
    return {"op3_ngram_join": NGRAM_JOIN, "op8_warc": WARC}
