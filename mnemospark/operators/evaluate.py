"""Evaluation: what of a set of probes is still there, and how well search finds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cues import content_terms  # noqa: F401  (part of the surface)
from ..functions.lexicon import QUESTION_STOPS
from ..functions.text import ascii_tokens, jaccard, normalized, member, search_tokens
from ..storage import table
from . import search
from .extract import MARKER

PARAPHRASE = 0.5


#: Most probes that are sent to every task; more are joined by their tokens.
FEW_PROBES = 4096


def best_match(probes: DataFrame, items: DataFrame, threshold: float = PARAPHRASE) -> DataFrame:
    """id, verdict (EXACT, PARA, LOST), score, matched (extractor), expected: one row for each probe.

    probes: id, text, harvester; items: seq (total order), text, harvester. Equal texts are found by their normal form.
    For the rest, up to FEW_PROBES probes are sent to the items, and each batch gives its best item a probe; beyond, items that
    share a token with a probe are joined on it and counted a pair. The first item that reaches the maximum is the match.
    """
    p = table(probes.select("id", F.col("harvester").alias("expected"), normalized(F.col("text")).alias("norm"), ascii_tokens(F.col("text")).alias("tokens")), "probes")
    i = items.select("seq", "harvester", normalized(F.col("text")).alias("norm"))
    i = i.withColumn("tokens", F.array_distinct(F.regexp_extract_all("norm", F.lit("[a-z0-9]+"), F.lit(0))))
    same = i.join(p.select("id", "norm"), "norm").groupBy("id").agg(F.min(F.struct("seq", "harvester")).alias("x")).select("id", F.col("x.harvester").alias("same"), F.lit(True).alias("exact"))
    pairs = _near_few(p, i) if p.count() <= FEW_PROBES else _near_many(p, i)
    best = pairs.groupBy("id").agg(F.max(F.struct("j", (-F.col("seq")).alias("s"), "harvester")).alias("b")).select("id", F.col("b.j").alias("j"), F.col("b.harvester").alias("near"))
    rows = p.select("id", "expected").join(same, "id", "left").join(best, "id", "left")
    verdict = F.when(F.col("exact"), "EXACT").when(F.col("j") >= threshold, "PARA").otherwise("LOST")
    matched = F.when(F.col("exact"), F.col("same")).when(F.col("j") >= threshold, F.col("near"))
    return rows.select("id", verdict.alias("verdict"), F.round(F.when(F.col("exact"), 1.0).otherwise(F.coalesce("j", F.lit(0.0))), 3).alias("score"), matched.alias("matched"), "expected")


def _near_many(p: DataFrame, i: DataFrame) -> DataFrame:
    """id, seq, harvester, j of all pairs that share a token."""
    pt = p.select("id", F.size("tokens").alias("np"), F.explode("tokens").alias("token"))
    it = i.select("seq", "harvester", F.size("tokens").alias("ni"), F.explode("tokens").alias("token"))
    pairs = pt.join(it, "token").groupBy("id", "seq", "harvester", "np", "ni").agg(F.count("*").alias("both"))
    return pairs.select("id", "seq", "harvester", (F.col("both") / (F.col("np") + F.col("ni") - F.col("both"))).alias("j"))


def _near_few(p: DataFrame, i: DataFrame) -> DataFrame:
    """id, seq, harvester, j of the best item of each batch for each probe that shares a token with one."""
    import numpy as np
    import pyarrow as pa

    known = p.select("id", "tokens").toArrow()  # FEW_PROBES rows at most
    ids, tokens = known.column("id").combine_chunks(), known.column("tokens").combine_chunks()
    words = tokens.flatten().unique()
    of = np.asarray(pa.compute.index_in(tokens.flatten(), words))
    owner = np.repeat(np.arange(len(ids)), np.diff(tokens.offsets.to_numpy()))
    order = np.argsort(of, kind="stable")
    owner, first = owner[order], np.searchsorted(of[order], np.arange(len(words) + 1))
    sizes = np.diff(tokens.offsets.to_numpy())

    def near(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                lists = b.column("tokens")
                count = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                w = pa.compute.fill_null(pa.compute.index_in(lists.flatten(), words), -1).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(count)), count)[w >= 0]
                w = w[w >= 0]
                n = first[w + 1] - first[w]
                place = np.repeat(first[w] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                both = np.bincount(np.repeat(row, n) * len(ids) + owner[place], minlength=len(count) * len(ids)).reshape(len(count), len(ids))
                j = both / np.maximum(count[:, None] + sizes[None, :] - both, 1)
                seq = b.column("seq").to_numpy()
                by = np.argsort(seq, kind="stable")
                best = by[np.argmax(j[by], axis=0)] if len(by) else np.zeros(0, np.int64)
                met = np.flatnonzero(both[best, np.arange(len(ids))] > 0) if len(by) else np.zeros(0, np.int64)
                rows = pa.array(best[met])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(met)), b.column("seq").take(rows), b.column("harvester").take(rows), pa.array(j[best[met], met])], names=["id", "seq", "harvester", "j"])

    kinds = dict(p.dtypes) | {"seq": dict(i.dtypes)["seq"]}
    return i.select("seq", "harvester", "tokens").mapInArrow(near, f"id {kinds['id']}, seq {kinds['seq']}, harvester string, j double")


def retention(results: DataFrame) -> DataFrame:
    """arm, exact, para, lost, n, retention_rate."""
    arm = F.coalesce("expected", "matched", F.lit("unknown"))
    per = results.groupBy(arm.alias("arm")).agg(*(F.count_if(F.col("verdict") == v).alias(v.lower()) for v in ("EXACT", "PARA", "LOST")), F.count("*").alias("n"))
    return per.withColumn("retention_rate", F.round((F.col("exact") + F.col("para")) / F.col("n"), 3))


# Probes taken from text.

PROBE_PATH = r"(?U)(?<![\w.])/(?:[0-9A-Za-z._-]+/)+[0-9A-Za-z._-]+"
PROBE_HASH = r"(?U)\b(?=[a-f]*[0-9])(?=[0-9]*[a-f])[a-f0-9]{7,40}\b"
PROBE_FACT = r"(?U)\b(\d[,.\d]{0,12})\s+([A-Za-zЀ-ӿ]{4,20})"
FAMILY_LIMITS = {"path": 15, "hash": 10, "fact": 15, "claim": 15}


def extract_probes(texts: DataFrame, marker: str = MARKER, limits: dict[str, int] = FAMILY_LIMITS) -> DataFrame:
    """family, text, n, rank: the most frequent paths, hashes and numbers with a word, and the longest marked statements."""
    t = texts.select("text")
    lines = t.select(F.explode(F.split("text", "\n")).alias("line"))
    paths = t.select(F.explode(F.regexp_extract_all("text", F.lit(PROBE_PATH), F.lit(0))).alias("x")).select(F.lit("path").alias("family"), F.regexp_replace("x", "[.,;:)]+$", "").alias("text")).filter(F.length("text") >= 12)
    hashes = t.select(F.lit("hash").alias("family"), F.explode(F.regexp_extract_all("text", F.lit(PROBE_HASH), F.lit(0))).alias("text"))
    plain = lines.filter(~F.col("line").rlike(marker) & ~F.col("line").rlike(PROBE_PATH) & ~F.col("line").rlike(PROBE_HASH))
    pair = F.arrays_zip(F.regexp_extract_all("line", F.lit(PROBE_FACT), F.lit(1)).alias("number"), F.regexp_extract_all("line", F.lit(PROBE_FACT), F.lit(2)).alias("word"))
    facts = plain.select(F.explode(pair).alias("p")).select(F.regexp_replace("p.number", "[.,]+$", "").alias("number"), F.lower("p.word").alias("word"))
    facts = facts.filter((F.length("number") >= 2) & ~F.col("word").isin("and", "for", "that", "the", "with")).select(F.lit("fact").alias("family"), F.concat_ws(" ", "number", "word").alias("text"))
    counted = paths.unionByName(hashes).unionByName(facts).groupBy("family", "text").agg(F.count("*").alias("n"))
    marked = lines.filter(F.col("line").rlike(marker)).select(F.regexp_replace(F.regexp_replace("line", marker, ""), "^[ \\t•*—-]+|[ \\t•*—-]+$", "").alias("text"))
    marked = marked.filter(F.length("text").between(25, 400)).groupBy(normalized(F.col("text")).alias("key")).agg(F.min("text").alias("text"))
    counted = counted.unionByName(marked.select(F.lit("claim").alias("family"), "text", F.length("text").cast("long").alias("n")))
    w = Window.partitionBy("family").orderBy(F.desc("n"), "text")
    most = F.create_map(*(F.lit(x) for kv in limits.items() for x in kv))[F.col("family")]
    return counted.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def score_arm(probes: DataFrame, items: DataFrame, threshold: float = PARAPHRASE) -> DataFrame:
    """family, text, kept for each probe against the items (text) of one arm.

    A fact is kept if one item holds its number and its word; a path or hash if some item holds it; a statement if an
    item is near enough. Probes are at most 55 by construction, so they are broadcast to the items.
    """
    i = items.select(normalized(F.col("text")).alias("norm"), ascii_tokens(F.col("text")).alias("tokens"))
    p = probes.select("family", "text", normalized(F.col("text")).alias("p_norm"), ascii_tokens(F.col("text")).alias("p_tokens"), F.split("text", " ").alias("pair"))
    number, word = F.get("pair", 0), F.get("pair", 1)
    hit = F.when(F.col("family") == "fact", F.col("norm").contains(number) & F.col("norm").contains(word)).when(F.col("family") == "claim", jaccard(F.col("p_tokens"), F.col("tokens")) >= threshold).otherwise(F.col("norm").contains(F.col("p_norm")))
    kept = i.join(F.broadcast(p), hit).select("family", "text").distinct().withColumn("kept", F.lit(True))
    return probes.select("family", "text").join(kept, ["family", "text"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def tally(scores: DataFrame) -> DataFrame:
    """Of each family and of all together: kept, n, share."""
    per = scores.groupBy("family").agg(F.count_if("kept").alias("kept"), F.count("*").alias("n"))
    total = scores.agg(F.lit("all").alias("family"), F.count_if("kept").alias("kept"), F.count("*").alias("n"))
    return per.unionByName(total.filter("n > 0")).withColumn("share", F.round(F.col("kept") / F.col("n"), 4))


def duel(pairs: DataFrame) -> DataFrame:
    """Wins, draws, losses, median and worst difference of two shares, over segments (columns ours, theirs)."""
    d = F.col("ours") - F.col("theirs")
    return pairs.agg(F.count_if(d > 0).alias("wins"), F.count_if(d == 0).alias("draws"), F.count_if(d < 0).alias("losses"), F.round(F.percentile(d, F.lit(0.5)), 4).alias("median"), F.round(F.min(d), 4).alias("worst"))


# Recall at k.


def recall_at(ranked: DataFrame, gold: DataFrame, owner: str = "session", ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """query_id and hit_k: whether a gold session is among the first k sessions, in the order in which they first appear.

    ranked: query_id, rank, owner; gold: query_id, owner. A query without any gold has no row, one that found nothing misses.
    """
    first = ranked.groupBy("query_id", owner).agg(F.min("rank").alias("rank"))
    place = first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    hits = place.join(gold.select("query_id", owner).distinct(), ["query_id", owner]).groupBy("query_id").agg(F.min("place").alias("place"))
    rows = gold.select("query_id").distinct().join(hits, "query_id", "left")
    return rows.select("query_id", *(F.coalesce(F.col("place") <= k, F.lit(False)).alias(f"hit_{k}") for k in ks))


def upper_median(rows: DataFrame, column: str) -> DataFrame:
    """The element at place n // 2 of the sorted values."""
    return rows.agg(F.expr(f"percentile_disc(0.5) within group (order by `{column}` desc)").cast(rows.schema[column].dataType).alias("median"))


def question_terms(text: Column) -> Column:
    return F.array_distinct(F.filter(search_tokens(text), lambda t: (F.length(t) > 2) & ~member(QUESTION_STOPS, t)))


def _longest_inner(part: Column) -> Column:
    """The longest of the tokens that a text with this part holds whole, or NULL."""
    inner = F.slice(search_tokens(part), 2, F.greatest(F.size(search_tokens(part)) - 2, F.lit(0)))
    return F.get(F.transform(F.array_sort(F.transform(F.array_distinct(inner), lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), lambda x: x["t"]), 0)


#: Most parts, and most of their characters, that are sent to every task.
FEW_PARTS, FEW_CHARS = 4096, 1 << 24


def ranked_and_held(docs: DataFrame, terms: DataFrame, items: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """search.best of docs (key, tokens, text), and query_id and key of those that contain the question of items (query_id, question).

    Tokens are the heaviest part of both; few queries and questions are answered from one scan, more by search.best and `holders`.
    """
    terms = table(terms, "terms")
    known = search.few_terms(terms)
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("question")), F.lit(0))).first()
    if known is None or n > FEW_PARTS or chars > FEW_CHARS:
        return search.best(docs, terms, key), holders(docs.drop("tokens"), items).select("query_id", key)
    parts = items.select(F.col("query_id").alias("part_id"), F.col("question").alias("part"), _longest_inner(F.col("question")).alias("key"))
    ranked, held = search.best_and_holders(docs, terms, known, parts, key)
    return ranked, held.select(F.col("part_id").alias("query_id"), F.col("id").alias(key))


def holders(docs: DataFrame, items: DataFrame, text: str = "text", part: str = "question") -> DataFrame:
    """Rows of docs and items whose part the text contains.

    A text that contains a part holds the part's inner tokens whole; the longest of these is what both are joined on. Parts
    without an inner token are compared with every text.
    """
    keyed = table(items.withColumn("_key", _longest_inner(F.col(part))), "parts")
    rows = docs.withColumn("_key", F.explode(F.array_distinct(search_tokens(F.col(text))))).join(keyed.filter("_key is not null"), "_key").filter(F.col(text).contains(F.col(part))).drop("_key")
    short = keyed.filter("_key is null").drop("_key")
    return rows if short.isEmpty() else rows.unionByName(docs.join(short, F.col(text).contains(F.col(part))))


def miss_causes(misses: DataFrame) -> DataFrame:
    """Adds lost (terms of the question that the raw gold had and the kept one lacks) and cause; columns question, raw, kept."""
    terms = question_terms(F.col("question"))
    lost = F.array_except(F.array_intersect(terms, search_tokens(F.col("raw"))), search_tokens(F.col("kept")))
    return misses.withColumn("lost", F.array_sort(lost)).withColumn("cause", F.when(F.size("lost") > 0, "lexical").otherwise("ranking"))


def evidence_coverage(turns: DataFrame) -> DataFrame:
    """turns, kept, evidence, covered and their shares; columns items (number kept of a turn), evidence (boolean)."""
    kept = F.col("items") > 0
    rows = turns.agg(F.count("*").alias("turns"), F.count_if(kept).alias("turns_kept"), F.count_if("evidence").alias("evidence_turns"), F.count_if(F.col("evidence") & kept).alias("covered"))
    share = lambda a, b: F.round(F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0)), 4)
    return rows.withColumn("kept_share", share("turns_kept", "turns")).withColumn("coverage", share("covered", "evidence_turns"))


def session_text(turns: DataFrame) -> DataFrame:
    """session, text: `role: content` lines in order; one session's own turns."""
    per = turns.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.coalesce("role", F.lit("")), F.lit(": "), F.coalesce("content", F.lit(""))).alias("line")))).alias("x"))
    return per.select("session", F.array_join(F.transform("x", lambda t: t["line"]), "\n").alias("text"))


# Documents of a haystack, and reports over many questions.


def raw_docs(turns: DataFrame, by: str = "session") -> DataFrame:
    """id, owner, text of a haystack as it is, a document for each session or turn; turns: session, turn, role, content."""
    if by == "session":
        return session_text(turns).select(F.col("session").cast("string").alias("id"), F.col("session").alias("owner"), "text")
    return turns.select(F.concat_ws("#", F.col("session").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("session").alias("owner"), F.col("content").alias("text"))


def harvested_docs(items: DataFrame, grouped: bool = False, group: str = "transcript_id") -> DataFrame:
    """id, owner, text of what extraction kept (bucket, pos, text): a document for each item, or one for each session."""
    place = F.row_number().over(Window.partitionBy(group).orderBy("bucket", "pos")) - 1
    rows = items.select(group, "text", place.alias("n"))
    if not grouped:
        return rows.select(F.concat(F.col(group).cast("string"), F.lit("#h"), F.col("n")).alias("id"), F.col(group).alias("owner"), "text")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "\n")  # one session's own items
    return rows.groupBy(group).agg(body.alias("text")).select(F.col(group).cast("string").alias("id"), F.col(group).alias("owner"), "text")


def recall_report(hits: DataFrame, kinds: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """kind, n and the share of questions with a hit at each k, for each kind of question and for all; hits: as of recall_at."""
    rows = hits.join(kinds.select("query_id", "kind"), "query_id").select(F.explode(F.array("kind", F.lit("all"))).alias("kind"), *(f"hit_{k}" for k in ks))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), *(F.round(F.avg(F.col(f"hit_{k}").cast("int")), 4).alias(f"recall_{k}") for k in ks))


def kept_share(kept: DataFrame, haystack: DataFrame) -> DataFrame:
    """kept_chars, haystack_chars, kept_share: recall says little without the volume that it cost."""
    total = lambda rows, name: rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias(name))
    both = total(kept, "kept_chars").crossJoin(total(haystack, "haystack_chars"))
    return both.withColumn("kept_share", F.round(F.col("kept_chars") / F.nullif(F.col("haystack_chars"), F.lit(0)), 4))


def zero_results(queries: DataFrame, ranked: DataFrame) -> DataFrame:
    """queries, without_result, zero_share; both have query_id."""
    rows = queries.select("query_id").distinct().join(ranked.select("query_id").distinct().withColumn("found", F.lit(True)), "query_id", "left")
    return rows.agg(F.count("*").alias("queries"), F.count_if(F.col("found").isNull()).alias("without_result"), F.round(F.avg(F.col("found").isNull().cast("int")), 4).alias("zero_share"))


def evidence_trace(turns: DataFrame, items: DataFrame, question: str) -> DataFrame:
    """transcript_id, unit_idx, kept, hits, lost for each gold turn (text): how many items it gave, which terms of the question they hold,
    and which ones the turn has and they lack."""
    asked = question_terms(F.lit(question))
    held = items.select("transcript_id", "unit_idx", F.explode_outer(search_tokens(F.col("text"))).alias("t"), F.lit(1).alias("one"))
    held = held.groupBy("transcript_id", "unit_idx").agg(F.collect_set("t").alias("held"))  # one turn's own words
    count = items.groupBy("transcript_id", "unit_idx").agg(F.count("*").alias("kept"))
    rows = turns.join(count, ["transcript_id", "unit_idx"], "left").join(held, ["transcript_id", "unit_idx"], "left")
    have = F.coalesce("held", F.array().cast("array<string>"))
    lost = F.array_except(F.array_intersect(asked, search_tokens(F.col("text"))), have)
    return rows.select("transcript_id", "unit_idx", F.coalesce("kept", F.lit(0)).cast("long").alias("kept"), F.array_sort(F.array_intersect(asked, have)).alias("hits"), F.array_sort(lost).alias("lost"))


def without_markers(units: DataFrame, marker: str = MARKER) -> DataFrame:
    """The units of the arm that never marked its confidence."""
    return units.withColumn("text", F.regexp_replace("text", marker, ""))


def usable_segments(segments: DataFrame, least_summary: int = 200, least_units: int = 20, least_probes: int = 5) -> DataFrame:
    """Segments that are worth comparing; columns summary_chars, units, probes."""
    return segments.filter((F.col("summary_chars") >= least_summary) & (F.col("units") >= least_units) & (F.col("probes") >= least_probes))
