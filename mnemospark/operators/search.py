"""BM25 over documents and over their parents, boosts, and the two ways of recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cues import content_terms, live_state
from ..functions.text import casefold, cut, search_tokens, squeeze
from ..storage import table

K1, B = 1.5, 0.75
KIND_BOOST = {"path": 0.85, "id": 0.9, "decision": 1.0, "claim": 1.0, "lesson": 1.4}
SUPERSEDED, RECENCY, PARENT = 0.4, 0.25, 1.0


def query_terms(spark, queries: dict[str, str]) -> DataFrame:
    """query_id, term, times: the terms of given queries, repeats counted."""
    rows = spark.createDataFrame(list(queries.items()), "query_id string, query string")
    return rows.select("query_id", F.explode(search_tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))


def bm25(docs: DataFrame, terms: DataFrame, key: str = "id") -> DataFrame:
    """query_id, key, raw: the score of each group of documents for each query whose terms it holds."""
    rows = docs.select(F.col(key).alias("unit"), "tokens")
    return _weighed(*_postings(rows, terms), terms, "unit").withColumnRenamed("unit", key)


#: Most queries, and most rows of query terms, that are sent to every task; more are joined by term.
FEW_QUERIES, FEW_TERMS = 4096, 1 << 18


def best(docs: DataFrame, terms: DataFrame, key: str = "id", limit: int = 10) -> DataFrame:
    """query_id, id, score (to 4 places), rank: the best groups of documents for each query by BM25, equal scores by id.

    A pair of a document and a query that shares a term with it is never a row: each task adds up the scores of its documents
    for all queries at once and hands on `limit` of them a query. Beyond FEW_QUERIES or FEW_TERMS, pairs are joined by term.
    """
    terms = table(terms, "terms")
    known = few_terms(terms)
    if known is None:
        return top(bm25(docs, terms, key).select("query_id", F.col(key).alias("id"), F.round("raw", 4).alias("score")), limit)
    return top(_best_few(docs.select(F.col(key).alias("id"), "tokens"), known, dict(terms.dtypes)["query_id"], limit), limit)


def few_terms(terms: DataFrame):
    """The terms of all queries, as an Arrow table, or None where they are too many to be sent to every task."""
    known = terms.select("query_id", "term", "times").limit(FEW_TERMS + 1).toArrow().combine_chunks()
    return None if known.num_rows > FEW_TERMS or len(known.column("query_id").unique()) > FEW_QUERIES else known


def best_and_holders(docs: DataFrame, terms: DataFrame, known, parts: DataFrame, key: str = "id", limit: int = 10) -> tuple[DataFrame, DataFrame]:
    """best, and part_id and id of the documents (id, tokens, text) whose text contains a part, from one scan of the documents.

    known: few_terms(terms); parts: few rows of part_id, part and key, a token that texts with the part hold, or NULL.
    """
    kinds = dict(terms.dtypes)["query_id"], dict(parts.dtypes)["part_id"]
    ranked, held = _best_few(docs.select(F.col(key).alias("id"), "tokens", "text"), known, kinds[0], limit, parts.select("part_id", "part", "key").toArrow().combine_chunks(), kinds[1])
    return top(ranked, limit), held


def _best_few(docs: DataFrame, known, query_kind: str, limit: int, parts=None, part_kind: str = "string"):
    """query_id, id, score: what each task holds of the best; with parts also part_id, id of best_and_holders."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    queries, words = (pa.array(known.column(c).unique().to_pylist(), known.schema.field(c).type) for c in ("query_id", "term"))
    n_parts, n_queries = 0, len(queries)
    if parts is not None:
        n_parts, asked = len(parts), parts.column("part").to_pylist()
        words = pa.concat_arrays([words, *parts.column("key").cast(words.type).chunks]).unique().drop_null()
        keys = np.asarray(pc.fill_null(pc.index_in(parts.column("key").cast(words.type), words), -1)).astype(np.int64)
        keyed, keyless = np.flatnonzero(keys >= 0), np.flatnonzero(keys < 0)
        part_ids = pa.array(parts.column("part_id").to_pylist(), parts.schema.field("part_id").type)
    n_words = len(words)
    term, query = (np.asarray(pc.index_in(known.column(c), v).combine_chunks()).astype(np.int64) for c, v in (("term", words), ("query_id", queries)))
    order = np.lexsort((query, term))
    query, times, first = query[order], np.asarray(known.column("times").combine_chunks()).astype(np.float64)[order], np.searchsorted(term[order], np.arange(n_words + 1))

    def flat(lists):
        """Where each list begins among the members of all."""
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        return np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)

    def counted(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, step := max(1, (1 << 20) // max(1, n_words, n_parts))):
                b = whole.slice(at, step)
                lists, ends = b.column("tokens"), flat(b.column("tokens"))
                w = pc.fill_null(pc.index_in(lists.flatten(), words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                cell = np.repeat(np.arange(b.num_rows), np.diff(ends))[w >= 0] * n_words + w[w >= 0]
                freq = np.bincount(cell, minlength=b.num_rows * n_words)
                met = np.flatnonzero(freq)
                offsets = pa.array(np.searchsorted(met, np.arange(b.num_rows + 1) * n_words).astype(np.int32))
                found = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (met % max(1, n_words), freq[met])]
                more = [holding(b.column("text"), freq.reshape(b.num_rows, n_words))] if n_parts else []
                yield pa.RecordBatch.from_arrays([b.column("id"), pc.list_value_length(lists).cast(pa.int64()), *found, *more], names=["id", "length", "terms", "freqs", "parts"][: 4 + len(more)])

    def holding(texts, freq):
        """The parts of each text: those whose key it has are looked for in it, and those without a key."""
        row, part = np.nonzero(freq[:, keys[keyed]])
        row, part = np.concatenate((row, np.repeat(np.arange(len(texts)), len(keyless)))), np.concatenate((keyed[part], np.tile(keyless, len(texts))))
        need, place = np.unique(row, return_inverse=True)
        said = texts.take(pa.array(need)).to_pylist()
        good = np.array([said[t] is not None and asked[k] is not None and asked[k] in said[t] for t, k in zip(place.tolist(), part.tolist())], bool)
        row, part = row[good], part[good]
        order = np.argsort(row, kind="stable")
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[order], np.arange(len(texts) + 1)).astype(np.int32)), part_ids.take(pa.array(part[order])))

    kind = dict(docs.dtypes)["id"]
    # Written once: the frequency of a term among all documents is known only after the last one.
    rows = table(docs.mapInArrow(counted, f"id {kind}, length long, terms array<int>, freqs array<int>" + f", parts array<{part_kind}>" * bool(n_parts)), "postings")
    owners = rows.select(F.explode("parts").alias("part_id"), "id") if n_parts else rows.filter("false").select(F.lit(None).cast(part_kind).alias("part_id"), "id")
    groups = rows.groupBy("id").agg(F.sum("length").alias("length"), F.count("*").alias("n"))
    total, mean, most = groups.agg(F.count("*"), F.avg("length"), F.max("n")).first()
    if (most or 0) > 1:
        each = rows.select("id", F.explode(F.arrays_zip("terms", "freqs")).alias("x")).groupBy("id", F.col("x.terms").alias("term")).agg(F.sum("x.freqs").cast("int").alias("freq"))
        each = each.groupBy(F.col("id").alias("own")).agg(F.array_sort(F.collect_list(F.struct("term", "freq"))).alias("x"))  # the queries' terms at most
        rows = table(groups.join(each, F.col("id").eqNullSafe(F.col("own"))).select("id", "length", F.col("x.term").alias("terms"), F.col("x.freq").alias("freqs")), "postings")

    def held(batches):
        n = np.zeros(n_words, np.int64)
        for b in batches:
            n += np.bincount(b.column("terms").flatten().to_numpy(zero_copy_only=False), minlength=n_words)
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(n[met])], names=["term", "n"])

    frequency = rows.select("terms").mapInArrow(held, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # one row a term
    n = np.zeros(n_words)
    n[frequency.column("term").to_numpy()] = frequency.column("n").to_numpy()
    idf = np.log(1 + (total - n + 0.5) / (n + 0.5))
    weight = times * np.repeat(idf, np.diff(first))
    mean = mean if mean and mean > 0 else 1.0
    step = max(1, min((1 << 18) // max(1, n_queries), (1 << 22) // max(1, len(weight))))

    def cut(found, least):
        found = found.sort_by([("query", "ascending"), ("score", "descending"), ("id", "ascending")])
        q = found.column("query").to_numpy()
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = np.flatnonzero(place == limit - 1)
        least[q[last]] = found.column("score").to_numpy()[last]
        return found.filter(pa.array(place < limit))

    def scores(batches):
        found, least = None, np.zeros(n_queries)
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                ends = flat(b.column("terms"))
                t, f = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("terms", "freqs"))
                row = np.repeat(np.arange(b.num_rows), np.diff(ends))
                length = np.maximum(pc.fill_null(b.column("length"), 0).to_numpy(zero_copy_only=False), 1)[row]
                above, below = f * (K1 + 1), f + K1 * (1 - B + B * length / mean)
                many = first[t + 1] - first[t]
                pair = np.repeat(first[t] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                part = weight[pair] * np.repeat(above, many) / np.repeat(below, many)
                raw = np.bincount(np.repeat(row, many) * n_queries + query[pair], part, b.num_rows * n_queries).reshape(b.num_rows, n_queries)
                score = np.floor(raw * 1e4 + 0.5) / 1e4
                good = (raw > 0) & (score >= least)
                if b.num_rows > limit and good.sum() > 4 * limit * n_queries:
                    good &= score >= np.partition(score, b.num_rows - limit, axis=0)[b.num_rows - limit]
                r, q = np.nonzero(good)
                new = pa.table({"query": pa.array(q.astype(np.int32)), "score": pa.array(score[r, q]), "id": b.column("id").take(pa.array(r))})
                found = new if found is None else pa.concat_tables([found, new])
                if found.num_rows > 2 * limit * n_queries:
                    found = cut(found, least)
        if found is not None:
            found = cut(found, least).combine_chunks()
            names = pa.table({"query_id": queries.take(found.column("query").combine_chunks()), "id": found.column("id"), "score": found.column("score")})
            yield from names.combine_chunks().to_batches()

    ranked = rows.filter("id is not null and size(terms) > 0").select("id", "length", "terms", "freqs").mapInArrow(scores, f"query_id {query_kind}, id {kind}, score double")
    return ranked if parts is None else (ranked, owners)


def _postings(rows: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written once, from one scan each: (all columns but tokens, term, freq) for the terms that are asked for, and the lengths.

    Only tokens that a query asks for leave the scan: the terms are joined before anything is counted, and counts are
    pre-aggregated. Terms are those of the queries at hand; the planner broadcasts them if they are few.
    """
    own = [c for c in rows.columns if c != "tokens"]
    asked = table(terms.select("term").distinct(), "asked")
    hits = table(rows.select(*own, F.explode("tokens").alias("term")).join(asked, "term").groupBy(*own, "term").agg(F.count("*").alias("freq")), "postings")
    return hits, table(rows.groupBy(*own).agg(F.sum(F.size("tokens")).alias("length")), "lengths")


def _weighed(hits: DataFrame, lengths: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """BM25 of groups by key. The number and the mean length of groups come from one aggregate."""
    hits = hits.groupBy(key, "term").agg(F.sum("freq").alias("freq"))
    groups = lengths.groupBy(key).agg(F.sum("length").alias("length"))
    shape = groups.agg(F.count("*").alias("total"), F.avg("length").alias("mean"))
    frequency = hits.groupBy("term").agg(F.count("*").alias("n"))
    idf = F.log(1 + (F.col("total") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    weights = terms.join(frequency, "term").crossJoin(F.broadcast(shape)).select("query_id", "term", "times", "mean", idf.alias("idf"))
    per = hits.join(weights, "term").join(groups, key)
    length = F.greatest(F.col("length"), F.lit(1))
    mean = F.when(F.col("mean") > 0, F.col("mean")).otherwise(1.0)
    part = F.col("times") * F.col("idf") * (F.col("freq") * (K1 + 1)) / (F.col("freq") + K1 * (1 - B + B * length / mean))
    return per.groupBy("query_id", key).agg(F.sum(part).alias("raw"))


def _parent() -> Column:
    return F.coalesce(F.nullif("source", F.lit("")), "id")


def _contexts(hits: DataFrame, lengths: DataFrame, terms: DataFrame) -> DataFrame:
    several = lengths.agg((F.min("parent") < F.max("parent")).alias("_several"))
    return _weighed(hits, lengths, terms, "parent").crossJoin(F.broadcast(several)).filter("_several").select("query_id", "parent", F.col("raw").alias("context"))


def parent_scores(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """query_id, parent, context: BM25 of whole parents; nothing if there is only one."""
    return _contexts(*_postings(docs.select(_parent().alias("parent"), "tokens"), terms), terms)


def scored(docs: DataFrame, terms: DataFrame, recency: DataFrame | None = None, parent_boost: float = PARENT, recency_boost: float = RECENCY) -> DataFrame:
    """query_id, id, score, bm25 and the document, for all that match or whose parent does.

    Documents' own scores and those of their parents come from the same postings.
    """
    rows = docs.withColumn("parent", _parent())
    hits, lengths = _postings(rows.select("id", "parent", "tokens"), terms)
    own = _weighed(hits, lengths, terms, "id")
    if parent_boost:
        pairs = _contexts(hits, lengths, terms).join(lengths.select("id", "parent").distinct(), "parent").select("query_id", "id", "context")
        found = own.join(pairs, ["query_id", "id"], "full")
    else:
        found = own.withColumn("context", F.lit(0.0))
    raw = F.coalesce("raw", F.lit(0.0)) + parent_boost * F.coalesce("context", F.lit(0.0))
    found = found.withColumn("raw", raw).filter("raw > 0")
    out = found.select("query_id", "id", "raw").join(rows.drop("tokens"), "id")
    out = out.join(recency, "id", "left") if recency is not None else out.withColumn("recency", F.lit(0.0))
    boost = F.lit(1.0)
    for kind, w in KIND_BOOST.items():
        boost = F.when(F.col("kind") == kind, w).otherwise(boost)
    weight = boost * F.when(F.col("superseded"), SUPERSEDED).otherwise(1.0) * (1 + recency_boost * F.coalesce("recency", F.lit(0.0)))
    return out.select("query_id", "id", F.round(F.col("raw") * weight, 4).alias("score"), F.round("raw", 4).alias("bm25"), "text", "kind", "ts", "superseded", "source")


def top(results: DataFrame, limit: int = 10) -> DataFrame:
    """The best of each query with their rank; equal scores by id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return results.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def recall(results: DataFrame, limit: int = 10, budget: int = 0) -> DataFrame:
    """Top results; under a budget those that fit, one that doesn't is skipped."""
    best = top(results, limit)
    if budget <= 0:
        return best
    lists = best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", (F.length("text") + 1).alias("cost")))).alias("c"))  # `limit` rows at most
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("taken"))
    step = lambda s, x: F.when(s["used"] + x["cost"] <= budget, F.struct((s["used"] + x["cost"]).alias("used"), F.concat(s["taken"], F.array(x["rank"])).alias("taken"))).otherwise(s)
    taken = lists.select("query_id", F.explode(F.aggregate("c", start, step, lambda s: s["taken"])).alias("rank"))
    return best.join(taken, ["query_id", "rank"], "left_semi")


def accepted(asked: Column, hit: Column, overlap: float = 0.5) -> Column:
    """One or two terms must all be hit; of more, at least two and that share."""
    n, h = F.size(asked), F.size(hit)
    return F.when(n == 0, False).when(n <= 2, h == n).otherwise((h >= 2) & (h / n >= overlap))


def hook_lines(results: DataFrame, prompts: DataFrame, limit: int = 3, budget: int = 600, item: int = 200, overlap: float = 0.5) -> DataFrame:
    """query_id, rank, line: what may be put in front of a prompt (query_id, query).

    The order matters: the best 8 * limit are taken first, then filtered, then cut to the limit; the budget ends the list.
    """
    best = top(results, limit * 8).join(F.broadcast(prompts), "query_id")
    text = squeeze(F.col("text"))
    best = best.filter(~F.col("superseded") & (F.length(F.trim("query")) >= 3)).withColumn("flat", text)
    asked = content_terms(F.col("query"))
    best = best.filter(accepted(asked, F.array_intersect(asked, content_terms(F.col("flat"))), overlap))
    best = best.withColumn("key", F.substring(casefold(F.col("flat")), 1, 120))
    best = best.withColumn("_again", F.row_number().over(Window.partitionBy("query_id", "key").orderBy("rank"))).filter("_again = 1")
    best = best.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter(F.col("n") <= limit)
    short = cut(F.col("flat"), item)
    day = F.substring(F.coalesce("ts", F.lit("")), 1, 10)
    marks = F.filter(F.array(F.when(day != "", day), F.when(live_state(short), "VERIFY CURRENT")), lambda x: x.isNotNull())
    prefix = F.when(F.size(marks) > 0, F.concat(F.lit("- ["), F.array_join(marks, " · "), F.lit("] "))).otherwise("- ")
    best = best.withColumn("short", short).withColumn("prefix", prefix)
    before = F.coalesce(F.sum(F.length("short")).over(Window.partitionBy("query_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    best = best.withColumn("over", before + F.length("prefix") + F.length("short") > budget)
    ended = F.max("over").over(Window.partitionBy("query_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    return best.withColumn("_ended", ended).filter(~F.col("_ended")).select("query_id", F.col("n").alias("rank"), "id", F.concat("prefix", "short").alias("line"))


HOOK_HEAD = "## Recalled from earlier sessions\nFound by keywords of this turn. It may be beside the point; check before relying on it.\n"


def hook_payload(lines: DataFrame, event: str = "UserPromptSubmit") -> DataFrame:
    """query_id and the JSON that a host expects; at most `limit` lines each."""
    body = F.concat(F.lit(HOOK_HEAD), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n"))
    inner = F.struct(F.lit(event).alias("hookEventName"), body.alias("additionalContext"))
    return lines.groupBy("query_id").agg(F.to_json(F.struct(inner.alias("hookSpecificOutput"))).alias("payload"))


__all__ = ["accepted", "best", "bm25", "hook_lines", "hook_payload", "parent_scores", "query_terms", "recall", "scored", "top"]
