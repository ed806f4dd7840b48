"""One query for each operator, over the driver's tables; the names are those of the SQL in oracle.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cues, grammar
from ..functions.redact import redact
from ..functions.text import content_id, date_tokens, normalized, script_share, search_tokens
from ..operators import budget as b
from ..operators import corpus as co
from ..operators import evaluate as ev
from ..operators import extract as ex
from ..operators import resolve as rs
from ..operators import search as se
from ..operators import segments as sg
from ..operators import stats as st
from ..shipping import ship
from ..sources import events as evs
from ..sources import stores, transcripts
from ..storage import table
from ..streaming import views
from . import memory, overlay
from .settings import HOOK_PROMPTS, SEARCHES, TASKS, THRESHOLD


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked units, written once: extractors scan them several times."""
    return table(overlay.units(spark, sf_dir), "units")


def _json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as the JSON lines of five hosts, with a broken line behind each."""
    c = _t(spark, sf_dir, "conversations")
    shape = (F.col("conv_id") + F.col("turn")) % 5
    msg = F.struct("role", F.col("text").alias("content"))
    parts = F.struct("role", F.array(F.struct(F.lit("text").alias("type"), "text")).alias("content"))
    row = (
        F.when(shape == 0, F.to_json(F.struct("role", "text")))
        .when(shape == 1, F.to_json(F.struct("role", F.col("text").alias("content"))))
        .when(shape == 2, F.to_json(F.struct(F.lit("event").alias("type"), msg.alias("message"))))
        .when(shape == 3, F.to_json(F.struct(F.col("role").alias("type"), parts.alias("message"))))
        .otherwise(F.to_json(F.struct(F.col("text").alias("message"))))
    )
    good = c.select(F.col("conv_id").alias("transcript_id"), (F.col("turn") * 2).alias("line"), row.alias("value"))
    return good.unionByName(c.select(F.col("conv_id").alias("transcript_id"), (F.col("turn") * 2 + 1).alias("line"), F.lit('{"text": ').alias("value")))


def transcript_scan(spark, sf_dir):
    return transcripts.units(_json_rows(spark, sf_dir), masked=False)


def scan_quality(spark, sf_dir):
    return transcripts.quality(_json_rows(spark, sf_dir))


def redact_documents(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", redact(F.col("text")).alias("text"))


def redact_conversations(spark, sf_dir):
    return overlay.units(spark, sf_dir)


def normalized_text_ids(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", normalized(F.col("text")).alias("norm"), content_id("documents", F.col("lang"), F.col("text")).alias("id"))


def tokens_per_document(spark, sf_dir):
    t = search_tokens(F.col("text"))
    return _t(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


def date_token_lists(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", date_tokens(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("tokens"))


def script_shares(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.round(script_share(F.col("text"), "[äöüÄÖÜß]"), 6).alias("share"))


def _ordered(items: DataFrame) -> DataFrame:
    return items.withColumn("k", F.element_at("ordinal", -1))


def calibration_claims(spark, sf_dir):
    return rs.with_ids(_ordered(ex.calibration(overlay.units(spark, sf_dir)))).select("transcript_id", "unit_idx", "k", "text", "confidence", "topic", "id")


def _floor(spark, sf_dir, kind):
    return ex.regex_floor(_units(spark, sf_dir)).filter(F.col("kind") == kind).select("transcript_id", "unit_idx", "text")


def floor_paths(spark, sf_dir):
    return _floor(spark, sf_dir, "path")


def floor_ids(spark, sf_dir):
    return _floor(spark, sf_dir, "id")


def floor_decisions(spark, sf_dir):
    return _floor(spark, sf_dir, "decision")


def retraction_lines(spark, sf_dir):
    return ex.retraction(_units(spark, sf_dir)).select("transcript_id", "unit_idx", "text", "topic")


def lesson_lines(spark, sf_dir):
    return ex.lessons(overlay.units(spark, sf_dir)).select("transcript_id", "unit_idx", "text", "topic")


def atomic_facts(spark, sf_dir):
    return ex.atomic(_units(spark, sf_dir)).select("transcript_id", "unit_idx", "text", "topic")


def sentence_parts(spark, sf_dir):
    s = overlay.units(spark, sf_dir).select("transcript_id", "unit_idx", F.posexplode(grammar.sentences(F.col("text"))).alias("sent", "sentence"))
    return s.withColumn("factual", grammar.is_factual(F.col("sentence"))).withColumn("parts", F.size(grammar.factual_parts(F.col("sentence"))))


def topic_keys(spark, sf_dir):
    said = overlay.units(spark, sf_dir).filter("role = 'assistant'").select("transcript_id", "unit_idx", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    return ex.claim_topic(said.filter("line != ''"), "line").select("transcript_id", "unit_idx", "k", "line", "topic")


def _harvest(spark, sf_dir):
    # Without the spans, whole texts that no query here shows, and that every window would move.
    return table(rs.with_ids(ex.harvest(_units(spark, sf_dir))).drop("span"), "items")


def _claims(spark, sf_dir):
    return rs.link_corrections(_harvest(spark, sf_dir).filter("bucket = 'claim'"))


def _resolved(spark, sf_dir):
    return table(rs.resolve(_claims(spark, sf_dir)), "resolved")


def harvested_claims(spark, sf_dir):
    return _harvest(spark, sf_dir).filter("bucket = 'claim'").select("transcript_id", "pos", "id", "text", "confidence", "topic", "harvester")


def retraction_links(spark, sf_dir):
    return _claims(spark, sf_dir).filter("superseded_by is not null or supersedes is not null").select("transcript_id", "pos", "id", "superseded_by", "supersedes")


def supersede_by_topic(spark, sf_dir):
    return _resolved(spark, sf_dir).select("transcript_id", "pos", "id", "text", "topic", "superseded_by", "supersedes")


def active_claims(spark, sf_dir):
    return _resolved(spark, sf_dir).filter(rs.is_active()).select("transcript_id", "id", "text")


def supersede_orders(spark, sf_dir):
    from pyspark.sql import Window

    none = F.lit(None).cast("string")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    rows = _t(spark, sf_dir, "orders").select("o_custkey", place.alias("pos"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("topic"), none.alias("superseded_by"), none.alias("supersedes"))
    return rs.resolve(rows, "o_custkey").select("o_custkey", "pos", "id", "topic", "superseded_by", "supersedes")


def cross_conv_settle(spark, sf_dir):
    items = _harvest(spark, sf_dir).withColumn("brief_id", F.lpad(F.col("transcript_id").cast("string"), 9, "0")).withColumn("ts", F.lit(None).cast("string")).withColumn("created_utc", F.lit(TASKS["created"]))
    return co.corpus(items.filter("bucket = 'claim'"), items.filter("bucket = 'supplement'")).select("id", "text", "kind", "superseded", "source")


def _items(spark, sf_dir):
    items = _harvest(spark, sf_dir).withColumn("ts", F.lit(None).cast("string"))
    claims = rs.resolve(rs.link_corrections(items.filter("bucket = 'claim'")))
    return table(b.scored(claims.unionByName(rs.once_by_id(items.filter("bucket = 'supplement'")))), "scored")


def claim_scores(spark, sf_dir):
    return _items(spark, sf_dir).select("transcript_id", "bucket", "pos", "id", F.round("score", 9).alias("score"), "priority")


def greedy_budget(spark, sf_dir):
    return b.greedy(_items(spark, sf_dir), TASKS["budget"]).filter("kept").select("transcript_id", "priority", "id", "bucket")


def budget_report(spark, sf_dir):
    items = b.greedy(_items(spark, sf_dir), TASKS["budget"])
    return b.budget_report(items, items.filter("kept"), TASKS["budget"])


def rendered_fit(spark, sf_dir):
    return b.rendered_fit(_items(spark, sf_dir), TASKS["rendered"], TASKS["created"]).select("transcript_id", "priority", "id", "rendered")


def rendered_brief(spark, sf_dir):
    return b.render(_items(spark, sf_dir), TASKS["created"])


def session_payload(spark, sf_dir):
    return memory.context_payload(_items(spark, sf_dir).drop("score", "priority"), TASKS["created"], "SessionStart", 3000)


def full_briefs(spark, sf_dir):
    units = _units(spark, sf_dir)
    return memory.briefs(units, TASKS["created"])


def live_state_flags(spark, sf_dir):
    lines = overlay.units(spark, sf_dir).select("transcript_id", "unit_idx", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    return lines.select("transcript_id", "unit_idx", "k", cues.live_state(F.col("line")).alias("live"))


def _searched(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", "source", "text", search_tokens(F.col("text")).alias("tokens"))


def bm25_documents(spark, sf_dir):
    return se.best(_searched(spark, sf_dir), se.query_terms(spark, SEARCHES), "doc_id", 20)


def bm25_parent(spark, sf_dir):
    docs = _searched(spark, sf_dir).withColumn("id", F.col("doc_id").cast("string"))
    return se.parent_scores(docs, se.query_terms(spark, SEARCHES)).select("query_id", "parent", F.round("context", 4).alias("context"))


def _boosted(spark, sf_dir):
    d = F.col("doc_id")
    docs = _searched(spark, sf_dir).select(
        F.lpad(d.cast("string"), 9, "0").alias("id"), F.when(d % 3 == 0, "claim").when(d % 3 == 1, "lesson").otherwise("decision").alias("kind"), "source", "text",
        (d % 7 == 0).alias("superseded"), F.concat(F.lit("2024-01-"), F.lpad((1 + d % 28).cast("string"), 2, "0")).alias("ts"), "tokens", F.lpad(d.cast("string"), 9, "0").alias("doc_seq"),
    )
    return se.scored(docs, se.query_terms(spark, SEARCHES), co.recency_rank(docs))


def recall_boosted(spark, sf_dir):
    return se.recall(_boosted(spark, sf_dir), 20).select("query_id", "rank", "id", "score", "bm25")


def recall_budget(spark, sf_dir):
    return se.recall(_boosted(spark, sf_dir), 20, 5000).select("query_id", "rank", "id", F.length("text").alias("chars"))


def recall_hook_filter(spark, sf_dir):
    return se.hook_lines(_boosted(spark, sf_dir), spark.createDataFrame(list(HOOK_PROMPTS.items()), "query_id string, query string"))


def recency_rank(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), F.col("event_id").alias("doc_seq"))
    return co.recency_rank(e).select("id", F.round("recency", 9).alias("recency"))


def _tall(spark, sf_dir):
    return _resolved(spark, sf_dir).withColumn("at", F.col("transcript_id") * 1_000_000 + F.col("pos"))


def stats_summary(spark, sf_dir):
    made = F.concat(F.lit("2024-01-"), F.lpad((1 + F.col("transcript_id") % 28).cast("string"), 2, "0"))
    none = F.lit(None).cast("struct<harvested_claims:bigint,dropped_items:bigint>")
    briefs = overlay.units(spark, sf_dir).select("transcript_id").distinct().select("transcript_id", made.alias("created_utc"), none.alias("budget"))
    return st.summary(briefs, _resolved(spark, sf_dir))


def stats_by_harvester(spark, sf_dir):
    return st.counts(_tall(spark, sf_dir), "harvester", "at")


def stats_top_topics(spark, sf_dir):
    return st.counts(_tall(spark, sf_dir), "topic", "at", 10)


def probe_retention(spark, sf_dir):
    probes = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text", F.concat(F.lit("arm"), (F.col("item_id") % 3).cast("string")).alias("harvester"))
    lines = _t(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("harvester"), F.posexplode(F.split("text", "\n")).alias("k", "text"))
    return ev.best_match(probes, lines.select((F.col("doc_id") * 100_000 + F.col("k")).alias("seq"), "harvester", "text"))


def retention_by_arm(spark, sf_dir):
    return ev.retention(probe_retention(spark, sf_dir))


def probe_extraction(spark, sf_dir):
    return ev.extract_probes(_units(spark, sf_dir).filter("role = 'assistant'"))


def probe_arms(spark, sf_dir):
    probes = probe_extraction(spark, sf_dir)
    return ev.tally(ev.score_arm(probes, _items(spark, sf_dir).filter("superseded_by is null")))


def arm_duel(spark, sf_dir):
    """Our share of kept items against that of the newest half, by transcript."""
    rows = b.greedy(_items(spark, sf_dir), TASKS["budget"])
    total = F.count("*")
    newest = F.count_if(F.col("pos") >= 3)
    return ev.duel(rows.groupBy("transcript_id").agg((F.count_if("kept") / total).alias("ours"), (newest / total).alias("theirs")))


def _built(units):
    items = table(rs.with_ids(ex.harvest(units)).drop("span"), "items").withColumn("ts", F.lit(None).cast("string"))
    claims = rs.resolve(rs.link_corrections(items.filter("bucket = 'claim'")))
    return table(b.scored(claims.unionByName(rs.once_by_id(items.filter("bucket = 'supplement'")))), "scored")


def equal_budget_arms(spark, sf_dir):
    """Probes kept by the whole harvest and by that of texts without markers, both within an eighth of each transcript's length."""
    units = _units(spark, sf_dir)
    room = units.groupBy("transcript_id").agg(F.floor(F.sum(F.length("text")) / 8).alias("budget"))
    probes = table(ev.extract_probes(units.filter("role = 'assistant'")), "probes")
    out = None
    for arm, own in (("marked", units), ("stripped", ev.without_markers(units))):
        kept = b.greedy(_built(own), 0, budgets=room).filter("kept")
        rows = ev.tally(ev.score_arm(probes, kept)).select(F.lit(arm).alias("arm"), "family", "kept", "n", "share")
        out = rows if out is None else out.unionByName(rows)
    return out


def recall_by_type(spark, sf_dir):
    kinds = _t(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.concat(F.lit("type"), (F.col("item_id") % 3).cast("string")).alias("kind"))
    return ev.recall_report(recall_at_k(spark, sf_dir), kinds)


def kept_volume(spark, sf_dir):
    units = _units(spark, sf_dir)
    return ev.kept_share(rs.with_ids(ex.harvest(units)), units)


def grouped_documents(spark, sf_dir):
    return ev.harvested_docs(_harvest(spark, sf_dir), grouped=True)


def item_documents(spark, sf_dir):
    return ev.harvested_docs(_harvest(spark, sf_dir))


def turn_documents(spark, sf_dir):
    return ev.raw_docs(_t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), "turn", "role", F.col("text").alias("content")), "turn")


def tokenizer_ab(spark, sf_dir):
    """Recall and share of queries without a result, with words of any script and with ASCII words."""
    items = _t(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query"))
    items = items.unionByName(spark.createDataFrame([("ru", "порт панели"), ("fr", "élu être"), ("none", "???")], "query_id string, query string"))
    gold = table(_gold(spark, sf_dir).select(F.col("item_id").cast("string").alias("query_id"), F.col("doc_id").alias("session")), "gold")
    out = None
    for arm, split in (("any script", search_tokens), ("ascii", lambda x: F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0)))):
        terms = items.select("query_id", F.explode(split(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
        docs = _t(spark, sf_dir, "documents").select("doc_id", split(F.col("text")).alias("tokens"))
        ranked = table(se.best(docs, terms, "doc_id"), "ranked")
        hits = ev.recall_report(ev.recall_at(ranked.withColumnRenamed("id", "session"), gold), gold.select("query_id").distinct().withColumn("kind", F.lit("q"))).filter("kind = 'all'").drop("kind", "n")
        rows = ev.zero_results(items, ranked).crossJoin(hits).withColumn("arm", F.lit(arm))
        out = rows if out is None else out.unionByName(rows)
    return out


def evidence_traces(spark, sf_dir):
    units = _units(spark, sf_dir)
    return ev.evidence_trace(units.filter("role = 'user'"), table(ex.harvest(units), "items"), "what is the dashboard port token of user")


def quality_coverage(spark, sf_dir):
    n = F.size(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+"), F.lit(0))) + F.size(F.regexp_extract_all("text", F.lit(r"\b[0-9a-f]{16,40}\b"), F.lit(0)))
    rows = _t(spark, sf_dir, "documents").select("doc_id", n.alias("items")).join(_t(spark, sf_dir, "labels"), "doc_id")
    return ev.evidence_coverage(rows.select("items", F.coalesce(F.col("quality") == 1, F.lit(False)).alias("evidence")))


def _gold(spark, sf_dir):
    """Which documents hold which benchmark text."""
    items = _t(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"))
    return ev.holders(_t(spark, sf_dir, "documents"), items)


def recall_at_k(spark, sf_dir):
    items = _t(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("question"))
    q = items.select("query_id", F.explode(search_tokens(F.col("question"))).alias("term"))
    ranked, held = ev.ranked_and_held(_searched(spark, sf_dir), q.groupBy("query_id", "term").agg(F.count("*").alias("times")), items)
    gold = table(held.withColumnRenamed("doc_id", "session"), "gold")
    return ev.recall_at(ranked.withColumnRenamed("id", "session"), gold)


def miss_causes(spark, sf_dir):
    rows = _gold(spark, sf_dir).select("item_id", "doc_id", "question", F.col("text").alias("raw"), F.get(F.split("text", "\n"), 0).alias("kept"))
    return ev.miss_causes(rows).select("item_id", "doc_id", "lost", "cause")


def median_length(spark, sf_dir):
    return ev.upper_median(_t(spark, sf_dir, "documents").withColumn("n", F.length("text")), "n")


def event_threshold_segments(spark, sf_dir):
    return sg.threshold_segments(_t(spark, sf_dir, "events"), "user_id", "event_id", "value", THRESHOLD).select("event_id", "user_id", "segment")


def compaction_segments(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") == "error").alias("boundary"), (F.col("event_type") == "purchase").alias("summary"))
    return sg.compactions(e, "user_id", "event_id")


def lesson_anti_append(spark, sf_dir):
    found = ex.lessons(overlay.units(spark, sf_dir)).select("transcript_id", "unit_idx", "text", (F.col("transcript_id") * 100_000 + F.col("unit_idx")).alias("seq"))
    first = found.filter("text like '%run 0'").withColumn("id", stores.lesson_id(F.col("text")))
    return stores.new_lessons(first, found).select("id", "text")


def lessons_carried(spark, sf_dir):
    units = _units(spark, sf_dir)
    claims = table(rs.with_ids(ex.harvest(units)), "items").filter("bucket = 'claim'").withColumn("ts", F.lit(None).cast("string"))
    said = ex.lessons(units).select("transcript_id", "unit_idx", "text", (F.col("transcript_id") * 100_000 + F.col("unit_idx")).alias("seq"))
    store = stores.new_lessons(said.select(stores.lesson_id(F.col("text")).alias("id")).filter("false"), said.select("text", "seq")).withColumn("ts", F.lit("2024-01-01T00:00:00Z"))
    groups = units.select("transcript_id").distinct()
    return rs.carry_lessons(claims, store, 2, groups=groups).select("transcript_id", "pos", "id", "text", "topic", "ts")


def latest_by_topic_stream(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("topic"), "value", "event_id")
    return views.latest_by_topic(e, "topic", "event_id")


def _event_lines(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    done = F.to_json(F.struct(F.lit("turn.completed").alias("type"), F.struct((F.col("event_id") * 10).alias("input_tokens"), F.col("event_id").alias("cached_input_tokens")).alias("usage")))
    said = F.to_json(F.struct(F.lit("item.completed").alias("type"), F.struct(F.lit("agent_message").alias("type"), F.concat(F.col("event_type"), F.lit(" happened")).alias("text")).alias("item")))
    lines = e.select(F.col("user_id").alias("run_id"), (F.col("event_id") + 1).alias("line"), F.when(F.col("event_type") == "view", said).otherwise(done).alias("value"))
    last = e.groupBy(F.col("user_id").alias("run_id")).agg(F.max("event_id").alias("m"))
    # Each run ends with its usage and begins with its thread.
    end = last.join(e.select(F.col("event_id").alias("m"), "user_id"), "m").select("run_id", (F.col("m") + 1).alias("line"), F.to_json(F.struct(F.lit("turn.completed").alias("type"), F.struct((F.col("m") * 10).alias("input_tokens"), F.col("m").alias("cached_input_tokens")).alias("usage"))).alias("value"))
    begin = last.select("run_id", F.lit(-1).cast("long").alias("line"), F.to_json(F.struct(F.lit("thread.started").alias("type"), F.concat(F.lit("t"), F.col("run_id").cast("string")).alias("thread_id"))).alias("value"))
    return lines.join(last.select("run_id", (F.col("m") + 1).alias("line")), ["run_id", "line"], "left_anti").unionByName(end).unionByName(begin)


def agent_runs(spark, sf_dir):
    return evs.runs(_event_lines(spark, sf_dir))


def agent_messages(spark, sf_dir):
    return evs.agent_messages(_event_lines(spark, sf_dir))


def session_texts(spark, sf_dir):
    return ev.session_text(_t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), "turn", "role", F.col("text").alias("content")))


_NAMES = """
transcript_scan scan_quality redact_documents redact_conversations normalized_text_ids tokens_per_document calibration_claims floor_paths floor_ids
floor_decisions retraction_lines lesson_lines atomic_facts sentence_parts topic_keys harvested_claims retraction_links supersede_by_topic active_claims
supersede_orders cross_conv_settle claim_scores greedy_budget budget_report rendered_fit rendered_brief session_payload full_briefs live_state_flags
bm25_documents bm25_parent recall_boosted recall_budget recall_hook_filter recency_rank stats_summary stats_by_harvester stats_top_topics probe_retention
retention_by_arm probe_extraction probe_arms arm_duel quality_coverage recall_at_k miss_causes median_length event_threshold_segments compaction_segments
equal_budget_arms recall_by_type kept_volume grouped_documents item_documents turn_documents tokenizer_ab evidence_traces
lesson_anti_append lessons_carried latest_by_topic_stream agent_runs agent_messages session_texts
""".split()


def queries():
    def shipped(f):
        def run(spark, sf_dir):
            ship(spark)
            return f(spark, sf_dir)

        return run

    found = {n: globals()[n] for n in _NAMES} | {"date_tokens": date_token_lists, "script_share": script_shares}
    return {n: shipped(f) for n, f in found.items()}
