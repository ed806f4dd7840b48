"""Command line: version, markers, stats, recall, recall-hook, lessons, precompact, postcompact."""

from __future__ import annotations

import argparse
import json
import os
import sys
from datetime import datetime, timezone

from . import __version__


def _spark():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("mnemospark").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _store(config):
    from .sources import briefs, stores

    spark = _spark()
    folder, log = os.path.expanduser(config.brief_dir), os.path.expanduser(config.lessons_path)
    docs = briefs.scan(spark, f"{folder}/*.json") if os.path.isdir(folder) and any(x.endswith(".json") for x in os.listdir(folder)) else None
    lessons = stores.read_lessons(spark, log) if config.lessons_enabled and os.path.isfile(log) else None
    return spark, docs, lessons


def _hook() -> dict:
    if sys.stdin is None or sys.stdin.isatty():
        return {}
    try:
        x = json.loads(sys.stdin.read() or "{}")
        return x if isinstance(x, dict) else {}
    except ValueError:
        return {}


def _recalled(config, query: str, limit: int, budget: int):
    from .operators.corpus import corpus, recency_rank
    from .operators.search import query_terms, recall, scored
    from .sources import briefs

    spark, docs, lessons = _store(config)
    if docs is None:
        return spark, None
    good = briefs.strict(docs)
    all_ = corpus(briefs.claims(good), briefs.supplements(good), lessons)
    return spark, recall(scored(all_, query_terms(spark, {"q": query}), recency_rank(all_)), limit, budget)


def _stats(args, config) -> None:
    from pyspark.sql import functions as F

    from .operators import stats
    from .sources import briefs

    spark, docs, lessons = _store(config)
    if docs is None:
        docs = spark.createDataFrame([], briefs.SCHEMA.replace(", _broken string", "") + ", brief_id string, modified timestamp")
    claims = briefs.claims(docs.filter("claims is not null"))
    row = stats.summary(docs.select("brief_id", "created_utc", F.col("source.budget").alias("budget")), claims, lessons).first()
    at = lambda rows: rows.withColumn("at", F.struct("brief_id", "pos"))
    parts = stats.breakdown(at(claims), at(briefs.supplements(docs.filter("supplement is not null")))).collect()  # extractors, kinds, ten topics
    if not args.json:
        print(stats.report(row, parts))
        return
    more = {name: {p["value"]: p["n"] for p in sorted((p for p in parts if p["part"] == part), key=lambda p: p["rank"])} for part, name in (("harvester", "by_harvester"), ("kind", "supplement_by_kind"), ("topic", "top_topics"))}
    print(json.dumps(row.asDict() | more, ensure_ascii=False, sort_keys=True))


def _recall(args, config) -> None:
    _, rows = _recalled(config, args.query, args.limit, args.budget)
    found = [r.asDict() for r in rows.orderBy("rank").collect()] if rows is not None else []
    if args.json:
        print(json.dumps([{k: r[k] for k in ("id", "kind", "score", "bm25", "source", "superseded", "text", "ts")} for r in found], ensure_ascii=False, indent=2))
    else:
        for r in found:
            print(f"{r['score']:.4f} [{r['kind']}{', superseded' if r['superseded'] else ''}] {' '.join(r['text'].split())}")


def _recall_hook(args, config) -> None:
    from .operators.search import hook_lines, hook_payload

    if os.environ.get("MNEMOSPARK_RECALL_HOOK") in ("0", "false", "off"):
        return
    given = _hook()
    prompt = str(given["prompt"]).strip() if given.get("prompt") else ""
    if len(prompt) < 3:
        return
    spark, rows = _recalled(config, prompt, 24, 0)
    if rows is not None:
        prompts = spark.createDataFrame([("q", prompt)], "query_id string, query string")
        for r in hook_payload(hook_lines(rows.drop("rank"), prompts)).collect():
            print(r["payload"])


def _lessons(args, config) -> None:
    from .sources import stores

    log = os.path.expanduser(config.lessons_path)
    if args.add:
        stores.append_private(log, [stores.lesson_row(args.add, args.now or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"))])
    _, _, lessons = _store(config)
    rows = [r.asDict() for r in stores.recent(lessons, args.limit).collect()] if lessons is not None else []
    print(json.dumps(rows, ensure_ascii=False) if args.json else "\n".join("- " + r["text"] for r in rows))


def _precompact(args, config) -> None:
    from .operators.extract import lessons as stated
    from .plans.memory import documents
    from .sources import briefs, stores, transcripts

    hook = _hook() if not args.transcript else {}
    path = args.transcript or hook.get("transcript_path")
    if not path or not os.path.isfile(path):
        print("mnemospark: no transcript", file=sys.stderr)
        return
    now = args.now or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    spark, _, lessons = _store(config)
    lines = transcripts.read_lines(spark, path)
    for r in transcripts.quality(lines).filter("problem is not null").collect():
        print(f"mnemospark: {r['problem']} in {path} ({r['skipped']} of {r['total']} skipped)", file=sys.stderr)
    units = transcripts.units(lines, config.redact).persist()
    session = str(hook.get("session_id") or "session")
    document = documents(units, now, config, lessons, "cli").first()
    body = json.loads(document["value"]) if document else {"schema_version": 1, "created_utc": now, "claims": [], "supplement": [], "source": {"agent": "cli"}}
    body["source"]["session"] = session
    out = args.out or f"{os.path.expanduser(config.brief_dir)}/{now.replace(':', '').replace('-', '')}-{session}.json"
    print(briefs.write_private(out, briefs.pretty(json.dumps(body))))
    if config.lessons_enabled:
        fresh = [stores.lesson_row(r["text"], now, session) for r in stated(units, config.options()).orderBy("ordinal").collect()]  # of one transcript
        known = {r["id"] for r in lessons.select("id").collect()} if lessons is not None else set()
        new = {r["id"]: r for r in reversed(fresh) if r["id"] not in known}
        if new:
            stores.append_private(os.path.expanduser(config.lessons_path), list(reversed(new.values())))
    if log := os.environ.get("MNEMOSPARK_PROBE_LOG"):
        stores.append_private(log, [{"ts": now, "session_id": session, "corpus_id": os.environ.get("MNEMOSPARK_CORPUS_ID"), "harvest_enabled": config.harvest_enabled, "brief": body}])


def _postcompact(args, config) -> None:
    from pyspark.sql import functions as F

    from .operators.resolve import once_by_id, resolve
    from .plans.memory import context_payload
    from .sources import briefs

    spark, docs, _ = _store(config)
    if args.brief:
        docs = briefs.scan(spark, args.brief)
    if docs is None:
        return
    one = briefs.newest(briefs.strict(docs)).persist()
    head = one.first()
    if head is None:
        return
    claims = resolve(briefs.claims(one).withColumn("bucket", F.lit("claim")).withColumn("transcript_id", F.col("brief_id")))
    rest = once_by_id(briefs.supplements(one).withColumn("bucket", F.lit("supplement")).withColumn("transcript_id", F.col("brief_id")))
    for r in context_payload(claims.unionByName(rest, allowMissingColumns=True), head["created_utc"] or "", args.event, config.budget_chars).collect():
        print(r["payload"])


def main(argv: list[str] | None = None) -> int:
    from .operators.budget import MARKERS
    from .plans.memory import Config

    parser = argparse.ArgumentParser(prog="mnemospark")
    sub = parser.add_subparsers(required=True, dest="command")
    sub.add_parser("version")
    sub.add_parser("markers")
    sub.add_parser("stats").add_argument("--json", action="store_true")
    p = sub.add_parser("recall")
    p.add_argument("query")
    p.add_argument("--limit", default=10, type=int)
    p.add_argument("--budget", default=0, type=int)
    p.add_argument("--json", action="store_true")
    sub.add_parser("recall-hook")
    p = sub.add_parser("lessons")
    p.add_argument("--limit", default=20, type=int)
    p.add_argument("--add")
    p.add_argument("--now")
    p.add_argument("--json", action="store_true")
    p = sub.add_parser("precompact")
    p.add_argument("--transcript")
    p.add_argument("--out")
    p.add_argument("--now")
    p = sub.add_parser("postcompact")
    p.add_argument("--brief")
    p.add_argument("--event", default=os.environ.get("MNEMOSPARK_EVENT", "SessionStart"))
    args = parser.parse_args(argv)
    if args.command == "version":
        print(__version__)
        return 0
    if args.command == "markers":
        print(MARKERS)
        return 0
    run = {"stats": _stats, "recall": _recall, "recall-hook": _recall_hook, "lessons": _lessons, "precompact": _precompact, "postcompact": _postcompact}[args.command]
    try:
        run(args, Config.from_env())
    except Exception as e:  # a memory must never stop the agent that it serves
        print(f"mnemospark: {args.command} gave nothing: {type(e).__name__}: {e}", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
