"""Operators and sources end to end on small literal tables."""

import json

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import budget as b
from mnemospark.operators import corpus as co
from mnemospark.operators import evaluate as ev
from mnemospark.operators import extract as ex
from mnemospark.operators import resolve as rs
from mnemospark.operators import search as se
from mnemospark.operators import segments as sg
from mnemospark.operators import stats as st
from mnemospark.plans import memory
from mnemospark.sources import briefs, events, stores, transcripts


def units(spark, *texts, role="assistant"):
    rows = [(1, k, *(t if isinstance(t, tuple) else (role, t))) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "transcript_id long, unit_idx int, role string, text string")


def test_marked_statements(spark):
    u = units(spark, "The port is 3333 [C:80%] and the limit is 5 [C:90%, basis: log]\ntail", "[C:70%] The host is alpha.", "Aside. It costs 2.5 units [C:150%]", ("user", "Port is 1 [C:99%]"), "no marker")
    got = [(r.text, r.confidence) for r in ex.calibration(u).orderBy("ordinal").collect()]
    assert got == [("The port is 3333", 0.8), ("and the limit is 5", 0.9), ("The host is alpha", 0.7), ("It costs 2.5 units", 1.0)]


def test_floor(spark):
    u = units(spark, "see /srv/app/x.yaml, commit d8d158b and 1234567", "ID 123e4567-e89b-12d3-a456-426614174000 in #12; /srv/app/x.yaml", "/tmp/d8d158c/log has d8d158c", "We decided to ship", "мы договорились")
    got = {(r.kind, r.text) for r in ex.regex_floor(u).collect()}
    assert ("path", "/srv/app/x.yaml") in got and ("id", "d8d158b") in got and ("id", "#12") in got and ("id", "123e4567-e89b-12d3-a456-426614174000") in got
    assert ("id", "1234567") not in got and ("id", "d8d158c") not in got and ("id", "426614174000") not in got
    assert sum(k == "decision" for k, _ in got) == 2 and sum(t == "/srv/app/x.yaml" for _, t in got) == 1


def test_facts_and_anchors(spark):
    long = "Yoga is an excellent way to begin each new day. " + "Try a gentle pose and breathe. " * 8
    u = units(spark, "I adopted a dog last month. I adopted a dog last month.", long, "short", "The port is 3 [C:90%]")
    got = [(r.text, r.topic) for r in ex.atomic(u).orderBy("ordinal").collect()]
    assert got[0] == ("I adopted a dog last month.", "i|adopt|dog") and got[1][1].startswith("context|") and len(got) == 2
    exact = ex.atomic(u, ex.Options(exact_fold=True))
    assert [(r.text, r.topic) for r in exact.orderBy("ordinal").collect()] == got
    assert ex.atomic(u, ex.Options(anchor="off")).count() == 1


def test_corrections_supersede_what_they_refute(spark):
    u = units(spark, "The dashboard port is 3333 [C:90%]", "The retry ceiling is 9 [C:80%]", ("user", "Correction: the dashboard port is 4444, not 3333"), ("system", "Correction: everything was wrong, value 9"))
    items = rs.with_ids(ex.harvest(u, ("retraction", "calibration")))
    rows = {r.text: r for r in rs.resolve(rs.link_corrections(items)).collect()}
    assert rows["The dashboard port is 3333"].superseded_by == rows["Correction: the dashboard port is 4444, not 3333"].id
    assert rows["The retry ceiling is 9"].superseded_by is None and len(rows) == 3


def claims(spark, *rows):
    return spark.createDataFrame([(1, k, *r) for k, r in enumerate(rows)], "transcript_id int, pos int, id string, topic string, superseded_by string, supersedes string")


def test_supersession(spark):
    got = {r.id: r for r in rs.resolve(claims(spark, ("A", "t", None, None), ("B", "t", None, None), ("A", "t", None, None), ("C", "u", "X", None), ("D", "t", "A", None), ("E", "t", None, None))).collect()}
    assert [got[k].superseded_by for k in "ABDE"] == ["E", "E", "E", None]
    assert got["C"].superseded_by == "X" and got["E"].supersedes == "D" and len(got) == 5
    again = {r.id: r for r in rs.resolve(claims(spark, ("A", "t", None, None), ("B", "t", None, None), ("A", "t", "B", None))).collect()}
    assert again["A"].superseded_by is None and again["B"].superseded_by == "A" and again["A"].supersedes == "B"


def test_rendered_size_is_what_is_counted(spark):
    u = units(spark, *(f"The gauge{k} is {k * 111} [C:{50 + k}%]\nSee /srv/a/b{k}.txt and d8d158{k}a" for k in range(9)), "We decided to go.", "LESSON: always verify the owner before pushing", ("user", "Correction: gauge3 is 4444, not 333 at all"))
    items = b.scored(memory.build_items(u)).persist()
    full = b.render(items, "2024-05-01").first()["rendered"]
    sizes = {r.priority: r.rendered for r in b.rendered_fit(items, 10**6, "2024-05-01").collect()}
    n = items.count()
    assert sizes[n] == len(full)
    for k in (1, 4, n // 2, n - 1):
        assert sizes[k] == len(b.render(items.filter(F.col("priority") <= k), "2024-05-01").first()["rendered"]), k
    assert {r.priority for r in b.rendered_fit(items, sizes[5], "2024-05-01").collect()} >= {1, 2, 3, 4, 5}
    assert "## Superseded Claims" in full and "## Lessons" in full and "### decision" in full
    kept = memory.select_items(memory.build_items(u), 700, "2024-05-01")
    assert len(b.render(kept, "2024-05-01").first()["rendered"]) <= 700
    (p,) = memory.context_payload(items.drop("score", "priority"), "2024-05-01", "SessionStart", 1500).collect()
    assert len(json.loads(p.payload)["hookSpecificOutput"]["additionalContext"]) <= 1500


def test_greedy_skips_what_does_not_fit(spark):
    rows = spark.createDataFrame([(1, 1, "a" * 50, "x"), (1, 2, "b" * 60, "y"), (1, 3, "c" * 30, "z")], "transcript_id int, priority int, text string, id string")
    assert [r.id for r in b.greedy(rows, 90).filter("kept").orderBy("priority").collect()] == ["x", "z"]
    assert b.greedy(rows, 0).filter("kept").count() == 3


def docs(spark, *rows):
    d = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_seq int, id string, kind string, text string, ts string, superseded boolean, source string")
    from mnemospark.functions.text import search_tokens

    return d.withColumn("tokens", search_tokens(F.col("text")))


def test_search_ranks_matches_and_standing(spark):
    d = docs(spark, ("a", "claim", "the dashboard port is 3333", "2024-01-01", True, "b1"), ("b", "claim", "the dashboard port is 4444", "2024-01-02", False, "b1"), ("c", "path", "dashboard", "2024-01-03", False, "b2"), ("d", "lesson", "dashboard", "2024-01-03", False, "b2"), ("e", "claim", "unrelated words", "", False, "b3"))
    res = se.scored(d, se.query_terms(spark, {"q": "dashboard port"}), co.recency_rank(d))
    ids = [r.id for r in se.top(res).orderBy("rank").collect()]
    assert ids.index("b") < ids.index("a") and ids.index("d") < ids.index("c") and "e" not in ids
    alone = se.scored(d, se.query_terms(spark, {"q": "dashboard port"}), parent_boost=0.0)
    assert alone.count() == 4
    kept = se.recall(res, 10, 30)
    assert sum(len(r.text) + 1 for r in kept.collect()) <= 30
    prompts = spark.createDataFrame([("q", "which dashboard port"), ("hi", "hello")], "query_id string, query string")
    lines = se.hook_lines(res, prompts).collect()
    assert len(lines) == 1 and "VERIFY CURRENT" in lines[0].line and lines[0].line.startswith("- [2024-01-02")
    assert se.scored(d, se.query_terms(spark, {"q": "nothing"})).count() == 0


def test_recency_of_ties_and_single(spark):
    one = docs(spark, ("a", "claim", "x", "2024", False, "s"))
    assert co.recency_rank(one).first()["recency"] == 1.0
    d = docs(spark, *((f"k{k}", "claim", "x", f"20{k // 2:02d}", False, "s") for k in range(9)), ("n", "claim", "x", None, False, "s"))
    got = {r.id: r.recency for r in co.recency_rank(d).collect()}
    assert got == {f"k{k}": k / 8 for k in range(9)}


def test_statistics_say_null_when_unknown(spark):
    schema = "text string, topic string, harvester string, confidence double, superseded_by string"
    head = spark.createDataFrame([("b1", "2024-01-01", None)], "brief_id string, created_utc string, budget struct<harvested_claims:int,dropped_items:int>")
    r = st.summary(head, spark.createDataFrame([("t", "x", None, None, None)], schema)).first()
    assert r.retractions is None and r.harvested_claims is None and r.mean_confidence is None and r.lessons_total is None and r.labelled_claims == 0
    r = st.summary(head, spark.createDataFrame([("t", "x", "atomic", 0.5, "y"), ("u", "retraction:1", "?", None, None)], schema), spark.createDataFrame([], "id string")).first()
    assert (r.retractions, r.superseded, r.marked_share, r.lessons_total) == (1, 1, 0.5, 0)
    assert "not measurable" in st.report(r)


def test_transcripts_of_all_shapes(spark):
    lines = [
        {"text": "a"}, {"content": "b", "role": "User"}, {"message": "c", "type": "system"}, {"type": "x", "message": {"role": "Tool", "content": "d"}}, {"message": {"content": ["e", {"text": "f"}, {"no": 1}, 5]}},
        {"text": "", "content": "never"}, {"text": {"k": 1}, "content": "g"}, [1], {"role": "stranger", "text": "h"},
    ]
    rows = spark.createDataFrame([("t", k, json.dumps(x)) for k, x in enumerate(lines)] + [("t", 99, "{broken")], "transcript_id string, line int, value string")
    got = [(r.role, r.text) for r in transcripts.units(rows).orderBy("unit_idx").collect()]
    assert got == [("assistant", "a"), ("user", "b"), ("system", "c"), ("tool", "d"), ("assistant", "e\nf"), ("assistant", "g"), ("assistant", "h")]
    q = transcripts.quality(rows).first()
    assert (q.total, q.skipped, q.usable, q.problem) == (10, 2, 7, "some rows skipped")


def test_brief_files_and_lesson_store(spark, tmp_path):
    u = units(spark, "The port is 3333 [C:80%]", "see /srv/a/b.txt")
    items = memory.build_items(u)
    text = briefs.pretty(briefs.to_json(items, "2024-05-01T00:00:00Z").first()["value"])
    briefs.write_private(str(tmp_path / "b" / "one.json"), text)
    (tmp_path / "b" / "two.json").write_text("{not json")
    (tmp_path / "b" / "three.json").write_text(json.dumps({"schema_version": 2, "claims": [], "supplement": []}))
    assert oct((tmp_path / "b" / "one.json").stat().st_mode)[-3:] == "600"
    loose = briefs.scan(spark, str(tmp_path / "b" / "*.json"))
    good = briefs.strict(loose)
    assert loose.count() == 2 and [r.brief_id for r in good.collect()] == ["one.json"]
    assert [r.text for r in briefs.claims(good).collect()] == ["The port is 3333"] and briefs.supplements(good).first()["kind"] == "path"
    log = str(tmp_path / "l" / "lessons.jsonl")
    stores.append_private(log, [stores.lesson_row("first rule"), stores.lesson_row("second rule", "1"), stores.lesson_row("First  rule", "2")])
    with open(log, "a") as f:
        f.write('{broken\n{"text": "a line without an id counts for nothing"}\n')
    kept = stores.read_lessons(spark, log)
    assert [(r.text, r.ts) for r in stores.recent(kept, 5).collect()] == [("second rule", "1"), ("First  rule", "2")]
    batch = spark.createDataFrame([(1, "first rule"), (2, "third rule"), (3, "third  RULE")], "seq int, text string")
    assert [r.text for r in stores.new_lessons(kept, batch).collect()] == ["third rule"]


def test_lesson_ids_are_the_same_on_both_sides(spark):
    texts = ["Always  VERIFY the Straße", "ς end"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(stores.lesson_id(F.col("text")).alias("id"))
    assert [r.id for r in rows.collect()] == [stores.lesson_row(t)["id"] for t in texts]


def test_fresh_lessons_take_places_among_the_newest(spark):
    u = spark.createDataFrame([(1, k, "assistant", f"LESSON: always verify the fresh thing number {k}") for k in range(3)] + [(2, 0, "assistant", "nothing here")], "transcript_id int, unit_idx int, role string, text string")
    claims = rs.with_ids(ex.harvest(u, ("lessons",))).withColumn("ts", F.lit(None).cast("string"))
    old = spark.createDataFrame([(k, f"an older lesson, of number {k}", "t") for k in range(12)], "seq int, text string, ts string")
    got = rs.carry_lessons(claims, old, 10, groups=u.select("transcript_id")).filter("ts = 't'").groupBy("transcript_id").count()
    assert {tuple(r) for r in got.collect()} == {(1, 7), (2, 10)}
    stored = old.unionByName(claims.select((F.col("pos") + 20).alias("seq"), "text", F.lit("t").alias("ts")))
    got = rs.carry_lessons(claims, stored, 10, groups=u.select("transcript_id")).filter("ts = 't'").groupBy("transcript_id").count()
    assert {tuple(r) for r in got.collect()} == {(1, 7), (2, 10)}


def test_documents_record_their_budget_and_empty_transcripts_have_one(spark):
    u = units(spark, *(f"The gauge{k} is {k * 111} [C:{50 + k}%]" for k in range(9))).unionByName(spark.createDataFrame([(2, 0, "tool", "nothing")], "transcript_id long, unit_idx int, role string, text string"))
    extras = spark.createDataFrame([(1, ["next"], "go on")], "transcript_id long, open_threads array<string>, last_user_ask string")
    rows = {r.transcript_id: json.loads(r.value) for r in memory.documents(u, "2024-05-01", memory.Config(budget_chars=600), agent="test", extras=extras).collect()}
    cost = rows[1]["source"]["budget"]
    assert cost["harvested_claims"] == 9 and cost["kept_claims"] == len(rows[1]["claims"]) == 9 - cost["dropped_items"] and 0 < cost["rendered_chars"] <= 600 and rows[1]["source"]["agent"] == "test"
    assert rows[1]["open_threads"] == ["next"] and rows[2]["claims"] == [] and rows[2]["source"]["budget"]["harvested_claims"] == 0
    shown = {r.transcript_id: r.rendered for r in memory.briefs(u, "2024-05-01").collect()}
    assert "- None" in shown[2] and "gauge3" in shown[1]


def test_statistics_by_extractor_kind_and_topic(spark):
    c = spark.createDataFrame([("a", "t1", 1), ("a", "t2", 2), ("b", "t1", 3)], "harvester string, topic string, at int")
    k = spark.createDataFrame([("path", 1), ("id", 2), ("path", 3)], "kind string, at int")
    rows = st.breakdown(c, k).collect()
    assert {(r.part, r.value, r.n, r["rank"]) for r in rows} == {("harvester", "a", 2, 1), ("harvester", "b", 1, 2), ("kind", "path", 2, 1), ("kind", "id", 1, 2), ("topic", "t1", 2, 1), ("topic", "t2", 1, 2)}
    head = spark.createDataFrame([("b1", "2024", None)], "brief_id string, created_utc string, budget struct<harvested_claims:int,dropped_items:int>")
    text = st.report(st.summary(head, spark.createDataFrame([], "text string, topic string, harvester string, confidence double, superseded_by string")).first(), rows)
    assert "by extractor:\n  a: 2" in text and "most frequent topics:\n  t1: 2" in text


def test_transcripts_roll_and_briefs_are_checked_first(tmp_path):
    path = tmp_path / "t" / "live.jsonl"
    assert stores.rotate(str(path), "1") is None
    assert stores.append_units(str(path), [{"text": "a"}, {"text": "é"}]) == 2
    path.chmod(0o644)
    stores.append_units(str(path), [{"text": "b"}])
    assert oct(path.stat().st_mode)[-3:] == "600" and [json.loads(x)["text"] for x in path.read_text("utf-8").splitlines()] == ["a", "é", "b"]
    away = stores.rotate(str(path), "2024")
    assert not path.exists() and len(open(away).readlines()) == 3
    brief = tmp_path / "b.json"
    said = []
    for text in (None, "", "{", "[]", '{"claims": []}', '{"claims": [], "supplement": [], "schema_version": 1}'):
        if text is not None:
            brief.write_text(text)
        said.append(briefs.problem_of(str(brief)))
    assert said[:2] == ["no brief was written", "the brief is empty"] and "can't be read" in said[2] and "no JSON object" in said[3] and said[4].endswith("schema_version, supplement") and said[5] is None
    assert "older" in briefs.problem_of(str(brief), brief.stat().st_mtime + 5)


def test_managed_block():
    once = briefs.managed_block("# Notes\n", f"a {briefs.END} b")
    assert briefs.managed_block(once, f"a {briefs.END} b") == once and once.startswith("# Notes\n\n") and once.count(briefs.END) == 1
    assert briefs.managed_block("", "x").startswith(briefs.BEGIN)
    assert briefs.managed_block(f"a\n{briefs.BEGIN}\nold\n{briefs.END}\nmid\n{briefs.END}\nz", "new").endswith(f"new\n{briefs.END}\nz")


def test_events(spark):
    said = lambda **x: json.dumps({"item": {**x, "type": "agent_message"}, "type": "item.completed"})
    used = lambda n: json.dumps({"usage": {"input_tokens": n}, "type": "turn.completed"})
    lines = ["noise", json.dumps({"thread_id": "t1", "type": "thread.started"}), said(text="hi"), said(content=[{"text": "x"}, "y"]), used(5), used(9)]
    blob = spark.createDataFrame([("r", "\n".join(lines)), ("e", "junk")], "run_id string, value string")
    rows = events.lines_of(blob)
    assert [r.text for r in events.agent_messages(rows).orderBy("line").collect()] == ["hi", "x\ny"]
    got = {r.run_id: r for r in events.runs(rows).collect()}
    assert (got["r"].thread_id, got["r"].input_tokens, got["r"].events, got["e"].parse_error) == ("t1", 9, 5, True)


def test_many_probes_are_matched_as_few_are(spark, monkeypatch):
    rng = __import__("random").Random(3)
    some = lambda n: " ".join(rng.choice("abcdefghij") * rng.randint(1, 2) for _ in range(n))
    probes = spark.createDataFrame([(k, some(rng.randint(0, 6)), "x") for k in range(40)], "id int, text string, harvester string")
    items = spark.createDataFrame([(k, some(rng.randint(0, 8)), f"h{k % 3}") for k in range(300)], "seq int, text string, harvester string")
    few = sorted(map(tuple, ev.best_match(probes, items).collect()))
    monkeypatch.setattr(ev, "FEW_PROBES", 0)
    assert few == sorted(map(tuple, ev.best_match(probes, items).collect()))


def test_holders_of_a_passage(spark):
    d = spark.createDataFrame([(1, "one two three four"), (2, "xone two threex"), (3, "two"), (4, None), (5, "one two thre")], "doc_id int, text string")
    i = spark.createDataFrame([("a", "one two three"), ("b", "two"), ("c", "e two t")], "item string, question string")
    assert {(r.doc_id, r.item) for r in ev.holders(d, i).collect()} == {(1, "a"), (2, "a"), (1, "b"), (2, "b"), (3, "b"), (5, "b"), (1, "c"), (2, "c"), (5, "c")}


def test_probes_and_recall(spark):
    probes = spark.createDataFrame([("p1", "the port is 3333", "calibration"), ("p2", "/srv/app", "regex_floor"), ("p3", "port is 3333 now ok", "x"), ("p4", "nothing alike", "x")], "id string, text string, harvester string")
    items = spark.createDataFrame([(0, "The  port is 3333", "atomic"), (1, "/srv/app", "regex_floor"), (2, "the port is 3333", "calibration")], "seq int, text string, harvester string")
    got = {r.id: (r.verdict, r.matched) for r in ev.best_match(probes, items).collect()}
    assert got == {"p1": ("EXACT", "atomic"), "p2": ("EXACT", "regex_floor"), "p3": ("PARA", "atomic"), "p4": ("LOST", None)}
    assert {r.arm: r.retention_rate for r in ev.retention(ev.best_match(probes, items)).collect()}["x"] == 0.5
    ranked = spark.createDataFrame([("q", 1, "s1"), ("q", 2, "s1"), ("q", 3, "s2")], "query_id string, rank int, session string")
    gold = spark.createDataFrame([("q", "s2"), ("r", "s1")], "query_id string, session string")
    got = {r.query_id: (r.hit_1, r.hit_3) for r in ev.recall_at(ranked, gold).collect()}
    assert got == {"q": (False, True), "r": (False, False)}
    assert ev.upper_median(spark.createDataFrame([(k,) for k in (4, 1, 3, 2)], "x int"), "x").first()["median"] == 3


def test_segments(spark):
    rows = spark.createDataFrame([("u", k, v) for k, v in enumerate([1, 9, 1, 9, 9, 1])], "k string, o int, v int")
    assert [r.segment for r in sg.threshold_segments(rows, "k", "o", "v", 5).orderBy("o").collect()] == [0, 0, 1, 1, 2, 3]
    marks = [(0, False, False), (1, True, False), (2, False, True), (3, True, False), (4, True, False), (5, False, True), (6, True, False)]
    rows = spark.createDataFrame([("t", *m) for m in marks], "transcript_id string, line int, boundary boolean, summary boolean")
    assert [tuple(r)[1:] for r in sg.compactions(rows).orderBy("boundary_at").collect()] == [(0, 1, 2), (3, 3, 5)]


def test_bridge_streams_segments_into_claims(spark, tmp_path):
    from mnemospark.shipping import ship
    from mnemospark.streaming import bridge

    ship(spark)
    rows = [("t1", 1, "The port is 3333 [C:80%]", None, False), ("t1", 2, None, 300_000, False), ("t1", 3, "The port is 4444 [C:90%]", 10, False), ("t2", 1, "The limit is 5 [C:70%]", None, True)]
    spark.createDataFrame(rows, bridge.INPUT).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(bridge.INPUT).parquet(str(tmp_path / "in"))
    bridge.start(stream, str(tmp_path / "out"), str(tmp_path / "check"), once=True).awaitTermination(120)
    got = {(r.transcript_id, r.text) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("t1#0", "The port is 3333"), ("t2#0", "The limit is 5")}


def test_config_and_command_line(tmp_path, capsys, monkeypatch, spark):
    from mnemospark import cli

    assert memory.Config.from_env({"MNEMOSPARK_BUDGET_CHARS": "x", "MNEMOSPARK_HARVEST": "off"}).budget_chars == 12_000
    assert memory.Config.from_env({"MNEMOSPARK_BUDGET_CHARS": "-5"}).budget_chars == 0
    monkeypatch.setenv("MNEMOSPARK_BRIEF_DIR", str(tmp_path / "briefs"))
    monkeypatch.setenv("MNEMOSPARK_LESSONS_PATH", str(tmp_path / "lessons.jsonl"))
    monkeypatch.setattr(cli, "_spark", lambda: spark)
    lines = [{"text": "The dashboard port is 3333 [C:90%]"}, {"text": "LESSON: always verify the owner before pushing"}, {"role": "user", "text": "thanks"}]
    (tmp_path / "t.jsonl").write_text("\n".join(map(json.dumps, lines)))
    assert cli.main(["precompact", "--transcript", str(tmp_path / "t.jsonl"), "--now", "2024-05-01T00:00:00Z"]) == 0
    assert cli.main(["recall", "dashboard port", "--json"]) == 0
    assert cli.main(["stats", "--json"]) == 0
    assert cli.main(["lessons", "--json"]) == 0
    assert cli.main(["postcompact"]) == 0
    assert cli.main(["version"]) == 0
    out = capsys.readouterr()
    assert "3333" in out.out and '"claims_total": 2' in out.out and "hookSpecificOutput" in out.out and not out.err


@pytest.mark.parametrize("name", ["active_claims", "greedy_budget", "bm25_documents", "probe_retention", "recall_hook_filter"])
def test_queries_give_rows(spark, name):
    import __spark_entry__

    assert __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
    assert __spark_entry__.oracle_sql()[name]


def test_lessons_of_every_transcript_reach_the_append(spark, tmp_path):
    from mnemospark.plans import queries

    rows = spark.createDataFrame([(1, 1, "assistant", "x"), (1, 3, "assistant", "y"), (2, 1, "assistant", "z")], "conv_id long, turn long, role string, text string")
    rows.write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.lesson_anti_append(spark, str(tmp_path)).collect()
    assert sorted(r.text for r in got) == ["So next time always verify the token owner of run 2", "always verify the token owner before pushing run 1"]
