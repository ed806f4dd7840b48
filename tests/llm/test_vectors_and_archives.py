"""Nearest neighbours, archives, components and the pipeline against brute force."""

import base64
import gzip
import hashlib
import random
import urllib.parse

import numpy as np
import pytest

from mnemospark.llm import graph, lshforest, warc
from mnemospark.llm.shared import prepare


@pytest.fixture(scope="module")
def spark_(spark):
    prepare(spark)
    return spark


def test_neighbours_recall_and_scores(spark_):
    rng = np.random.default_rng(0)
    x = (rng.normal(0, 1, (20, 16))[rng.integers(0, 20, 3000)] + rng.normal(0, 0.5, (3000, 16))).astype(np.float32)
    rows = [(k, v.tolist(), 0, "s") for k, v in enumerate(x)]
    rows += [(5000, None, 0, "s"), (5100, [0.0] * 16, 0, "s"), (5200, [float("nan")] * 16, 0, "s"), (5300, [1.0, None] + [0.0] * 14, 0, "s"), (5400, [1.0] * 3, 0, "s"), (None, [1.0] * 16, 0, "s"), (300, x[300].tolist(), 0, "s")]
    df = spark_.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, score string")
    got = lshforest.neighbours(df, block=700).collect()
    asked = {r.query_id for r in got}
    assert asked == set(range(0, 3000, 100))
    good = 0
    for q in asked:
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        order = [k for k in np.lexsort((np.arange(3000), d)) if k != q][:10]
        good += len({r.vec_id for r in mine} & set(order))
        assert [r["rank"] for r in mine] == list(range(1, 11))
        assert all(abs(r.score - d[r.vec_id]) < 1e-9 for r in mine)
        assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
    assert good >= 0.9 * 10 * len(asked)


def test_neighbours_of_few_and_none(spark_):
    schema = "vec_id long, embedding array<float>"
    few = spark_.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0])], schema)
    assert [(r.query_id, r["rank"], r.vec_id) for r in lshforest.neighbours(few).orderBy("rank").collect()] == [(0, 1, 2), (0, 2, 1)]
    assert lshforest.neighbours(few.filter("false")).count() == 0


def pages(spark):
    html = ["<p>a</p>", "<p>b</p>", "<p>a</p>", None, "", "é" * 3000, "<p>a</p>", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"]
    rows = [(k, f"http://x/{k} ?\n", h) for k, h in enumerate(html)] + [(100, None, "unique"), (None, "http://n", "nobody")]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string")


def test_archives_round_trip(spark_):
    rows, df = pages(spark_)
    got = {r.page_id: r for r in warc.round_trip(df.repartition(3)).collect()}
    assert len(got) == len(rows)
    largest = {}
    for page, _, html in rows:
        largest[html or ""] = max(largest.get(html or "", -1), -1 if page is None else page)
    for page, _, html in rows:
        raw = (html or "").encode()
        r = got[page]
        first = page is None or largest[html or ""] == page
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if first else ("revisit", largest[html or ""]))
    assert warc.round_trip(df.filter("false")).count() == 0


def test_normaliser_makes_one_member_a_record(spark_):
    rows, df = pages(spark_)
    whole = warc.write(df.coalesce(1))
    made = warc.normalise(whole, keep_whole=True)
    (before,), (after,) = whole.collect(), made.collect()
    path = lambda uri: urllib.parse.urlparse(uri).path
    data, new = open(path(before.path), "rb").read(), open(path(after.path), "rb").read()
    assert gzip.decompress(data) == gzip.decompress(new) and len(new) > len(data)
    index = [__import__("json").loads(x) for x in open(path(after["index"]))]
    assert len(index) == len(rows) == after.n_records and index[0]["offset"] == 0
    for a, b in zip(index, index[1:]):
        assert a["offset"] + a["length"] == b["offset"]
        assert gzip.decompress(new[a["offset"] : b["offset"]]).startswith(b"WARC/1.1\r\n")
    # A stream that comes in small pieces, of several members, is read alike.
    heads = [h for h, _ in warc.records(iter([gzip.decompress(new)[k : k + 7] for k in range(0, len(gzip.decompress(new)), 7)]))]
    assert len(heads) == len(rows)


def test_components(spark_):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(40)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(150)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.node: r.label for r in graph.components(spark_.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert graph.components(spark_.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_stages_take_effect(spark_):
    import corpus_pipeline as cp

    d = "/root/testdata/sf0.001"
    docs = spark_.read.parquet(f"{d}/documents.parquet")
    columns, left = docs.columns, docs.count()
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark_, docs, d)
        assert out.columns == columns, name
        docs = out.persist()
        assert 0 < docs.count() <= left
        left = docs.count()
    packed = cp.STAGES[-1][1](spark_, docs, d)
    assert sorted(r.doc_id for r in packed.collect()) == sorted(r.doc_id for r in docs.collect())
    empty = docs.filter("false")
    for name, stage in cp.STAGES:
        assert stage(spark_, empty, d).count() == 0, name
    assert cp.run(spark_, d).count() == left
