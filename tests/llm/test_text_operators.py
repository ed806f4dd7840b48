"""Operators on texts against brute force and the public libraries, with awkward rows."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from mnemospark.llm import langid, ngram_join, packing, paragraphs, pieces, rules, sharding, tokencount
from mnemospark.llm.shared import Scratch, prepare

public = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, n string, token string"


@pytest.fixture(scope="module")
def spark_(spark):
    prepare(spark)
    return spark


def docs(spark, texts, ids=None):
    """Documents with extra columns whose names operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", None, "x", "y", "z") for i, t in zip(ids, texts)], SCHEMA)


def awkward():
    rng = random.Random(4)
    bits = ["ab", " ", "s", "'", "'re", "\n", "\r", "1", "23", "é", "ß", "漢", "🙂", "!", "---", "<|endoftext|>", "<|", "the", "tion", " and", "\x00", "\x1c", "ʼ", "▁", "  "]
    fuzz = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(600)]
    return [*fuzz, "", None, "a" * 50, " " * 100, "=-" * 900, "x" * 3000, "the" * 1500 + "ing" * 300]


def test_piece_ids_equal_the_library_and_decode_back(spark_):
    import sentencepiece

    path = public.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = awkward()
    got = {r.doc_id: r for r in pieces.round_trip(docs(spark_, texts), path).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        if t is None:
            assert got[i].ids is None and got[i].n_pieces == 0 and got[i].exact is None
            continue
        assert got[i].ids == library.encode(t), t
        assert got[i].exact == (library.decode(got[i].ids) == t)
    back = pieces.decode(pieces.encode(docs(spark_, texts[:50]), path), path)
    assert all(r.decoded == library.decode(r.ids) for r in back.collect())
    assert pieces.round_trip(docs(spark_, []), path).count() == 0


def test_chunked_max_plus_scan_equals_the_lockstep_run():
    m = pieces.Model(public.path("piece_bpe_32k.model"))
    rng = random.Random(9)
    for _ in range(15):
        word = [ord(c) for c in "".join(rng.choice(["ation", "the", "a", "é", "un", "zz", "漢"]) for _ in range(rng.randint(1, 60)))]
        whole = m.machine.encode(word)
        for size in (1, 3, 7, 64):
            assert m.machine.long_word(word, size) == whole


def test_token_counts_equal_the_library(spark_):
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = awkward()
    got = {r.doc_id: r for r in tokencount.token_counts(docs(spark_, texts), path).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 512), t
    counter = tokencount.Counter(path, tokencount.classes())
    column = pa.array(texts, pa.string())
    assert (counter.count(column) == counter.count(column, long=16)).all()
    assert tokencount.token_counts(docs(spark_, []), path).count() == 0


@pytest.mark.parametrize("chunk, long", [(7, 5), (64, 32), (4096, 1024)])
def test_texts_cut_into_chunks_equal_the_libraries(chunk, long):
    """Real documents go through the scan at the shipped sizes, awkward ones at any."""
    import pyarrow.parquet as pq
    import sentencepiece
    from tokenizers import Tokenizer

    texts = awkward() if chunk < 4096 else pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    path, other = public.path("piece_bpe_32k.model"), public.path("byte_bpe_50k.json")
    m, library = pieces.Model(path), sentencepiece.SentencePieceProcessor(model_file=path)
    ids, at = m.encode(pa.array(texts), long, chunk)
    assert [ids[at[k] : at[k + 1]].tolist() for k in range(len(texts))] == [library.encode(t or "") for t in texts]
    counter, library = tokencount.Counter(other, tokencount.classes()), Tokenizer.from_file(other)
    assert counter.count(pa.array(texts), long, chunk).tolist() == [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    long_texts = sum(len(t or "") > chunk for t in texts)
    assert long_texts and m.machine.scans >= long_texts and counter.machine.scans >= 0.9 * long_texts


def test_new_columns_must_have_a_name_of_their_own(spark_):
    path = public.path("piece_bpe_32k.model")
    rows = docs(spark_, ["a b"]).withColumnRenamed("score", "ids")
    with pytest.raises(ValueError):
        pieces.encode(rows, path)
    assert pieces.encode(rows, path, ids="pieces").first()["pieces"]


def test_character_classes_follow_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    counter = tokencount.Counter(public.path("byte_bpe_50k.json"), tokencount.classes())
    texts = ["a" + chr(c) + "1 " + chr(c) + "b" for c in [*range(0x20, 0x700), *range(0x2000, 0x2100), *range(0xA640, 0xA800), *range(0x10940, 0x109C0), *range(0x1E900, 0x1E960)]]
    expected = [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]
    assert counter.count(pa.array(texts)).tolist() == expected


def brute_links(texts):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    near = collections.defaultdict(set)
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 90 * len(sets[a] | sets[b]):
                near[a].add(b)
                near[b].add(a)
    return sets, near


def component(near, n):
    out = list(range(n))
    for a in range(n):
        seen, todo = set(), [a]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += near[x]
        out[a] = min(seen)
    return out


def near_texts():
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(400)]
    shared = [rng.choice(vocabulary) for _ in range(70)]
    out = []
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([5, 8, 30, 120, 300]))]
        for _ in range(rng.choice([1, 2, 6])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            if g % 2:
                t = t[:3] + shared + t[3:]
            out.append(" ".join(t))
    # A group large enough for its shingles to be hot, which hold little else.
    for _ in range(140):
        t = list(shared)
        t[rng.randrange(70)] = rng.choice(vocabulary)
        out.append(" ".join(t))
    return [*out, out[0], out[0].upper(), "", None, " \n\t", "one two", "One TWO", "one two three four five", "x"]


def test_ngram_join_equals_brute_force(spark_):
    texts = near_texts()
    sets, near = brute_links(texts)
    label = component(near, len(texts))
    got = {r.doc_id: r for r in ngram_join.near_copies(docs(spark_, texts)).collect()}
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert (got[i].n_shingles, got[i].n_similar, got[i].component_id) == (len(sets[i]), len(near[i]), label[i]), (i, texts[i])
    kept = {r.doc_id for r in ngram_join.keep_one(docs(spark_, texts)).collect()}
    assert kept == set(label)


def test_ngram_join_of_nothing_nulls_and_repeated_rows(spark_):
    assert ngram_join.near_copies(docs(spark_, [])).count() == 0
    rows = docs(spark_, ["a b c d e f", "a b c d e f", "a b c d e f", None], [1, 1, 2, None])
    got = sorted((r.doc_id or -1, r.n_similar, r.component_id) for r in ngram_join.near_copies(rows).collect())
    assert got == [(-1, 0, None), (1, 1, 1), (1, 1, 1), (2, 1, 1)]
    assert sorted(r.doc_id or -1 for r in ngram_join.keep_one(rows).collect()) == [-1, 1]


def brute_counts(t):
    w = WORD.findall(t or "")
    seen = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)]


def test_rule_counts_equal_brute_force(spark_):
    texts = [*awkward(), "a\n\na\n", "a\na", "a b c a b c a b c", "x\r\nx\r\n", "#|a a a a", " \n \n", "é é\té é é é"]
    got = {r.doc_id: [r[c] for c in rules.COUNTS] for r in rules.statistics(docs(spark_, texts)).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute_counts(t), t


def test_decision_list_rejects_what_it_learned(spark_):
    rng = random.Random(3)
    texts, labels = [], []
    for k in range(300):
        bad = k % 4 == 0
        words = [rng.choice(["alpha", "beta", "gamma", "delta", "zeta", "eta"]) + str(rng.randrange(99)) + ("###" if bad and rng.random() < 0.5 else "") for _ in range(80)]
        texts.append(" ".join(words))
        labels.append((k, 0 if bad else 1))
    texts += ["short", None, "", "a b c " * 40]
    table = spark_.createDataFrame([*labels, (0, None), (999_999, 0), (None, 0)], "doc_id long, quality int")
    got = {r.doc_id: r for r in rules.judge(docs(spark_, texts), table).collect()}
    assert all(got[k].kept == (k % 4 != 0) for k in range(300))
    assert all(got[k].base_failed and not got[k].kept for k in range(300, 304))
    kept = rules.keep_good(docs(spark_, texts), table)
    assert kept.columns == docs(spark_, []).columns and {r.doc_id for r in kept.collect()} == {k for k in range(300) if k % 4}
    none = rules.judge(docs(spark_, texts), table.filter("false"))
    assert none.filter("kept").count() == 300
    assert rules.judge(docs(spark_, []), table).count() == 0


def test_language_id_is_right_on_held_out_documents(spark_):
    rows = spark_.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(rows).join(rows.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 200 and np.mean([r.lang == r.lang_pred for r in got]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    odd = docs(spark_, ["", None, "123 !?", "the and of that with"])
    network = langid.fit(rows)
    assert [r.lang_pred for r in langid.predict(odd, network).orderBy("doc_id").collect()][:3] == ["und"] * 3
    assert {r.lang_pred for r in langid.predict(odd, None).collect()} == {"und"}
    assert [r.doc_id for r in langid.keep_known(odd, network).collect()] == [3]
    assert langid.identify(docs(spark_, [])).count() == 0


def test_back_propagation_agrees_with_differences():
    rng = np.random.default_rng(1)
    net = langid.Network(["a", "b", "c"], hidden=3)
    for layer in (net.forward, net.backward):
        layer.w, layer.u = (rng.normal(0, 0.5, p.shape) for p in layer.params())
    net.v, net.b = rng.normal(0, 0.5, net.v.shape), rng.normal(0, 0.5, net.b.shape)
    x, want = rng.integers(97, 103, (7, 5)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    mask = (rng.random((7, 5)) < 0.8).astype(np.float32)
    _, grads = net.gradients(x, want, mask)
    for p, g in zip(net.params(), grads):
        used = np.argwhere(np.abs(g) > 1e-4)
        for at in map(tuple, used[rng.permutation(len(used))[:12]]):
            kept, e = p[at], 1e-2
            p[at] = kept + e
            high = net.gradients(x, want, mask)[0]
            p[at] = kept - e
            low = net.gradients(x, want, mask)[0]
            p[at] = kept
            assert abs((high - low) / (2 * e) - g[at]) < 2e-3 + 0.03 * abs(g[at])


def test_training_learns():
    rng = np.random.default_rng(1)
    net = langid.Network(["a", "b"], hidden=3)
    x = rng.integers(97, 110, (64, 12)).astype(np.uint8)
    y = (x[:, 0] % 2).astype(int)
    losses = net.train(x, y, np.ones((64, 12), bool), steps=150, batch=64)
    assert np.mean(losses[-10:]) < 0.3 * losses[0]


def test_seventy_languages_are_all_learned(spark_):
    rng = random.Random(2)
    letters = [chr(c) for c in range(0x561, 0x587)] + [chr(c) for c in range(0x3B1, 0x3C9)] + [chr(c) for c in range(0x10D0, 0x10F0)]
    rows = []
    for k in range(70):
        own = [letters[k], letters[(3 * k + 7) % len(letters)]]
        rows += [(100 * k + j, "".join(rng.choice(own) for _ in range(300)), f"l{k:02d}") for j in range(8)]
    table = spark_.createDataFrame(rows, "doc_id long, text string, lang string")
    network = langid.fit(table)
    assert network.languages == [f"l{k:02d}" for k in range(70)]
    got = langid.predict(table, network).join(table, "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.8


def test_packing_is_optimal_and_within_budget(spark_):
    rng = random.Random(8)
    values = np.array(sorted(rng.sample(range(1, 60), 9)))
    counts = np.array([rng.randint(1, 9) for _ in values])

    def padding(ends):
        return sum(c * (min(e for e in ends if e >= v) - v) for v, c in zip(values, counts))

    import itertools

    for k in (1, 2, 3, 5, 9, 20):
        best = min(padding([*s, values[-1]]) for n in range(min(k, 9)) for s in itertools.combinations(values[:-1], n))
        ends = packing.boundaries(values, counts, k)
        assert len(ends) <= k and padding(ends) == best
    texts = ["w " * rng.randint(0, 300) for _ in range(400)] + ["w " * 5000, None, "", "w"]
    got = packing.pack(docs(spark_, texts), buckets=4, budget=1000).collect()
    assert len(got) == len(texts)
    batches = collections.defaultdict(list)
    for r in got:
        assert r.n_tokens == len((texts[r.doc_id] or "").split()) and r.padding == r.bucket_len - r.n_tokens >= 0
        batches[r.batch_id].append(r)
    for b in batches.values():
        assert sorted(r.batch_pos for r in b) == list(range(len(b)))
        assert len(b) == 1 or len(b) * b[0].bucket_len <= 1000
    assert packing.pack(docs(spark_, [])).count() == 0


def test_packing_of_long_lengths_is_optimal(spark_):
    """Lengths far apart and above any rounding: total padding equals the least of all choices of boundaries."""
    import itertools

    rng = random.Random(4)
    sizes = sorted(rng.sample(range(4097, 20_500), 9))
    rows = [n for n in sizes for _ in range(rng.randint(1, 3))]
    got = packing.pack(docs(spark_, ["w " * n for n in rows]), buckets=4).collect()
    least = min(sum(min(e for e in (*s, sizes[-1]) if e >= n) - n for n in rows) for s in itertools.combinations(sizes[:-1], 3))
    assert sum(r.padding for r in got) == least and sorted(r.n_tokens for r in got) == rows


def test_shards_are_near_equal_and_slots_gapless(spark_):
    import zlib

    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 400))) for _ in range(2000)] + ["copy " * 20] * 900 + [None] * 700
    got = sharding.shard(docs(spark_, texts)).collect()
    assert len(got) == len(texts) and {r.law for r in got} == {"bytes"}
    size, places = collections.Counter(), collections.defaultdict(list)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), None) and 0 <= r.shard < 24
        size[r.shard] += r.size
        places[r.shard].append(r.slot)
    assert max(size.values()) - min(size.values()) < 0.02 * sum(size.values()) / 24
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert sharding.shard(docs(spark_, [])).count() == 0


def test_copies_stay_together_where_the_law_allows(spark_):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcd ") for _ in range(rng.randint(100, 400))) for _ in range(6000)]
    texts += [t for k, t in enumerate(texts[:60]) for _ in range(3 + k % 9)]  # light groups
    texts += ["middle " * 40] * 60  # above a sixteenth of a share, below a half
    got = sharding.shard(docs(spark_, texts)).collect()
    of, size = collections.defaultdict(set), collections.Counter()
    for r in got:
        of[texts[r.doc_id]].add(r.shard)
        size[r.shard] += r.size
    assert all(len(s) == 1 for s in of.values())
    assert max(size.values()) - min(size.values()) < 0.02 * sum(size.values()) / 24


def test_columns_of_any_name_are_left_alone(spark_):
    """Stages keep extra columns that are named as they name their own inside."""
    from pyspark.sql import functions as F

    names = ["_letters", "letters", "n_words", "_rule_n_words", "doc", "_doc", "_gone", "gone", "holes", "cell", "_cell", "again", "h", "key", "hash"]
    prose = " ".join(f"word{k % 97}" for k in range(120))
    rows = docs(spark_, [prose, prose + " end", prose.upper(), None, "", prose], [1, 2, 3, 4, None, 5]).withColumns({c: F.lit("kept") for c in names})
    labels = spark_.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    network = langid.Network(["en"])
    for out in (langid.keep_known(rows, network), rules.keep_good(rows, labels), ngram_join.keep_one(rows), paragraphs.remove(rows)):
        assert out.columns == rows.columns
        found = out.collect()
        assert found and all(r[c] == "kept" for r in found for c in names)
    assert {r.doc_id for r in ngram_join.keep_one(rows).collect()} == {1, 3, 4, None} - {3}


def test_slot_map_versions(spark_, tmp_path):
    rng = random.Random(6)
    weight = [rng.randint(0, 1000) for _ in range(512)]
    one = sharding.SlotMap.balanced(weight, 8)
    two = one.grown(weight)
    assert two.version == 2 and all(a == b or b == 8 for a, b in zip(one.shard_of, two.shard_of))
    load = collections.Counter()
    for s, w in zip(two.shard_of, weight):
        load[s] += w
    assert load[8] > 0.9 * sum(weight) / 9
    weight[0] += 50_000
    three = two.rebalanced(weight)
    assert three.version == 3 and sum(a != b for a, b in zip(two.shard_of, three.shard_of)) < 300
    path = one.save(spark_, str(tmp_path))
    assert sharding.SlotMap.load(spark_, path) == one
    with pytest.raises(Exception):
        one.save(spark_, str(tmp_path))


def test_repeated_passages_and_near_paragraphs_are_found(spark_):
    rng = random.Random(12)

    def prose(n):
        out = []
        while len(out) < n:
            s = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(5, 11))]
            out += [s[0].capitalize(), *s[1:-1], s[-1] + "."]
        return out

    passage, para = prose(60), prose(90)
    edited = list(para)
    edited[40] = "changed"
    texts = [" ".join(prose(100)) for _ in range(6)]
    texts[0] = " ".join([*prose(40)[:37], *passage, *prose(30)])
    texts[1] = " ".join([*prose(50)[:44], *passage, *prose(20)])
    texts[2] = " ".join(prose(60)) + "\n" + " ".join(para)
    texts[3] = " ".join(edited) + "\n" + " ".join(prose(55))
    texts += [None, "", "Short line.", texts[4]]
    got = paragraphs.spans(docs(spark_, texts)).collect()
    assert {r.doc_id for r in got} == {0, 1, 2, 3, 4, 9}
    assert {r.doc_id for r in got if r.removed} == {1, 3, 9}
    (cut,) = [r for r in got if r.doc_id == 1]
    assert " ".join(passage) in texts[1].encode()[cut.begin : cut.end].decode() or len(texts[1].encode()[cut.begin : cut.end].decode().split()) >= 50
    left = {r.doc_id: r.text for r in paragraphs.remove(docs(spark_, texts)).collect()}
    assert left[0] == texts[0] and left[5] == texts[5] and left[8] == "Short line."
    assert 9 not in left and len(left[1].split()) < len(texts[1].split()) - 45
    assert paragraphs.spans(docs(spark_, [])).count() == 0


def test_large_buckets_lose_no_near_copy(spark_, monkeypatch):
    monkeypatch.setattr(paragraphs, "FEW", 4)
    rng = random.Random(1)
    core = [f"Core{k}" if k % 9 == 0 else f"core{k}" for k in range(60)]
    texts, pairs = [], []
    for g in range(30):
        own = [f"own{g}x{k}" for k in range(60)]
        a = own[:30] + core + own[30:]
        b = list(a)
        b[rng.randrange(20)] = "edit"
        pairs.append((2 * g, 2 * g + 1))
        texts += [" ".join(a).lower(), " ".join(b).lower()]
    links = paragraphs._links(docs(spark_, texts).select("doc_id", "text"), 50, 0.7)
    found = {tuple(sorted((r.a, r.b))) for r in links.collect()}
    name = {}
    for i, t in enumerate(texts):
        p = paragraphs.Pieces(pa.array([t]), 50)
        name[i] = int(p.hash[p.kind == paragraphs.LINE].view(np.int64)[0])
    assert {tuple(sorted((name[a], name[b]))) for a, b in pairs} <= found


def joined(pairs, n):
    label = np.arange(n)
    for a, b in pairs:
        if label[a] != label[b]:
            label[label == max(label[a], label[b])] = min(label[a], label[b])
    return label.tolist()


def test_groups_of_varied_copies_stay_whole_in_large_buckets(spark_):
    rng = random.Random(7)
    texts = []
    for _ in range(1000):
        t = [f"w{k}" for k in range(120)]
        for k in rng.sample(range(120), rng.randint(1, 4)):
            t[k] = f"edit{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    p = paragraphs.Pieces(pa.array(texts), 50)
    lines = np.flatnonzero(p.kind == paragraphs.LINE)
    sets = [p.grams(k) for k in lines]
    keys = paragraphs.bands(sets)
    near, colliding = set(), set()
    where = collections.defaultdict(list)
    for a, row in enumerate(sets):
        for x in row:
            where[int(x)].append(a)
    for a, row in enumerate(sets):
        for b, both in collections.Counter(b for x in row for b in where[int(x)] if b < a).items():
            if both >= 0.8 * (len(row) + len(sets[b]) - both):
                near.add((a, b))
                if (keys[a] == keys[b]).any():
                    colliding.add((a, b))
    assert max(collections.Counter(keys.ravel().tolist()).values()) > paragraphs.FEW
    name = {int(p.hash[k].view(np.int64)): a for a, k in enumerate(lines)}
    got = set()
    for r in paragraphs._links(docs(spark_, texts).select("doc_id", "text"), 50, 0.8).collect():
        got.add((max(name[r.a], name[r.b]), min(name[r.a], name[r.b])))
    label = joined(got, len(sets))
    assert got <= near and all(label[a] == label[b] for a, b in colliding)


def test_every_word_lies_in_a_banded_paragraph_and_wrapped_copies_collide():
    rng = random.Random(3)
    texts = ["\n".join(" ".join(f"w{rng.randrange(999)}" for _ in range(rng.randint(0, 70))) for _ in range(rng.randint(1, 12))) for _ in range(200)]
    p = paragraphs.Pieces(pa.array([*texts, None, "", "one line"]), 50)
    covered = np.zeros(p.firsts[-1], bool)
    for a, b, row in zip(p.a, p.b, p.row):
        assert p.firsts[row] <= a and b <= p.firsts[row + 1] and b - a >= 50
    for k in np.flatnonzero(p.kind == paragraphs.LINE):
        covered[p.a[k] : p.b[k]] = True
    for row, n in enumerate(np.diff(p.firsts)):
        assert covered[p.firsts[row] : p.firsts[row + 1]].all() if n >= 50 else not covered[p.firsts[row] : p.firsts[row + 1]].any()
    wrapped = [[f"a{k}" for k in range(80)] for _ in range(2)]
    wrapped[1][41] = "changed"
    p = paragraphs.Pieces(pa.array(["\n".join(" ".join(w[k : k + 10]) for k in range(0, 80, 10)) for w in wrapped]), 50)
    keys = [{tuple(x) for x in enumerate(paragraphs.bands([p.grams(k)])[0])} for k in np.flatnonzero(p.kind == paragraphs.LINE)]
    rows = p.row[p.kind == paragraphs.LINE]
    assert set.union(*[k for k, r in zip(keys, rows) if r == 0]) & set.union(*[k for k, r in zip(keys, rows) if r == 1])


def runs_by_brute_force(texts, words):
    """Bytes of each (doc, removed) that repeated runs of words cover."""
    places = {}
    for i, t in enumerate(texts):
        found = [(m.start(), m.end(), m[0]) for m in WORD.finditer(t or "")]
        for k in range(len(found) - words + 1):
            places.setdefault(tuple(w for _, _, w in found[k : k + words]), []).append((i, found[k][0], found[k + words - 1][1]))
    out = collections.defaultdict(set)
    for own in places.values():
        doc, begin, end = own[0]
        for i, x, z in own if len(own) > 1 else ():
            out[i, (i, x) != (doc, begin)] |= set(range(max(x, end) if i == doc and x != begin else x, z))
    return {k: v for k, v in out.items() if v}


def repeating_texts(seed, n):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(60)}" for _ in range(rng.randint(60, 200))] for _ in range(8)]
    texts = []
    for _ in range(n):
        t = []
        for _ in range(rng.randint(1, 4)):
            b = rng.choice(base)
            x = rng.randrange(len(b) - 12)
            t += b[x : x + rng.randint(5, 80)] + [f"u{rng.randrange(10**6)}" for _ in range(rng.randint(0, 6))]
        texts.append(rng.choice([" ", "\n", "  "]).join(t))
    return [*texts, "la " * 90, "x " * 300 + "y" * 400 + " " + "z " * 60, "", None, "a b c"]


@pytest.mark.parametrize("hot", [paragraphs.HOT, 3])
def test_repeated_runs_equal_brute_force(spark_, monkeypatch, hot):
    monkeypatch.setattr(paragraphs, "HOT", hot)
    texts = repeating_texts(5, 60)
    scratch = Scratch(spark_)
    got = collections.defaultdict(set)
    rows = docs(spark_, texts + texts[:1], [*range(len(texts)), 0])  # a repeated row is one document
    for r in paragraphs._merged(paragraphs._passages(paragraphs._texts(rows), 12, scratch)).collect():
        got[r.doc_id, r.removed] |= set(range(r.begin, r.end))
    assert got == runs_by_brute_force(texts, 12)


def test_bands_follow_the_threshold():
    for jaccard in (0.5, 0.6, 0.7, 0.8, 0.9, 0.95):
        bands, rows = paragraphs.tuning(jaccard)
        assert 1 - (1 - jaccard**rows) ** bands >= 0.98 and bands * rows <= 128
    assert paragraphs.tuning(0.8) == (10, 5)
