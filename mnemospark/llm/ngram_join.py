"""N-gram Jaccard join: all pairs of documents whose 5-word shingle sets reach a Jaccard of 0.9.

T-occurrence search: a partner of a document must occur in at least T of the inverted lists of its
shingles. As DivideSkip does, the lists are divided in short and long ones (L). The short ones are merged: equal
entries meet in a join on the shingle and are counted a pair, and only pairs with T - L hits or more go on (L: of the
one of the two with more long lists; T follows from both sizes). The long lists are never read through: whether
list(shingle) holds a candidate is asked by binary search, in the candidate's own sorted shingles, as long as the
required overlap can still be reached. Entries that no other list entry can meet are dropped before the join.

The order that makes lists short or long is any total order of shingles; here hot shingles, which
stand in the leading parts of more than ``HOT`` sets, come last, and the rest is ordered by hash. So a
passage that a third of all documents holds is never joined on, unless a document has hardly
anything else. Copies are folded first: only distinct sets, one document for each, are searched.

Cases: a null or empty text, or one without words, has an empty set and no links. With fewer words
than the width, the whole sequence is the one shingle. Rows that repeat a doc_id with an equal text
count as one document; each row is returned. Of different texts under one doc_id, the one whose set has the smallest
key stands for the document. Rows with a null doc_id come back without links and
component. An empty table gives no rows. Other columns, whatever their names, are ignored (kept by ``keep_one``).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan
from .graph import components
from .shared import Bitmap, Scratch, fresh, lean, maybe_in, release, slices

WIDTH = 5
HOT = 100
#: Most documents of one side of a tile, in which pairs are verified.
TILE = 256
#: A pair is linked if 100 * intersection >= PERCENT * union.
PERCENT = 90


def prefix(n: int, percent: int = PERCENT) -> int:
    """How many short lists a set of n needs against partners of any size."""
    return n - (percent * n + 99) // 100 + 1 if n else 0


def required(n, m, percent: int = PERCENT):
    """The overlap that sets of n and m need."""
    return (percent * (n + m) + 99 + percent) // (100 + percent)


def shingles(text: pa.Array, width: int = WIDTH):
    """For each row, the sorted distinct 64-bit hashes of its shingles."""
    for at, count in slices(text):
        data, offsets = bytescan.utf8(text.slice(at, count))
        data = bytescan.LOWER[data]
        starts, ends, firsts = bytescan.words(data, offsets)
        hashes = bytescan.word_hashes(data, starts, ends)
        runs, first = bytescan.windows(hashes, firsts, width)
        for k in range(count):
            if first[k + 1] > first[k]:
                yield np.unique(runs[first[k] : first[k + 1]])
            elif firsts[k + 1] > firsts[k]:
                own = hashes[firsts[k] : firsts[k + 1]]
                yield np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(x) for x in arrays], out=offsets[1:])
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _sets(docs: DataFrame, width: int, percent: int, whole: bool) -> DataFrame:
    """doc_id, n, key (of the whole set), tokens: the whole sorted set or its leading part."""

    def make(batches):
        for b in batches:
            n, keys, tokens = [], [], []
            for s in shingles(b.column(1), width):
                p = prefix(len(s), percent)
                n.append(len(s))
                keys.append(_key(s))
                tokens.append(s if whole else s[: p + p // 4 + 8])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), pa.array(keys, pa.binary()), _lists(tokens)], names=["doc_id", "n", "key", "tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(make), "doc_id long, n int, key binary, tokens array<long>")


def _short_lists(rows: DataFrame, hot: Bitmap, percent: int) -> DataFrame:
    """doc_id, n, prefix: the shingles of the short lists of each set, in order; null where what is known of the set
    (tokens) doesn't hold enough that aren't hot."""

    def choose(batches):
        for b in batches:
            tokens = b.column("tokens")
            values, offsets = np.asarray(tokens.values).view(np.uint64), np.asarray(tokens.offsets)
            late = hot(values)
            out, known = [], []
            for n, x, z in zip(b.column("n").to_numpy(), offsets, offsets[1:]):
                p, own, last = prefix(int(n), percent), values[x:z], late[x:z]
                rare = own[~last]
                known.append(len(rare) >= p or z - x == n)
                out.append(np.concatenate([rare, own[last]])[:p] if known[-1] else own[:0])
            lists = _lists(out)
            lists = pa.ListArray.from_arrays(lists.offsets, lists.values, mask=pa.array(~np.array(known, bool)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n"), lists], names=["doc_id", "n", "prefix"])

    return rows.select("doc_id", "n", "tokens").mapInArrow(lean(choose), "doc_id long, n int, prefix array<long>")


def _entries(lists: DataFrame, met: Bitmap) -> DataFrame:
    """token, doc_id, n, pos: list entries that another one may meet."""

    def explode(batches):
        for b in batches:
            lists = b.column("prefix")
            values, offsets = np.asarray(lists.values), np.asarray(lists.offsets)
            size = np.diff(offsets)
            pos = np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], size)
            values = values[offsets[0] : offsets[-1]]
            keep = met(values)
            columns = [values, np.repeat(b.column("doc_id").to_numpy(), size), np.repeat(b.column("n").to_numpy(), size), pos.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], names=["token", "doc_id", "n", "pos"])

    return lists.mapInArrow(lean(explode), "token long, doc_id long, n int, pos int")


def _candidates(reps: DataFrame, texts: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs a, b of representatives with enough hits on their short lists."""
    counts = reps.select(F.explode("tokens").alias("token")).groupBy("token").count().filter("count > 1")
    counts = scratch.table("counts", counts)
    # Any fixed set of shingles may count as hot, so a bitmap decides.
    hot = Bitmap(counts.filter(F.col("count") > HOT).select("token"))
    known = scratch.table("prefixes", _short_lists(reps, hot, percent))
    # Documents whose leading part is mostly hot: all their shingles are needed to find rare ones.
    short = known.filter("prefix is null").select("doc_id")
    full = _sets(maybe_in(texts, "doc_id", short).join(short, "doc_id", "left_semi"), width, percent, True)
    full = full.groupBy("doc_id").agg(F.min(F.struct("key", "n", "tokens")).alias("x")).select("doc_id", "x.n", "x.tokens")
    rest = scratch.table("rest", _short_lists(full, hot, percent))
    met = Bitmap(counts.select("token").union(rest.select(F.explode("prefix"))))
    entries = scratch.table("entries", _entries(known.filter("prefix is not null").unionByName(rest), met))
    scratch.drop("counts", "prefixes", "rest")
    left = entries.select("token", F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"))
    right = entries.select("token", F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"))
    need = F.expr(f"({percent} * (bigint(na) + nb) + {99 + percent}) div {100 + percent}")
    fits = ((F.col("na") < F.col("nb")) | (F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))) & (F.col("na") * 100 >= F.col("nb") * percent) & (F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= need - F.least("pa", "pb"))
    hits = left.join(right.hint("merge"), "token").filter(fits).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("hits"))
    # Of the smaller set, fewer lists are long.
    long = F.expr(f"({percent} * bigint(nb) + 99) div 100 - 1")
    return hits.filter(F.col("hits") >= need - long).select("a", "b")


def overlap_at_least(a: np.ndarray, b: np.ndarray, need: int) -> bool:
    """Whether sorted sets a and b share `need` members: blocks of a are probed in b by binary search
    until that is reached or out of reach."""
    got, at = 0, 0
    while at < len(a):
        block = a[at : at + max(64, need - got)]
        found = np.searchsorted(b, block)
        found[found == len(b)] = 0
        got += int(np.count_nonzero(b[found] == block))
        at += len(block)
        if got >= need:
            return True
        if got + len(a) - at < need:
            return False
    return got >= need


def _tiles(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs with the tile in which they are verified.

    Pairs are gathered by the smallest document near to both, which in a group of near copies is
    nearly always the same one; so a set is sent to few tiles, not to each of its pairs. A group of
    more than TILE documents is split into blocks, and each pair of blocks is a tile of its own.
    """
    ends = pairs.select("a", "b").union(pairs.select(F.col("b"), F.col("a")))
    near = ends.groupBy("a").agg(F.least("a", F.min("b")).alias("near"))
    keyed = pairs.select("a", "b").join(near.withColumnRenamed("near", "x").hint("merge"), "a").join(near.select(F.col("a").alias("b"), F.col("near").alias("y")).hint("merge"), "b")
    keyed = scratch.table("keyed", keyed.select("a", "b", F.least("x", "y").alias("group")))
    blocks = keyed.select("group", "a").union(keyed.select("group", "b")).distinct().groupBy("group").agg(F.ceil(F.count("*") / TILE).alias("blocks"))
    x, y = (F.pmod(F.xxhash64(c), F.col("blocks")) for c in ("a", "b"))
    tiled = scratch.table("tiles", keyed.join(blocks.hint("merge"), "group").select("a", "b", F.xxhash64("group", F.least(x, y), F.greatest(x, y)).alias("tile")))
    scratch.drop("keyed")
    return tiled


def _key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs a, b that reach the threshold."""
    tiled = _tiles(pairs, scratch)
    needs = tiled.select("tile", F.col("a").alias("doc_id")).union(tiled.select("tile", "b")).distinct()
    needs = scratch.table("needs", needs)
    release(scratch.spark)
    some = maybe_in(texts, "doc_id", needs.select("doc_id").distinct()).join(needs.hint("merge"), "doc_id").select("doc_id", "text", "tile")

    def sets(batches):
        for b in batches:
            found = list(shingles(b.column(1), width))
            none = pa.nulls(b.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(0), none, _lists(found)], names=["tile", "a", "b", "tokens"])

    shape = "tile long, a long, b long, tokens array<long>"
    stream = some.mapInArrow(lean(sets), shape).unionByName(tiled.select("tile", "a", "b", F.lit(None).cast("array<long>").alias("tokens")))

    def check(batches):
        held: dict[int, np.ndarray] = {}
        now = None
        for x in batches:
            tokens = x.column("tokens")
            values, offsets = np.asarray(tokens.values).view(np.uint64), np.asarray(tokens.offsets)
            out = []
            for k, (tile, a, b) in enumerate(zip(x.column("tile").to_pylist(), x.column("a").to_pylist(), x.column("b").to_pylist())):
                if tile != now:
                    now, held = tile, {}
                if b is None:
                    own = values[offsets[k] : offsets[k + 1]].copy()
                    held[a] = own if a not in held else min(held[a], own, key=_key)
                elif overlap_at_least(held[a], held[b], int(required(len(held[a]), len(held[b]), percent))):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    # In a tile, the sets (b is null, and sorts first) come before the pairs.
    return stream.repartition("tile").sortWithinPartitions("tile", F.col("b").asc_nulls_first()).mapInArrow(lean(check), "a long, b long")


def links(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """sets (doc_id, n, key), classes (key, rep, members) and links (a, b: representatives)."""
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = scratch.table("leading", _sets(texts, width, percent, False))
    once = sets.filter("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("key").alias("key"))
    classes = scratch.table("classes", once.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("members")))
    reps = sets.join(classes.select(F.col("rep").alias("doc_id"), "key").hint("merge"), ["doc_id", "key"], "left_semi").select("doc_id", "n", "tokens").dropDuplicates(["doc_id"])
    reps = scratch.table("reps", reps)
    slim = scratch.table("sets", sets.select("doc_id", "n", "key"))
    scratch.drop("leading")
    pairs = scratch.table("candidates", _candidates(reps, texts, width, percent, scratch))
    scratch.drop("reps", "entries")
    linked = scratch.table("links", _verified(pairs, texts, width, percent, scratch))
    scratch.drop("candidates", "tiles", "needs")
    return slim, classes, linked


def near_copies(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, n_similar, component_id, class_id: one row for each row of docs."""
    spark = docs.sparkSession
    sets, classes, linked = links(docs, width, percent)
    label = components(linked)
    size = classes.select(F.col("rep").alias("b"), "members")
    ends = linked.select("a", "b").union(linked.select(F.col("b"), F.col("a")))
    others = ends.join(size, "b").groupBy(F.col("a").alias("rep")).agg(F.sum("members").alias("others"))
    info = classes.join(others, "rep", "left").join(label.withColumnRenamed("node", "rep"), "rep", "left")
    info = info.select("key", F.col("rep").alias("class_id"), (F.col("members") - 1 + F.coalesce("others", F.lit(0))).alias("n_similar"), F.coalesce("label", "rep").alias("component_id"))
    live = F.col("doc_id").isNotNull()
    return sets.join(info, "key", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(live, F.coalesce("n_similar", F.lit(0))).otherwise(0).cast("long").alias("n_similar"),
        F.when(live, F.coalesce("component_id", "doc_id")).alias("component_id"), F.when(live, F.coalesce("class_id", "doc_id")).alias("class_id"),
    )


def keep_one(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each group of near copies: that with the smallest doc_id. Rows that repeat
    a doc_id are one document; one row of it stays. Rows with a null doc_id stay."""
    scratch = Scratch(docs.sparkSession)
    found = scratch.table("near-copies", near_copies(docs, width, percent).select("doc_id", "component_id"))
    gone_, again_ = fresh(docs, "gone"), fresh(docs, "again")
    gone = scratch.table("gone", found.filter("doc_id != component_id").select(F.col("doc_id").alias(gone_)).distinct())
    again = found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias(again_))
    again = scratch.table("again", again)
    scratch.drop("near-copies")
    doc_id = docs["doc_id"].cast("long")
    kept = docs.join(gone, doc_id == F.col(gone_), "left_anti")
    if again.isEmpty():
        return kept
    once = kept.join(again, doc_id == F.col(again_), "left_semi").dropDuplicates(["doc_id"])
    return kept.join(again, doc_id == F.col(again_), "left_anti").unionByName(once)
