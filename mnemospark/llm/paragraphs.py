"""Substring deduplication: repeated passages and near copies of paragraphs, across documents.

Near copies. Paragraphs are lines of `words` words and more, and groups of adjoining shorter lines, which end after a
line that its own content chooses (so that copies are grouped alike). A group of fewer than `words` words is joined with
its neighbours until that is reached, besides; so every word of a text of `words` words lies in a paragraph. MinHash
signatures of their word triples are cut into bands, tuned by `tuning` for a chance of 98 % and more that a pair at the
threshold collides. Colliding paragraphs are joined and verified by exact Jaccard: the pairs of a bucket of at most FEW
members are gathered in tiles; a larger bucket is split into blocks of about BLOCK triples, and each pair of
blocks is a tile. In a tile every pair is compared, unless links found in it already connect its ends; so the
classes, which are the connected components, are those of all colliding pairs, at every size of a bucket. Of a
class, the paragraphs in the smallest doc_id are kept and all others removed.

Exact passages. Every run of `words` words that occurs twice is found, wherever it begins. Each run has an anchor, the
smallest hash of the shorter runs inside of it (winnowing), so that equal runs have equal anchors and neighbouring runs
mostly share theirs. Anchors are counted; where one occurs again, the runs around it are sent, a row an anchor, to the
task of that anchor, which keeps the first place of each run in the smallest doc_id. Overlapping runs are merged, so a
passage of any length from `words` words is found to the word. An anchor of more than HOT rows isn't gathered in a task:
its runs are aggregated one by one instead.

Cases: null and empty texts, and texts of fewer than `words` words, have no piece. Repeated rows (equal
doc_id) count as one document. Rows with a null doc_id take no part. White space doesn't matter inside of a run of words,
capital letters do. In a document, a run's first place is kept and what later places add is removed. An
empty table gives no rows. Other columns, whatever their names, are ignored by `spans` and kept by `remove`.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan
from .graph import components
from .ngram_join import _tiles as near_tiles
from .shared import Bitmap, Scratch, fresh, lean, maybe_in, release, slices

WORDS, JACCARD = 50, 0.8
MOST_BANDS, CHANCE = 10, 0.98
#: Most members of a bucket whose pairs are listed; larger ones are compared block by block.
FEW = 256
#: About as many triples are in a block of a large bucket; a task holds two blocks.
BLOCK = 1 << 18
#: Most rows of an anchor that a task gathers.
HOT = 1 << 16
#: A group of short lines ends after a line whose hash is divisible by this.
CUT = 8
LINE = 0
#: Bits of a position in a batch, below the bits of a hash that decide about the smallest one.
PLACE_BITS = 24
_rng = np.random.default_rng(4711)
_MULTIPLIERS = _rng.integers(1, 2**63, 128, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADDENDS = _rng.integers(0, 2**63, 128, dtype=np.uint64)


def tuning(jaccard: float) -> tuple[int, int]:
    """Bands and rows a band: as many rows as MOST_BANDS bands allow for a chance of CHANCE at the threshold."""
    best = 1, 1
    for rows in range(1, 128 // MOST_BANDS + 1):
        same = jaccard**rows
        count = 1 if same > CHANCE else math.ceil(math.log(1 - CHANCE) / math.log(1 - same))
        if count <= MOST_BANDS or rows == 1:
            best = min(count, 128), rows
    return best


class Words:
    """The words of a batch of texts."""

    def __init__(self, text: pa.Array):
        self.data, self.offsets = bytescan.utf8(text)
        self.starts, self.ends, self.firsts = bytescan.words(self.data, self.offsets)
        self.n = len(self.starts)
        self.hashes = bytescan.word_hashes(self.data, self.starts, self.ends)
        up, self.down = bytescan.POWERS.upto(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(self.hashes * up[: self.n], out=self.sums[1:])

    def digest(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of the words from a to b."""
        return bytescan.mix((self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(np.uint64))

    def span(self, a: np.ndarray, b: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte of word a and the byte after word b - 1, from the begin of the text."""
        base = self.offsets[row]
        return self.starts[a] - base, self.ends[b - 1] - base


class Pieces(Words):
    """Paragraphs of a batch of texts, as spans a, b of words; row: the text's place in the batch; place: the same for
    paragraphs that overlap, otherwise not, inside a text."""

    def __init__(self, text: pa.Array, least: int):
        super().__init__(text)
        n = self.n
        if not n:
            self.a = self.b = self.row = self.place = np.zeros(0, np.int64)
            self.hash, self.kind = np.zeros(0, np.uint64), np.zeros(0, np.int8)
            return
        breaks = np.concatenate([[0], np.cumsum(self.data == 10)])
        line = np.zeros(n + 1, bool)
        line[self.firsts] = True
        first = line.copy()
        line[1:n] |= breaks[self.starts[1:]] > breaks[self.ends[:-1]]
        a = np.flatnonzero(line[:n])
        b = np.append(a[1:], n)
        long = b - a >= least
        cut = first[a] | long
        cut[1:] |= long[:-1] | (self.digest(a, b)[:-1] % np.uint64(CUT) == 0)
        group = a[cut]
        every = np.append(group, n)
        number = np.arange(len(group))
        big = np.diff(every) >= least
        # Small groups with those after them; at the end of a text, with those before.
        row_end = np.repeat(self.firsts[1:], np.diff(self.firsts))[group[~big]]
        row_start = np.repeat(self.firsts[:-1], np.diff(self.firsts))[group[~big]]
        to = np.minimum(np.searchsorted(every, group[~big] + least), len(every) - 1)
        fits = (every[to] <= row_end) & (every[to] - group[~big] >= least)
        since = np.maximum(np.searchsorted(every, row_end[~fits] - least, "right") - 1, 0)
        back = (every[since] >= row_start[~fits]) & (row_end[~fits] - every[since] >= least)
        self.a = np.concatenate([group[big], group[~big][fits], every[since][back]])
        self.b = np.concatenate([every[1:][big], every[to][fits], row_end[~fits][back]])
        self.place = np.concatenate([number[big], to[fits] - 1, since[back]])
        self.kind = np.full(len(self.a), LINE, np.int8)
        self.hash = self.digest(self.a, self.b)
        self.row = np.searchsorted(self.firsts, self.a, "right") - 1
        self.place = self.place - np.searchsorted(group, self.firsts[self.row])
        self.triples = bytescan.mix((self.hashes[:-2] * np.uint64(3) + self.hashes[1:-1]) * np.uint64(5) + self.hashes[2:])

    def grams(self, k: int) -> np.ndarray:
        """Sorted distinct hashes of the word triples of piece k."""
        a, b = self.a[k], self.b[k]
        return np.unique(self.triples[a : b - 2]) if b - a > 2 else np.unique(self.hashes[a:b])


class Runs(Words):
    """All runs of `words` words of a batch of texts, by anchor: runs from `low` to `high` have the anchor with hash `mark`."""

    def __init__(self, text: pa.Array, words: int):
        super().__init__(text)
        self.words = words
        size = max(1, words // 3)
        span = words - size + 1
        self.low = self.high = self.row = np.zeros(0, np.int64)
        self.mark = np.zeros(0, np.uint64)
        if self.n < words:
            return
        at = np.arange(self.n - size + 1)
        marks = self.digest(at, at + size)
        bits = np.uint64(max(PLACE_BITS, self.n.bit_length()))
        low = marks >> bits << bits | at.astype(np.uint64)
        width = 1
        while 2 * width <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < span:
            low = np.minimum(low[: self.n - words + 1], low[span - width :])
        place = (low & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
        count = np.maximum(np.diff(self.firsts) - words + 1, 0)
        run = np.repeat(self.firsts[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        if not len(run):
            return
        row = np.repeat(np.arange(len(count)), count)
        new = np.ones(len(run), bool)
        new[1:] = (place[run[1:]] != place[run[:-1]]) | (row[1:] != row[:-1])
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(run)) - 1
        self.low, self.high, self.row = run[begin], run[end] + 1, row[begin]
        self.mark = marks[place[self.low]]

    def rows(self, keep: np.ndarray):
        """For the chosen anchors: begin and end of the first run (packed), hashes of the runs, steps of begins and ends."""
        low, high, row = self.low[keep], self.high[keep], self.row[keep]
        count = high - low
        ends = np.cumsum(count)
        run = np.repeat(low - (ends - count), count) + np.arange(ends[-1])
        hashes = self.digest(run, run + self.words)
        begin, end = self.span(run, run + self.words, np.repeat(row, count))
        first = ends - count
        steps = np.zeros((len(run), 2), np.int64)
        steps[1:, 0], steps[1:, 1] = np.diff(begin), np.diff(end)
        steps[first] = 0
        wide = np.maximum.reduceat(steps.max(axis=1), first) > 255
        if wide.any():
            packed = pa.array([steps[x:z].astype("<i4" if w else np.uint8).tobytes() for x, z, w in zip(first, ends, wide)], pa.binary())
        else:
            packed = _binary(steps.astype(np.uint8), np.append(first, ends[-1]) * 2)
        return begin[first] << 32 | end[first], _binary(hashes, np.append(first, ends[-1]) * 8), packed


def _binary(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def bands(sets: list[np.ndarray], jaccard: float = JACCARD) -> np.ndarray:
    """A row of bucket keys for each set, one for each band."""
    count, rows = tuning(jaccard)
    if not sets:
        return np.zeros((0, count), np.uint64)
    cut = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    values = np.concatenate(sets)
    out = np.zeros((len(sets), count), np.uint64)
    for k in range(count * rows):
        low = np.minimum.reduceat(values * _MULTIPLIERS[k] + _ADDENDS[k], cut)
        band = k // rows
        out[:, band] = bytescan.mix(out[:, band] * np.uint64(31) + low + np.uint64(band))
    return out


def _scan(docs: DataFrame, schema: str, make) -> DataFrame:
    """Runs make(doc ids, texts) over all texts; it gives columns, or None."""

    def run(batches):
        for b in batches:
            for at, n in slices(b.column(1)):
                if (out := make(b.column(0).slice(at, n).to_numpy(), b.column(1).slice(at, n))) is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(x) if not isinstance(x, pa.Array) else x for x in out], names=names)

    names = [x.split()[0] for x in schema.split(", ")]
    return docs.mapInArrow(lean(run), schema)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")


# Near copies of paragraphs


def _reps(texts: DataFrame, least: int) -> DataFrame:
    """hash, doc: each paragraph and the smallest doc_id that holds it."""

    def make(ids, text):
        p = Pieces(text, least)
        hashes, once = np.unique(p.hash, return_index=True)
        return (hashes.view(np.int64), ids[p.row[once]]) if len(once) else None

    return _scan(texts, "hash long, doc long", make).groupBy("hash").agg(F.min("doc").alias("doc"))


def _colliding(texts: DataFrame, reps: DataFrame, least: int, jaccard: float) -> DataFrame:
    """Pairs a, b of paragraphs that share a bucket of at most FEW (large is false); buckets a and members b of larger ones.

    A bucket streams through one task, sorted; no more than FEW members are held.
    """
    wanted = Bitmap(reps.select(F.col("hash").bitwiseXOR(F.col("doc"))))

    def keys(ids, text):
        p = Pieces(text, least)
        chosen = np.flatnonzero(wanted(p.hash.view(np.int64) ^ ids[p.row]))
        _, once = np.unique(p.hash[chosen], return_index=True)
        chosen = chosen[once]
        if not len(chosen):
            return None
        found = bands([p.grams(k) for k in chosen], jaccard)
        place = bytescan.mix(bytescan.mix(ids[p.row[chosen]].astype(np.uint64)) + p.place[chosen].astype(np.uint64)).view(np.int64)
        times = found.shape[1]
        return found.ravel().view(np.int64), np.repeat(p.hash[chosen].view(np.int64), times), np.repeat(place, times)

    few = FEW

    def collide(batches):
        held = [np.zeros(0, np.int64)] * 3  # of the last bucket met
        large = None

        def out(kind, a, b):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind)), pa.array(a), pa.array(b)], names=["large", "a", "b"])

        def pairs(bucket, hash_, place):
            """Of whole buckets, sorted."""
            new = np.ones(len(bucket), bool)
            new[1:] = bucket[1:] != bucket[:-1]
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(bucket)))
            many = np.repeat(size > few, size)
            yield out(True, bucket[many], hash_[many])
            nth = np.arange(len(bucket)) - np.repeat(first, size)
            nth[many] = 0
            x = np.repeat(np.arange(len(bucket)), nth)
            y = np.repeat(np.arange(len(bucket)) - nth, nth) + np.arange(len(x)) - np.repeat(np.cumsum(nth) - nth, nth)
            good = place[x] != place[y]
            yield out(False, hash_[y[good]], hash_[x[good]])

        for b in batches:
            bucket, hash_, place = (np.concatenate([h, c.to_numpy()]) for h, c in zip(held, b.columns))
            new = np.ones(len(bucket), bool)
            new[1:] = (bucket[1:] != bucket[:-1]) | (hash_[1:] != hash_[:-1])
            bucket, hash_, place = bucket[new], hash_[new], place[new]
            if large is not None:
                rest = int(np.searchsorted(bucket, large, "right"))
                yield out(True, bucket[:rest], hash_[:rest])
                if rest == len(bucket):
                    held = [x[:0] for x in (bucket, hash_, place)]
                    continue
                bucket, hash_, place, large = bucket[rest:], hash_[rest:], place[rest:], None
            last = int(np.searchsorted(bucket, bucket[-1], "left")) if len(bucket) else 0
            yield from pairs(bucket[:last], hash_[:last], place[:last])
            held = [x[last:].copy() for x in (bucket, hash_, place)]
            if len(held[0]) > few:
                large = held[0][0]
                yield out(True, held[0], held[1])
                held = [x[:0] for x in held]
        if len(held[0]):
            yield from pairs(*held)

    rows = _scan(texts, "bucket long, hash long, place long", keys)
    return rows.repartition("bucket").sortWithinPartitions("bucket", "hash").mapInArrow(lean(collide), "large boolean, a long, b long")


def _links(texts: DataFrame, least: int, jaccard: float, reps: DataFrame | None = None) -> DataFrame:
    """Verified pairs a, b of different paragraphs; they connect what all colliding pairs that are near connect."""
    scratch = Scratch(texts.sparkSession)
    if reps is None:
        reps = scratch.table("reps", _reps(texts, least))
    met = scratch.table("met", _colliding(texts, reps, least, jaccard))
    release(scratch.spark)
    pairs = scratch.table("pairs", met.filter("not large").select("a", "b").distinct())
    many = met.filter("large").select(F.col("a").alias("bucket"), F.col("b").alias("hash"))
    involved = pairs.select(F.col("a").alias("hash")).union(pairs.select("b")).union(many.select("hash")).distinct()
    places = scratch.table("places", reps.join(involved.hint("merge"), "hash"))
    there = Bitmap(places.select(F.col("hash").bitwiseXOR(F.col("doc"))))

    def sets(ids, text):
        p = Pieces(text, least)
        chosen = np.flatnonzero(there(p.hash.view(np.int64) ^ ids[p.row]))
        _, once = np.unique(p.hash[chosen], return_index=True)
        chosen = chosen[once]
        found = [p.grams(k) for k in chosen]
        if not found:
            return None
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in found])]).astype(np.int32)
        return p.hash[chosen].view(np.int64), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found).view(np.int64)))

    sized = scratch.table("grams", _scan(texts, "hash long, grams array<long>", sets))
    # A set is sent once to each tile that holds pairs of it, not with each pair.
    tiled = near_tiles(pairs, scratch)
    needs = tiled.select("tile", F.col("a").alias("hash")).union(tiled.select("tile", "b")).distinct()
    good = _spanned(needs.join(sized.hint("merge"), "hash").select("tile", F.lit(0).alias("side"), "hash", "grams"), jaccard)
    if not many.isEmpty():
        good = good.unionByName(_tiled(many, sized, jaccard))
    good = scratch.table("links", good)
    scratch.drop(*(x for x in scratch.paths if x != "links"))
    return good


def _tiled(members: DataFrame, sized: DataFrame, jaccard: float) -> DataFrame:
    """Links a, b that connect what the near pairs of each bucket connect."""
    heavy = members.join(sized.select("hash", F.size("grams").alias("w")).hint("merge"), "hash").groupBy("bucket")
    heavy = heavy.agg(F.ceil(F.sum("w") / BLOCK).cast("int").alias("blocks"), F.bit_xor("hash").alias("x"), F.bit_xor(F.xxhash64("hash")).alias("y"))
    # Buckets of the same members, in several bands, are compared once.
    heavy = heavy.groupBy("blocks", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "blocks")
    own = members.join(heavy, "bucket").withColumn("own", F.pmod(F.xxhash64("hash"), F.col("blocks")).cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tile = F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))
    rows = own.select("hash", tile.alias("tile"), F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"))
    return _spanned(rows.join(sized.hint("merge"), "hash").select("tile", "side", "hash", "grams"), jaccard)


def _spanned(rows: DataFrame, jaccard: float) -> DataFrame:
    """Links a, b of `spanning`, tile by tile (columns tile, side, hash, grams)."""

    def check(batches):
        now, side, names, sets = None, [], [], []

        def links():
            found = spanning(sets, np.array(side), jaccard)
            ends = np.array(names, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ends[[x[k] for x in found]]) for k in (0, 1)], names=["a", "b"])

        for b in batches:
            grams = b.column("grams")
            values, offsets = np.asarray(grams.values), np.asarray(grams.offsets)
            for k, (t, s, h) in enumerate(zip(*(b.column(c).to_pylist() for c in ("tile", "side", "hash")))):
                if t != now:
                    if len(sets) > 1:
                        yield links()
                    now, side, names, sets = t, [], [], []
                elif names[-1] == h:  # from a repeated row of docs
                    continue
                side.append(s)
                names.append(h)
                sets.append(values[offsets[k] : offsets[k + 1]].copy())
        if len(sets) > 1:
            yield links()

    return rows.repartition("tile").sortWithinPartitions("tile", "hash").mapInArrow(lean(check), "a long, b long").distinct()


def spanning(sets: list[np.ndarray], side: np.ndarray, jaccard: float) -> list[tuple[int, int]]:
    """Near pairs that connect what all near pairs connect: those inside of side 0, or between sides 1 and 2."""
    cut = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    size = np.diff(cut)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(ids), bool)
    label = np.arange(len(sets))
    place = np.arange(len(sets))
    out = []
    for x in place[side != 2]:
        left = place[side == 2] if side[x] else place[:x]
        left = left[(label[left] != label[x]) & (np.minimum(size[left], size[x]) >= jaccard * np.maximum(size[left], size[x]))]
        mine = ids[cut[x] : cut[x + 1]]
        mark[mine] = True
        step = 16
        while len(left):
            part, left = left[:step], left[step:]
            step = min(4 * step, 4096)
            n = size[part]
            begin = np.cumsum(n) - n
            both = np.add.reduceat(mark[ids[np.repeat(cut[part] - begin, n) + np.arange(n.sum())]], begin, dtype=np.int64)
            for y in part[both >= jaccard * (size[x] + n - both)]:
                if label[y] != label[x]:
                    out.append((int(x), int(y)))
                    label[label == label[y]] = label[x]
            left = left[label[left] != label[x]]
        mark[mine] = False
    return out


SPAN = "doc_id long, removed boolean, begin int, end int, class_id long, kept_doc long"


def _near(texts: DataFrame, least: int, jaccard: float, scratch: Scratch) -> DataFrame:
    """SPAN of every paragraph of a class of near copies."""
    reps = scratch.table("reps", _reps(texts, least))
    links = _links(texts, least, jaccard, reps)
    label = components(links).select(F.col("node").alias("hash"), F.col("label").alias("class_id"))
    known = reps.join(label.hint("merge"), "hash")
    keeper = known.groupBy("class_id").agg(F.min("doc").alias("kept_doc"))
    classes = scratch.table("classes", known.join(keeper.hint("merge"), "class_id").select("hash", "class_id", "kept_doc"))
    scratch.drop("reps")
    wanted = Bitmap(classes.select("hash"))

    def places(ids, text):
        p = Pieces(text, least)
        keep = wanted(p.hash)
        if not keep.any():
            return None
        begin, end = p.span(p.a[keep], p.b[keep], p.row[keep])
        return p.hash[keep].view(np.int64), ids[p.row[keep]], begin.astype(np.int32), end.astype(np.int32)

    at = _scan(texts, "hash long, doc_id long, begin int, end int", places).join(classes.hint("merge"), "hash")
    return at.select("doc_id", (F.col("doc_id") != F.col("kept_doc")).alias("removed"), "begin", "end", "class_id", "kept_doc")


# Exact passages


def _passages(texts: DataFrame, words: int, scratch: Scratch) -> DataFrame:
    """SPAN of all runs of `words` words that occur twice, neighbouring ones merged in part."""

    def marks(ids, text):
        mark, n = np.unique(Runs(text, words).mark, return_counts=True)
        return (mark.view(np.int64), n) if len(mark) else None

    again = _scan(texts, "mark long, n long", marks).groupBy("mark").agg(F.sum("n").alias("n")).filter("n > 1")
    again = scratch.table("marks", again)
    release(scratch.spark)
    wanted = Bitmap(again.select("mark"))

    def anchored(ids, text):
        r = Runs(text, words)
        keep = np.flatnonzero(wanted(r.mark))
        return (r.mark[keep].view(np.int64), ids[r.row[keep]], *r.rows(keep)) if len(keep) else None

    # A mark that passes without being there twice meets no equal run, so no join is needed.
    rows = _scan(texts, "mark long, doc_id long, first long, hashes binary, steps binary", anchored)
    hot = again.filter(F.col("n") > HOT).select("mark")
    if hot.isEmpty():
        return _gathered(rows)
    hot = scratch.table("hot", hot)
    return _gathered(rows.join(hot, "mark", "left_anti")).unionByName(_aggregated(rows.join(hot, "mark", "left_semi")))


def _unpacked(b: pa.RecordBatch):
    """Of anchored rows: runs a row, hashes, begins and ends of all."""
    hashes = b.column("hashes").cast(pa.large_binary())
    count = pa.compute.binary_length(hashes).to_numpy() // 8
    ends = np.cumsum(count)
    first = ends - count
    data, offsets = bytescan.utf8(hashes)
    hash_ = np.frombuffer(data.tobytes(), np.int64)
    data, offsets = bytescan.utf8(b.column("steps"))
    wide = np.diff(offsets) != 2 * count
    if wide.any():
        steps = np.concatenate([data[x:z].view("<i4" if w else np.uint8).reshape(-1, 2).astype(np.int64) for x, z, w in zip(offsets, offsets[1:], wide)])
    else:
        steps = data.reshape(-1, 2).astype(np.int64)
    start = b.column("first").to_numpy()
    at = np.cumsum(steps, axis=0)
    at -= np.repeat(at[first], count, axis=0)
    return count, hash_, at[:, 0] + np.repeat(start >> 32, count), at[:, 1] + np.repeat(start & 0xFFFFFFFF, count)


def _span_batch(doc, removed, begin, end, class_id, kept) -> pa.RecordBatch:
    arrays = [pa.array(doc, pa.int64()), pa.array(removed, pa.bool_()), pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(class_id, pa.int64()), pa.array(kept, pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in SPAN.split(", ")])


def first_places(b: pa.RecordBatch) -> pa.RecordBatch:
    """SPAN of the runs that occur twice in b, which holds all rows of its anchors."""
    count, hash_, begin, end = _unpacked(b)
    row = np.repeat(np.arange(len(count)), count)
    doc = b.column("doc_id").to_numpy()[row]
    order = np.lexsort((begin, doc, hash_))
    new = np.ones(len(order), bool)
    new[1:] = hash_[order[1:]] != hash_[order[:-1]]
    group = np.cumsum(new) - 1
    low = order[new]
    high = order[np.append(np.flatnonzero(new)[1:], len(order)) - 1]
    twice = (doc[low] != doc[high]) | (begin[low] != begin[high])
    head = np.zeros(len(order), np.int64)
    head[order] = low[group]
    found = np.zeros(len(order), bool)
    found[order] = twice[group]
    kept = doc[head]
    own = doc == kept
    removed = ~own | (begin != begin[head])
    begin = np.where(own & removed, np.maximum(begin, end[head]), begin)  # the first place stays whole
    at = np.flatnonzero(found)
    if not len(at):
        return _span_batch(*[np.zeros(0, np.int64)] * 6)
    cut = np.ones(len(at), bool)
    x, y = at[1:], at[:-1]
    cut[1:] = (row[x] != row[y]) | (x != y + 1) | (removed[x] != removed[y]) | (kept[x] != kept[y])
    cut = np.flatnonzero(cut)
    head = at[cut]
    return _span_batch(doc[head], removed[head], np.minimum.reduceat(begin[at], cut), np.maximum.reduceat(end[at], cut), np.minimum.reduceat(hash_[at], cut), kept[head])


def _gathered(rows: DataFrame) -> DataFrame:
    def check(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            mark = b.column("mark").to_numpy()
            if not len(mark):
                continue
            cut = int(np.searchsorted(mark, mark[-1], "left"))
            if cut:
                yield first_places(pa.concat_batches([*held, b.slice(0, cut)]))
                held = []
            held.append(b.slice(cut))
        if held:
            yield first_places(pa.concat_batches(held))

    return rows.repartition("mark").sortWithinPartitions("mark").mapInArrow(lean(check), SPAN)


def _aggregated(rows: DataFrame) -> DataFrame:
    """The same for anchors of any number of rows, run by run; copies are aggregated before they are shuffled."""

    def explode(batches):
        for b in batches:
            count, hash_, begin, end = _unpacked(b)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (hash_, np.repeat(b.column("doc_id").to_numpy(), count), begin, end)], names=["run", "doc_id", "begin", "end"])

    runs = rows.mapInArrow(lean(explode), "run long, doc_id long, begin long, end long")
    heads = runs.groupBy("run").agg(F.min(F.struct("doc_id", "begin", "end")).alias("low"), F.max(F.struct("doc_id", "begin")).alias("high"))
    heads = heads.filter("low.doc_id != high.doc_id or low.begin != high.begin").select("run", F.col("low.doc_id").alias("kept_doc"), F.col("low.begin").alias("b"), F.col("low.end").alias("e"))
    own = F.col("doc_id") == F.col("kept_doc")
    removed = ~own | (F.col("begin") != F.col("b"))
    begin = F.when(own & removed, F.greatest("begin", "e")).otherwise(F.col("begin"))
    return runs.join(heads, "run").select("doc_id", removed.alias("removed"), begin.cast("int").alias("begin"), F.col("end").cast("int").alias("end"), F.col("run").alias("class_id"), "kept_doc")


# Both


def _merged(rows: DataFrame) -> DataFrame:
    """Overlapping stretches of a document merged, removed and kept ones apart; a document's own rows only are sorted together."""

    def merge(batches):
        held = None

        def segments(b: pa.RecordBatch) -> pa.RecordBatch:
            """Of sorted rows; the last segment is last."""
            doc, removed, begin, end, class_id, kept = (b.column(k).to_numpy(zero_copy_only=False) for k in range(6))
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (removed[1:] != removed[:-1])
            group = np.cumsum(new) - 1
            reach = np.maximum.accumulate(group << 32 | end.astype(np.int64)) & 0xFFFFFFFF
            new[1:] |= begin[1:] > reach[:-1]
            cut = np.flatnonzero(new)
            return _span_batch(doc[cut], removed[cut], begin[cut], np.maximum.reduceat(end, cut), np.minimum.reduceat(class_id, cut), np.minimum.reduceat(kept, cut))

        for b in batches:
            if b.num_rows:
                out = segments(pa.concat_batches([held, b]) if held is not None else b)
                yield out.slice(0, out.num_rows - 1)
                held = out.slice(out.num_rows - 1)
        if held is not None:
            yield held

    merged = rows.repartition("doc_id").sortWithinPartitions("doc_id", "removed", "begin", "end").mapInArrow(lean(merge), SPAN)
    return merged.select("doc_id", "begin", "end", "class_id", "kept_doc", "removed")


def spans(docs: DataFrame, words: int = WORDS, jaccard: float = JACCARD) -> DataFrame:
    """doc_id, begin, end (bytes of the text in UTF-8), class_id, kept_doc, removed: one row for each
    stretch of a document that repeats elsewhere (or earlier in it), overlapping pieces merged."""
    texts = _texts(docs)
    scratch = Scratch(docs.sparkSession)
    near = scratch.table("near", _near(texts, words, jaccard, scratch))
    scratch.drop("classes")
    exact = scratch.table("exact", _passages(texts, words, scratch))
    scratch.drop("marks", "hot")
    return _merged(near.unionByName(exact))


def remove(docs: DataFrame, words: int = WORDS, jaccard: float = JACCARD) -> DataFrame:
    """docs without the removed stretches of their texts; a row whose text loses all of its words goes."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.withColumn("text", F.col("text").cast("string"))
    found = spans(docs, words, jaccard).filter("removed")
    gone = scratch.table("gone", found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("holes")))  # a document's own, merged
    columns = docs.columns

    def cut(batches):
        for b in batches:
            at = b.schema.get_field_index("text")
            text, holes = b.column(at), b.column(b.num_columns - 1)
            touched = pa.compute.and_(holes.is_valid(), text.is_valid()).to_numpy(zero_copy_only=False)
            flat = holes.flatten()
            begins, ends = flat.field("begin").to_numpy(), flat.field("end").to_numpy()
            size = pa.compute.fill_null(pa.compute.list_value_length(holes), 0).to_numpy(zero_copy_only=False)
            low = np.cumsum(size) - size
            out, keep = text.to_pylist(), np.ones(b.num_rows, bool)
            for k in np.flatnonzero(touched):
                raw, parts, last = out[k].encode(), [], 0
                for x, z in zip(begins[low[k] : low[k] + size[k]].tolist(), ends[low[k] : low[k] + size[k]].tolist()):
                    parts.append(raw[last:x])
                    last = max(last, z)
                parts.append(raw[last:])
                out[k] = b"".join(parts).decode("utf-8", "ignore")
                keep[k] = bool(out[k].strip(" \t\n\v\f\r"))
            arrays = [pa.array(out, b.column(k).type) if k == at else b.column(k) for k in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(arrays, names=columns).filter(pa.array(keep, pa.bool_()))

    # Only texts that may have lost something are shuffled.
    key, holes = fresh(docs, "doc"), fresh(docs, "holes")
    gone = gone.select(F.col("doc_id").alias(key), F.col("holes").alias(holes))
    ids = gone.select(F.col(key).alias("doc_id"))
    touched = maybe_in(docs, "doc_id", ids)
    joined = touched.join(gone.hint("merge"), touched["doc_id"].cast("long") == gone[key], "left").drop(key)
    return joined.mapInArrow(lean(cut), docs.schema).unionByName(maybe_in(docs, "doc_id", ids, among=False))
