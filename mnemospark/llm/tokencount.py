"""Token counts by a compiled finite-state tokenizer, without making tokens.

The vocabulary and merges of a byte-level BPE file become a deterministic transducer whose
transitions carry the number of tokens they emit (transducer.py). Where it is reset, a smaller
automaton over classes of characters decides: the pre-tokenizer, whose borders depend on at most the
character before and the three after, so that all borders of a batch come from array operations. A
text of more than CHUNK bytes is cut into chunks, wherever the cuts fall: each gives a map from the boundary states of its left cut
to those of its right one with the tokens emitted in between, and a parallel prefix scan composes the maps; pre-tokens longer
than LONG are cut inside, too. The count is that of the composed map: no ids are made.

Counts are those of the `tokenizers` library for the same file: no special tokens are added, and a
special string inside a text is one token.

Cases: null counts as empty and has no tokens. Repeated rows are counted one by one. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan
from .shared import lean, slices
from .transducer import Transducer, cuts_of

LIMIT = 512
LONG, CHUNK = 1024, 4096
WHITE, LETTER, NUMBER, OTHER = range(4)
SPACES = [0x20, *range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def classes() -> bytes:
    """The class of every code point, compressed.

    Where two Unicode versions at hand disagree, the tokenizer library is asked, whose version counts.
    """
    import regex
    from tokenizers import pre_tokenizers

    split = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
    text = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    at = np.r_[0:0xD800, 0xE000:0x110000]
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        newer = np.zeros(len(at), bool)
        for m in regex.finditer(pattern, text):
            newer[m.start() : m.end()] = True
        older = np.fromiter((unicodedata.category(c)[0] == "LN"[kind - 1] for c in text), bool, len(at))
        out[at[newer & older]] = kind
        probe = {LETTER: "a", NUMBER: "1"}[kind]
        for k in at[newer != older]:
            if len(split(probe + chr(k) + probe)) == 1:
                out[k] = kind
    out[SPACES] = WHITE
    return zlib.compress(out.tobytes())


def borders(symbols: np.ndarray, kinds: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Where a pre-token starts; edge: where a text starts, one longer than symbols."""
    n = len(symbols)
    start = edge.copy()
    start[1:n] |= kinds[1:] != kinds[:-1]
    white = kinds == WHITE
    at = np.flatnonzero(~white[1:] & white[:-1] & ~edge[1:n]) + 1
    start[at] = symbols[at - 1] != 0x20  # a blank goes with what follows it
    start[at - 1] = True
    quote = np.flatnonzero((symbols == 0x27) & start[:n])
    quote = quote[quote + 1 < n]
    quote = quote[~edge[quote + 1]]
    one = quote[np.isin(symbols[quote + 1], [ord(c) for c in "stmd"])]
    start[one + 1] = False
    start[one + 2] = True
    quote = quote[quote + 2 < n]
    quote = quote[~edge[quote + 2]]
    pair = symbols[quote + 1].astype(np.int64) << 32 | symbols[quote + 2]
    two = quote[np.isin(pair, [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")])]
    start[two + 1] = False
    start[two + 3] = True
    return np.flatnonzero(start[:n])


class Counter:
    """Counts tokens of a byte-level BPE file."""

    def __init__(self, path: str, packed_classes: bytes):
        spec = json.load(open(path, encoding="utf-8"))
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in visible]
        byte = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(rest)}
        self.special = [x["content"].encode() for x in spec["added_tokens"]]
        known = {k: v for k, v in spec["model"]["vocab"].items() if k not in {x["content"] for x in spec["added_tokens"]}}
        tokens = {tuple(byte[c] for c in k): v for k, v in known.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        rank = {(known[a], known[b]): (r, known[a + b]) for r, (a, b) in enumerate(merges)}
        alone = [tokens[(b,)] for b in range(256)]

        def encode(symbols) -> list[int]:
            seq = [alone[b] for b in symbols]
            while len(seq) > 1:
                best = min(((*rank[p], k) for k, p in enumerate(zip(seq, seq[1:])) if p in rank), default=None, key=lambda x: (x[0], x[2]))
                if best is None:
                    break
                seq[best[2] : best[2] + 2] = [best[1]]
            return seq

        self.machine = Transducer(tokens, encode, 1 << 20)
        self.kinds = np.frombuffer(zlib.decompress(packed_classes), np.uint8)

    def count(self, text: pa.Array, long: int = LONG, chunk: int = CHUNK) -> np.ndarray:
        data, offsets = bytescan.utf8(text)
        if len(data) == 0:
            return np.zeros(len(text), np.int64)
        raw = data.tobytes()
        symbols = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        first = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        edge = np.zeros(len(symbols) + 1, bool)
        edge[np.searchsorted(first, offsets)] = True
        specials = []
        for s in self.special:
            at = raw.find(s)
            while at >= 0:
                k = int(np.searchsorted(offsets, at, "right"))
                if at + len(s) <= offsets[k]:
                    specials.append((at, at + len(s)))
                    at = raw.find(s, at + len(s))
                else:
                    at = raw.find(s, at + 1)
        for a, b in specials:
            edge[np.searchsorted(first, (a, b))] = True
        starts = first[borders(symbols, self.kinds[symbols], edge)]
        lengths = np.diff(np.append(starts, len(data)))
        counts = np.zeros(len(starts), np.int64)
        fixed = np.zeros(len(starts), bool)
        for a, b in specials:
            x, y = np.searchsorted(starts, (a, b))
            fixed[x:y] = True
            counts[x] = 1
        word = np.searchsorted(starts, offsets)
        short = ~fixed
        cuts: dict[int, np.ndarray] = {}
        wide = np.add.reduceat(np.append(lengths > long, False), np.minimum(word[:-1], len(lengths)), dtype=np.int64) * (np.diff(word) > 0)
        for r in np.flatnonzero((np.diff(offsets) > chunk) | (wide > 0)):
            own = cuts_of(starts[word[r] : word[r + 1]], lengths[word[r] : word[r + 1]], offsets[r], offsets[r + 1], chunk, long)
            at = np.searchsorted(starts, own, "right") - 1
            own, at = own[~fixed[at]], at[~fixed[at]]  # a special string is one token, whatever is cut
            if len(own):
                cuts[r] = own
                short[at[starts[at] < own]] = False
        counts[short] = self.machine.run(data, starts[short], lengths[short])
        sums = np.concatenate([[0], np.cumsum(counts)])
        out = np.diff(sums[word])
        for r, own in cuts.items():
            a, b = word[r], word[r + 1]
            out[r] = self.machine.giant(data, starts[a:b], lengths[a:b], counts[a:b], own, False)[0]
        return out


_held: dict[str, Counter] = {}


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row; path: a tokenizers file on every executor."""
    packed = classes()

    def count(batches):
        counter = _held.get(path)
        if counter is None:
            counter = _held[path] = Counter(path, packed)
        for b in batches:
            text = b.column(1)
            out = np.zeros(len(text), np.int64)
            for at, n in slices(text):
                out[at : at + n] = counter.count(text.slice(at, n))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out)], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    out = rows.mapInArrow(lean(count), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
