"""SentencePiece encoding and decoding of whole text columns.

Encoding is a search through the lattice of pieces. Its weights are those of BPE models: a way is
allowed exactly if each two neighbouring pieces encode themselves, all else weighs -inf (see
transducer.py); so the one finite way is the library's result, which the sum of scores, as for unigram
models, would not be. Words (cut before a blank, which no piece holds elsewhere than in its front) run
through a compiled transducer in lockstep, all words of a batch side by side; then every word is traced back by itself from the
last piece at each position. A text longer than CHUNK symbols is split into chunks, wherever the cuts fall: each chunk gives the
max-plus transfer matrix between the boundary states of its cuts, an associative scan multiplies them, and the chunks are traced
back independently. Words longer than LONG are cut inside, too.

Decoding turns ids into text: byte pieces become bytes, the blank added in front is taken away.

Cases: a null text has null ids and decodes to null; an empty one has none. Characters without a piece
become byte pieces. Repeated rows are encoded one by one. An empty table gives no rows. Other columns
are kept by encode and decode; the column that is added must have a name that no other has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan
from .shared import lean, slices
from .transducer import Transducer, cuts_of

BLANK = 0x2581
LONG, CHUNK = 1024, 4096


class Model:
    """A BPE model with byte fallback, identity normalisation and a blank put in front."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(k) for k in range(size)]
        self.byte = np.full(256, -1, np.int64)
        rank: dict[str, tuple[float, int]] = {}
        for k, name in enumerate(names):
            if model.is_byte(k):
                self.byte[int(name[3:5], 16)] = k
            elif not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k)):
                rank[name] = (model.get_score(k), k)
                if chr(BLANK) in name.lstrip(chr(BLANK)):
                    raise ValueError(f"piece {name!r} has a blank inside")
        if (self.byte < 0).any():
            raise ValueError("the model has no byte pieces")
        self.unknown = 1 << 20
        unknown = self.unknown

        def encode(symbols) -> list[int]:
            seq = [chr(c) for c in symbols]
            while len(seq) > 1:
                best = None
                for k in range(len(seq) - 1):
                    x = rank.get(seq[k] + seq[k + 1])
                    if x is not None and (best is None or x[0] > best[0]):
                        best = x[0], k
                if best is None:
                    break
                seq[best[1] : best[1] + 2] = [seq[best[1]] + seq[best[1] + 1]]
            return [rank[s][1] if s in rank else unknown + ord(s) for s in seq]

        self.machine = Transducer({tuple(map(ord, s)): k for s, (_, k) in rank.items()}, encode, unknown)
        self.width = np.array([len(n) if n in rank else 1 for n in names], np.int64)
        shown = [bytes([int(n[3:5], 16)]) if model.is_byte(k) else b"" if model.is_control(k) else n.replace(chr(BLANK), " ").encode() for k, n in enumerate(names)]
        self.bytes = np.frombuffer(b"".join(shown), np.uint8)
        self.begin = np.concatenate([[0], np.cumsum([len(x) for x in shown])])

    def encode(self, text: pa.Array, long: int = LONG, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the offset of each row's."""
        data, offsets = bytescan.utf8(text)
        symbols = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
        first = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        rows = np.searchsorted(first, offsets)
        filled = np.diff(rows) > 0
        symbols = np.insert(symbols, rows[:-1][filled], BLANK)
        rows = rows + np.concatenate([[0], np.cumsum(filled)])
        n = len(symbols)
        if n == 0:
            return np.zeros(0, np.int32), np.zeros(len(text) + 1, np.int64)
        symbols[symbols == 0x20] = BLANK
        blank = symbols == BLANK
        start = blank.copy()
        start[1:] &= ~blank[:-1]
        start[rows[:-1][filled]] = True
        starts = np.flatnonzero(start)
        lengths = np.diff(np.append(starts, n))
        last = np.zeros(n, np.int64)
        counts = np.zeros(len(starts), np.int64)
        short = np.ones(len(starts), bool)
        word = np.searchsorted(starts, rows)
        cuts: dict[int, np.ndarray] = {}
        wide = np.add.reduceat(np.append(lengths > long, False), np.minimum(word[:-1], len(lengths)), dtype=np.int64) * (np.diff(word) > 0)
        for r in np.flatnonzero((np.diff(rows) > chunk) | (wide > 0)):
            cuts[r] = cuts_of(starts[word[r] : word[r + 1]], lengths[word[r] : word[r + 1]], rows[r], rows[r + 1], chunk, long)
            at = np.searchsorted(starts, cuts[r], "right") - 1
            short[at[starts[at] < cuts[r]]] = False
        counts[short] = self.machine.run(symbols, starts[short], lengths[short], last)
        others = {}
        for r, own in cuts.items():
            a, b = word[r], word[r + 1]
            _, found = self.machine.giant(symbols, starts[a:b], lengths[a:b], counts[a:b], own, True)
            others |= {int(a) + w: np.array(ids) for w, ids in found.items()}
        for k, ids in others.items():
            counts[k] = len(ids)
        ends = np.cumsum(counts)
        out = np.zeros(int(ends[-1]), np.int64)
        lanes = np.flatnonzero(short)
        at, put, low = starts[lanes] + lengths[lanes], ends[lanes] - 1, starts[lanes]
        while len(at):
            token = last[at - 1]
            out[put] = token
            at = at - np.where(token < self.unknown, self.width[np.minimum(token, len(self.width) - 1)], 1)
            more = at > low
            at, put, low = at[more], put[more] - 1, low[more]
        for k, ids in others.items():
            out[ends[k] - len(ids) : ends[k]] = ids
        firsts = np.concatenate([[0], ends])[np.searchsorted(starts, rows)]
        # Characters without a piece: their bytes.
        strange = out >= self.unknown
        point = out - self.unknown
        times = np.where(strange, 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000), 1)
        sums = np.concatenate([[0], np.cumsum(times)])
        ids = np.repeat(out, times)
        ascii_ = strange & (point < 0x80)
        ids[sums[:-1][ascii_]] = self.byte[point[ascii_]]
        for k in np.flatnonzero(strange & ~ascii_):
            ids[sums[k] : sums[k + 1]] = self.byte[list(chr(point[k]).encode())]
        return ids.astype(np.int32), sums[firsts]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The text of each row of ids."""
        size = (self.begin[1:] - self.begin[:-1])[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        data = self.bytes[np.repeat(self.begin[ids] - (ends - size), size) + np.arange(total)]
        rows = np.concatenate([[0], ends])[offsets]
        drop = rows[:-1][(np.diff(rows) > 0)]
        drop = drop[data[drop] == 0x20]
        keep = np.ones(total, bool)
        keep[drop] = False
        rows = np.concatenate([[0], np.cumsum(keep)])[rows]
        binary = pa.Array.from_buffers(pa.large_binary(), len(rows) - 1, [None, pa.py_buffer(rows.astype(np.int64).tobytes()), pa.py_buffer(data[keep].tobytes())])
        try:
            return binary.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:  # ids that aren't the encoding of a text may give broken UTF-8
            return pa.array([x.as_py().decode("utf-8", "replace") for x in binary], pa.string())


_held: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _held:
        _held[path] = Model(path)
    return _held[path]


def _lists(ids: list[np.ndarray], lengths: list[np.ndarray], valid: pa.Array) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]) if lengths else np.zeros(1, np.int64)
    mask = pa.compute.invert(valid) if valid.null_count == 0 else None
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32()), mask=mask)


def _unused(rows: DataFrame, name: str) -> None:
    if name.lower() in {c.lower() for c in rows.columns}:
        raise ValueError(f"there is a column {name} already; name the new one otherwise")


def encode(rows: DataFrame, path: str, text: str = "text", ids: str = "ids", chunk: int = CHUNK) -> DataFrame:
    """rows with a column of piece ids of the column `text`; path: a model file on every executor."""
    _unused(rows, ids)

    def run(batches):
        m = model(path)
        for b in batches:
            column = b.column(b.schema.get_field_index(text))
            parts, lengths = [], []
            for at, n in slices(column):
                x, offsets = m.encode(column.slice(at, n), chunk=chunk)
                parts.append(x)
                lengths.append(np.diff(offsets))
            yield pa.RecordBatch.from_arrays([*b.columns, _lists(parts, lengths, column.is_valid())], names=[*b.schema.names, ids])

    rows = rows.withColumn(text, F.col(text).cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(lean(run), f"{schema}, `{ids}` array<int>")


def decode(rows: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """rows with a column of the texts that piece ids stand for."""
    _unused(rows, text)

    def run(batches):
        m = model(path)
        for b in batches:
            column = b.column(b.schema.get_field_index(ids)).cast(pa.list_(pa.int32()))
            lengths = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            out = m.decode(np.asarray(column.flatten()), np.concatenate([[0], np.cumsum(lengths)]))
            out = pa.compute.if_else(column.is_valid(), out, pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns, out], names=[*b.schema.names, text])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(lean(run), f"{schema}, `{text}` string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pieces, ids, exact (whether decoding gives the text back): one row for each row."""
    rows = docs.select("doc_id", "text")

    def run(batches):
        m = model(path)
        for b in batches:
            column = b.column(1)
            parts, lengths, exact = [], [], []
            for at, n in slices(column):
                piece = column.slice(at, n)
                x, offsets = m.encode(piece)
                parts.append(x)
                lengths.append(np.diff(offsets))
                exact.append(pa.compute.equal(m.decode(x, offsets), pa.compute.fill_null(piece.cast(pa.string()), "")))
            counts = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
            exact = pa.concat_arrays(exact) if exact else pa.array([], pa.bool_())
            exact = pa.compute.if_else(column.is_valid(), exact, pa.scalar(None, pa.bool_()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), _lists(parts, lengths, column.is_valid()), exact], names=["doc_id", "n_pieces", "ids", "exact"])

    rows = rows.withColumn("text", F.col("text").cast("string"))
    return rows.mapInArrow(lean(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_pieces long, ids array<int>, exact boolean")
