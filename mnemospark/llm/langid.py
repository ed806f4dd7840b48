"""Language identification by a bidirectional gated recurrent network over bytes.

The network (two GRU layers side by side, one from each end, and a softmax at every position) is
trained here in numpy by backpropagation through time. It labels every byte position of a text, cut
into windows; a document's probabilities are the mean over all of its positions.

Every language that a labelled document has is learned, from at most PER_LANGUAGE stretches of SPAN characters each (fewer
where there are so many languages that TOTAL stretches wouldn't do; one at least), taken from its documents with the smallest hashes
of doc_id; all bytes of these are used. A prediction sees nothing but the text.

Cases: a null text, or one without a letter, is `und` with score 0. Without any labelled document all
are `und`. With one language, that is it. Repeated rows are predicted one by one. An empty table gives
no rows. Other columns, whatever their names, are ignored by `predict` and kept by `keep_known`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bytescan
from .shared import fresh, lean, slices

PER_LANGUAGE, TOTAL, SPAN = 400, 25_600, 256
WINDOW, HIDDEN = 64, 8
UNKNOWN = "und"


def held_out() -> Column:
    """Documents that training never sees."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Direction:
    """One gated recurrent layer: update gate z, reset gate r, candidate c; columns are lanes.

    h' = z * h + (1 - z) * c with c = tanh(Wc[byte] + r * (Uc h)).
    """

    def __init__(self, hidden: int, rng: np.random.Generator):
        self.h = hidden
        self.w = (rng.normal(0, 0.1, (3 * hidden, 256))).astype(np.float32)
        self.u = (rng.normal(0, 0.4, (3 * hidden, hidden))).astype(np.float32)

    def params(self) -> list[np.ndarray]:
        return [self.w, self.u]

    def step(self, byte: np.ndarray, h: np.ndarray):
        k = self.h
        x = np.take(self.w, byte, axis=1)
        y = self.u @ h
        gates = x[: 2 * k]
        gates += y[: 2 * k]
        np.clip(gates, -30, 30, out=gates)
        _sigmoid(gates)
        z, r = gates[:k], gates[k:]
        c = x[2 * k :]
        c += r * y[2 * k :]
        np.tanh(c, out=c)
        out = h - c
        out *= z
        out += c
        return out, (z, r, c, y[2 * k :])

    def back(self, byte, h, saved, dout, grads):
        """Gradient of the input state; adds those of the parameters."""
        z, r, c, yc = saved
        k = self.h
        dc = dout * (1 - z) * (1 - c * c)
        dz = dout * (h - c) * z * (1 - z)
        dr = dc * yc * r * (1 - r)
        dy = np.concatenate([dz, dr, dc * r])
        dx = np.concatenate([dz, dr, dc])
        grads[1] += dy @ h.T
        onehot = np.zeros((len(byte), 256), np.float32)
        onehot[np.arange(len(byte)), byte] = 1
        grads[0] += dx @ onehot
        return dout * z + self.u.T @ dy


class Network:
    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.forward, self.backward = Direction(hidden, rng), Direction(hidden, rng)
        self.v = rng.normal(0, 0.3, (len(languages), 2 * hidden)).astype(np.float32)
        self.b = np.zeros((len(languages), 1), np.float32)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(window position, language, lane) for windows x (lane, position)."""
        lanes, steps = x.shape
        x = np.ascontiguousarray(x.T)
        k = self.forward.h
        back = np.empty((steps, k, lanes), np.float32)
        h = np.zeros((k, lanes), np.float32)
        for t in range(steps - 1, -1, -1):
            h, _ = self.backward.step(x[t], h)
            back[t] = h
        out = np.empty((steps, len(self.languages), lanes), np.float32)
        h = np.zeros((k, lanes), np.float32)
        for t in range(steps):
            h, _ = self.forward.step(x[t], h)
            y = self.v[:, :k] @ h
            y += self.v[:, k:] @ back[t]
            y += self.b
            y -= y.max(axis=0)
            np.exp(y, out=y)
            y /= y.sum(axis=0)
            out[t] = y
        return out

    def params(self) -> list[np.ndarray]:
        return [*self.forward.params(), *self.backward.params(), self.v, self.b]

    def gradients(self, bytes_: np.ndarray, want: np.ndarray, mask: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over the positions in mask, and its gradient for each of params, by backpropagation through time;
        bytes_ and mask: (position, lane), want: the language of each lane."""
        k, batch, n = self.forward.h, bytes_.shape[1], len(bytes_)
        runs = []
        for layer, order in ((self.forward, range(n)), (self.backward, range(n - 1, -1, -1))):
            h, states, saved = np.zeros((k, batch), np.float32), {}, {}
            for t in order:
                before = h
                h, keep = layer.step(bytes_[t], h)
                states[t], saved[t] = h, (before, keep)
            runs.append((states, saved))
        grads = [np.zeros_like(p) for p in self.params()]
        douts, loss, total = {}, 0.0, max(1.0, float(mask.sum()))
        lanes = np.arange(batch)
        for t in range(n):
            both = np.concatenate([runs[0][0][t], runs[1][0][t]])
            y = self.v @ both + self.b
            y = np.exp(y - y.max(axis=0))
            y /= y.sum(axis=0)
            loss -= float((np.log(y[want, lanes] + 1e-9) * mask[t]).sum())
            y[want, lanes] -= 1
            y *= mask[t] / total
            grads[4] += y @ both.T
            grads[5] += y.sum(axis=1, keepdims=True)
            douts[t] = self.v.T @ y
        for layer, (_, saved), order, part, g in ((self.forward, runs[0], range(n - 1, -1, -1), slice(0, k), grads[:2]), (self.backward, runs[1], range(n), slice(k, 2 * k), grads[2:4])):
            dh = np.zeros((k, batch), np.float32)
            for t in order:
                dh = layer.back(bytes_[t], saved[t][0], saved[t][1], dh + douts[t][part], g)
        return loss / total, grads

    def train(self, x: np.ndarray, labels: np.ndarray, valid: np.ndarray, steps: int = 260, batch: int = 128, rate: float = 0.02, seed: int = 13) -> list[float]:
        """Adam on windows drawn at random, each language as often as any other; the mean loss of every step."""
        rng = np.random.default_rng(seed)
        params = self.params()
        moment, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        own = [np.flatnonzero(labels == k) for k in np.unique(labels)]
        losses = []
        for s in range(1, steps + 1):
            pick = np.array([own[k][int(u * len(own[k]))] for k, u in zip(rng.integers(0, len(own), batch), rng.random(batch))])
            loss, grads = self.gradients(np.ascontiguousarray(x[pick].T), labels[pick], valid[pick].T.astype(np.float32))
            losses.append(loss)
            step = rate * min(1.0, 3 * (1 - s / (steps + 1)))
            for p, g, m, v in zip(params, grads, moment, square):
                np.clip(g, -1, 1, out=g)
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= (step * (m / (1 - 0.9**s)) / (np.sqrt(v / (1 - 0.99**s)) + 1e-8)).astype(np.float32)
        return losses


def windows(data: np.ndarray, offsets: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all rows (a row's last one is filled up with zeros), their lengths, and each row's first."""
    counts = -(-np.diff(offsets) // width)
    first = np.concatenate([[0], np.cumsum(counts)])
    row = np.repeat(np.arange(len(counts)), counts)
    begin = offsets[row] + (np.arange(first[-1]) - first[row]) * width
    length = np.minimum(offsets[row + 1] - begin, width)
    at = begin[:, None] + np.arange(width)
    inside = np.arange(width) < length[:, None]
    return np.where(inside, data[np.minimum(at, max(len(data) - 1, 0))], 0).astype(np.uint8), length, first


def _training_rows(docs: DataFrame) -> list[tuple[str, str]]:
    """(lang, stretch) of each language's documents with the smallest hashes."""
    known = docs.select("doc_id", "lang", F.col("text").cast("string").alias("text")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = known.groupBy("lang").count()
    languages = sizes.count()
    if not languages:
        return []
    most = max(1, min(PER_LANGUAGE, TOTAL // languages))
    hashed = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 40))
    # Some more than needed pass by their hash alone, so only they are ranked.
    chance = F.least(F.lit(1.0), F.lit(2.0 * most + 50) / F.col("count")) * (1 << 40)
    few = F.broadcast(sizes) if languages <= TOTAL else sizes  # else all texts would be shuffled
    chosen = known.withColumn("h", hashed).join(few, "lang").filter(F.col("h") < chance)
    begin = F.pmod(F.col("h"), F.greatest(F.length("text") - SPAN, F.lit(1))) + 1
    chosen = chosen.select("lang", F.substr("text", begin.cast("int"), F.lit(SPAN)).alias("text"), "h")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    return chosen.withColumn("n", place).filter(F.col("n") <= most).orderBy("lang", "n").select("lang", "text").collect()


def fit(docs: DataFrame) -> Network | None:
    """Trains a network on the labelled documents that aren't held out; with more languages it is larger and trained for longer."""
    rows = _training_rows(docs)
    languages = sorted({r[0] for r in rows})
    if not languages:
        return None
    data, offsets = bytescan.utf8(pa.array([r[1] for r in rows], pa.string()))
    x, length, first = windows(data, offsets)
    labels = np.array([languages.index(r[0]) for r in rows])[bytescan.row_of(first)]
    n = len(languages)
    network = Network(languages, max(HIDDEN, min(32, n // 2)))
    if n > 1 and len(x):
        network.train(x, labels, np.arange(WINDOW) < length[:, None], steps=max(260, 8 * n))
    return network


def document_probabilities(network: Network, text: pa.Array) -> np.ndarray:
    """The mean over all byte positions, a row for each text; zeros for an empty one."""
    out = np.zeros((len(text), len(network.languages)))
    for at, n in slices(text, 1 << 19):
        data, offsets = bytescan.utf8(text.slice(at, n))
        x, length, first = windows(data, offsets)
        sums = np.zeros((len(x) + 1, len(network.languages)))
        for k in range(0, len(x), 8192):
            p = network.probabilities(x[k : k + 8192])
            inside = (np.arange(WINDOW)[:, None] < length[k : k + 8192]).astype(np.float32)
            sums[k + 1 : k + 1 + p.shape[2]] = np.einsum("tlb,tb->bl", p, inside)
        sums = np.cumsum(sums, axis=0)
        out[at : at + n] = (sums[first[1:]] - sums[first[:-1]]) / np.maximum(np.diff(offsets), 1)[:, None]
    return out


def predict(docs: DataFrame, network: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row."""
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).select("doc_id", F.when(letter, F.col("text")).alias("text"), held_out().alias("held_out"))

    def run(batches):
        for b in batches:
            text = b.column(1)
            if network is None:
                lang, score = [UNKNOWN] * len(text), np.zeros(len(text))
            else:
                p = document_probabilities(network, text)
                known = text.is_valid().to_numpy(zero_copy_only=False)
                best = p.argmax(axis=1) if len(p) else np.zeros(0, int)
                lang = [network.languages[k] if v else UNKNOWN for k, v in zip(best, known)]
                score = np.where(known, np.clip(p.max(axis=1, initial=0), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(lean(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, fit(docs))


def keep_known(docs: DataFrame, network: Network | None, least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose language is told with at least this score."""
    text = F.when(F.col("text").rlike(r"\p{L}"), F.col("text").cast("string"))

    def run(batches):
        for b in batches:
            text, rest = b.column(b.num_columns - 1), b.select(list(range(b.num_columns - 1)))
            known = text.is_valid().to_numpy(zero_copy_only=False)
            if network is None or not len(known):
                yield rest.slice(0, 0)
            else:
                yield rest.filter(pa.array(known & (document_probabilities(network, text).max(axis=1) >= least)))

    return docs.withColumn(fresh(docs, "letters"), text).mapInArrow(lean(run), docs.schema)
