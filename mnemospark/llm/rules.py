"""Quality rules as a learned decision list.

Sequential covering: on labelled documents, a conjunction of thresholds is grown (the test with the most
information gain, one after the other, on two thirds of the rows) and pruned (tests are taken from its
end while that helps on the last third); what it covers is set aside, and the next rule is grown on the
rest, until none is good enough. The list becomes one ordered Spark conditional expression, so that
scoring a document costs a few comparisons.

The statistics are taken from whole texts. Learning uses at most `rows` labelled documents, those with
the smallest hash of their doc_id; of these, the ones that the base rule leaves.

Cases: a null or empty text has no words and fails the base rule; so does any text of fewer than 50
words. Without labels, or without two classes, the list is empty and only the base rule decides. A
doc_id labelled several times counts as often; labels without a document, or null ones, are left out.
Repeated rows are judged one by one. An empty table gives no rows. Other columns, whatever their names, are ignored by `judge` and
kept by `keep_good`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytescan
from .shared import fresh, lean, slices

ROWS = 20_000
MIN_WORDS = 50
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: What the rules test: exact quotients of the counts.
RATIOS = {"words": ("n_words", None), "chars_a_word": ("word_chars", "n_words"), "symbols_a_char": ("n_symbols", "word_chars"), "symbols_a_word": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", None), "dup_lines_a_word": ("n_dup_lines", "n_words"), "repeats_a_word": ("n_repeat_words", "n_words")}


def _sums(per_item: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(per_item, dtype=np.int64)])
    return np.diff(total[first])


def _again(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item, whether an equal one exists, and whether one is before it."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    any_, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:][same]] = True
    any_[order[1:][same]] = any_[order[:-1][same]] = True
    return any_, later


def counts(text: pa.Array) -> np.ndarray:
    """The base counts (columns as COUNTS) of a batch of texts."""
    out = np.zeros((len(text), len(COUNTS)), np.int64)
    for at, n in slices(text):
        data, offsets = bytescan.utf8(text.slice(at, n))
        starts, ends, firsts = bytescan.words(data, offsets)
        hashes = bytescan.word_hashes(data, starts, ends)
        head = (~bytescan.SPACE[data]) & ((data & 0xC0) != 0x80)
        part = out[at : at + n]
        part[:, 0] = np.diff(firsts)
        part[:, 1] = _sums(head, offsets)
        part[:, 2] = _sums(_SYMBOL[data], offsets)
        breaks = np.flatnonzero(data == 10)
        line_start = np.union1d(np.append(offsets[:-1], breaks + 1), [])
        line_start = line_start[line_start < len(data)].astype(np.int64)
        line_end = np.append(line_start[1:], len(data))
        cut = line_end[(line_end > 0)]
        line_end[line_end > 0] -= (data[cut - 1] == 10) & (cut > line_start)
        word = np.searchsorted(starts, line_start)
        full = (word < len(starts)) & (starts[np.minimum(word, len(starts) - 1)] < line_end) if len(starts) else np.zeros(len(line_start), bool)
        line_start, line_end = line_start[full], line_end[full]
        row = np.searchsorted(offsets, line_start, "right") - 1
        salt = bytescan.mix(np.arange(n, dtype=np.uint64) + np.uint64(1))
        _, later = _again(bytescan.word_hashes(data, line_start, line_end) ^ salt[row])
        part[:, 3] = np.bincount(row[later], minlength=n)
        runs, first = bytescan.windows(hashes, firsts, 3)
        if len(runs):
            row = bytescan.row_of(first)
            twice, _ = _again(runs ^ salt[row])
            begin = (firsts[:-1] - first[:-1])[row] + np.arange(len(runs))
            covered = np.zeros(len(starts), bool)
            for k in range(3):
                covered[begin[twice] + k] = True
            part[:, 4] = _sums(covered, firsts)
    return out


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS of each row."""

    def run(batches):
        for b in batches:
            x = counts(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x[:, k]) for k in range(len(COUNTS)))], names=["doc_id", *COUNTS])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def ratio(name: str) -> Column:
    over, under = RATIOS[name]
    return F.col(over).cast("double") / (F.greatest(F.col(under), F.lit(1)).cast("double") if under else F.lit(1.0))


@dataclass(frozen=True)
class Test:
    name: str
    above: bool
    limit: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.name] > self.limit if self.above else x[self.name] <= self.limit

    def column(self) -> Column:
        return ratio(self.name) > self.limit if self.above else ratio(self.name) <= self.limit

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.limit:g}"


def _covers(tests: list[Test], x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for t in tests:
        out &= t.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int) -> list[Test]:
    tests: list[Test] = []
    inside = np.ones(len(bad), bool)
    while len(tests) < most and (inside & ~bad).any() and (inside & bad).any():
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        best, gain = None, 1e-9
        for name, values in x.items():
            own = values[inside]
            u = np.unique(own)
            if len(u) > 65:
                u = np.unique(np.quantile(own, np.linspace(0, 1, 65), method="lower"))
            for limit in (u[:-1] + u[1:]) / 2:
                for above in (True, False):
                    t = Test(name, above, float(limit))
                    q = inside & t.holds(x)
                    a, b = (q & bad).sum(), (q & ~bad).sum()
                    if a and (g := a * (np.log2(a / (a + b)) - np.log2(p / (p + n)))) > gain:
                        best, gain = t, g
        if best is None:
            break
        tests.append(best)
        inside &= best.holds(x)
    return tests


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.9, most_tests: int = 4, most_rules: int = 16, seed: int = 7) -> list[list[Test]]:
    """Ordered rules that reject; each has at least this precision on the rows that reach it."""
    rules: list[list[Test]] = []
    left = np.arange(len(bad))
    rng = np.random.default_rng(seed)
    while bad[left].sum() >= 4 and len(rules) < most_rules:
        part = rng.permutation(len(left)) % 3 == 2
        if not bad[left[~part]].any():
            break
        pick = lambda rows: {k: v[rows] for k, v in x.items()}
        grown = _grow(pick(left[~part]), bad[left[~part]], most_tests)
        held, held_bad = pick(left[part]), bad[left[part]]

        def worth(tests: list[Test]) -> float:
            c = _covers(tests, held)
            a, b = (c & held_bad).sum(), (c & ~held_bad).sum()
            return (a - b) / (a + b) if a + b else -1.0

        while len(grown) > 1 and worth(grown[:-1]) >= worth(grown):
            grown = grown[:-1]
        covered = _covers(grown, pick(left)) if grown else np.zeros(len(left), bool)
        good = (covered & bad[left]).sum()
        if not grown or good < 3 or good < precision * covered.sum():
            break
        rules.append(grown)
        left = left[~covered]
    return rules


def verdict(rules: list[list[Test]]) -> Column:
    """Ordered conditions: the first rule that holds rejects."""
    out = F.lit(True)
    for tests in reversed(rules):
        cond = tests[0].column()
        for t in tests[1:]:
            cond = cond & t.column()
        out = F.when(cond, F.lit(False)).otherwise(out)
    return out


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> list[list[Test]]:
    """The decision list for documents; labels: doc_id, quality (0: reject). At most `rows` labels are sent to the documents."""
    known = labels.filter("quality is not null and doc_id is not null").select("doc_id", (F.col("quality") == 0).alias("bad"))
    n = known.count()
    hashed = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1 << 40))
    # Some more than needed pass by their hash alone, so only they are sorted.
    sample = known.withColumn("h", hashed).filter(F.col("h") < (1 << 40 if n <= rows else int((1 << 40) * (1.1 * rows + 100) / n)))
    sample = sample.orderBy("h", "doc_id", "bad").limit(rows).select("doc_id", "bad")
    stats = statistics(docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id").distinct()), "doc_id", "left_semi"))
    got = stats.filter(~base_failed()).join(F.broadcast(sample), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", *COUNTS).select(*(ratio(k).alias(k) for k in RATIOS), "bad").toPandas()
    return learn({k: got[k].to_numpy(np.float64) for k in RATIOS}, got["bad"].to_numpy(bool)) if len(got) else []


def judge(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """doc_id, COUNTS, base_failed, kept for each row of docs."""
    rules = fit(docs, labels, rows)
    return statistics(docs).select("doc_id", *COUNTS, base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """The rows of docs, all columns, that neither the base rule nor the decision list rejects."""
    rules = fit(docs, labels, rows)
    named = {c: fresh(docs, c) for c in COUNTS}
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"`{c}` long" for c in named.values())])

    def run(batches):
        for b in batches:
            x = counts(b.column(b.schema.get_field_index("text")).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x[:, k]) for k in range(len(COUNTS)))], names=[*b.schema.names, *named.values()])

    failed, good = base_failed(), verdict(rules)
    counted = docs.mapInArrow(lean(run), schema)
    doc = "d" + fresh(docs, "doc")
    for_rules = counted.select(F.struct(*docs.columns).alias(doc), *(F.col(v).alias(c) for c, v in named.items()))
    return for_rules.filter(~failed & good).select(*(F.col(doc)[c].alias(c) for c in docs.columns))
