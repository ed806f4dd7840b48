"""Approximate nearest neighbours with a hash-prefix forest.

Every tree gives each vector a long string of hash bits and keeps the strings in a sorted array. A
query descends to its longest matching prefix by binary search and then ascends in all trees at once:
prefixes shorten bit by bit, and the ranges of the arrays that still match widen, until they hold
enough candidates. Those are compared by exact Euclidean distance in double precision.

Vectors are spread by a hash of their id over blocks of about BLOCK rows; each block has a forest of its
own over all its rows, and the stated queries visit every block, in batches. So no index outgrows a
task, recall doesn't fall with the number of rows, and nothing is broadcast. A bit asks on which side
of the mid between two of the block's own vectors a vector lies.

Recall measured against brute force: see README.

Cases: vectors that are null, zero, or hold a null or a component that isn't finite take no part,
neither do vectors whose length isn't the most frequent one (the larger of equally frequent ones), nor
rows with a null id. Rows that repeat an id are candidates each, but never for a query of their own id; a
repeated query is answered once. Fewer candidates than neighbours asked for give all there are. Equal
distances are ordered by the smaller id. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import lean, table

BLOCK, TREES, BITS, CANDIDATES = 8192, 96, 24, 0.5


class Forest:
    """Sorted arrays of hash strings over the rows of x."""

    def __init__(self, x: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.x, self.trees, self.bits = x, trees, bits
        p, q = (x[rng.integers(0, len(x), trees * bits)] for _ in range(2))
        self.normal = p - q
        self.mid = np.einsum("ij,ij->i", p + q, self.normal) / 2
        self.strings = self._strings(x)
        self.order = np.argsort(self.strings, axis=1, kind="stable")
        self.sorted = np.take_along_axis(self.strings, self.order, axis=1)

    def _strings(self, x: np.ndarray) -> np.ndarray:
        bit = (x @ self.normal.T > self.mid).reshape(len(x), self.trees, self.bits)
        return (bit @ (1 << np.arange(self.bits - 1, -1, -1, dtype=np.int64))).T

    def ranges(self, strings: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each tree and query, the part of the sorted array that shares the first `depth` bits."""
        low = strings >> (self.bits - depth) << (self.bits - depth)
        high = low + (1 << (self.bits - depth))
        return tuple(np.stack([np.searchsorted(self.sorted[t], v[t]) for t in range(self.trees)]) for v in (low, high))

    def candidates(self, queries: np.ndarray, least: int, own: np.ndarray, k: int):
        """For each query, rows found by ascending in all trees at once until `least` are met, and k of them at least that
        aren't its own (own: how many rows of the query's own id there are)."""
        strings = self._strings(queries)
        kept = {}
        todo = np.arange(len(queries))
        for depth in range(self.bits, -1, -1):
            low, high = self.ranges(strings[:, todo], depth)
            # Trees overlap: each row may be met once in each.
            enough = (high - low).sum(axis=0) >= least * 1.5 if depth else np.ones(len(todo), bool)
            for j in np.flatnonzero(enough):
                met = self._met(low[:, j], high[:, j])
                if depth == 0 or met.sum() >= k + own[todo[j]]:
                    kept[todo[j]] = met
                else:
                    enough[j] = False
            todo = todo[~enough]
            if not len(todo):
                break
        for j in range(len(queries)):
            yield np.flatnonzero(kept[j])

    def _met(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        met = np.zeros(len(self.x), bool)
        for t in range(self.trees):
            met[self.order[t, low[t] : high[t]]] = True
        return met


def _clean(vectors: DataFrame, id_: str, vector: str) -> tuple[DataFrame, int]:
    v = F.col("v")
    rows = vectors.select(F.col(id_).cast("long").alias("id"), F.col(vector).alias("v")).filter(F.col("id").isNotNull() & v.isNotNull())
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = table(vectors.sparkSession, rows.filter(finite).withColumn("v", v.cast("array<double>")), "vectors")
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    rows = rows.filter(F.size("v") == (size[0] if size else 0))
    return rows, size[1] if size else 0


def neighbours(vectors: DataFrame, every: int = 100, k: int = 10, id_: str = "vec_id", vector: str = "embedding", block: int = BLOCK, share: float = CANDIDATES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by `every`."""
    rows, n = _clean(vectors, id_, vector)
    blocks = max(1, -(-n // block))
    data = rows.select(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), "id", "v")
    asked = rows.filter(F.col("id") % every == 0).dropDuplicates(["id"])
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "id", "v")

    def search(batches):
        block, ids, held, forest = None, [], [], None
        for b in batches:
            of, kind = b.column("block").to_numpy(), b.column("kind").to_numpy()
            id_ = b.column("id").to_numpy()
            v = b.column("v")
            x = np.asarray(v.flatten()).reshape(len(of), -1)
            out = []
            cuts = np.flatnonzero(np.diff(of) | np.diff(kind)) + 1
            for a, z in zip([0, *cuts], [*cuts, len(of)]):
                if of[a] != block:
                    block, ids, held, forest = of[a], [], [], None
                if kind[a] == 0:
                    ids.append(id_[a:z].copy())
                    held.append(x[a:z].copy())
                elif held:
                    if forest is None:
                        ids = np.concatenate(ids)
                        forest = Forest(np.concatenate(held))
                    own = np.array([np.count_nonzero(ids == q) for q in id_[a:z]])
                    for j, found in enumerate(forest.candidates(x[a:z], max(60 * k, int(share * len(ids))), own, k)):
                        found = found[ids[found] != id_[a + j]]
                        distance = np.sqrt(((forest.x[found] - x[a + j]) ** 2).sum(axis=1))
                        best = np.lexsort((ids[found], distance))[:k]
                        out.append((np.full(len(best), id_[a + j]), ids[found[best]], distance[best]))
            columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["query_id", "vec_id", "score"])

    stream = data.unionByName(asked).repartition("block").sortWithinPartitions("block", "kind")
    found = stream.mapInArrow(lean(search), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
