"""Packing into optimal length buckets.

The global histogram of lengths goes through a dynamic program that chooses the bucket boundaries with
the least padding; inside each bucket, batches are formed that hold at most a budget of padded tokens.

A length is a number of whitespace-separated words. The histogram is exact, a row for each length that occurs: d of these
need d * (d + 1) / 2 words in all, so 10^13 words (about 100 TB) give at most 4.5 million rows to the driver.

Cases: a null or empty text has length 0 and is packed like any other. A document longer than the
budget makes a batch by itself. Repeated rows are packed one by one. An empty table gives no rows. Ties
in length are ordered by doc_id. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytescan
from .shared import lean, slices, table

BUCKETS = 16
BUDGET = 65_536
#: Rows of a bucket that are ranked together, about; at least PARTS parts.
PARTS, PART_ROWS = 256, 1 << 20


def lengths(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens and salt (a hash of id and text) of every row."""

    def count(batches):
        for b in batches:
            text = b.column(1)
            out = np.zeros(len(text), np.int64)
            for at, n in slices(text):
                out[at : at + n] = np.diff(bytescan.words(*bytescan.utf8(text.slice(at, n)))[2])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out), b.column(2)], names=["doc_id", "n_tokens", "salt"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("doc_id", "text")).mapInArrow(lean(count), "doc_id long, n_tokens long, salt long")


def boundaries(values: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper ends of at most `buckets` buckets of sorted values with the least total padding.

    Divide and conquer over the last cut: the optimal cut never moves left as the end moves right. The intervals of a
    level are searched side by side, so a layer takes log2(n) passes over arrays of about n candidates.
    """
    n = len(values)
    if n == 0:
        return []
    value = values.astype(np.float64)
    rows = np.concatenate([[0.0], np.cumsum(counts, dtype=np.float64)])
    # Padding of bucket (i, j] is value[j-1] * (rows[j] - rows[i]) less a constant sum: only the first part is minimised.
    best = np.concatenate([[0.0], value * rows[1:]])
    cuts = []
    for _ in range(min(buckets, n) - 1):
        nxt, cut = best.copy(), np.zeros(n + 1, np.int64)
        lo, hi, a, b = (np.array([x]) for x in (1, n, 0, n - 1))
        while len(lo):
            j = (lo + hi) // 2
            size = np.minimum(j - 1, b) - a + 1
            first = np.cumsum(size) - size
            i = np.repeat(a - first, size) + np.arange(size.sum())
            end = np.repeat(j, size)
            cost = best[i] + value[end - 1] * (rows[end] - rows[i])
            least = np.minimum.reduceat(cost, first)
            at = np.flatnonzero(cost == np.repeat(least, size))
            owner = np.searchsorted(first, at, "right") - 1
            k = i[at[np.unique(owner, return_index=True)[1]]]
            nxt[j], cut[j] = least, k
            lo, hi, a, b = np.concatenate([lo, j + 1]), np.concatenate([j - 1, hi]), np.concatenate([a, k]), np.concatenate([k, b])
            go = lo <= hi
            lo, hi, a, b = lo[go], hi[go], a[go], b[go]
        cuts.append(cut)
        best = nxt
    ends, j = [], n
    for cut in reversed(cuts):
        ends.append(int(values[j - 1]))
        j = int(cut[j])
        if j == 0:
            break
    if j:
        ends.append(int(values[j - 1]))
    return sorted(set(ends))


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_len, batch_id, batch_pos, padding: one row a document."""
    spark = docs.sparkSession
    sized = table(spark, lengths(docs), "lengths")
    bins = sized.groupBy("n_tokens").count().toArrow().sort_by("n_tokens")
    values, counts = (bins.column(c).to_numpy() for c in ("n_tokens", "count"))
    ends = boundaries(values, counts, buckets)
    bucket = F.lit(len(ends) - 1)
    for k in range(len(ends) - 2, -1, -1):
        bucket = F.when(F.col("n_tokens") <= ends[k], k).otherwise(bucket)
    parts = max(PARTS, int(counts.sum()) // PART_ROWS)
    sized = sized.withColumn("bucket", bucket.cast("int")).withColumn("part", F.pmod("salt", F.lit(parts)).cast("int"))
    begin: dict[int, int] = {}
    before = []
    for r in sized.groupBy("bucket", "part").count().orderBy("bucket", "part").collect():  # at most buckets * parts rows
        at = begin.get(r[0], 0)
        before.append((r[0], r[1], ends[r[0]], max(1, budget // max(1, ends[r[0]])), at))
        begin[r[0]] = at + r[2]
    lookup = spark.createDataFrame(before, "bucket int, part int, bucket_len long, a_batch long, begin long")
    rank = F.col("begin") + F.row_number().over(Window.partitionBy("bucket", "part").orderBy("doc_id", "n_tokens", "salt")) - 1
    return (
        sized.join(F.broadcast(lookup), ["bucket", "part"])
        .withColumn("rank", rank)
        .select(
            "doc_id", "n_tokens", "bucket", "bucket_len",
            F.concat_ws("-", F.col("bucket"), F.floor(F.col("rank") / F.col("a_batch"))).alias("batch_id"),
            (F.col("rank") % F.col("a_batch")).cast("int").alias("batch_pos"), (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
        )
    )
