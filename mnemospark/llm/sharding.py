"""Sharding by fixed virtual slots.

Records hash into a fixed number of virtual slots; a small, versioned table maps slots to shards.
Only that table is edited when shards must be rebalanced or added, records never change their slot.

Law ``bytes``: the shards' sizes are near equal. Rows with equal texts share a slot, hence a shard, wherever the law allows:
groups of copies that hold more than 1/16 of a shard's fair share of bytes (at most 16 * shards can) are placed on the driver
first, whole where they hold at most half a share. Only if sizes then differ by more than 1 % of a share, groups above a
quarter, then an eighth, then a sixteenth of a share are salted by doc_id over several slots.

Cases: a null text counts as no bytes and has checksum 0; an empty one equals it in size. Repeated
rows each get a place of their own. An empty table gives no rows. A null doc_id hashes like any
other value. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import new_path, table

SLOTS = 4096
HEAVY = 16
#: Rows of a slot that are ranked together, about.
PART_ROWS = 1 << 20


@dataclass(frozen=True)
class SlotMap:
    """Version n of the table that gives each virtual slot its shard."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    @staticmethod
    def balanced(slot_bytes: list[int], shards: int, version: int = 1) -> "SlotMap":
        """Largest slot first, always into the shard with the fewest bytes."""
        load = [(0, 0, s) for s in range(shards)]
        out = [0] * len(slot_bytes)
        for slot in sorted(range(len(slot_bytes)), key=lambda k: (-slot_bytes[k], k)):
            size, slots, shard = heapq.heappop(load)
            out[slot] = shard
            heapq.heappush(load, (size + slot_bytes[slot], slots + 1, shard))
        return SlotMap(version, shards, tuple(out))

    def grown(self, slot_bytes: list[int]) -> "SlotMap":
        """One shard more, which takes slots from the fullest shards and gives none away."""
        new, out = self.shards, list(self.shard_of)
        load = [0] * (new + 1)
        own: list[list[int]] = [[] for _ in range(new)]
        for slot, shard in enumerate(out):
            load[shard] += slot_bytes[slot]
            own[shard].append(slot)
        for slots in own:
            slots.sort(key=lambda k: (-slot_bytes[k], k))
        fair = sum(slot_bytes) / (new + 1)
        while True:
            full = max(range(new), key=lambda s: (load[s], -s))
            pick = next((k for k in own[full] if 0 < slot_bytes[k] and load[new] + slot_bytes[k] <= fair), None)
            if pick is None or load[full] <= fair:
                return SlotMap(self.version + 1, new + 1, tuple(out))
            own[full].remove(pick)
            out[pick] = new
            load[full] -= slot_bytes[pick]
            load[new] += slot_bytes[pick]

    def rebalanced(self, slot_bytes: list[int], slack: float = 0.01) -> "SlotMap":
        """Moves slots from the fullest to the emptiest shard until they differ by slack of the mean."""
        out, load = list(self.shard_of), [0] * self.shards
        for slot, shard in enumerate(out):
            load[shard] += slot_bytes[slot]
        while True:
            full, empty = max(range(self.shards), key=load.__getitem__), min(range(self.shards), key=load.__getitem__)
            gap = load[full] - load[empty]
            fits = [k for k, s in enumerate(out) if s == full and 0 < slot_bytes[k] < gap]
            if not fits or gap <= slack * sum(load) / self.shards:
                return SlotMap(self.version + 1, self.shards, tuple(out))
            pick = min(fits, key=lambda k: (abs(slot_bytes[k] - gap / 2), k))
            out[pick] = empty
            load[full] -= slot_bytes[pick]
            load[empty] += slot_bytes[pick]

    def save(self, spark: SparkSession, folder: str) -> str:
        """Writes this version beside the others; a version that exists is never overwritten."""
        path = f"{folder}/version={self.version:06d}"
        spark.createDataFrame([(json.dumps({"version": self.version, "shards": self.shards, "shard_of": self.shard_of}),)], "value string").coalesce(1).write.mode("error").text(path)
        return path

    @staticmethod
    def load(spark: SparkSession, path: str) -> "SlotMap":
        x = json.loads(spark.read.text(path, wholetext=False).first()[0])
        return SlotMap(x["version"], x["shards"], tuple(x["shard_of"]))


def split_from(groups: list[int], total: int, shards: int, slots: int, slack: float = 0.01) -> int:
    """2, 4, 8 or 16: groups of copies above this part of a shard's share are split. The first with which the largest and the smallest
    shard differ by at most slack of a share, where each group or piece of one is placed as a whole and the rest is spread evenly."""
    share = total / shards
    rest = (total - sum(groups)) / slots
    for parts in (2, 4, 8, HEAVY):
        items = []
        for b in groups:
            n = max(1, -(-b * parts // share)) if b > share / parts else 1
            items += [b / n] * int(n)
        load = [0.0] * shards
        for x in sorted(items, reverse=True) + [rest] * slots:
            k = min(range(shards), key=load.__getitem__)
            load[k] += x
        if max(load) - min(load) <= max(slack * share, 2 * rest):
            return parts
    return HEAVY


def shard(docs: DataFrame, shards: int = 24, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (place inside the shard, gapless from 0), grown_shard,
    virtual_slot, map_version."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(
        spark,
        docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"), F.xxhash64(text).alias("copies")),
        "shard-rows",
    )
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    share = max(1.0, total / shards)
    # At most shards * HEAVY groups are that heavy.
    groups = rows.groupBy("copies").agg(F.sum("size").alias("b"), F.count("*").alias("n")).filter((F.col("b") > share / HEAVY) & (F.col("n") > 1)).collect()
    limit = share / split_from([r["b"] for r in groups], total, shards, slots)
    pieces = spark.createDataFrame([(r["copies"], int(-(-r["b"] // limit))) for r in groups if r["b"] > limit], "copies long, pieces long")
    salt = F.when(F.col("pieces").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.col("pieces"))).otherwise(F.lit(0).cast("long"))
    parts = max(1, n // (slots * PART_ROWS))
    placed = rows.join(F.broadcast(pieces), "copies", "left").withColumn("virtual_slot", F.pmod(F.xxhash64("copies", salt), F.lit(slots)).cast("int"))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("doc_id", "copies"), F.lit(parts)).cast("int"))
    weights, counts = [0] * slots, [[0] * parts for _ in range(slots)]
    for r in placed.groupBy("virtual_slot", "part").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():  # at most one row a slot, or a million rows
        weights[r[0]] += r[2]
        counts[r[0]][r[1]] = r[3]
    folder = new_path(spark, "slot-map")
    slot_map = SlotMap.load(spark, SlotMap.balanced(weights, shards).save(spark, folder))
    begin, before = [0] * shards, []
    for slot, s in enumerate(slot_map.shard_of):
        for part, count in enumerate(counts[slot]):
            before.append((slot, part, s, begin[s]))
            begin[s] += count
    lookup = spark.createDataFrame(before, "virtual_slot int, part int, shard int, begin long")
    inside = F.row_number().over(Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "size", "text_crc32"))
    return (
        placed.withColumn("inside", inside)
        .join(lookup, ["virtual_slot", "part"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("begin") + F.col("inside") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(slot_map.version).alias("map_version"),
        )
    )
