"""Sharding over fixed virtual slots.

Every record hashes into one of a few thousand virtual slots.  Bytes and rows are summed per slot, a
small versioned map says which shard owns which slot, and rebalancing edits the map by moving or
swapping whole slots, so that few records move.  Only slot sums, whose number is a fixed parameter,
reach the driver; records never do.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOTS = 4096


def virtual_slot(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a record, by the first 28 bits of its key's md5."""
    return (F.conv(F.substring(F.md5(key.cast("string")), 1, 7), 16, 10).cast("long") % slots).cast("int")


@dataclass
class SlotMap:
    """Which shard owns each slot, and the edits that led there: (version, slot, from_shard, to_shard)."""

    shards: int
    owner: list[int]
    version: int = 1
    edits: list[tuple[int, int, int, int]] = field(default_factory=list)

    @classmethod
    def initial(cls, shards: int, slots: int = SLOTS) -> SlotMap:
        """Version 1 deals the slots round robin."""
        return cls(shards, [s % shards for s in range(slots)])

    def move(self, slot: int, shard: int) -> None:
        self.edits.append((self.version, slot, self.owner[slot], shard))
        self.owner[slot] = shard

    def rebalance(self, weight: list[int], within: int = 0) -> SlotMap:
        """Edit the map, as a new version, until no move or swap between the heaviest and lightest shard narrows their gap.

        ``within``: stop as soon as the gap is at most this many bytes. Each step looks only at the
        slots of two shards, and every step shrinks the sum of squares, so it ends.
        """
        self.version += 1
        load = [0] * self.shards
        held: list[set[int]] = [set() for _ in range(self.shards)]
        for slot, shard in enumerate(self.owner):
            load[shard] += weight[slot]
            held[shard].add(slot)
        while True:
            high, low = load.index(max(load)), load.index(min(load))
            gap = load[high] - load[low]
            if gap <= within:
                return self
            best, pair = gap, None
            given = sorted((weight[s], s) for s in held[high] if weight[s])
            taken = [(0, -1), *sorted((weight[s], s) for s in held[low] if weight[s])]
            j = 0
            for w, s in given:  # two pointers: for each slot given away the one taken back whose difference is nearest to half the gap
                while j + 1 < len(taken) and abs(gap - 2 * (w - taken[j + 1][0])) <= abs(gap - 2 * (w - taken[j][0])):
                    j += 1
                if (after := abs(gap - 2 * (w - taken[j][0]))) < best:
                    best, pair = after, (w, s, *taken[j])
            if pair is None:
                return self
            w, s, back_w, back = pair
            self.move(s, low)
            held[high].remove(s)
            held[low].add(s)
            if back >= 0:
                self.move(back, high)
                held[low].remove(back)
                held[high].add(back)
            load[high] += back_w - w
            load[low] += w - back_w

    def grow(self, shards: int, weight: list[int]) -> SlotMap:
        """A version for more shards: only slots that fill the new shards move."""
        self.version += 1
        total, n = sum(weight), self.shards
        load = [0] * shards
        for slot, shard in enumerate(self.owner):
            load[shard] += weight[slot]
        order = sorted(range(len(self.owner)), key=lambda s: (-weight[s], s))
        self.shards = shards
        for new in range(n, shards):
            for slot in order:
                old = self.owner[slot]
                if old < n and load[new] + weight[slot] <= total // shards < load[old]:
                    load[old] -= weight[slot]
                    load[new] += weight[slot]
                    self.move(slot, new)
        return self

    def save(self, path: str, spark: SparkSession) -> None:
        """Write this version beside the earlier ones: ``path/version-N`` (version, virtual_slot, shard) and ``path/edits-N``."""
        self.frame(spark).coalesce(1).write.parquet(f"{path}/version-{self.version}")
        self.history(spark).where(F.col("version") == self.version).coalesce(1).write.parquet(f"{path}/edits-{self.version}")

    @classmethod
    def load(cls, path: str, spark: SparkSession, version: int) -> SlotMap:
        """A stored version, to be edited further; its rows are as many as there are slots."""
        rows = spark.read.parquet(f"{path}/version-{version}").orderBy("virtual_slot").collect()
        return cls(max(r.shard for r in rows) + 1, [r.shard for r in rows], version)

    def frame(self, spark: SparkSession) -> DataFrame:
        """The map as a table (version, slot, shard), to be stored beside the shards."""
        return spark.createDataFrame([(self.version, s, o) for s, o in enumerate(self.owner)], "version int, virtual_slot int, shard int")

    def history(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.edits, "version int, virtual_slot int, from_shard int, to_shard int")


def slotted(docs: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """(key, size, text_crc32, virtual_slot) of every record; those without a key are dealt by their text."""
    body = F.coalesce(F.col(text), F.lit(""))
    named = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("text "), F.md5(body.cast("binary"))))
    return docs.select(F.col(key), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), virtual_slot(named, slots).alias("virtual_slot"))


def slot_sums(rows: DataFrame) -> DataFrame:
    """(virtual_slot, bytes, records); as many rows as slots in use."""
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("records"))


def shard(docs: DataFrame, path: str, shards: int = 16, key: str = "doc_id", text: str = "text", slots: int = SLOTS, version: int | None = None) -> DataFrame:
    """Assign every row to a shard so that the shards' bytes are near equal, by the slot map stored under ``path``.

    Returns (key, size, text_crc32, virtual_slot, shard, slot).  ``size``: UTF-8 bytes of
    the text plus 1, 1 for a null.  ``slot``: place in the shard, gapless from 0, in order of virtual
    slot and then key, hash of the text and size.  Repeated rows all get places of their own; rows
    with a null key are dealt by their text; an empty
    table gives no rows.  Other columns of ``docs`` are not read.  One record larger than an even
    share stays whole, so it alone can unbalance a shard, and so do records that share one key.

    Without ``version`` a first version is stored, else that one is read; the edits that even out
    these records are stored as the next version, which is read back and joined to the records.
    """
    spark = docs.sparkSession
    rows = slotted(docs, key, text, slots)
    if version is None:
        first = SlotMap.initial(shards, slots)
        first.save(path, spark)
    slot_map = SlotMap.load(path, spark, version or 1)
    weight = [0] * slots
    for r in slot_sums(rows).collect():  # `slots` rows at most
        weight[r.virtual_slot] = r.bytes
    slot_map.rebalance(weight).save(path, spark)
    return place(rows, spark.read.parquet(f"{path}/version-{slot_map.version}"), key)


def place(rows: DataFrame, slot_map: DataFrame, key: str = "doc_id") -> DataFrame:
    """Join records, as ``slotted`` gives them, to a stored version of the map, and number them in their shards."""
    ahead = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    places = slot_map.join(slot_sums(rows), "virtual_slot").select("virtual_slot", "shard", F.coalesce(F.sum("records").over(ahead), F.lit(0)).alias("first"))
    within = Window.partitionBy("virtual_slot").orderBy(key, "text_crc32", "size")
    out = rows.join(F.broadcast(places), "virtual_slot").withColumn("slot", F.col("first") + F.row_number().over(within) - 1)  # broadcast: a row for each slot
    return out.select(key, "size", "text_crc32", "virtual_slot", "shard", "slot")
