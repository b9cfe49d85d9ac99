"""Sharding by fixed virtual slots.

Records hash into a fixed number of virtual slots. Bytes and rows are summed per slot, and a versioned map gives each
slot its shard. Rebalancing edits the map - it moves whole slots off shards above the mean - and never rehashes records.

Memory is bounded by the number of slots: only per-slot totals reach the driver, and only the map is broadcast. A
record's position in its shard is its position in its slot plus the rows of the shard's earlier slots, so no task ever
sorts more than one slot.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinframe.llm.common import materialise, shared_dir

#: Virtual slots; fixed for the life of a dataset. A slot holds about 1/8192 of the rows, whatever the input.
SLOTS = 8192
#: Bytes a record takes besides its text.
RECORD_OVERHEAD = 16


@dataclass(frozen=True)
class SlotMap:
    """One version of the slot-to-shard map. ``edits`` lists the (slot, from, to) moves that led to this version."""

    version: int
    shards: int
    owner: tuple[int, ...]
    edits: tuple[tuple[int, int, int], ...] = field(default=())

    @classmethod
    def initial(cls, shards: int, slots: int = SLOTS) -> SlotMap:
        if shards < 1 or slots < shards:
            raise ValueError("needs at least one shard and as many slots as shards")
        return cls(1, shards, tuple(s % shards for s in range(slots)))

    def _edited(self, shards: int, owner: list[int]) -> SlotMap:
        moves = tuple((s, a, b) for s, (a, b) in enumerate(zip(self.owner, owner)) if a != b)
        return SlotMap(self.version + 1, shards, tuple(owner), moves)

    def rebalance(self, slot_bytes: list[int], fine: float = 0.125) -> SlotMap:
        """The next version, with near-equal bytes per shard.

        Shards above the mean give up their largest slots until they are not above it, and every shard gives up its
        smallest slots, up to ``fine`` of the mean, so that small pieces are at hand to level with. The slots given up
        go, largest first, to the shard that has least.
        """
        load, held = [0] * self.shards, [[] for _ in range(self.shards)]
        for slot, shard in enumerate(self.owner):
            load[shard] += slot_bytes[slot]
            held[shard].append(slot)
        mean, owner, pool = sum(load) / self.shards, list(self.owner), []
        for shard in range(self.shards):
            for slot in sorted(held[shard], key=lambda s: (-slot_bytes[s], s)):
                if load[shard] <= mean or not slot_bytes[slot]:
                    break
                load[shard] -= slot_bytes[slot]
                pool.append(slot)
            given, left = 0.0, set(held[shard]).difference(pool)
            for slot in sorted(left, key=lambda s: (slot_bytes[s], s)):
                given += slot_bytes[slot]
                if given > fine * mean:
                    break
                load[shard] -= slot_bytes[slot]
                pool.append(slot)
        heap = [(b, s) for s, b in enumerate(load)]
        heapq.heapify(heap)
        for slot in sorted(pool, key=lambda s: (-slot_bytes[s], s)):
            b, shard = heapq.heappop(heap)
            owner[slot] = shard
            heapq.heappush(heap, (b + slot_bytes[slot], shard))
        return self._edited(self.shards, owner)

    def grow(self, slot_bytes: list[int]) -> SlotMap:
        """The next version with one more shard, which takes slots from the fullest shards; no other slot moves."""
        owner, load = list(self.owner), [0] * self.shards
        held: list[list[int]] = [[] for _ in range(self.shards)]
        for slot in sorted(range(len(owner)), key=lambda s: slot_bytes[s]):
            load[owner[slot]] += slot_bytes[slot]
            held[owner[slot]].append(slot)
        share, taken = sum(load) / (self.shards + 1), 0
        heap = [(-b, s) for s, b in enumerate(load)]
        heapq.heapify(heap)
        while heap and taken < share:
            b, shard = heapq.heappop(heap)
            if not held[shard] or -b <= share:
                continue
            slot = held[shard].pop()
            if taken + slot_bytes[slot] > share + slot_bytes[slot] / 2:
                continue
            owner[slot] = self.shards
            taken += slot_bytes[slot]
            heapq.heappush(heap, (b + slot_bytes[slot], shard))
        return self._edited(self.shards + 1, owner)


def virtual_slot(*keys: str, slots: int = SLOTS) -> Column:
    """The slot of a record: depends on its keys alone."""
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(slots)).cast("int")


def slot_totals(records: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot; ``records`` has ``virtual_slot`` and ``size``. At most ``slots`` rows are fetched."""
    size, rows = [0] * slots, [0] * slots
    for r in records.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).toLocalIterator():
        size[r["virtual_slot"]], rows[r["virtual_slot"]] = r["b"], r["n"]
    return size, rows


def hot_slots(rows: list[int], slots: int) -> tuple[list[tuple[int, int, int]], int]:
    """(slot, its first part, number of parts) of each slot with several times the mean of rows (chance alone does not make
    one), and the number of slots with those parts. A part has about the mean; there are fewer parts than slots."""
    mean, split, every = sum(rows) / slots, [], slots
    for slot, n in enumerate(rows):
        if n > 4 * mean + 16:
            parts = int(n // (mean + 4)) + 1
            split.append((slot, every, parts))
            every += parts
    return split, every


def store(spark: SparkSession, maps: list[SlotMap], path: str) -> DataFrame:
    """Write map versions as a table (version, virtual_slot, shard) and read it back."""
    rows = [(m.version, s, o) for m in maps for s, o in enumerate(m.owner)]
    spark.createDataFrame(rows, "version int, virtual_slot int, shard int").coalesce(1).write.mode("append").partitionBy("version").parquet(path)
    return spark.read.schema("virtual_slot int, shard int, version int").parquet(path)


def shard_records(df: DataFrame, shards: int, *, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Put every row of ``df`` into a shard; near-equal bytes per shard.

    Returns id, size (UTF-8 bytes of the text plus 16), text_crc32, virtual_slot, shard, map_version and position
    (gapless from 0 within the shard). Other columns of the input are not carried.

    Null text: size 16, crc32 of no bytes (0). Null ids hash by their text. Rows equal in id and text share a slot, in
    either order, unless they are so many that the slot is far above the mean: such a slot is split into further ones, by
    where its rows lie. An empty table gives no rows. Very long texts are measured, never cut.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    records = df.select(
        F.col(id_col).alias("record_id"),
        (F.octet_length(text) + RECORD_OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("lies_at"),
    ).withColumn("virtual_slot", virtual_slot("record_id", "text_crc32", slots=slots))
    records = materialise(records, "shard-records")
    size, rows = slot_totals(records, slots)
    split, every = hot_slots(rows, slots)
    if split:
        hot = F.broadcast(spark.createDataFrame(split, "virtual_slot int, first_part int, parts int"))
        apart = F.col("first_part") + F.pmod(F.xxhash64("lies_at"), F.col("parts")).cast("int")
        records = records.join(hot, "virtual_slot", "left").withColumn("virtual_slot", F.coalesce(apart, "virtual_slot")).drop("first_part", "parts")
        size, rows = slot_totals(records, every)
    first = SlotMap.initial(shards, every)
    current = first.rebalance(size)
    stored = store(spark, [first, current], map_path or f"{shared_dir(spark)}/twinframe/slot-map-{uuid.uuid4().hex}")
    start, seen = [], [0] * shards
    for slot, shard in enumerate(current.owner):
        start.append(seen[shard])
        seen[shard] += rows[slot]
    offsets = spark.createDataFrame(list(enumerate(start)), "virtual_slot int, first_row long")
    owner = stored.filter(F.col("version") == current.version).join(F.broadcast(offsets), "virtual_slot")
    place = Window.partitionBy("virtual_slot").orderBy("record_id", "text_crc32", "lies_at")
    return records.withColumn("in_slot", F.row_number().over(place)).join(F.broadcast(owner), "virtual_slot").select(
        F.col("record_id").alias(id_col),
        "size",
        "text_crc32",
        "virtual_slot",
        "shard",
        F.col("version").alias("map_version"),
        (F.col("first_row") + F.col("in_slot") - 1).alias("position"),
    )


def op5_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards under the law ``bytes``; ``slot`` is the gapless position within the shard."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard_records(docs, 40).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("position").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        "map_version",
    )
