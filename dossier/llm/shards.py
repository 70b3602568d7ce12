"""Sharding through fixed virtual slots.

A record is hashed into one of thousands of slots, for good. A small table maps slots to
shards; it has versions, and rebalancing edits entries of it. So records never have to be
hashed again, and only the records of edited slots move.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stored, column_named

# Fixed for the life of a data set.
SLOTS = 4096
SHARDS = 16


@dataclass(frozen=True)
class SlotMap:
    """Shard of each slot."""

    version: int
    shards: int
    owner: tuple[int, ...]

    def shard(self, slot: Column) -> Column:
        """Shard of a slot column: one look-up in a constant array, no join."""
        owners = F.expr(f"array({','.join(map(str, self.owner))})")
        return F.element_at(owners, (slot + 1).cast("int"))


def virtual_slot(*keys: Column, slots: int = SLOTS) -> Column:
    """Slot of a record. Null keys are hashed like any other value."""
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def slot_sizes(rows: DataFrame, slots: int = SLOTS) -> list[tuple[int, int]]:
    """(bytes, rows) of each slot of a table with ``vslot, size``.

    One partial aggregate; the driver gets as many rows as there are slots.
    """
    found = {
        r.vslot: (r.b, r.n)
        for r in rows.groupBy("vslot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    }
    return [found.get(s, (0, 0)) for s in range(slots)]


def first_map(sizes: list[int], shards: int = SHARDS) -> SlotMap:
    """Version 1: largest slots first, each to the shard with the fewest bytes so far."""
    heap = [(0, k) for k in range(shards)]
    owner = [0] * len(sizes)
    for slot in sorted(range(len(sizes)), key=lambda s: (-sizes[s], s)):
        load, k = heapq.heappop(heap)
        owner[slot] = k
        heapq.heappush(heap, (load + sizes[slot], k))
    return SlotMap(1, shards, tuple(owner))


def rebalance(old: SlotMap, sizes: list[int], shards: int | None = None) -> SlotMap:
    """Next version: move slots off overfull shards until no move brings them closer together.

    ``shards`` may add shards, which start empty; then slots move only into these. Slots that
    are not moved keep their shard.
    """
    shards = shards or old.shards
    if shards < old.shards:
        raise ValueError("shards are only added")
    owner, load = list(old.owner), [0] * shards
    takers = range(old.shards, shards) if shards > old.shards else range(shards)
    for slot, k in enumerate(owner):
        load[k] += sizes[slot]
    held: list[list[int]] = [[] for _ in range(shards)]
    for slot in sorted(range(len(owner)), key=lambda s: (sizes[s], s)):
        held[owner[slot]].append(slot)
    while True:
        full = max(range(shards), key=lambda k: (load[k], -k))
        free = min(takers, key=lambda k: (load[k], k))
        gap = load[full] - load[free]
        # The largest slot that still leaves both closer together than before.
        fit = [i for i, s in enumerate(held[full]) if 0 < sizes[s] <= gap // 2]
        if not fit:
            return SlotMap(old.version + 1, shards, tuple(owner))
        slot = held[full].pop(fit[-1])
        owner[slot] = free
        load[full] -= sizes[slot]
        load[free] += sizes[slot]
        held[free].append(slot)
        held[free].sort(key=lambda s: (sizes[s], s))


def save_map(spark: SparkSession, path: str, slot_map: SlotMap) -> None:
    """Write a version of the map next to the earlier ones. A version is written once."""
    rows = spark.range(0, len(slot_map.owner), numPartitions=1).select(
        F.col("id").cast("int").alias("vslot"),
        slot_map.shard(F.col("id")).alias("shard"),
        F.lit(slot_map.shards).alias("shards"),
    )
    rows.write.mode("errorifexists").parquet(f"{path}/version={slot_map.version}")


def load_map(spark: SparkSession, path: str, version: int) -> SlotMap:
    """Read a version of the map: as many rows as there are slots."""
    rows = spark.read.parquet(f"{path}/version={version}").orderBy("vslot").collect()
    return SlotMap(version, rows[0].shards, tuple(r.shard for r in rows))


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, size, text_crc32, vslot``. Size: UTF-8 bytes plus 1; a null text has none.

    The checksum takes part in the hash, so that rows without an id are spread as well.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = column_named(docs, "doc_id", "text").select(
        "doc_id",
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return narrow.withColumn("vslot", virtual_slot(F.col("doc_id"), F.col("text_crc32")))


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Place every document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot``.

    Law ``bytes``: shards hold nearly equal bytes. ``slot`` numbers the rows of a shard from
    0 without gaps: rows before the virtual slot, plus the place inside it, so no task sorts
    a whole shard. Texts are read once; what follows works on a narrow stored table. Empty
    tables give no rows; repeated rows are placed like any other.
    """
    spark = docs.sparkSession
    rows = Stored(spark, "shards").write(measured(docs))
    sizes = slot_sizes(rows)
    slot_map = first_map([b for b, _ in sizes], shards)
    before, filled = [], [0] * shards
    for k, (_, n) in zip(slot_map.owner, sizes, strict=True):
        before.append(filled[k])
        filled[k] += n
    offset = F.element_at(F.expr(f"array({','.join(f'{n}L' for n in before)})"), F.col("vslot") + 1)
    return rows.selectExpr(
        "*", "row_number() OVER (PARTITION BY vslot ORDER BY doc_id, text_crc32, size) AS place"
    ).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        slot_map.shard(F.col("vslot")).alias("shard"),
        (offset + F.col("place") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "vslot",
    )
