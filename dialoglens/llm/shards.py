"""Sharding over fixed virtual slots.

A record belongs for ever to one of `n_slots` virtual slots (a hash of its id). Shards own slots, and the
slot-to-shard map is a small versioned table: growing or rebalancing edits the map and moves whole slots, no record is
hashed anew. The first map packs slots by their bytes, so shards are near equal in bytes.

Defined results: a NULL text has no bytes and the CRC of the empty text; a record without id is placed by its text;
rows repeated with one id share the slot; an empty table gives no rows and a map that deals the empty slots round.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from dialoglens.session import fresh_path, materialize

N_SLOTS = 16_384
ROW_OVERHEAD = 16

MAP_SCHEMA = "version int, slot int, shard int, first long"


@dataclass(frozen=True)
class SlotMap:
    """One version of the map; `owner[slot]` is the shard. Its size depends on the number of slots alone."""

    version: int
    n_shards: int
    owner: tuple[int, ...]

    def loads(self, slot_bytes: list[int]) -> list[int]:
        out = [0] * self.n_shards
        for slot, shard in enumerate(self.owner):
            out[shard] += slot_bytes[slot]
        return out


def first_map(slot_bytes: list[int], n_shards: int) -> SlotMap:
    """Give each slot, largest first, to the shard with the fewest bytes; slots without bytes go round."""
    owner = [0] * len(slot_bytes)
    heap = [(0, shard) for shard in range(n_shards)]
    turn = 0
    for slot in sorted(range(len(slot_bytes)), key=lambda s: (-slot_bytes[s], s)):
        if slot_bytes[slot] == 0:
            owner[slot] = turn % n_shards
            turn += 1
            continue
        load, shard = heap[0]
        owner[slot] = shard
        heapq.heapreplace(heap, (load + slot_bytes[slot], shard))
    return SlotMap(1, n_shards, tuple(owner))


def rebalance(current: SlotMap, slot_bytes: list[int], n_shards: int) -> SlotMap:
    """Next version of the map for today's bytes: shards above the mean hand slots to those below it.

    A slot moves only where the giver stays at or above the mean, so nothing moves between full shards, and growing by
    one shard moves slots into that shard alone. Shards that no longer exist hand over all their slots.
    """
    owner = list(current.owner)
    kept = min(n_shards, current.n_shards)
    mean = sum(slot_bytes) / n_shards
    loads = [0] * n_shards
    owned: list[list[int]] = [[] for _ in range(n_shards)]
    homeless = []
    for slot, shard in enumerate(owner):
        if shard < kept:
            loads[shard] += slot_bytes[slot]
            owned[shard].append(slot)
        else:
            homeless.append(slot)
    below = [(loads[s], s) for s in range(n_shards) if loads[s] < mean]
    heapq.heapify(below)
    for shard in range(kept):
        for slot in sorted(owned[shard], key=lambda s: (-slot_bytes[s], s)):
            if slot_bytes[slot] and loads[shard] - slot_bytes[slot] >= mean:
                loads[shard] -= slot_bytes[slot]
                homeless.append(slot)
    for slot in sorted(homeless, key=lambda s: (-slot_bytes[s], s)):
        if not below:
            below = [(load, s) for s, load in enumerate(loads)]
            heapq.heapify(below)
        _, shard = heapq.heappop(below)
        owner[slot] = shard
        loads[shard] += slot_bytes[slot]
        heapq.heappush(below, (loads[shard], shard))
    return SlotMap(current.version + 1, n_shards, tuple(owner))


def first_positions(slot_map: SlotMap, slot_rows: list[int]) -> list[int]:
    """Position inside its shard at which each slot begins: slots of a shard follow each other by number."""
    used = [0] * slot_map.n_shards
    out = []
    for slot, shard in enumerate(slot_map.owner):
        out.append(used[shard])
        used[shard] += slot_rows[slot]
    return out


def save_map(spark: SparkSession, slot_map: SlotMap, slot_rows: list[int], path: str) -> None:
    """Append this version to the map table at `path`."""
    first = first_positions(slot_map, slot_rows)
    rows = [(slot_map.version, slot, shard, first[slot]) for slot, shard in enumerate(slot_map.owner)]
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(MAP_SCHEMA).parquet(path).filter(F.col("version") == version).drop("version")


def record_sizes(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual slot of every record."""
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_OVERHEAD
    known = F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.col("doc_id").cast("long")))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), crc.alias("text_crc32"),
        F.pmod(F.coalesce(known, F.xxhash64(crc, size)), F.lit(n_slots)).cast("int").alias("virtual_slot"),
    )


def slot_totals(records: DataFrame, n_slots: int) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot. One row for each slot comes to the driver, `n_slots` at most."""
    sizes, rows = [0] * n_slots, [0] * n_slots
    for r in records.groupBy("virtual_slot").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect():
        sizes[r.virtual_slot], rows[r.virtual_slot] = r["size"], r["rows"]
    return sizes, rows


def place(records: DataFrame, slot_table: DataFrame) -> DataFrame:
    """Add `shard` and `slot`, the position in the shard. The map has a fixed number of rows, so it is broadcast.

    Rows are numbered inside their virtual slot, of which there are thousands, and never inside a whole shard.
    """
    by = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    placed = records.join(F.broadcast(slot_table.withColumnRenamed("slot", "virtual_slot")), "virtual_slot")
    return placed.withColumn("slot", F.col("first") + F.row_number().over(by) - 1).drop("first")


def shard_documents(docs: DataFrame, n_shards: int = 40, n_slots: int = N_SLOTS, map_path: str | None = None) -> DataFrame:
    """Place all documents by version 1 of a new map, and say where version 2, with a shard more, puts them.

    Both versions are stored at `map_path`.
    """
    spark = docs.sparkSession
    map_path = map_path or fresh_path(spark, "slot-map")
    records = materialize(record_sizes(docs, n_slots), "record-sizes")
    sizes, rows = slot_totals(records, n_slots)
    first = first_map(sizes, n_shards)
    grown = rebalance(first, sizes, n_shards + 1)
    save_map(spark, first, rows, map_path)
    save_map(spark, grown, rows, map_path)
    later = load_map(spark, map_path, 2).select(F.col("slot").alias("virtual_slot"), F.col("shard").alias("next_shard"))
    return (
        place(records, load_map(spark, map_path, 1))
        .join(F.broadcast(later), "virtual_slot")
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
            F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "next_shard",
        )
    )
