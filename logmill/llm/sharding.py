"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

A record is hashed into one of some thousands of virtual slots for good.  Bytes are summed per slot, and only
the small map from slots to shards is made, stored under a version, and edited when the shards get uneven.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import numbered, stored, whole_text

SLOTS = 4096
MAP_SCHEMA = "version int, virtual_slot int, shard int"


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot), one row for each row of ``docs``.

    Size is UTF-8 bytes plus 1; a null text counts as empty.  The slot depends on doc_id (null allowed) and the
    text's checksum, so that rows that share an id, or a text, still spread.  Repeated rows stay, in one slot.
    """
    text = whole_text()
    return docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
    ).withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int"))


def slot_sizes(rows: DataFrame) -> DataFrame:
    """Bytes and rows per virtual slot: at most as many rows as there are slots."""
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))


def first_map(sizes: dict[int, int], shards: int) -> dict[int, int]:
    """Slots, largest first, each to the shard with the fewest bytes; ties by slot and shard number."""
    loads = [(0, shard) for shard in range(shards)]
    placed = {}
    for slot, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(loads)
        placed[slot] = shard
        heapq.heappush(loads, (load + size, shard))
    return placed


def rebalanced(old: dict[int, int], sizes: dict[int, int], shards: int, tolerance: float = 0.01) -> dict[int, int]:
    """Edit a map with few moves: slots go from the fullest to the emptiest shard while that narrows the gap.

    New slots and slots of shards that no longer exist are placed first.
    """
    new = {slot: old[slot] for slot in sizes if 0 <= old.get(slot, -1) < shards}
    loads = [0] * shards
    members: list[list[int]] = [[] for _ in range(shards)]
    for slot in sorted(new):
        loads[new[slot]] += sizes[slot]
        members[new[slot]].append(slot)
    for slot in sorted(sizes.keys() - new.keys(), key=lambda x: (-sizes[x], x)):
        shard = min(range(shards), key=lambda k: (loads[k], k))
        new[slot], loads[shard] = shard, loads[shard] + sizes[slot]
        members[shard].append(slot)
    mean = sum(sizes.values()) / shards
    for _ in range(len(sizes) * 4):
        full = max(range(shards), key=lambda k: (loads[k], -k))
        empty = min(range(shards), key=lambda k: (loads[k], k))
        gap = loads[full] - loads[empty]
        fits = [slot for slot in members[full] if 0 < sizes[slot] < gap]
        if gap <= tolerance * mean or not fits:
            break
        slot = min(fits, key=lambda x: (abs(gap - 2 * sizes[x]), x))
        members[full].remove(slot)
        members[empty].append(slot)
        loads[full] -= sizes[slot]
        loads[empty] += sizes[slot]
        new[slot] = empty
    return new


def write_map(spark: SparkSession, path: str, slot_map: dict[int, int], version: int) -> None:
    """Append one version of the map to the table at ``path``."""
    rows = [(version, slot, shard) for slot, shard in sorted(slot_map.items())]
    # one row even for an empty table, so that the version is there
    spark.createDataFrame(rows or [(version, -1, 0)], MAP_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(virtual_slot, shard) of one version, the latest by default."""
    table = spark.read.schema(MAP_SCHEMA).parquet(path)
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    return table.where(F.col("version") == F.lit(version)).select("virtual_slot", "shard")


def shard_documents(
    docs: DataFrame, shards: int = 16, slots: int = SLOTS, map_path: str | None = None, version: int | None = None
) -> DataFrame:
    """Every row with its shard (law ``bytes``: near equal sizes) and its place there, gapless from 0.

    The slot map is stored at ``map_path`` (default: a fresh table in the shared folder) and read from there.  With
    ``version``, that version is edited with few moves and stored as the next one; else version 1 is made.

    Places follow (virtual slot, doc_id, checksum), nulls first; repeated rows get neighbouring places in any
    order.  An empty table gives an empty result.  Other columns are ignored.  A record larger than a shard's
    share cannot be split and makes its shard the fullest.
    """
    spark = docs.sparkSession
    rows = stored(records(docs, slots), "shard-records")
    counted = slot_sizes(rows).collect()  # at most ``slots`` rows
    sizes = {r.virtual_slot: r.bytes for r in counted}
    path = map_path or scratch_path(spark, "slot-map")
    if version is None:
        slot_map, now = first_map(sizes, shards), 1
    else:
        old = {r.virtual_slot: r.shard for r in read_map(spark, path, version).collect()}  # at most ``slots`` rows
        # a slot that is empty now keeps its place for later
        slot_map, now = old | rebalanced(old, sizes, shards), version + 1
    write_map(spark, path, slot_map, now)
    starts = [0] * (shards + 1)
    for r in counted:
        starts[slot_map[r.virtual_slot] + 1] += r.n
    for shard in range(shards):
        starts[shard + 1] += starts[shard]
    first = spark.createDataFrame(list(enumerate(starts[:shards])), "shard int, _start long")
    # at most ``slots`` rows
    table = F.broadcast(read_map(spark, path, now).join(F.broadcast(first), "shard"))
    placed = rows.join(table, "virtual_slot")
    order = [F.col(c) for c in ("shard", "virtual_slot", "doc_id", "text_crc32")]
    return numbered(placed, order, "_row").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_row") - F.col("_start")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        F.lit(now).alias("map_version"),
    )
