"""Sharding through fixed virtual slots.

Records hash into some thousands of slots whose number never changes. A small versioned map gives each slot its
shard: the first version spreads the slots' bytes evenly, later ones are edits of the one before that move as few
bytes as the new balance needs.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import exists, shared_dir

SLOTS = 4096
SHARDS = 24
#: Bytes that a record has besides its text.
OVERHEAD = 8
#: Ranges of positions by which the rows of a shard are counted off, so that no task holds a whole shard.
RANGES = 256
#: Rows of a slot that are counted off together, about.
PART_ROWS = 100_000


@dataclass(frozen=True)
class SlotMap:
    """Shard of each slot, as of a version."""

    version: int
    shards: int
    shard: tuple[int, ...]

    def save(self, spark: SparkSession, path: str) -> None:
        """Append this version to the table of versions at ``path``."""
        rows = [(self.version, self.shards, i, s) for i, s in enumerate(self.shard)]
        spark.createDataFrame(rows, "version int, shards int, virtual_slot int, shard int").coalesce(1).write.mode("append").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """A version of the map, the latest unless it is named."""
        t = spark.read.parquet(path)
        version = t.agg(F.max("version")).first()[0] if version is None else version
        rows = sorted((r.virtual_slot, r.shard, r.shards) for r in t.where(F.col("version") == version).distinct().collect())
        return SlotMap(version, rows[0][2], tuple(r[1] for r in rows))


def first_map(loads: list[int], shards: int) -> SlotMap:
    """Slots by falling bytes, each to the shard with the fewest bytes so far."""
    heap = [(0, s) for s in range(shards)]
    shard = [0] * len(loads)
    for i in sorted(range(len(loads)), key=lambda i: (-loads[i], i)):
        b, s = heap[0]
        shard[i] = s
        heapq.heapreplace(heap, (b + max(loads[i], 1), s))
    return SlotMap(1, shards, tuple(shard))


def rebalanced(old: SlotMap, loads: list[int], shards: int | None = None, slack: float = 0.01) -> SlotMap:
    """The next version for new loads or more shards: slots leave the fullest shard for the emptiest while that evens them out.

    Stops when every shard is within ``slack`` of the mean or no move helps. Nothing else moves.
    """
    shards = shards or old.shards
    if shards < old.shards:
        raise ValueError("shards can be added, not removed")
    shard, total = list(old.shard), [0] * shards
    own: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for i, s in enumerate(shard):
        total[s] += loads[i]
        own[s].append((loads[i], i))
    mean = sum(loads) / shards
    for _ in range(len(shard)):
        high, low = max(range(shards), key=total.__getitem__), min(range(shards), key=total.__getitem__)
        if total[high] - mean <= slack * mean and mean - total[low] <= slack * mean:
            break
        room = min(total[high] - mean, mean - total[low]) if total[low] < mean < total[high] else 0
        # the slot nearest to what has to move, among those that leave the two nearer to each other
        fit = [x for x in own[high] if 0 < x[0] < total[high] - total[low]]
        if not fit:
            break
        load, i = min(fit, key=lambda x: (abs(x[0] - room), x[1]))
        own[high].remove((load, i))
        own[low].append((load, i))
        total[high] -= load
        total[low] += load
        shard[i] = low
    return SlotMap(old.version + 1, shards, tuple(shard))


def current_map(spark: SparkSession, path: str, loads: list[int], shards: int) -> SlotMap:
    """The stored map at ``path``, edited for these loads: its first version is made where there is none, a new one is added where slots move.

    A version is settled, so the same loads find it again as it is.
    """
    if not exists(spark, path):
        new = replace(rebalanced(first_map(loads, shards), loads), version=1)
        new.save(spark, path)
        return new
    old = SlotMap.load(spark, path)
    new = rebalanced(old, loads, max(shards, old.shards))
    if new.shard == old.shard and new.shards == old.shards:
        return old
    new.save(spark, path)
    return new


def map_path(spark: SparkSession, table: str, use: str) -> str:
    """Where the map of a table's shards for one use is kept, in the shared folder."""
    return f"{shared_dir(spark)}/siftwright/maps/{use}-{hashlib.sha256(table.encode()).hexdigest()[:16]}"


def _parts() -> dict[str, Column]:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    crc = F.crc32(F.encode(text, "UTF-8"))
    size = (F.octet_length(text) + OVERHEAD).cast("long")
    return {"size": size, "text_crc32": crc, "virtual_slot": F.pmod(F.xxhash64("doc_id", crc, size), F.lit(SLOTS)).cast("int")}


def slot_loads(docs: DataFrame) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot; SLOTS numbers each, whatever the table."""
    rows = docs.select(F.col("virtual_slot"), "size").groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    loads, counts = [0] * SLOTS, [0] * SLOTS
    for r in rows:
        loads[r.virtual_slot], counts[r.virtual_slot] = r.b, r.n
    return loads, counts


def _counted_off(d: DataFrame, group: str, part: str, order: list[str]) -> DataFrame:
    """``d`` with ``place``: from 0 and gapless within ``group``, by its parts and in ``order`` inside them. A task holds one part."""
    n = d.groupBy(group, part).agg(F.count("*").alias("n"))
    before = n.select(group, part, (F.sum("n").over(Window.partitionBy(group).orderBy(part)) - F.col("n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy(group, part).orderBy(*order)) - 1
    return d.withColumn("_in", place).join(before, [group, part]).withColumn("place", (F.col("_before") + F.col("_in")).cast("long")).drop("_before", "_in", part)


def shard_documents(
    docs: DataFrame, shards: int = SHARDS, known: SlotMap | str | None = None, carry: bool = False, order: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Every row's shard, and its place in it, gapless from 0.

    Reads ``doc_id`` and ``text`` of ``docs`` and returns doc_id, size, text_crc32, law (``bytes``: the shards'
    sums of sizes are near equal), shard, slot, grown_shard (null), virtual_slot and map_version; with ``carry``
    all columns of ``docs`` come first, any by those names as ``own_`` and its name. A null text has no bytes and
    the checksum of the empty one. Null ids and repeated rows are rows like any other; rows alike in id and text
    share a virtual slot, which stays in one shard, and are counted off together.

    ``known`` is a map, or the path of a table of its versions: the latest is used, and a new one is added if these
    documents need it. Without it a first map is made for ``docs``. ``order`` adds ``position`` (whole, from 0, unique, the
    same each time) to the rows, and places follow it; without it they follow virtual slots and a hash of the ids.
    """
    spark = docs.sparkSession
    made = ["size", "text_crc32", "law", "shard", "slot", "grown_shard", "virtual_slot", "map_version"]
    inner = ["position", "place"]
    d = docs.withColumnsRenamed({c: f"own_{c}" for c in (*made, *inner) if c in docs.columns}).withColumns(_parts())
    loads, counts = slot_loads(d)
    if isinstance(known, str):
        known = current_map(spark, known, loads, shards)
    known = known or first_map(loads, shards)
    start, seen = [], [0] * known.shards
    for i, s in enumerate(known.shard):
        start.append(seen[s])
        seen[s] += counts[i]
    rows = [(i, s, start[i], known.version) for i, s in enumerate(known.shard)]
    table = F.broadcast(spark.createDataFrame(rows, "virtual_slot int, shard int, _start long, map_version int"))  # SLOTS rows
    if not carry:
        d = d.select("doc_id", "size", "text_crc32", "virtual_slot")
    kept = [c for c in d.columns if c not in made]
    if order is None:
        parts = max(1, sum(counts) // (SLOTS * PART_ROWS))
        d = d.withColumn("_part", F.pmod(F.xxhash64("text_crc32", "doc_id", F.lit(3)), F.lit(parts)))
        out = _counted_off(d, "virtual_slot", "_part", ["doc_id", "text_crc32", "size"]).join(table, "virtual_slot").withColumn("slot", F.col("_start") + F.col("place"))
    else:
        d = order(d).join(table, "virtual_slot").withColumn("_range", F.expr(f"position div {max(1, -(-sum(counts) // RANGES))}"))
        out = _counted_off(d, "shard", "_range", ["position"]).withColumn("slot", F.col("place"))
    back = [F.col(c).alias(c.removeprefix("own_") if c.removeprefix("own_") in inner else c) for c in kept]
    return out.select(*back, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")
