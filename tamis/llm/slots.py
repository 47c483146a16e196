"""Sharding by fixed virtual slots.

Every record hashes, by id and text, into one of thousands of slots, for ever; so an id that
many rows share makes no hot slot. A slot map says which shard holds a slot. It is stored
with its versions: rebalancing reads the newest one, edits as few slots as it can, and
appends the edited map as the next version. Rows never move but with their slot. The map is
one row a slot, so it is small whatever the table's size and may be broadcast.

The map that :func:`rebalance` edits keeps the law ``bytes``: the shards' sizes come near
equal. Rows alike in id and text fall into one slot, unless they are so many that the slot
would hold more than a 64th of a shard: such rows, which nothing tells apart, are dealt to
all slots by their places in the table.

Defined results: a null text has no bytes, a null id hashes like any other value, an empty
table leaves the map as it is, other columns are not looked at.
"""

from __future__ import annotations

import heapq

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import shared_path, text_or_empty, written

SLOTS = 4096
MAP_SCHEMA = "version int, vslot int, shard int"


def slot_of(*record: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*record), F.lit(slots)).cast("int")


def first_map(shards: int, slots: int = SLOTS) -> list[int]:
    """Version 0: slot by slot round the shards."""
    return [s % shards for s in range(slots)]


def rebalance(shard_of: list[int], size: dict[int, int], shards: int, tolerance: float = 0.0005) -> list[int]:
    """A copy of a slot map, edited until the fullest and emptiest shard differ by tolerance of the mean, or no edit helps.

    An edit moves the slot of the fullest shard that comes nearest to half the gap to the
    emptiest one, or swaps two slots of the two if that comes nearer. A new shard is filled
    with slots of the others alone. Slots of shards that are no more go to the emptiest first.
    """
    out = list(shard_of)
    if max(out, default=0) >= shards:
        room = [sum(size.get(s, 0) for s, k in enumerate(out) if k == j) for j in range(shards)]
        for s in sorted((s for s, k in enumerate(out) if k >= shards), key=lambda s: (-size.get(s, 0), s)):
            out[s] = min(range(shards), key=lambda k: (room[k], k))
            room[out[s]] += size.get(s, 0)
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for s, k in enumerate(out):
        held[k].append((size.get(s, 0), s))
    load = [sum(b for b, _ in h) for h in held]
    mean = sum(load) / shards
    grown = [k for k in range(shards) if not held[k]]
    for _ in range(4 * len(out)):
        top, low = max(range(shards), key=lambda k: (load[k], -k)), min(grown or range(shards), key=lambda k: (load[k], k))
        gap = load[top] - load[low]
        if gap <= max(1, tolerance * mean) or grown and load[low] >= (1 - tolerance) * mean:
            break
        moves = [(abs(gap / 2 - b), s, None, b) for b, s in held[top] if 0 < b < gap]
        best = min(moves, default=None)
        if grown:
            pass  # old shards only give
        elif best is None or best[0] > gap / 4:  # no single slot fits well: swap two
            lows = sorted(held[low])
            for b, s in heapq.nlargest(256, held[top]):
                for c, t in lows:
                    if 0 < b - c < gap and (best is None or abs(gap / 2 - (b - c)) < best[0]):
                        best = (abs(gap / 2 - (b - c)), s, t, b - c)
        if best is None:
            break
        _, s, t, moved = best
        for slot, a, z in ((s, top, low), (t, low, top)):
            if slot is not None:
                held[a].remove((size.get(slot, 0), slot))
                held[z].append((size.get(slot, 0), slot))
                out[slot] = z
        load[top] -= moved
        load[low] += moved
    return out


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, key (a hash of the record) and virtual slot of every row."""
    text = text_or_empty().cast("binary")
    return docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64("doc_id", text).alias("key"),
        slot_of(F.col("doc_id"), text, slots=slots).alias("vslot"),
    )


def dealt(rows: DataFrame, shards: int, slots: int = SLOTS, share: int = 64) -> DataFrame:
    """rows (a written table), those of a key that fills more than 1 / share of a shard dealt to all slots.

    Such keys are at most shards * share, and groups are summed before the shuffle.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    groups = rows.groupBy("key").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    large = [r["key"] for r in groups.where((F.col("n") > 1) & (F.col("b") * shards * share > total)).select("key").collect()]
    if not large:
        return rows
    place = F.pmod(F.xxhash64("key", F.monotonically_increasing_id()), F.lit(slots)).cast("int")
    return written(rows.withColumn("vslot", F.when(F.col("key").isin(large), place).otherwise(F.col("vslot"))), "slot-rows")


def slot_bytes(rows: DataFrame) -> dict[int, int]:
    """Bytes of each slot; as many values as slots at most."""
    return {r["vslot"]: r["b"] for r in rows.groupBy("vslot").agg(F.sum("size").alias("b")).collect()}


def append_map(spark: SparkSession, path: str, version: int, shard_of: list[int]) -> None:
    """Add a version to the map stored at a path."""
    rows = [(version, s, k) for s, k in enumerate(shard_of)]
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """The stored map: one row a version and slot."""
    return spark.read.schema(MAP_SCHEMA).parquet(path)


def newest(stored: DataFrame) -> tuple[int, list[int]]:
    """Number and slots of the last version; one value a slot comes to the driver."""
    version = stored.agg(F.max("version")).first()[0]
    return version, [r["shard"] for r in stored.where(F.col("version") == version).orderBy("vslot").collect()]


def place(rows: DataFrame, stored: DataFrame, version: int) -> DataFrame:
    """Each row's shard under one version of the map, and its gapless place among the shard's rows.

    Rows are numbered within their slot; a slot's first number is the count of the rows in
    the shard's slots before it. Both tables beside the rows have one row a slot.
    """
    current = stored.where(F.col("version") == version).select("vslot", "shard")
    counts = rows.groupBy("vslot").agg(F.count("*").alias("n"))
    per_slot = F.broadcast(current).join(counts, "vslot", "left")
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    first = per_slot.select("vslot", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    numbered = rows.withColumn("nth", F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")) - 1)
    joined = numbered.join(F.broadcast(first), "vslot")
    return joined.select("doc_id", "size", "text_crc32", "vslot", F.col("shard").cast("int").alias("shard"), (F.col("first") + F.col("nth")).cast("long").alias("slot"))


def shard(docs: DataFrame, shards: int = 8, slots: int = SLOTS, map_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows with their shards under a rebalanced map, and the stored map with all its versions.

    map_path: where the map is stored; without it, or at a path without a map, a new one begins
    with version 0. A version is only added where the edited map differs from the last one.
    A stored map keeps the number of slots that it began with, whatever ``slots`` says; with fewer
    shards than before the slots of the last ones are dealt to the others.
    """
    spark = docs.sparkSession
    path = map_path or shared_path(spark, "slot-map")
    try:
        version, last = newest(read_map(spark, path))
    except AnalysisException:  # no such path
        version, last = 0, first_map(shards, slots)
        append_map(spark, path, version, last)
    slots = len(last)
    rows = dealt(written(sized(docs, slots), "slot-rows"), shards, slots)  # the texts are read once
    edited = rebalance(last, slot_bytes(rows), shards)
    if edited != last:
        version += 1
        append_map(spark, path, version, edited)
    stored = read_map(spark, path)
    return place(rows, stored, version), stored
