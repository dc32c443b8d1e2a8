"""Sharding by fixed virtual slots.

Every record hashes to one of `slots` virtual slots (thousands, a fixed parameter). Records and bytes are summed per
slot, and a versioned table maps slots to shards. Version 0 deals the slots out evenly; rebalancing edits the map,
moving single slots from the fullest to the emptiest shard, and stores the result as the next version. Only the map
changes: a record never changes its slot. The law is `bytes`: sizes are near equal.

The slot is the hash of doc_id and text, so even one doc_id that a third of all rows share spreads over slots. Equal texts
under different ids are parted likewise. A row that is repeated so often that it would fill a slot (one in HEAVY_ROWS of
all rows) is dealt over all slots by its place in the table; of equal rows none is told from another, so which one lies
where says nothing. A null text has no bytes, a null doc_id hashes like a value of its own, repeated rows are placed one by
one, very long texts count with all their bytes, ties in a slot are equal rows, an empty table gives an empty result, and
further columns, whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, fresh_path

SLOTS = 4096
RECORD_BYTES = 8
#: A row is repeated too often for one slot if it is more than one in so many of all rows.
HEAVY_ROWS = 10_000


@dataclass(frozen=True)
class SlotMap:
    """shard_of[s] is the shard of slot s."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    @staticmethod
    def first(slots: int, shards: int) -> SlotMap:
        return SlotMap(0, shards, tuple(s % shards for s in range(slots)))

    def loads(self, weights: list[int]) -> list[int]:
        out = [0] * self.shards
        for s, w in enumerate(weights):
            out[self.shard_of[s]] += w
        return out

    def rebalanced(self, weights: list[int], shards: int | None = None) -> SlotMap:
        """The next version: move one slot at a time from the fullest shard to the emptiest, the one that brings them
        closest, while that lowers their difference. More shards than before start empty. Slots are bounded, so this
        runs on the driver."""
        shards = shards or self.shards
        shard_of = list(self.shard_of)
        held: list[list[int]] = [[] for _ in range(shards)]
        load = [0] * shards
        for s, k in enumerate(shard_of):
            held[k].append(s)
            load[k] += weights[s]
        for _ in range(8 * len(shard_of)):
            full, low = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
            gap = load[full] - load[low]
            fit = min((s for s in held[full] if 0 < weights[s] < gap), key=lambda s: (abs(gap - 2 * weights[s]), s), default=None)
            if fit is None or abs(gap - 2 * weights[fit]) >= gap:
                break
            held[full].remove(fit)
            held[low].append(fit)
            shard_of[fit] = low
            load[full] -= weights[fit]
            load[low] += weights[fit]
        return SlotMap(self.version + 1, shards, tuple(shard_of))

    def frame(self, spark: SparkSession) -> DataFrame:
        listed = ",".join(map(str, self.shard_of))
        return spark.sql(f"SELECT {self.version} AS version, {self.shards} AS shards, CAST(pos AS INT) AS vslot, CAST(col AS INT) AS shard FROM (SELECT posexplode(array({listed})))")

    def save(self, spark: SparkSession, path: str) -> None:
        """Append this version to the table at path."""
        self.frame(spark).coalesce(1).write.mode("append").partitionBy("version").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """The given version of the table at path, or its newest."""
        table = spark.read.parquet(path)
        if version is None:
            version = table.agg(F.max("version")).first()[0]
        rows = table.where(F.col("version") == version).orderBy("vslot").collect()
        return SlotMap(version, rows[0]["shards"], tuple(r["shard"] for r in rows))


def sized(docs: DataFrame, slots: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, vslot of every row, kept in the shared folder. Rows that are repeated too often for one
    slot, at most HEAVY_ROWS different ones, are told from their counts and dealt anew."""
    text = F.col(f"`{text_col}`")
    rows = cut(docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + RECORD_BYTES).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.xxhash64(F.col(f"`{id_col}`"), text).alias("h"),
    ))
    counts = rows.groupBy("h").agg(F.count("*").alias("n"))
    heavy = counts.where(F.col("n") * HEAVY_ROWS > rows.count()).where("n > 1").select("h", F.lit(True).alias("often"))
    spread = F.when(F.col("often"), F.xxhash64("h", "_place")).otherwise(F.col("h"))
    placed = rows.withColumn("_place", F.monotonically_increasing_id()).join(F.broadcast(heavy), "h", "left")
    return placed.select("doc_id", "size", "text_crc32", F.pmod(spread, F.lit(slots)).cast("int").alias("vslot"))


def per_slot(records: DataFrame, slots: int) -> tuple[list[int], list[int]]:
    """Bytes and rows by slot: at most one row a slot comes to the driver."""
    size, rows = [0] * slots, [0] * slots
    for r in records.groupBy("vslot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
        size[r["vslot"]], rows[r["vslot"]] = r["b"], r["n"]
    return size, rows


def place(records: DataFrame, slot_map: SlotMap, rows: list[int]) -> DataFrame:
    """records with their shard and their place in it, counted from 0 without gaps. The place is the number of rows in
    the shard's slots before this one, from the bounded counts, and the rank within the slot; so no task holds more
    than some slots."""
    before, used = [0] * len(rows), [0] * slot_map.shards
    for s, k in enumerate(slot_map.shard_of):
        before[s] = used[k]
        used[k] += rows[s]
    spark = records.sparkSession
    listed = ",".join(f"{b}L" for b in before)
    offsets = spark.sql(f"SELECT CAST(pos AS INT) AS vslot, col AS before FROM (SELECT posexplode(array({listed})))")
    bounded = slot_map.frame(spark).select("vslot", "shard").join(F.broadcast(offsets), "vslot")
    rank = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size"))
    return records.withColumn("_rank", rank).join(F.broadcast(bounded), "vslot").withColumn("slot", (F.col("before") + F.col("_rank") - 1).cast("long")).drop("_rank", "before")


def shard(docs: DataFrame, shards: int, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """Every row's doc_id, size, text_crc32, vslot, shard and slot (its place in the shard), with sizes near equal.
    The map's versions are kept at path, in the shared folder if none is given; a map that is already there is edited."""
    spark = docs.sparkSession
    records = sized(docs, slots)
    size, rows = per_slot(records, slots)
    if path is None:
        path = fresh_path(spark, "slot-map")
        SlotMap.first(slots, shards).save(spark, path)
    SlotMap.load(spark, path).rebalanced(size, shards).save(spark, path)
    return place(records, SlotMap.load(spark, path), rows)
