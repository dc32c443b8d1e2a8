"""Metric rollups as a stream: events are aggregated by hour as they arrive; a watermark bounds the state."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import store
from ..operators.metrics import rollup
from ..operators.tables import BUCKETS, Table

#: Events that wait to be written, and events that a slow subscriber can still read.
PENDING, SLOTS = 4_096, 256


def hourly(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """A streaming frame of hourly sums; events later than lateness are dropped with their state."""
    return (
        events.withWatermark("ts", lateness).groupBy(F.window("ts", "1 hour").alias("w"), "operation")
        .agg(F.count("*").alias("operations"), F.sum("input_tokens").alias("input_tokens"))
        .select(F.col("w.start").alias("bucket"), "operation", "operations", "input_tokens")
    )


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    return stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


ROLLUP_KEYS = ["granularity", "bucket", "project", "operation"]


def rollup_table(spark: SparkSession, path: str, schema: str, buckets: int = BUCKETS) -> Table:
    return Table(spark, path, schema, ROLLUP_KEYS, buckets)


def added(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rollups of the same key as one: sums added, the greatest kept."""
    sums = [c for c in new.columns if c not in (*ROLLUP_KEYS, "max_duration_ms")]
    return old.unionByName(new).groupBy(*ROLLUP_KEYS).agg(*[F.sum(c).alias(c) for c in sums], F.max("max_duration_ms").alias("max_duration_ms")).select(*new.columns)


def refresh_each_batch(events: DataFrame, path: str, checkpoint: str, granularity: str = "hourly", buckets: int = BUCKETS, keep: int = 3):
    """Adds each batch's rollups to a keyed table at path, of which only the buckets of the batch's own keys are rewritten; a
    batch that is played again changes nothing. Read it by rollup_table."""
    def merge(batch: DataFrame, batch_id: int) -> None:
        new = rollup(batch, granularity)
        table = rollup_table(batch.sparkSession, path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema.fields), buckets)
        table.merge(new, version=batch_id, joined=added)
        table.expire(keep)

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Collector:
    """Events of this process that wait to be written: the oldest go when there is no room, and are counted. What a flush
    could not write waits again, before newer events. For a few events a second; bulk events come as frames."""

    def __init__(self, schema: str, capacity: int = PENDING, enabled: bool = True) -> None:
        self.schema, self.capacity, self.enabled = schema, max(1, capacity), enabled
        self.waiting: deque[tuple] = deque()
        self.dropped = 0

    def record(self, event: tuple) -> None:
        if self.enabled:
            self.waiting.append(event)
            self._fit()

    def flush(self, spark: SparkSession, path: str) -> int:
        """Appends all that wait, or nothing; how many were written."""
        events, self.waiting = list(self.waiting), deque()
        if not events:
            return 0
        try:
            store.append(spark.createDataFrame(events, self.schema).coalesce(1), path)
        except Exception:
            self.waiting.extendleft(reversed(events))
            self._fit()
            raise
        return len(events)

    def _fit(self) -> None:
        while len(self.waiting) > self.capacity:
            self.waiting.popleft()
            self.dropped += 1


def page(records: DataFrame, levels: tuple[str, ...], after: int, limit: int) -> DataFrame:
    """The newest records (seq, level) of some levels behind seq after, in order."""
    return records.where(F.col("level").isin(*levels) & (F.col("seq") > after)).orderBy(F.desc("seq")).limit(limit).orderBy("seq")


def since(events: DataFrame, seen: int, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """What a subscriber that has read up to seq seen gets, in order: of the newest slots events those it does not know;
    and (lost), how many it will never see."""
    newer = events.where(F.col("seq") > seen)
    page = newer.orderBy(F.desc("seq")).limit(slots)
    lost = newer.agg(F.greatest(F.count("*") - slots, F.lit(0)).cast("long").alias("lost"))
    return page.orderBy("seq"), lost
