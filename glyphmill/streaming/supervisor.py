"""Keeping an index up to date: changes are drained, coalesced and applied batch by batch, with a whole scan now and then."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from ..operators import store
from ..operators.tables import BUCKETS, Table
from .changes import sessions

#: Seconds between whole scans, if changes are watched and if they are not.
WATCHED, POLLING = 300.0, 30.0


def touched(changes: DataFrame) -> DataFrame:
    """Every (root, path) that changes (root, path, kind, from_path, ts, seq) touch, once."""
    named = changes.withColumn("path", F.to_json(F.struct("root", "path")))
    settled = sessions(named, 2**62, None).select(F.from_json("path", "root string, path string").alias("at")).select("at.*")
    left = changes.where("from_path IS NOT NULL").select("root", F.col("from_path").alias("path"))
    return cut(settled.unionByName(left).distinct())


def apply(files: DataFrame, changes: DataFrame, read: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """files (root, path, content_hash) after changes. Every changed path is looked up by read: (root, path) -> files that
    are there now. So the last state counts, applying twice changes nothing, and a path that is told as changed but is gone
    goes."""
    paths = touched(changes)
    return store.upsert(store.delete(files, paths, ["root", "path"]), read(paths).select(*files.columns), ["root", "path"])


class Supervisor:
    """The function of every batch. State is a keyed table in a folder that all share: batch n builds on the newest version
    below n and writes n, so a batch that failed is played again from the stream's checkpoint with nothing lost or done
    twice. A batch rewrites the buckets of the paths it touches; a scan, those of the files that differ. A scan is due when
    its time has passed; one that fails stays due. What touches nothing writes nothing. Versions before the last few
    expire."""

    def __init__(self, path: str, schema: str, read: Callable[[DataFrame], DataFrame], scan: Callable[[], DataFrame], every: float = WATCHED, clock: Callable[[], float] = time.monotonic, buckets: int = BUCKETS, keep: int = 3) -> None:
        self.path, self.schema, self.read, self.scan, self.every, self.clock = path, schema, read, scan, every, clock
        self.buckets, self.keep = buckets, keep
        self.scanned: float | None = None

    def table(self, spark) -> Table:
        return Table(spark, self.path, self.schema, ["root", "path"], self.buckets)

    def files(self, spark) -> DataFrame:
        """The newest version; without any, no rows."""
        return self.table(spark).read()

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        now = self.clock()
        due = self.scanned is None or now - self.scanned >= self.every
        if not due and batch.isEmpty():
            return
        table = self.table(batch.sparkSession)
        if due:  # a scan sees every file, so it stands for whatever the batch tells
            old, there = table._of(table.manifest(below=batch_id)[1]), cut(self.scan())
            there = there.select(*old.columns)
            table.merge(there.exceptAll(old), store.delete(old, there, table.keys), batch_id)
            self.scanned = now
        else:
            paths = touched(batch)
            there = cut(self.read(paths))
            table.merge(there, store.delete(paths, there, table.keys), batch_id)
        table.expire(self.keep)


def supervise(changes: DataFrame, step: Supervisor, checkpoint: str, **trigger):
    """changes: a streaming frame. Trigger by processingTime to run on, or availableNow for what is there."""
    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()
