"""Change feeds: coalescing, debouncing and rename pairing, over batches and as streams.

Changes have path, kind (created, modified, deleted, renamed), from_path and ts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import is_ignored

QUIET_MS, LONGEST_MS, RENAME_MS = 300, 5_000, 200
#: Rename times that a span of time is long in which a root's moves meet.
SPANS = 50
#: Shards of the paths that wait in a debounced stream.
SHARDS = 64


def merged(first: Column, then: Column) -> Column:
    """One kind for two changes in a row: a new file that changes is new, one that goes and comes has changed, a
    renamed one that changes is still renamed; else the later one."""
    return (
        F.when((first == "created") & (then == "modified"), "created")
        .when((first == "deleted") & (then == "created"), "modified")
        .when((first == "renamed") & (then == "modified"), "renamed")
        .otherwise(then)
    )


def merged_kind(first: str, then: str) -> str:
    return {("created", "modified"): "created", ("deleted", "created"): "modified", ("renamed", "modified"): "renamed"}.get((first, then), then)


def sessions(changes: DataFrame, quiet_ms: int = QUIET_MS, longest_ms: int | None = LONGEST_MS) -> DataFrame:
    """(path, first_seen, last_seen, changes, kind): bursts of a path, ended by a quiet time or when longest_ms have
    passed since the first change; the next change then begins a burst, and its own longest_ms. Changes are dealt by path
    and sorted, and a task folds them as they stream by, so a burst of any size is a few numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None  # path, first, last, changes, kind
        done: list[list] = []

        def out() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) if done else [()] * 5
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["path", "first", "last", "changes", "kind"])
            done.clear()
            return batch

        for batch in batches:
            for path, kind, at in zip(*(batch.column(c).to_pylist() for c in ("path", "kind", "at")), strict=True):
                ms = at // 1000
                if held and held[0] == path and ms - held[2] // 1000 <= quiet_ms and (longest_ms is None or ms - held[1] // 1000 <= longest_ms):
                    held[2:] = [at, held[3] + 1, merged_kind(held[4], kind)]
                else:
                    if held:
                        done.append(held)
                    held = [path, at, at, 1, kind]
            yield out()
        if held:
            done.append(held)
        yield out()

    rows = changes.select("path", "kind", F.unix_micros("ts").alias("at"), "seq").repartition("path").sortWithinPartitions("path", "at", "seq").select("path", "kind", "at")
    folded = rows.mapInArrow(run, "path string, first long, last long, changes long, kind string")
    return folded.select("path", F.timestamp_micros("first").alias("first_seen"), F.timestamp_micros("last").alias("last_seen"), "changes", "kind")


def affected_paths(changes: DataFrame) -> DataFrame:
    """Every path that a change touches; a rename touches two."""
    return changes.select(F.explode(F.array_compact(F.array("from_path", "path"))).alias("path")).distinct()


def batch_order(changes: DataFrame, at: str = "ts", limit: int | None = None) -> DataFrame:
    """(path, last_seen): a batch's paths, the latest touched first, then by path; so what is being edited is done first."""
    rows = changes.groupBy("path").agg(F.max(at).alias("last_seen")).orderBy(F.desc("last_seen"), "path")
    return rows if limit is None else rows.limit(limit)


def translated(events: DataFrame, rules: list[tuple[str, bool]]) -> DataFrame:
    """events: root, event, paths, ts, seq, as a watcher of files tells them. (root, path, kind, from_path, ts, seq,
    place) for pair_renames: paths that rules ignore go first, so half of a rename into an ignored place is a plain
    change. New folders, metadata, reads and what has no class tell nothing; a rename with both ends is one row."""
    kept = events.withColumn("paths", F.filter("paths", lambda p: ~is_ignored(p, rules)))
    kind = F.col("event")
    whole = (kind == "renamed_both") & (F.size("paths") >= 2)
    told = (
        F.when(kind.isin("created", "modified"), kind)
        .when(kind.isin("removed", "removed_folder"), "deleted")
        .when(kind == "renamed_from", "departed")
        .when(kind == "renamed_to", "arrived")
        .when(whole, "renamed")
        .when(kind == "renamed_both", "modified")
    )
    places = F.when(whole, F.slice("paths", 2, 1)).otherwise(F.col("paths"))
    rows = kept.where(told.isNotNull()).select("root", told.alias("kind"), F.when(whole, F.get("paths", F.lit(0))).alias("from_path"), "ts", "seq", F.posexplode(places).alias("place", "path"))
    return rows.select("root", "path", "kind", "from_path", "ts", "seq", "place")


def pair_renames(events: DataFrame, within_ms: int = RENAME_MS) -> DataFrame:
    """Departures and arrivals in order of time, whatever else happens between them: one departure waits at a time, the
    next arrival takes it, and is a rename if that is within the time. A departure that no move follows within the time is
    a deletion; one that another departure overtakes while it waits is forgotten; other arrivals are creations. Events of
    one seq go by place, if they have one, those without a seq last; other changes keep their from_path. A move without a
    time is within no other's: it is told by itself.

    Only moves within the time of each other matter to each other, so they meet in spans of time: a root's moves of one
    span, and those just outside of it, are a window, and a busy root is many."""
    span = max(SPANS * within_ms, 60_000)
    millis = lambda c: F.call_function("div", F.unix_micros(c), F.lit(1000))  # noqa: E731 (cut toward 1970, as in SQL)
    ms = millis("ts")
    at, into = F.floor(ms / span), F.pmod(ms, F.lit(span))  # times before 1970 are negative
    beside = F.when(into <= within_ms, at - 1).when(into >= span - within_ms, at + 1)
    moving = F.coalesce(F.col("kind").isin("departed", "arrived"), F.lit(False))
    timed = moving & F.col("ts").isNotNull()
    moves = events.where(timed).withColumn("_at", at)
    dealt = moves.withColumn("_span", F.explode(F.array_compact(F.array("_at", beside))))
    w = Window.partitionBy("root", "_span").orderBy("ts", F.asc_nulls_last("seq"), *(["place"] if "place" in events.columns else []))
    near = lambda a, b: (millis(b) - millis(a)) <= within_ms
    tagged = dealt.withColumn("_last", F.lag(F.struct("kind", "path", "ts")).over(w)).withColumn("_next", F.lead(F.struct("kind", "ts")).over(w)).where("_span = _at")
    arrived = F.coalesce((F.col("kind") == "arrived") & (F.col("_last.kind") == "departed") & near(F.col("_last.ts"), F.col("ts")), F.lit(False))
    followed = F.coalesce((F.col("kind") == "departed") & near(F.col("ts"), F.col("_next.ts")), F.lit(False))
    kind = F.when(arrived, "renamed").when(F.col("kind") == "arrived", "created").otherwise("deleted")
    paired = tagged.where(~followed).select("root", "path", kind.alias("kind"), F.when(arrived, F.col("_last.path")).alias("from_path"), "ts", "seq")
    alone = F.when(F.col("kind") == "departed", "deleted").when(moving, "created").otherwise(F.coalesce("kind", F.lit("created")))
    origin = F.when(~moving, F.col("from_path")) if "from_path" in events.columns else F.lit(None).cast("string")
    return paired.unionByName(events.where(~timed).select("root", "path", alone.alias("kind"), origin.alias("from_path"), "ts", "seq"))


def paired(stream: DataFrame, lateness: str = "10 seconds", within_ms: int = RENAME_MS) -> DataFrame:
    """pair_renames as a stream of events (root, path, kind, from_path, ts, seq): a root's state is its one waiting departure,
    and a timer, which fires when the watermark has passed its time, tells it as a deletion. Other changes pass as they
    come. Events of a batch are taken in order of time; a departure still waits when its batch ends. Events that are older
    than the watermark are dropped, so lateness bounds how long one may be under way."""
    from pyspark.sql.streaming import StatefulProcessor

    shape = "root string, path string, kind string, from_path string, ts timestamp, seq long"
    names = [c.split()[0] for c in shape.split(", ")]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names)
        return out.astype({"ts": "datetime64[ns]", "seq": "int64"}).astype({c: object for c in ("root", "path", "kind", "from_path")})

    class Pairing(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle, self.waiting = handle, handle.getValueState("waiting", "path string, ms long, seq long")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            out: list[tuple] = []
            held = self.waiting.get() if self.waiting.exists() else None
            for r in pd.concat(list(rows)).sort_values(["ts", "seq"]).itertuples():
                ms = r.ts.value // 1_000_000
                if r.kind not in ("departed", "arrived"):
                    out.append((key[0], r.path, r.kind, r.from_path, r.ts, r.seq))
                    continue
                alive = held is not None and ms - held[1] <= within_ms
                if held is not None and not alive:
                    out.append((key[0], held[0], "deleted", None, pd.Timestamp(held[1], unit="ms"), held[2]))
                if r.kind == "arrived":
                    out.append((key[0], r.path, "renamed" if alive else "created", held[0] if alive else None, r.ts, r.seq))
                held = (r.path, ms, r.seq) if r.kind == "departed" else None
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if held is None:
                self.waiting.clear()
            else:
                self.waiting.update(held)
                self.handle.registerTimer(held[1] + within_ms + 1)
            yield frame(out)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            if self.waiting.exists():
                path, ms, seq = self.waiting.get()
                self.waiting.clear()
                yield frame([(key[0], path, "deleted", None, pd.Timestamp(ms, unit="ms"), seq)])

        def close(self) -> None:
            pass

    known = stream.select("root", "path", F.coalesce("kind", F.lit("created")).alias("kind"), (F.col("from_path") if "from_path" in stream.columns else F.lit(None).cast("string").alias("from_path")), "ts", "seq")
    return known.withWatermark("ts", lateness).groupBy("root").transformWithStateInPandas(Pairing(), shape, "append", "eventTime")


def debounced(stream: DataFrame, quiet_ms: int = QUIET_MS, longest_ms: int = LONGEST_MS, shards: int = SHARDS) -> DataFrame:
    """A streaming frame that lets a path's change out after a quiet time or when longest_ms have passed since its first, by
    state and processing-time timers: path, kind, changes, first_ms and last_ms, of each release the latest touched first,
    then by path. A change of kind `drain` is the end mark of a shutdown: everything that waits is let out at once, settled
    or not. Paths wait in shards, each a map of its own and one timer for its next deadline; the end mark goes to all."""
    from pyspark.sql.streaming import StatefulProcessor

    shape = {"path": object, "kind": object, "changes": "int64", "first_ms": "int64", "last_ms": "int64"}

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(sorted(rows, key=lambda r: (-r[4], r[0])), columns=list(shape)).astype(shape)

    class Debounce(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle, self.held = handle, handle.getMapState("held", "path string", "kind string, first long, last long, n long")

        def due(self, first: int, last: int) -> int:
            return min(last + quiet_ms, first + longest_ms)

        def release(self, now: int | None) -> list[tuple]:
            """What is due by now (None: all) leaves; a timer waits for the next of the rest."""
            out, rest = [], []
            for (path,), (kind, first, last, n) in list(self.held.iterator()):
                if now is None or self.due(first, last) <= now:
                    out.append((path, kind, n, first, last))
                else:
                    rest.append(self.due(first, last))
            for row in out:
                self.held.removeKey((row[0],))
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if rest:
                self.handle.registerTimer(min(rest))
            return out

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            now, ended = timerValues.getCurrentProcessingTimeInMs(), False
            for pdf in rows:
                for path, change in pdf.sort_values("ts")[["path", "kind"]].itertuples(index=False):
                    if change == "drain":
                        ended = True
                        continue
                    kind, first, _, n = self.held.getValue((path,)) if self.held.containsKey((path,)) else (None, now, now, 0)
                    self.held.updateValue((path,), (merged_kind(kind, change) if kind else change, first, now, n + 1))
            yield frame(self.release(None if ended else now))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            yield frame(self.release(timerValues.getCurrentProcessingTimeInMs()))

        def close(self) -> None:
            pass

    every = F.sequence(F.lit(0), F.lit(shards - 1))
    dealt = stream.select("path", "kind", "ts", F.explode(F.when(F.col("kind") == "drain", every).otherwise(F.array(F.pmod(F.xxhash64("path"), F.lit(shards)).cast("int")))).alias("shard"))
    return dealt.groupBy("shard").transformWithStateInPandas(Debounce(), "path string, kind string, changes long, first_ms long, last_ms long", "update", "processingTime")


def waiting(spark: SparkSession, checkpoint: str) -> DataFrame:
    """path, kind, first_ms, last_ms and changes of what a debounced stream holds back, from its checkpoint."""
    rows = spark.read.format("statestore").option("stateVarName", "held").load(checkpoint)
    v = F.col("user_map_value")
    return rows.select(F.col("user_map_key.path").alias("path"), v["kind"].alias("kind"), v["first"].alias("first_ms"), v["last"].alias("last_ms"), v["n"].alias("changes"))


def next_deadline(held: DataFrame, now_ms: int, quiet_ms: int = QUIET_MS, longest_ms: int = LONGEST_MS) -> DataFrame:
    """(wait_ms): how long until something of held is ready, 0 if something is; null if nothing waits."""
    due = F.least(F.col("last_ms") + quiet_ms, F.col("first_ms") + longest_ms)
    return held.agg(F.min(F.greatest(due - now_ms, F.lit(0))).alias("wait_ms"))
