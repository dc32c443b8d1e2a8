"""Rename pairing and debouncing as streams with state."""

import glob
import os
import random
import shutil
import time
from collections import Counter

import duckdb
import pytest
from glyphmill import queries as q
from glyphmill.streaming import changes
from pyspark.sql import functions as F

SCHEMA = "root string, path string, kind string, from_path string, ts timestamp, seq long"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set(name, old)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def frame(spark, rows):
    data = [(r, p, k, f, seq) for seq, (r, p, k, f, _) in enumerate(rows)]
    at = {seq: 10**12 + ms for seq, (*_, ms) in enumerate(rows)}
    df = spark.createDataFrame(data, "root string, path string, kind string, from_path string, seq long")
    times = spark.createDataFrame(list(at.items()), "seq long, ms long")
    return df.join(times, "seq").select("root", "path", "kind", "from_path", F.timestamp_millis("ms").alias("ts"), "seq")


def streamed(spark, tmp_path, batches, make, mode="append"):
    """The rows of each batch, fed one after another."""
    for k, b in enumerate(batches):
        b.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{k}")
    out = []
    source = f"{tmp_path}/feed"
    os.makedirs(source)
    for k in range(len(batches)):
        for n, f in enumerate(glob.glob(f"{tmp_path}/in{k}/*.parquet")):
            shutil.copy(f, f"{source}/b{k}-{n}.parquet")
        raw = spark.readStream.schema(batches[0].schema).parquet(source)
        query = make(raw).writeStream.outputMode(mode).foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination()
    return out


def test_renames_are_paired_across_batches(rocks, tmp_path):
    """Both halves in different batches, an expired departure, one that is overtaken while it waits, a late arrival."""
    one = frame(rocks, [("r", "new.rs", "created", None, 0), ("r", "gone.rs", "deleted", None, 5), ("r", "c.rs", "renamed", "b.rs", 10), ("r", "src/old.rs", "departed", None, 1000)])
    two = frame(rocks, [("r", "src/new.rs", "arrived", None, 1100), ("r", "overtaken", "departed", None, 1500), ("r", "next", "departed", None, 1600), ("r", "place", "arrived", None, 1700), ("q", "away", "departed", None, 2000)])
    three = frame(rocks, [("r", "late", "arrived", None, 2500), ("q", "other", "departed", None, 2300), ("r", "moved-away", "departed", None, 3000)])
    four = frame(rocks, [("z", "tick", "modified", None, 60_000)])
    got = streamed(rocks, tmp_path, [one, two, three, four, frame(rocks, [("z", "tock", "modified", None, 61_000)])], lambda s: changes.paired(s, "0 seconds"))
    told = {(r["root"], r["kind"], r["path"], r["from_path"]) for r in got}
    assert told == {
        ("r", "created", "new.rs", None), ("r", "deleted", "gone.rs", None), ("r", "renamed", "c.rs", "b.rs"), ("r", "renamed", "src/new.rs", "src/old.rs"), ("r", "renamed", "place", "next"),
        ("q", "deleted", "away", None), ("r", "created", "late", None), ("q", "deleted", "other", None), ("r", "deleted", "moved-away", None), ("z", "modified", "tick", None), ("z", "modified", "tock", None),
    }
    assert len(got) == len(told)


def test_pairing_in_spans_is_pairing_in_order(spark, monkeypatch):
    """Moves of one busy root, at the edges of spans too, against one that takes them one by one."""
    rng, ms, rows = random.Random(8), 0, []
    for k in range(3000):
        ms += rng.choice((0, 1, 50, 199, 200, 201, 400, 30_000))
        rows.append(("r", f"p{k}", rng.choice(("departed", "arrived", "modified")), None, ms))
    want, held = [], None
    for k, (_, path, kind, _, at) in enumerate(rows):
        if kind == "modified":
            want.append((k, path, kind, None))
            continue
        alive = held is not None and at - held[2] <= 200
        if held is not None and not alive:
            want.append((held[0], held[1], "deleted", None))
        if kind == "arrived":
            want.append((k, path, "renamed" if alive else "created", held[1] if alive else None))
        held = (k, path, at) if kind == "departed" else None
    want += [(held[0], held[1], "deleted", None)] if held else []
    got = changes.pair_renames(frame(spark, rows)).collect()
    assert sorted((r["seq"], r["path"], r["kind"], r["from_path"]) for r in got) == sorted(want, key=lambda x: x[:3])


def test_moves_without_time_or_seq_and_before_1970_are_as_in_sql(spark, tmp_path):
    """A move without a time is told by itself, one without a seq goes last of its time, and spans meet before 1970 too."""
    hour = 3_600_000_000
    span = 50 * hour  # of jn12_pair_renames
    rows = [(3, None, 1), (5, None, 1), (4, None, 1), (None, None, 1)]
    rows += [(6, 10 * span, 2), (None, 10 * span, 2), (9, 20 * span, 2), (11, 20 * span + hour, 2)]
    rows += [(12, -3 * span - 1_000, 3), (14, -3 * span + 1_000, 3), (15, -5 * span - hour, 3), (17, -5 * span, 3), (18, -hour // 2, 3), (20, hour // 2, 3), (21, -9 * span - hour - 1_500, 3), (23, -9 * span - 1_000, 3), (24, -7 * span - hour - 1_000, 3), (26, -7 * span - 900, 3)]
    con = duckdb.connect()
    con.execute("CREATE TABLE events AS SELECT NULL::BIGINT AS event_id, NULL::TIMESTAMP AS ts, NULL::BIGINT AS user_id WHERE false")
    con.executemany("INSERT INTO events VALUES (?, make_timestamp(?::BIGINT), ?)", rows)
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    want = con.execute("SELECT root, path, seq, kind, from_path FROM (" + q.SQL["jn12_pair_renames"] + ")").fetchall()
    got = q.QUERIES["jn12_pair_renames"](spark, str(tmp_path)).select("root", "path", "seq", "kind", "from_path").collect()
    assert Counter(tuple(r) for r in got) == Counter(want)
    assert {r[4] for r in want} == {None, "6", "9", "12", "15", "18", "21"} and sum(r[0] == "1" for r in want) == 4


def test_an_overtaken_departure_alone_is_left_out(spark):
    """Every departure but the overtaken is told: as a rename's origin or as a deletion."""
    kinds = [("a", "departed", 0), ("b", "departed", 200), ("c", "departed", 401), ("d", "arrived", 601), ("e", "departed", 700), ("f", "arrived", 901), ("g", "departed", 1000)]
    got = changes.pair_renames(frame(spark, [("r", p, k, None, ms) for p, k, ms in kinds])).orderBy("seq").collect()
    assert [(r["kind"], r["path"], r["from_path"]) for r in got] == [("deleted", "b", None), ("renamed", "d", "c"), ("deleted", "e", None), ("created", "f", None), ("deleted", "g", None)]


def test_draining_releases_everything_unsettled(rocks, tmp_path):
    feed = lambda *rows: frame(rocks, [("r", p, k, None, ms) for p, k, ms in rows]).select("path", "kind", "ts")
    rocks.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else timers keep such a run alive
    batches = [feed(("b.rs", "created", 1), ("a.rs", "modified", 2), ("b.rs", "modified", 3), ("c.rs", "deleted", 3)), feed(("c.rs", "created", 4)), feed((None, "drain", 5))]
    out = []

    def make(stream):
        return changes.debounced(stream, 3_600_000, 7_200_000, shards=3)

    got = streamed(rocks, tmp_path, batches[:2], make, "update")
    assert got == []
    held = changes.waiting(rocks, f"{tmp_path}/cp")
    assert {(r["path"], r["kind"], r["changes"]) for r in held.collect()} == {("a.rs", "modified", 1), ("b.rs", "created", 2), ("c.rs", "modified", 2)}
    last = held.agg(F.min("last_ms"), F.max("last_ms")).first()
    wait = lambda now: changes.next_deadline(held, now, 3_600_000, 7_200_000).first()["wait_ms"]
    assert wait(last[0]) == 3_600_000 and wait(last[1] + 10_000_000) == 0
    assert changes.next_deadline(held.where("false"), 0).first()["wait_ms"] is None
    raw = f"{tmp_path}/feed"
    batches[2].coalesce(1).write.mode("append").parquet(raw)
    make(rocks.readStream.schema(batches[0].schema).parquet(raw)).writeStream.outputMode("update").foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    ordered = sorted(out, key=lambda r: (-r["last_ms"], r["path"]))
    assert {(r["path"], r["kind"], r["changes"]) for r in out} == {("a.rs", "modified", 1), ("b.rs", "created", 2), ("c.rs", "modified", 2)}
    assert [r["path"] for r in ordered] == ["c.rs", "a.rs", "b.rs"]
    assert changes.waiting(rocks, f"{tmp_path}/cp").count() == 0
    rocks.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def test_settled_changes_leave_by_themselves(rocks, tmp_path):
    rows = frame(rocks, [("r", "a", "created", None, 1), ("r", "a", "modified", None, 2), ("r", "b", "deleted", None, 3)]).select("path", "kind", "ts")
    rows.coalesce(1).write.parquet(f"{tmp_path}/feed")
    out = []
    query = changes.debounced(rocks.readStream.schema(rows.schema).parquet(f"{tmp_path}/feed"), 300, 5000, shards=2).writeStream.outputMode("update").foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="200 milliseconds").start()
    until = time.time() + 60
    while len(out) < 2 and time.time() < until:
        time.sleep(0.3)
    query.stop()
    assert {(r["path"], r["kind"], r["changes"]) for r in out} == {("a", "created", 2), ("b", "deleted", 1)}
