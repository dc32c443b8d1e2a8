"""What the training-data operators share: the shared folder, lineage cuts and Arrow batch helpers."""

from __future__ import annotations

import gc
import os
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of an Arrow batch that are turned into Python objects at a time.
SLICE = 256


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, wherever the driver was started."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where the master is local, one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            spark.sparkContext.setCheckpointDir(named)
        return named.rstrip("/")
    set_already = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_already.isDefined():
        return set_already.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="glyphmill-")
    spark.sparkContext.setCheckpointDir(own)
    return f"file://{own}"


def cut(df: DataFrame) -> DataFrame:
    """Compute df once and keep it in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: A key counts as heavy, and its fact is sent to every executor, if it has more than one in so many of all rows.
HEAVY = 2000


def with_facts(rows: DataFrame, facts: DataFrame, key: str, copies: str) -> DataFrame:
    """rows left-joined with facts (one row a key) on key. copies, a column of facts, tells how many rows have the key:
    rows of heavy keys, of which there are fewer than HEAVY, meet their facts by broadcast and are never shuffled."""
    total = facts.agg(F.sum(copies)).first()[0] or 0
    heavy = facts.where(F.col(copies) * HEAVY > total)
    found = rows.join(F.broadcast(heavy), key)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(facts, key, "left")
    return found.unionByName(rest)


#: Groups whose offsets are sent to every executor; more of them are joined by shuffle.
BROADCAST_GROUPS = 200_000


def numbered(rows: DataFrame, group: list[str], order: list[Column], name: str, size: str | None = None) -> DataFrame:
    """rows with their place in their group, counted from 0 in the given order, as a column of that name, and, if size names
    one, a column with how many rows the group has. Rows are sorted over partitions by range, equal ones by where they stood, so a group or a row repeated without end is parted over many
    tasks; a place is that within the partition, shifted by how many rows of the group the partitions before hold. rows
    are best cut already: their ranges are sampled first."""
    by = [*(F.col(f"`{g}`").asc_nulls_first() for g in group), *order, F.col("_stood")]
    spread = rows.withColumn("_stood", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("_stood")
    at = F.monotonically_increasing_id()
    placed = cut(spread).withColumn("_part", F.shiftright(at, 33)).withColumn("_at", at.bitwiseAND((1 << 33) - 1))
    keys = [F.col(f"`{g}`") for g in group]
    held = placed.groupBy(*keys, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = [F.sum("_n").over(whole).alias(size)] if size else []
    shifts = cut(held.select(*[k.alias(f"_g{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), (before - F.col("_first")).alias("_shift"), *total))
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & k.eqNullSafe(F.col(f"_g{i}"))
    few = F.broadcast(shifts) if shifts.count() <= BROADCAST_GROUPS else shifts
    return placed.join(few, same).withColumn(name, F.col("_at") + F.col("_shift")).select(*[F.col(f"`{c}`") for c in rows.columns], name, *([size] if size else []))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


_KEPT: dict[str, object] = {}


def kept(key: str, make: Callable[[], object]) -> object:
    """What make gives, made once in a Python worker; a worker keeps the last few."""
    if key not in _KEPT:
        if len(_KEPT) > 3:
            _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Let go of what earlier operators kept in this worker; they make it again when they need it."""
    _KEPT.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()


def share(spark: SparkSession, value: object) -> Callable[[Callable[[object], object]], object]:
    """Send value to the workers: a function that gives make(value) there, made once in each."""
    sent, key = spark.sparkContext.broadcast(pickle.dumps(value)), uuid.uuid4().hex
    return lambda make=lambda x: x: kept(key, lambda: make(pickle.loads(sent.value)))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[dict[str, list]]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows).to_pydict()
