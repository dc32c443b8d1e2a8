"""Keyed tables in a folder that all executors share, in hash buckets of their key.

A batch of rows rewrites the buckets that it touches and no other; a version's manifest names the folder that each live
bucket is in, and counts once it is whole. A version that is there already is not written again, so a batch that is played
twice changes nothing, and one that failed half way leaves no trace in any version. Old versions expire with the folders
that no kept version names. A bucket is a task's work: take so many that one is about a file's size.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut
from . import store

BUCKETS = 256
_NULL, _BETWEEN = "\x00", "\x01"


class Folder:
    """The few things a table asks of a file system, whichever Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self.make = path.rstrip("/"), spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.make(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, below: str) -> list[str]:
        at = self.make(f"{self.path}/{below}")
        return [f.getPath().getName() for f in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def versions(self, below: str) -> list[int]:
        """Versions whose writing ended."""
        told = [n for n in self.names(below) if n[:1] == "v" and n[1:].isdigit()]
        return sorted(int(n[1:]) for n in told if self.fs.exists(self.make(f"{self.path}/{below}/{n}/_SUCCESS")))

    def remove(self, below: str) -> None:
        self.fs.delete(self.make(f"{self.path}/{below}"), True)


class Table:
    """Rows of a schema, one for each value of keys."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, keys, buckets
        self.folder = Folder(spark, path)

    def bucket(self) -> Column:
        said = F.concat_ws(_BETWEEN, *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit(_NULL)) for k in self.keys])
        return F.pmod(F.crc32(said), F.lit(self.buckets)).cast("int")

    def bucket_of(self, *key) -> int:
        """The bucket of a key of texts and whole numbers, told without Spark."""
        return zlib.crc32(_BETWEEN.join(_NULL if k is None else str(k) for k in key).encode()) % self.buckets

    def manifest(self, version: int | None = None, below: int | None = None) -> tuple[int, dict[int, str]]:
        """The newest version (or the one asked for, or the newest below one), -1 if there is none, and its live buckets'
        folders: at most a row a bucket."""
        found = [v for v in self.folder.versions("manifest") if (version is None or v == version) and (below is None or v < below)]
        if not found:
            return -1, {}
        rows = self.spark.read.schema("bucket int, folder string").parquet(f"{self.path}/manifest/v{found[-1]}").collect()
        return found[-1], {r["bucket"]: r["folder"] for r in rows}

    def _of(self, live: dict[int, str], buckets: list[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/data/{live[b]}/_bucket={b}" for b in sorted(live if buckets is None else set(buckets) & set(live))]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, buckets: list[int] | None = None, version: int | None = None) -> DataFrame:
        """All rows, or those of some buckets; the newest version or an older one that has not expired."""
        return self._of(self.manifest(version)[1], buckets)

    def get(self, *key) -> DataFrame:
        """The row of a key of texts and whole numbers, or none: one bucket is read."""
        rows = self.read([self.bucket_of(*key)])
        for name, value in zip(self.keys, key, strict=True):
            rows = rows.where(F.col(name).eqNullSafe(F.lit(value)))
        return rows

    def near(self, keyed: DataFrame, below: int | None = None) -> DataFrame:
        """The rows of the buckets that the keys of keyed are in."""
        return self._of(self.manifest(below=below)[1], self._touched(keyed))

    def _touched(self, keyed: DataFrame) -> list[int]:
        return [r["b"] for r in keyed.select(self.bucket().alias("b")).distinct().collect()]

    def merge(self, new: DataFrame | None = None, gone: DataFrame | None = None, version: int | None = None, keep_first: tuple[str, ...] = (), joined: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> int:
        """The next version (or the numbered one, if it is not there yet): new's rows take the place of those of equal keys,
        rows of gone's keys go. joined: how the old rows of the touched buckets and the new ones make one, if not so. The
        version that counts afterwards is given; a batch that touches nothing writes none."""
        at, live = self.manifest(below=version)
        if version is not None and version in self.folder.versions("manifest"):
            return version
        empty = self.spark.createDataFrame([], self.schema)
        rows = cut(new.select(*empty.columns)) if new is not None else empty
        out = cut(gone.select(*self.keys).distinct()) if gone is not None else empty.select(*self.keys)
        touched = self._touched(rows.select(*self.keys).unionByName(out))
        if not touched:
            return at
        version = at + 1 if version is None else version
        old = self._of(live, touched)
        if joined:
            merged = joined(old, rows)
        else:
            for k in self.keys:
                out = out.withColumnRenamed(k, f"_gone_{k}")
            same = [F.col(k).eqNullSafe(F.col(f"_gone_{k}")) for k in self.keys]
            merged = store.upsert(old.join(out, same, "left_anti"), rows, self.keys, keep_first)
        dealt = merged.select(*empty.columns).withColumn("_bucket", self.bucket()).repartition(len(touched), "_bucket")
        dealt.write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/data/v{version}")
        made = {int(n.split("=")[1]) for n in self.folder.names(f"data/v{version}") if n.startswith("_bucket=")}
        now = {b: f for b, f in live.items() if b not in touched} | dict.fromkeys(made, f"v{version}")
        self.spark.createDataFrame(sorted(now.items()), "bucket int, folder string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v{version}")
        return version

    def expire(self, keep: int = 2) -> None:
        """Only the newest versions stay, and the folders that they name."""
        done = self.folder.versions("manifest")
        kept = done[-keep:] if keep else []
        used = {(f, b) for v in kept for b, f in self.manifest(v)[1].items()}
        for v in [x for x in done if x not in kept]:
            self.folder.remove(f"manifest/v{v}")
        newest = kept[-1] if kept else -1
        for name in self.folder.names("data"):
            if not name[1:].isdigit() or int(name[1:]) > newest:
                continue  # being written
            own = [int(n.split("=")[1]) for n in self.folder.names(f"data/{name}") if n.startswith("_bucket=")]
            if not any((name, b) in used for b in own):
                self.folder.remove(f"data/{name}")
            else:
                for b in own:
                    if (name, b) not in used:
                        self.folder.remove(f"data/{name}/_bucket={b}")
