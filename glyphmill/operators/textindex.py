"""A stored full-text index: postings in buckets of their term, written batch by batch.

A batch of texts adds one delta: its postings (term, document, length, places), sorted over files by bucket, term and
document, so that a term which every document holds is parted over many files and a file's statistics tell which terms it
has. What a replaced or deleted document had is not sought out: the batch notes the document's former writing as dead, and
a search leaves dead writings out. Documents' lengths are a keyed table; the corpus's counts are kept with each version. A
search reads the folders of its own terms' buckets and nothing else of the postings. Compaction makes one delta of all.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut
from . import search
from .tables import BUCKETS, Folder, Table

_POSTINGS = "term string, doc_id {kind}, gen int, dl long, at array<int>"
#: Dead writings that are sent to every task; more are joined by shuffle.
BROADCAST_DEAD = 1_000_000
#: Words that a task inverts at a time.
WORDS = 1 << 19


def words_of(term: str) -> list[str]:
    """The words of a query's term, which is a phrase if there are several."""
    return re.findall(r"[^\W_]+", term.lower())


class TextIndex:
    """An index at path of documents with ids of one kind. Versions are numbered by the batches that made them."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "long", buckets: int = BUCKETS):
        self.spark, self.path, self.kind, self.buckets = spark, path.rstrip("/"), kind, buckets
        self.folder = Folder(spark, path)
        self.documents = Table(spark, f"{self.path}/documents", f"doc_id {kind}, gen int, dl long", ["doc_id"], buckets)

    def state(self, below: int | None = None) -> dict:
        """version, deltas and dead (the versions that wrote postings and dead writings), n and length of all documents."""
        done = [v for v in self.folder.versions("state") if below is None or v < below]
        if not done:
            return {"version": -1, "deltas": [], "dead": [], "n": 0, "length": 0}
        schema = "version int, deltas array<int>, dead array<int>, n long, length long"
        return self.spark.read.schema(schema).parquet(f"{self.path}/state/v{done[-1]}").first().asDict()

    def _commit(self, state: dict) -> int:
        row = [(state["version"], state["deltas"], state["dead"], state["n"], state["length"])]
        self.spark.createDataFrame(row, "version int, deltas array<int>, dead array<int>, n long, length long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/state/v{state['version']}")
        return state["version"]

    def _write(self, postings: DataFrame, version: int) -> None:
        """Postings into the folders of their buckets; a hot term's rows go to several files, by document."""
        bucketed = postings.withColumn("_bucket", F.pmod(F.crc32("term"), F.lit(self.buckets)).cast("int"))
        order = ("_bucket", "term", "doc_id")
        bucketed.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/postings/v{version}")

    def apply(self, texts: DataFrame | None, gone: DataFrame | None = None, version: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> int:
        """texts take the place of what their documents had (one text each, the last by content of several), documents of gone
        leave. A version that is there already is not written again."""
        if version is not None and version in self.folder.versions("state"):
            return version
        was = self.state(version)
        version = was["version"] + 1 if version is None else version
        schema = f"doc_id {self.kind}, text string"
        given = self.spark.createDataFrame([], schema) if texts is None else texts.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        new = cut(given.groupBy("doc_id").agg(F.max(F.coalesce("text", F.lit(""))).alias("text")).withColumn("words", search.terms_of(F.col("text"))).select("doc_id", "words"))
        left = self.spark.createDataFrame([], f"doc_id {self.kind}") if gone is None else gone.select(F.col(id_col).alias("doc_id"))
        lengths = cut(new.select("doc_id", F.lit(version).alias("gen"), F.size("words").cast("long").alias("dl")))
        changed = cut(lengths.select("doc_id").unionByName(left).distinct())
        former = cut(self.documents.near(changed, below=version).join(changed, "doc_id", "left_semi"))
        former.select("doc_id", "gen").write.mode("overwrite").parquet(f"{self.path}/dead/v{version}")
        buckets = self.buckets
        rows = new.mapInArrow(lambda batches: invert(batches, buckets), f"term string, doc_id {self.kind}, dl long, at array<int>")
        self._write(rows.select("term", "doc_id", F.lit(version).alias("gen"), "dl", "at"), version)
        sums = lambda df: df.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        plus, minus = sums(lengths), sums(former)
        self.documents.merge(lengths, left.join(lengths.select("doc_id"), "doc_id", "left_anti"), version)
        dead = [*was["dead"], version] if minus[0] else was["dead"]
        return self._commit({"version": version, "deltas": [*was["deltas"], version], "dead": dead, "n": was["n"] + plus[0] - minus[0], "length": was["length"] + plus[1] - minus[1]})

    def _live(self, state: dict, buckets: list[int] | None) -> DataFrame:
        """Postings of some buckets (or all) without those of dead writings."""
        schema = _POSTINGS.format(kind=self.kind)
        folders = [f"postings/v{v}/{n}" for v in state["deltas"] for n in self.folder.names(f"postings/v{v}") if n.startswith("_bucket=") and (buckets is None or int(n.split("=")[1]) in buckets)]
        if not folders:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])
        if not state["dead"]:
            return rows
        dead = self.spark.read.schema(f"doc_id {self.kind}, gen int").parquet(*[f"{self.path}/dead/v{v}" for v in state["dead"]])
        few = F.broadcast(dead) if dead.count() <= BROADCAST_DEAD else dead
        return rows.join(few, ["doc_id", "gen"], "left_anti")

    def postings_of(self, words: list[str]) -> DataFrame:
        """The live postings of some words, from their buckets alone."""
        buckets = {zlib.crc32(w.encode()) % self.buckets for w in words}
        return self._live(self.state(), sorted(buckets)).where(F.col("term").isin(*words))

    def bm25(self, terms: list[str]) -> DataFrame:
        """(doc_id, relevance) of documents that hold a term; a term of several words is a phrase, whose words stand side by
        side. Statistics are those of the whole corpus."""
        state, phrases = self.state(), [p for p in map(words_of, terms) if p]
        words = sorted({w for p in phrases for w in p})
        if not words:
            return self.spark.createDataFrame([], f"doc_id {self.kind}, relevance double")
        per = self.postings_of(words).groupBy("doc_id", "dl").agg(F.map_from_entries(F.collect_list(F.struct("term", "at"))).alias("at"))
        found = cut(per.select("doc_id", "dl", *[occurrences(F.col("at"), p).alias(f"tf{k}") for k, p in enumerate(phrases)]))
        df = found.agg(*[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(phrases))])
        n, mean = F.lit(state["n"]).cast("long"), F.lit(state["length"] / max(1, state["n"]))
        scored = found.join(F.broadcast(df), F.lit(True)).select("doc_id", search.bm25_score([F.col(f"tf{k}") for k in range(len(phrases))], [F.col(f"df{k}") for k in range(len(phrases))], F.col("dl"), n, mean).alias("relevance"), F.greatest(F.lit(0), *[F.col(f"tf{k}") for k in range(len(phrases))]).alias("_most"))
        return scored.where("_most > 0").drop("_most")

    def term_stats(self) -> DataFrame:
        """term, df and cf of the whole corpus."""
        return self._live(self.state(), None).groupBy("term").agg(F.count("*").alias("df"), F.sum(F.size("at")).cast("long").alias("cf"))

    def compact(self, version: int | None = None) -> int:
        """One delta of all live postings, no dead writings."""
        if version is not None and version in self.folder.versions("state"):
            return version
        was = self.state(version)
        version = was["version"] + 1 if version is None else version
        self._write(self._live(was, None), version)
        return self._commit({**was, "version": version, "deltas": [version], "dead": []})

    def expire(self, keep: int = 2) -> None:
        """Only the newest versions stay, and what they read."""
        done = self.folder.versions("state")
        kept = done[-keep:]
        states = [self.state(v + 1) for v in kept]
        for part, used in (("postings", {v for s in states for v in s["deltas"]}), ("dead", {v for s in states for v in s["dead"]}), ("state", set(kept))):
            for name in self.folder.names(part):
                if int(name[1:]) not in used and int(name[1:]) <= (done[-1] if done else -1):
                    self.folder.remove(f"{part}/{name}")
        self.documents.expire(keep)


def invert(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """term, doc_id, dl, at of documents (doc_id, words). A document's words lie in one row, so its postings are made there
    and no word is shuffled before they are; documents of at most WORDS words together, or one, are inverted at a time. They
    come by bucket, term and place of the document, which leaves the later sort runs to merge."""
    for batch in batches:
        lists = batch.column("words")
        ends = lists.offsets.to_numpy().astype(np.int64)
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + WORDS, side="right")) - 1)
            starts, n = ends[first:last], ends[first + 1 : last + 1] - ends[first:last]
            words = lists.values.slice(ends[first], ends[last] - ends[first]).dictionary_encode()
            doc = np.repeat(np.arange(last - first), n)
            place = np.arange(len(doc), dtype=np.int64) - (starts - ends[first])[doc]
            known = [(zlib.crc32(t) % buckets, t) for t in words.dictionary.cast(pa.binary()).to_pylist()]
            rank = np.empty(len(known), dtype=np.int64)
            rank[sorted(range(len(known)), key=known.__getitem__)] = np.arange(len(known))
            key = rank[words.indices.to_numpy()] * (last - first) + doc
            order = np.argsort(key, kind="stable")
            heads = np.flatnonzero(np.diff(key[order], prepend=-1))
            at = pa.ListArray.from_arrays(pa.array(np.append(heads, len(order)), pa.int32()), pa.array(place[order], pa.int32()))
            own = doc[order[heads]]
            term = words.dictionary.take(words.indices.take(pa.array(order[heads])))
            yield pa.RecordBatch.from_arrays([term, batch.column("doc_id").take(pa.array(own + first)), pa.array(n[own], pa.int64()), at], names=["term", "doc_id", "dl", "at"])
            first = last


def occurrences(at: Column, phrase: list[str]) -> Column:
    """How often the words of a phrase stand side by side, by a map of their places."""
    none, places = F.array().cast("array<int>"), []
    for k, word in enumerate(phrase):
        places.append(F.transform(F.coalesce(at[word], none), _less(k)))
    return F.size(reduce(F.array_intersect, places))


def _less(k: int):
    return lambda place: place - k
