"""Keyed tables by buckets and the stored text index."""

import os
import random
import zlib

import pytest
from glyphmill.operators import search, store
from glyphmill.operators.tables import Table
from glyphmill.operators.textindex import TextIndex
from pyspark.sql import functions as F


def files_below(path):
    return {os.path.relpath(os.path.join(at, n), path) for at, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def test_one_row_writes_one_bucket_of_a_thousand(spark, tmp_path):
    path = f"{tmp_path}/t"
    table = Table(spark, path, "id long, name string, v long", ["id"], 1000)
    assert table.read().count() == 0 and table.get(3).count() == 0
    assert table.merge(spark.range(20_000).select("id", F.concat(F.lit("n"), "id").alias("name"), F.lit(1).cast("long").alias("v"))) == 0
    before = files_below(f"{path}/data")
    assert table.merge(spark.createDataFrame([(7, "seven", 2)], "id long, name string, v long"), version=5) == 5
    new = files_below(f"{path}/data") - before
    assert {os.path.dirname(n) for n in new} == {f"v5/_bucket={table.bucket_of(7)}"}
    held = {r["id"]: r["v"] for r in table.read().collect()}
    assert len(held) == 20_000 and held[7] == 2 and sum(held.values()) == 20_001
    assert table.merge(spark.createDataFrame([(7, "other", 9)], "id long, name string, v long"), version=5) == 5  # played again
    assert table.get(7).first()["name"] == "seven" and files_below(f"{path}/data") == before | new
    assert {os.path.basename(os.path.dirname(f)) for f in table.get(7).inputFiles()} == {f"_bucket={table.bucket_of(7)}"}


def test_rows_go_versions_expire_and_nulls_are_keys(spark, tmp_path):
    table = Table(spark, f"{tmp_path}/t", "root string, path string, at long", ["root", "path"], 4)
    rows = [("r", "a", 1), ("r", None, 1), (None, "a", 1), (None, None, 1)]
    table.merge(spark.createDataFrame(rows, table.schema))
    table.merge(spark.createDataFrame([("r", None, 2), (None, None, 2)], table.schema), spark.createDataFrame([("r", "a"), ("x", "y"), (None, "a")], "root string, path string"))
    state = lambda v=None: sorted(((r["root"], r["path"], r["at"]) for r in table.read(version=v).collect()), key=str)
    assert state() == sorted([("r", None, 2), (None, None, 2)], key=str) and state(0) == sorted(rows, key=str)
    assert table.merge(spark.createDataFrame([], table.schema)) == 1  # touches nothing
    table.merge(None, spark.createDataFrame([("r", None), (None, None)], "root string, path string"))
    assert state() == [] and table.get("r", None).count() == 0
    table.merge(spark.createDataFrame([("n", "n", 3)], table.schema), keep_first=("at",))
    table.merge(spark.createDataFrame([("n", "n", 4)], table.schema), keep_first=("at",))
    assert state() == [("n", "n", 3)]
    table.expire(1)
    assert state() == [("n", "n", 3)] and state(3) == [] and table.folder.versions("manifest") == [4] and len(files_below(f"{tmp_path}/t/data")) == 1


def test_a_failed_batch_leaves_no_trace(spark, tmp_path):
    table = Table(spark, f"{tmp_path}/t", "id long, v long", ["id"], 4)
    table.merge(spark.createDataFrame([(1, 1)], table.schema), version=0)
    broken = spark.createDataFrame([(1, 2)], table.schema).withColumn("v", F.raise_error(F.lit("busy")).cast("long"))
    with pytest.raises(Exception, match="busy"):
        table.merge(broken, version=1)
    assert table.read().first()["v"] == 1
    table.merge(spark.createDataFrame([(1, 2)], table.schema), version=1)
    assert table.read().first()["v"] == 2


WORDS = "open the store of a user session bread with walnuts lost and found reader".split()


def test_index_follows_its_texts(spark, tmp_path):
    """After puts, replacements and deletions a search gives what reading every text gives; its plan reads its own buckets."""
    rng = random.Random(5)
    index, texts = TextIndex(spark, f"{tmp_path}/i", buckets=16), {}
    made = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 30)))
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")

    def same():
        docs = frame(list(texts.items()))
        for terms in (["session"], ["the", "bread"], ["open the", "walnuts"], ["absent"], ["user session bread", "lost-and"]):
            got = {r["doc_id"]: round(r["relevance"], 6) for r in index.bm25(terms).collect()}
            assert got == {r["doc_id"]: round(r["relevance"], 6) for r in search.bm25(docs, terms).collect()}, terms
        stats = lambda df: {tuple(r) for r in df.select("term", "df", "cf").collect()}
        assert stats(index.term_stats()) == stats(search.term_stats(search.postings(docs)))

    for version in range(4):
        put = {rng.randrange(40): made() for _ in range(12)}
        gone = [i for i in list(texts) if rng.random() < 0.2 and i not in put]
        assert index.apply(frame(list(put.items())), frame([(i, None) for i in gone]), version) == version
        assert index.apply(frame([(1, "other words")]), None, version) == version  # played again
        texts = {k: v for k, v in texts.items() if k not in gone} | put
    same()
    read = [f.split("/") for f in index.postings_of(["session"]).inputFiles() if "/postings/" in f]
    assert {f[-2] for f in read} == {f"_bucket={zlib.crc32(b'session') % 16}"} and {f[-3] for f in read} <= {f"v{k}" for k in range(4)}
    index.compact()
    index.expire(1)
    same()
    assert len(os.listdir(f"{tmp_path}/i/postings")) == 1 and index.state()["dead"] == []
    index.apply(None, frame([(i, None) for i in texts]))
    assert index.bm25(["session"]).count() == 0 and index.state()["n"] == 0


def test_store_upsert_and_table_agree(spark, tmp_path):
    rng = random.Random(6)
    table, plain = Table(spark, f"{tmp_path}/t", "k string, v long", ["k"], 3), spark.createDataFrame([], "k string, v long")
    for _ in range(3):
        new = spark.createDataFrame([(f"k{i}", rng.randrange(100)) for i in rng.sample(range(12), 5)], "k string, v long")
        table.merge(new)
        plain = store.upsert(plain, new, ["k"])
    assert sorted(map(tuple, table.read().collect())) == sorted(map(tuple, plain.collect()))
