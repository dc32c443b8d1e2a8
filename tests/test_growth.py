"""What a task holds does not grow with its tables."""

import random
from types import SimpleNamespace

import pandas as pd
import pyarrow as pa
from glyphmill import queries as q
from glyphmill.functions import tokens
from glyphmill.operators import search, textindex, vectors
from glyphmill.plans import optimize as P
from pyspark.sql import functions as F


def test_edges_come_in_parts_by_rows(spark, small, monkeypatch):
    want = {tuple(r) for r in q.edges(spark, small).collect()}
    monkeypatch.setattr(q, "EDGE_ROWS", 500, raising=False)
    got = q.edges(spark, small)
    assert got.rdd.getNumPartitions() > 10 and {tuple(r) for r in got.collect()} == want


def test_ids_of_one_text_at_a_time(monkeypatch):
    def ids(text):
        return text.split()

    monkeypatch.setattr(tokens, "_coder", lambda path, pattern: SimpleNamespace(encode_ordinary=ids))
    count = tokens.bpe_counter("x", "y")
    assert count.func(pd.Series(["a b c", None, "d"])).tolist() == [3, 0, 1]


def test_vectors_are_given_out_in_small_parts(monkeypatch):
    texts = [f"word number {k}" if k % 7 else None for k in range(1300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1300)), pa.array(texts)], names=["id", "t"])
    parts = list(vectors.embed_batches(iter([batch]), "t"))
    assert max(p.num_rows for p in parts) <= vectors.EMBED_ROWS and sum(p.num_rows for p in parts) == 1300
    assert [v for p in parts for v in p.column("v").to_pylist()] == [vectors.embed(t or "").tolist() for t in texts]


def test_a_fragment_is_embedded_once(spark, tmp_path, monkeypatch):
    made, embed = spark.sparkContext.accumulator(0), vectors.embed_batches

    def told(batches, *more):
        for batch in embed(batches, *more):
            made.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(vectors, "embed_batches", told)
    docs = spark.createDataFrame([(1, "a b c\n\nc b a\n\nother words here"), (2, "one")], "doc_id long, text string")
    assert P.text(docs, near=0.9).count() == 2
    assert made.value == 4


def test_a_documents_postings_are_made_in_its_row(spark, monkeypatch):
    rng = random.Random(2)
    docs = [(f"d{k}", [rng.choice("abcdefg") for _ in range(rng.choice([0, 1, 5, 40]))]) for k in range(60)]
    want = {(t, i, len(w), tuple(k for k, x in enumerate(w) if x == t)) for i, w in docs for t in w}
    whole = pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs]), pa.array([w for _, w in docs], pa.list_(pa.string()))], names=["doc_id", "words"])
    for words in (1, 7, 64, 1 << 19):
        monkeypatch.setattr(textindex, "WORDS", words)
        parts = list(textindex.invert(iter([whole.slice(0, 0), whole.slice(0, 11), whole.slice(11)]), 4))
        got = [(t, i, n, tuple(at)) for p in parts for t, i, n, at in zip(*(p.column(c).to_pylist() for c in ("term", "doc_id", "dl", "at")), strict=True)]
        assert len(got) == len(want) and set(got) == want
        assert all(sum(map(len, p.column("at").to_pylist())) <= max(words, 40) for p in parts)


def test_no_word_is_shuffled_before_its_postings(spark, tmp_path, monkeypatch):
    plans = []
    monkeypatch.setattr(textindex.TextIndex, "_write", lambda self, rows, version: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()))
    textindex.TextIndex(spark, f"{tmp_path}/i", buckets=4).apply(spark.createDataFrame([(1, "a b a")], "doc_id long, text string"))
    assert "Aggregate" not in plans[0]


def test_documents_of_lines_are_not_made_whole(spark, small):
    """The same as of their texts, and no text is collected."""
    rng = random.Random(9)
    said = ["Compiling a", "test a ... ok", "test b ... FAILED", "error  in  b", "error in b", "\x1b[31mfailed\x1b[0m 3 ", "  ", "one, two: thirteen"]
    rows = [(k % 3, k, rng.choice(said), "cargo test") for k in range(90)] + [(7, 1, "Compiling a", "cargo test"), (8, 1, "x", "cargo test"), (8, 2, None, "cargo test")]
    lines = spark.createDataFrame(rows, "doc_id long, k long, line string, command string")
    ordered = F.array_sort(F.collect_list(F.struct("k", "line")))
    docs = lines.where("line IS NOT NULL").groupBy("doc_id", "command").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))
    for budget in (None, 0, 12, 30, 500):
        want = sorted(map(tuple, P.tool(docs, budget).drop("text").collect()))
        assert sorted(map(tuple, P.tool_lines(lines, ["k", "line"], budget).collect())) == want
    for query in (q.p5_tool_pipeline, q.p5_tool_pipeline_in_order):
        assert "collect_list" not in query(spark, small)._jdf.queryExecution().optimizedPlan().toString()


def test_only_ranked_texts_are_counted(spark, small, monkeypatch):
    counted = spark.sparkContext.accumulator(0)

    def told(text):
        counted.add(1)
        return 1

    want = search.bm25(q.docs(spark, small), ["license", "version"]).count()
    monkeypatch.setattr(tokens, "count_heuristic", F.udf(told, "long"))
    assert q.w3_rank_budget(spark, small).count() == counted.value == want < q.docs(spark, small).count()


def test_scores_cut_only_texts_that_may_hold_a_term(spark):
    """And find the same: words inside others, capitals, phrases, texts without words."""
    texts = ["A licensed one", "LICENSE of the", "of license the", "of  the; end", None, "", "\u0130 license", "nothing", "ofthe of", "License, license"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = search.bm25(docs, ["license", "of the", "!"])
    assert {r["doc_id"] for r in got.collect()} == {1, 2, 3, 6, 9}
    assert search.bm25(docs, ["!"]).count() == search.bm25(docs, []).count() == 0
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Contains(lower(text") == 3
