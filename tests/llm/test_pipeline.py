"""The pipeline: every stage against brute force over what the stage before it kept."""

import corpus_pipeline
from glyphmill.llm import neardup, queries, secrets
from pyspark.sql import functions as F

from .helpers import empty, odd
from .test_native import base, measure
from .test_neardup import brute
from .test_packing import check_packed
from .test_scans import norm


def test_stages(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    bench = [norm(r["text"]) for r in spark.read.parquet(f"{medium}/benchmark.parquet").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "decontamination", "secret_scan", "packing"]
    before = docs.collect()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, medium)
        assert made.columns == docs.columns
        docs = spark.createDataFrame(made.collect(), made.schema)
        after = docs.collect()
        kept = {r["doc_id"] for r in after}
        gone = [r for r in before if r["doc_id"] not in kept]
        assert after and gone or name == "secret_scan"
        if name == "quality_rules":
            assert not any(measure(r["text"])[-1] for r in after)
        elif name == "near_duplicates":
            assert kept == {d for d, _, c, k in brute(before, 5) if k}
        elif name == "decontamination":
            assert not any(s in norm(r["text"]) for r in after for s in bench)
        elif name == "secret_scan":
            assert len(after) == len(before)
            assert not any(base(r["text"]) for r in after)
            old = {r["doc_id"]: r["text"] for r in before}
            assert all(r["text"] == old[r["doc_id"]] for r in after if not base(old[r["doc_id"]]) and "[SECRET]" not in r["text"])
        before = after
    check_packed(before, corpus_pipeline.STAGES[-1][1](spark, docs, medium).collect(), 0.95)


def test_stages_take_odd_rows_and_empty_tables(spark, medium):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd(spark, extra=1), medium).count() >= 0
        assert stage(spark, empty(spark), medium).count() == 0


def test_near_duplicates_keep_rows_not_ids(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    data = [(7, text(k)) for k in range(5)]  # one id, five documents
    data += [(7, text(0)), (9, text(1) + " end")]  # a repeated row, and a near copy of a greater id
    data += [(None, text(10)), (None, text(10)), (None, text(11)), (3, text(11))]  # copies without an id
    data += [(1, ""), (1, ""), (None, None), (None, "\t")]
    docs = spark.createDataFrame([(*r, "en", "a", 0) for r in data], odd(spark).schema)
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()), key=repr)
    assert got == sorted([*[(7, text(k)) for k in range(5)], (None, text(10)), (3, text(11)), (1, ""), (None, None), (None, "\t")], key=repr)


def test_redaction_keeps_other_text(spark):
    docs = odd(spark).where("doc_id = 6").withColumn("text", F.lit("é a password = 'abcdefghijklmnop' b"))
    assert corpus_pipeline.secret_scan(spark, docs, "").first()["text"] == "é a [SECRET]' b"
    assert secrets.KINDS[:3] == ("assign", "access", "hex")


def test_beyond_every_broadcast_bound_nothing_changes(spark, small, monkeypatch):
    """Ids, spans and nodes that are joined by shuffle instead: the same rows."""
    docs = spark.read.parquet(f"{small}/documents.parquet").unionByName(odd(spark))
    source = F.col("source")
    marked = lambda: sorted((tuple(r) for r in secrets.redacted(docs, source, source).select("doc_id", "text").collect()), key=str)
    near = lambda: sorted((tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, small).select("doc_id", "text").collect()), key=str)
    found = lambda: sorted((tuple(r) for r in queries.op5_minhash_near_dup(spark, small).collect()), key=str)
    want = marked(), near(), found()
    monkeypatch.setattr(secrets, "BROADCAST_SPANS", -1)
    monkeypatch.setattr(neardup, "BROADCAST_IDS", -1)
    assert (marked(), near(), found()) == want
