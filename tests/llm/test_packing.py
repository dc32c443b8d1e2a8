"""Packing: exact round trip, no overflow, little padding."""

import zlib
from collections import Counter, defaultdict

import numpy as np
from glyphmill.llm import packing, queries
from tokenizers import Tokenizer

from .helpers import empty, odd


def check_packed(docs, got, fill=None):
    t = Tokenizer.from_file(queries.tokenizer_path())
    want = Counter()
    for r in docs:
        ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for s in range(0, len(ids), 2048):
            p = ids[s : s + 2048]
            want[(r["doc_id"], s, len(p), zlib.crc32(p.tobytes()), len(ids))] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for ps in by.values():
        at = 0
        for offset, length in sorted(ps):
            assert offset == at
            at += length
        assert at <= 2048
    if fill:
        assert sum(r["length"] for r in got) >= fill * 2048 * len(by)
    return by


def test_packing_round_trip(spark, medium):
    check_packed(spark.read.parquet(f"{medium}/documents.parquet").collect(), queries.op3_packing(spark, medium).collect(), 0.97)


def test_packing_odd_rows(spark):
    docs = odd(spark, start="x", length=1, sequence_id=2)
    check_packed(docs.collect(), packing.pack(docs, queries.tokenizer_path()).collect())
    assert packing.pack(empty(spark), queries.tokenizer_path()).count() == 0


def test_one_row_as_a_third_of_the_table(spark):
    rows = [(7, "the same row " * 40)] * 400 + [(k, f"word {k} " * (k % 90)) for k in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    check_packed(docs.collect(), packing.pack(docs, queries.tokenizer_path()).collect())


def test_words_the_fast_way_misses():
    coder, t = packing.WordIds(queries.tokenizer_path()), Tokenizer.from_file(queries.tokenizer_path())
    texts = ["don't we'll \x1c x\x1fy İstanbul ΣΑΣ éé 12,5 <|endoftext|> a b", "plain words. More, of them!!", "ß ŒUVRE Ünï|", ""]
    for _ in range(2):
        got = [np.frombuffer(x, dtype="<u4").tolist() for x in coder.of(texts)]
        assert got == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_column_generation_beats_no_packing_and_holds_demand():
    rng = np.random.default_rng(3)
    histogram = {int(s): int(n) for s, n in zip(range(1, 257), rng.integers(0, 900, 256), strict=True) if n}
    made = packing.plan(histogram, 256)
    held = Counter()
    for pattern, times in made:
        assert sum(s * n for s, n in pattern.items()) <= 256
        for s, n in pattern.items():
            held[s] += n * times
    assert dict(held) == histogram
    least = sum(s * n for s, n in histogram.items()) / 256
    assert sum(times for _, times in made) <= 1.02 * least + 10
