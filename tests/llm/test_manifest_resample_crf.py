"""Resampling, Merkle manifest and line-chain quality against brute force."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from glyphmill.llm import common, crf, merkle, queries, resample
from pyspark.sql import functions as F

from .helpers import ODD, empty, key, odd


@pytest.fixture
def many_groups(monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_GROUPS", 1)


def test_places_in_hot_groups_and_repeated_rows(spark, many_groups):
    """A third of the rows are one row repeated; offsets go by shuffle."""
    rows = [("a", 5)] * 200 + [(None, k % 7) for k in range(100)] + [(f"g{k % 50}", k) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(6)
    got = common.numbered(df, ["g"], [F.col("v").desc()], "at", "n").collect()
    for g in {r["g"] for r in got}:
        own = sorted((r["at"], r["v"], r["n"]) for r in got if r["g"] == g)
        assert [a for a, _, _ in own] == list(range(len(own))) and {n for _, _, n in own} == {len(own)}
        assert [v for _, v, _ in own] == sorted((v for _, v, _ in own), reverse=True)
    all_at = common.numbered(df, [], [F.col("v").asc()], "at").collect()
    assert sorted(r["at"] for r in all_at) == list(range(600))


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_resample(rows, target, s):
    def words(t):
        return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    def feats(t):
        w = words(t)
        return [" ".join(w[i : i + n]) for n in range(1, s.longest + 1) for i in range(len(w) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % s.buckets
    have, want = Counter(bucket(f) for _, t in rows for f in feats(t)), Counter(bucket(f) for t in target for f in feats(t))
    n, m = sum(have.values()), sum(want.values())
    gain = {b: math.floor(1000 * math.log((want[b] + 1) * (n + s.buckets) / ((have[b] + 1) * (m + s.buckets)))) for b in {*have, *want}}
    out = []
    for i, t in rows:
        f = feats(t)
        weight = sum(gain[bucket(x)] for x in f)
        h = int(hashlib.sha256(f"{s.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(t)) >= s.least_words])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is not None, r[0]))
    for k, r in enumerate(able[: len(able) * s.percent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=key)


@pytest.mark.parametrize("longest", [1, 2])
def test_resampling_as_by_hand(spark, small, longest, monkeypatch):
    monkeypatch.setattr(resample, "BLOCK_ROWS", 7)
    monkeypatch.setattr(resample, "WORDS_KEPT", 50)
    s = resample.Settings(longest=longest, buckets=500, least_words=3, percent=40)
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").unionByName(odd(spark).select("doc_id", "text"))
    target = spark.read.parquet(f"{small}/benchmark.parquet").select("text")
    got = resample.resample(docs.withColumn("score", F.lit("x")).withColumn("ids", F.lit(1)), target, s).collect()
    want = plain_resample([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()], s)
    assert sorted((tuple(r) for r in got), key=key) == want


def test_blocks_lie_in_small_row_groups(spark, tmp_path):
    """A row group is what a reader unpacks at once, whatever a task's share of the matrix is."""
    words = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7999)), lambda k: F.concat(F.lit("w"), (k + F.col("id") * 17).cast("string"))), " ")
    docs = spark.range(300).select(F.col("id").alias("doc_id"), words.alias("text")).coalesce(1)
    resample.write_matrix(docs, str(tmp_path / "m"), resample.Settings())
    files = [pq.ParquetFile(f).metadata for f in (tmp_path / "m").glob("*.parquet")]
    sizes = [m.row_group(k).total_byte_size for m in files for k in range(m.num_row_groups)]
    assert len(sizes) > 1 and max(sizes) < 4 << 20


def test_resampling_of_nothing(spark):
    nothing = empty(spark).select("text")
    assert resample.resample(empty(spark), odd(spark).select("text")).count() == 0
    got = resample.resample(odd(spark), nothing, resample.Settings(percent=100)).collect()
    assert len(got) == len(ODD) and sorted(r["rank"] for r in got if r["rank"]) == [1]  # one text has 20 words


def plain_manifest(rows, change, fanout=3):
    H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    spell = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, t, la, so, n: H(*(spell(v) for v in (i, so, la, n, t)))

    def tree(nodes):
        """The root, and each node's (left, right) siblings by level."""
        paths, where = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, w in enumerate(where):
                a = w // fanout * fanout
                paths[k].append(("".join(nodes[a:w]), "".join(nodes[w + 1 : a + fanout])))
            nodes, where = [H(*nodes[a : a + fanout]) for a in range(0, len(nodes), fanout)], [w // fanout for w in where]
        return nodes[0], paths

    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r))) for s in sources}
    trees = {s: tree([leaf(*r) for r in own[s]]) for s in sources}
    root, over = tree([trees[s][0] for s in sources])
    out = []
    for s, above in zip(sources, over, strict=True):
        for r, path in zip(own[s], trees[s][1], strict=True):
            now = leaf(*change(r))
            for a, b in path + above:
                now = H(a, now, b)
            out.append((r[0], leaf(*r), trees[s][0], root, H(*(x for ab in path + above for x in ab)), now, now == root))
    return sorted(out, key=key)


def broken(r):
    return (r[0], r[1].replace("\n", "") if r[1] is not None and zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 2 == 0 else r[1], *r[2:])


def test_manifest_as_by_hand(spark, small, many_groups):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    more = [(None, "a\nb", "en", None, 3), (None, None, None, None, None), (7, "x\ny", "en", "lone", 3), (8, "p\n", "en", "é", 2), (8, "p\n", "en", "é", 2), (9, "", "en", "", 0)]
    docs = docs.unionByName(odd(spark).select(docs.columns)).unionByName(spark.createDataFrame(more, docs.schema))
    text = F.when(queries.fold("doc_id", 2) == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    got = merkle.manifest(docs.withColumn("hash", F.lit(1)).withColumn("idx", F.lit("x")).withColumn("_g", F.lit(2)), {"text": text}).collect()
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    want = plain_manifest([tuple(r) for r in docs.collect()], broken)
    assert sorted((tuple(r[n] for n in names) for r in got), key=key) == want
    assert {True, False} == {r["verified"] for r in got} and {r["source"] for r in got} >= {None, "", "é", "lone"}


def test_manifest_of_one_row_one_source_and_nothing(spark):
    one = odd(spark).limit(1)
    r = merkle.manifest(one).first()
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] and r["verified"] and r["path"] == []
    same = odd(spark).withColumn("source", F.lit("s"))
    rows = merkle.manifest(same, fanout=2).collect()
    assert len(rows) == len(ODD) and {(x["subroot"], x["verified"]) for x in rows} == {(rows[0]["root"], True)} and {len(x["path"]) for x in rows} == {3}
    assert merkle.manifest(empty(spark)).count() == 0


def test_line_chances_are_sums_over_all_labellings():
    rng = np.random.default_rng(3)
    counts, good, bad = np.array([3, 1, 6, 5, 1]), 0.7, -0.4
    said = rng.normal(size=counts.sum())
    got, at, total = crf.marginals(said, counts, good, bad), 0, 0.0
    label = rng.integers(0, 2, counts.sum()).astype(float)
    for n in counts:
        own, parts = said[at : at + n], np.zeros(n)
        weigh = lambda y, own=own: math.exp(sum(e * v for e, v in zip(own, y, strict=True)) + sum(good if a and b else bad if not a and not b else 0 for a, b in itertools.pairwise(y)))
        all_of = [(weigh(y), y) for y in itertools.product((0, 1), repeat=int(n))]
        z = sum(w for w, _ in all_of)
        for w, y in all_of:
            parts += w / z * np.array(y)
        assert np.allclose(got[at : at + n], parts)
        total += math.log(weigh(tuple(int(v) for v in label[at : at + n])) / z)
        at += n
    mask = np.arange(6) < counts[:, None]
    padded = [np.zeros(mask.shape) for _ in range(2)]
    padded[0][mask], padded[1][mask] = said, label
    value, from_lines, from_good, from_bad = crf.likelihood(padded[0], padded[1], mask, good, bad)
    assert np.isclose(value, total)
    eps = 1e-6
    assert np.isclose((crf.likelihood(padded[0], padded[1], mask, good + eps, bad)[0] - value) / eps, from_good, atol=1e-3)
    assert np.isclose((crf.likelihood(padded[0], padded[1], mask, good, bad + eps)[0] - value) / eps, from_bad, atol=1e-3)
    moved = padded[0].copy()
    moved[2, 3] += eps
    assert np.isclose((crf.likelihood(moved, padded[1], mask, good, bad)[0] - value) / eps, from_lines[2, 3], atol=1e-3)


def test_lines_and_neighbours():
    lines = crf.lines_of(["a b\n\nA!", None, "x"])
    assert lines.counts.tolist() == [3, 1, 1] and lines.weight.tolist() == [2, 0, 2, 0, 1]
    seen, n = lines.seen(), crf.OWN
    assert (seen[1, n : 2 * n] == lines.own[0]).all() and (seen[1, 2 * n : 3 * n] == lines.own[2]).all()
    assert not seen[3, n : 3 * n].any() and not seen[2, 2 * n : 3 * n].any() and seen[:, -3].tolist() == [1, 0, 0, 1, 1]


def test_a_bad_line_among_good_ones(spark, medium):
    docs, labels = queries.table(spark, medium, "documents"), queries.table(spark, medium, "labels")
    model = crf.fit(docs.select("doc_id", "text"), labels, queries.fold("doc_id", 5) != 0)
    good = ["The nding of thanea was there and on the otherand.", "Itstions are the onest of allern.", "Onnd ther ea by the thoush.", "Erand the hathe for edly inre."]
    text = "\n".join([*good[:2], "WHEN!! AND!! THEN!! ONLY!! NOW!! WHEN!! AND!! THEN!! ONLY!! NOW!! WHEN!! AND!! THEN!!", *good[2:]])
    found = {r["line"]: r["p_good"] for r in crf.line_labels(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).collect()}
    assert len(found) == 5 and min(found, key=found.get) == 2 and found[2] < 0.1 and found[0] > 0.5


def test_quality_on_held_out_rows(spark, medium):
    sf = f"{medium}/../sf0.1"
    got = {r["doc_id"]: r for r in queries.op13_quality_classifier(spark, sf).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    held = [(r["quality"], got[r["doc_id"]]["predicted"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r["doc_id"]]["held_out"] and r["quality"] is not None]
    kept = sum(p for y, p in held if y) / sum(y for y, _ in held)
    passed = sum(p for y, p in held if not y) / sum(1 - y for y, _ in held)
    assert kept >= 0.99 and passed <= 0.03, (kept, passed)


def test_quality_odd_rows(spark, medium):
    labels = spark.createDataFrame([(1, 0), (2, 0), (5, 1), (6, 1), (4, None), (None, 1), (99, 1)], "doc_id long, quality int")
    model = crf.fit(odd(spark), labels, F.lit(True))
    got = crf.score(odd(spark, score="x", quality=1, predicted=None), model, keep={"held_out": F.lit(True)}).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2, 3)}) == 1  # null, empty and blank
    assert crf.score(empty(spark), model).count() == 0
    one = crf.fit(odd(spark), labels.where("quality = 1"), F.lit(True))
    assert {r["score"] for r in crf.score(odd(spark), one).collect()} == {1.0}
    assert {r["score"] for r in crf.score(odd(spark), crf.fit(empty(spark), labels.where("false"), F.lit(True))).collect()} == {0.0}
    long = spark.createDataFrame([(1, "word " * 300_000), (2, "\n" * 30_000)], "doc_id long, text string")
    assert crf.score(long, model).count() == 2
