"""Neighbours, collapse and diverse selection in blocks against the dense versions."""

import numpy as np
import pytest
from glyphmill.operators import blocks, vectors
from pyspark.sql import functions as F


def unit(rng, n, dims=6, centres=8, spread=0.25):
    c = rng.normal(size=(centres, dims))
    x = c[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dims))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def frame(spark, v, grp=None):
    rows = [(int(grp[k]) if grp is not None else 0, k, [float(y) for y in x]) for k, x in enumerate(v)]
    return spark.createDataFrame(rows, "grp long, id long, v array<float>").repartition(5)


@pytest.mark.parametrize("limit", [0, 1 << 26])
def test_nearest_skips_block_pairs_and_loses_none(spark, monkeypatch, limit):
    monkeypatch.setattr(blocks, "ROWS", 40)
    monkeypatch.setattr(blocks, "BROADCAST_BYTES", limit)
    rng = np.random.default_rng(1)
    v = unit(rng, 1500)
    rows = frame(spark, v)
    odd = spark.createDataFrame([(0, 9001, None), (0, 9002, [1.0]), (0, 9003, [0.0] * 6)], "grp long, id long, v array<float>")
    got = {(r["query_id"], r["rank"]): (r["id"], r["similarity"]) for r in blocks.nearest(rows.unionByName(odd), rows.where("id % 50 = 0").unionByName(odd), 0.6, 7, "id", "v").collect() if r["query_id"] < 9000}
    sims = np.round(np.clip(v.astype(np.float64) @ v.astype(np.float64).T, -1, 1), 6)
    want = {}
    for q in range(0, 1500, 50):
        order = [i for i in np.lexsort((np.arange(1500), -sims[q])) if v[q].astype(np.float64) @ v[i].astype(np.float64) >= 0.6][:7]
        want |= {(q, k + 1): (int(i), float(sims[q, i])) for k, i in enumerate(order)}
    assert got == want
    near = blocks.pivots_of(rows)
    b = blocks.pack(rows.select("grp", "id", F.lit(0.0).alias("told"), "v"), False, near)
    all_pairs, met = b.count() ** 2, b.alias("a").join(b.alias("b"), blocks.reach("a", "b", 0.6)).count()
    assert 0 < met < 0.6 * all_pairs, (met, all_pairs)


def test_collapse_of_large_groups_is_the_sequential_one(spark):
    """A group of 20,000 rows and small ones; no task holds a group, as blocks are of 1,024 rows."""
    rng = np.random.default_rng(2)
    v = unit(rng, 20_600, 8, 300, 0.12)
    grp = np.where(np.arange(len(v)) < 20_000, 1, 2 + np.arange(len(v)) % 3)
    got = {r["id"]: r["kept_id"] for r in blocks.collapse(frame(spark, v, grp), 0.92).collect()}
    want = {}
    for g in set(grp.tolist()):
        at = np.flatnonzero(grp == g)
        _, owner = vectors.collapse(v[at].astype(np.float64), 0.92)
        want |= {int(at[k]): int(at[o]) for k, o in enumerate(owner)}
    assert got == want and len(set(want.values())) < 8_000


def test_collapse_chains_copies_and_nothing(spark, monkeypatch):
    monkeypatch.setattr(blocks, "ROWS", 3)
    step = np.arange(24) * 0.3
    v = np.stack([np.cos(step), np.sin(step)], axis=1).astype(np.float32)  # each is near the next alone
    v = np.vstack([v, v[:1].repeat(9, axis=0), np.zeros((2, 2), dtype=np.float32)])
    rows = frame(spark, v).unionByName(spark.createDataFrame([(0, 99, None)], "grp long, id long, v array<float>"))
    got = {r["id"]: r["kept_id"] for r in blocks.collapse(rows, 0.92).collect()}
    _, owner = vectors.collapse(v.astype(np.float64), 0.92)
    assert got == dict(enumerate(owner)) | {99: 99} and got[1] == 0 and got[2] == 2 and got[34] == 34
    assert blocks.collapse(rows.where("false"), 0.9).count() == 0


def test_diverse_choice_is_the_dense_one(spark, monkeypatch):
    monkeypatch.setattr(blocks, "ROWS", 30)
    rng = np.random.default_rng(4)
    v, relevance = unit(rng, 400), np.round(rng.random(400), 1)
    v[1::2] = v[::2]
    grp = np.where(np.arange(400) < 300, 1, 2 + np.arange(400) % 2)
    rows = frame(spark, v, grp).join(spark.createDataFrame([(k, float(x)) for k, x in enumerate(relevance)], "id long, relevance double"), "id")
    got = {(r["query_id"], r["position"]): r["id"] for r in blocks.diverse(rows.withColumnRenamed("grp", "query_id"), 6).collect()}
    for g in (1, 2, 3):
        at = np.flatnonzero(grp == g)
        order = vectors.diverse(v[at].astype(np.float64), relevance[at], 6)
        assert [got[g, p] for p in range(6)] == [int(at[k]) for k in order]
    few = rows.where("id < 3").withColumnRenamed("grp", "query_id")
    assert blocks.diverse(few, 6).count() == 3 and blocks.diverse(few.where("false"), 6).count() == 0
