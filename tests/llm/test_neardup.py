"""Near duplicates against brute force over all pairs."""

import random
from collections import defaultdict

import numpy as np
from glyphmill.llm import neardup, queries
from glyphmill.llm.neardup import Settings

from .helpers import empty, key, odd


def sets_of(rows, k):
    out = []
    for r in rows:
        words = (r["text"] or "").encode().lower().split()
        out.append((r["doc_id"], frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])))
    return out


def brute(rows, k, percent=80):
    sets = sets_of(rows, k)
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(set)
    for d, s in sets:
        if s:
            by[s].add(d)
    distinct = list(by)
    holders = defaultdict(list)
    for i, s in enumerate(distinct):
        for x in s:
            holders[x].append(i)

    def union(a, b):
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)

    for i, s in enumerate(distinct):
        ids = sorted(by[s])
        for d in ids[1:]:
            union(ids[0], d)
        shared = defaultdict(int)
        for x in s:
            for j in holders[x]:
                if j < i:
                    shared[j] += 1
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(distinct[j]) - n):
                union(ids[0], min(by[distinct[j]]))
    return sorted((d, len(s), find(d), find(d) == d) for d, s in sets)


def told(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_shingles", "component_id", "kept")) for r in df.collect()), key=key)


def test_near_duplicates_match_brute_force(spark, medium):
    rows = spark.read.parquet(f"{medium}/documents.parquet").collect()
    assert told(queries.op5_minhash_near_dup(spark, medium)) == brute(rows, 2)


def test_large_near_group_with_chains(spark):
    """Copies that drift: many pairs lie under the threshold, and components hang on a few links."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    rows, text = [], list(base)
    for i in range(260):
        if i % 40 == 0:
            text = [rng.choice(vocabulary) for _ in range(120)] if i % 80 else list(base)
        text = list(text)
        for _ in range(rng.choice((1, 2, 4, 6))):
            text[rng.randrange(120)] = rng.choice(vocabulary)
        rows.append((i, " ".join(text), "en", "s", 0))
    docs = spark.createDataFrame(rows, odd(spark).schema)
    assert told(neardup.near_duplicates(docs, Settings(words=2))) == brute(docs.collect(), 2)


def test_blocks_join_what_hubs_leave(spark, monkeypatch):
    """Copies of one text, each with its own changes: most pairs lie about the threshold, so hubs leave hundreds of
    components in each bucket, and areas span several blocks."""
    monkeypatch.setattr(neardup, "BLOCK", 300)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(2000)]
    base = [rng.choice(words) for _ in range(100)]
    rows = []
    for i in range(1500):
        text = list(base)
        for at in rng.sample(range(100), rng.choice((2, 6, 9, 12, 14))):
            text[at] = rng.choice(words[:50])
        rows.append((i, " ".join(text), "en", "s", 0))
    docs = spark.createDataFrame(rows, odd(spark).schema)
    want = brute(docs.collect(), 1)
    assert 20 < len({c for _, _, c, _ in want}) < 1400
    assert told(neardup.near_duplicates(docs, Settings(words=1))) == want


def test_joining_links_match_pairs():
    """Shared counts against set intersection, with elements of few and of many members."""
    rng = random.Random(3)
    sets = [np.array(sorted({rng.randrange(60) for _ in range(12)} | {1000 + rng.randrange(4000) for _ in range(6)}), dtype=np.uint64) for _ in range(200)]
    left, right = np.arange(0, 120), np.arange(80, 200)
    got = neardup.shared_counts(sets, left, right)
    assert all(got[i, j] == len(np.intersect1d(sets[x], sets[y])) for i, x in enumerate(left) for j, y in enumerate(right) if x != y)
    assert neardup.joining(np.arange(2), np.arange(2), [sets[0], sets[0]], np.array([0]), np.array([1]), 80) == [(0, 1)]
    assert neardup.joining(np.arange(2), np.zeros(2), [sets[0], sets[0]], np.array([0]), np.array([1]), 80) == []


def test_an_id_of_many_texts_and_heavy_copies(spark):
    """One id on a third of the rows with texts of their own, and one text on another third."""
    rng = random.Random(4)
    own = lambda k: " ".join(f"a{k}b{rng.randrange(10**6)}" for _ in range(30))
    rows = [(7, own(k)) for k in range(60)] + [(100 + k, "the same text here again and again") for k in range(60)] + [(300 + k, own(k)) for k in range(60)]
    docs = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], odd(spark).schema)
    got = told(neardup.near_duplicates(docs, Settings(words=2)))
    assert len(got) == 180
    assert [r for r in got if r[0] == 7] == [(7, 29, 7, True)] * 60
    assert {r[2] for r in got if 100 <= r[0] < 160} == {100}
    assert all(r[3] for r in got if r[0] >= 300)


def test_odd_rows(spark):
    got = told(neardup.near_duplicates(odd(spark, node=1, bands="x"), Settings(words=2)))
    assert len(got) == 8
    by = {r[0]: r for r in got}
    assert by[1][1:] == (0, 1, True) and by[3][1:] == (0, 3, True) and by[4][1:] == (1, 4, True)
    assert by[None][2] is None and by[None][3]
    assert neardup.near_duplicates(empty(spark)).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    got = {r["node"]: r["comp"] for r in neardup.components(edges).collect()}
    assert all(got[i] == 0 for i in range(1, 201)) and got[501] == 500
