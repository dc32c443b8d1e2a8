"""Secret scans, sharding and quality rules against brute force."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

from glyphmill.llm import quality, queries, secrets, sharding
from pyspark.sql import functions as F

from .helpers import empty, key, odd

KEYWORDS = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in KEYWORDS.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def told(spans):
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def check_secrets(docs, got):
    want = Counter()
    for r in docs:
        b = base(r["text"])
        n = Counter(k for _, k, _ in b)
        want[(r["doc_id"], n[0], n[1], n[2], hashlib.sha256(told(b).encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got) == want


def test_secrets_match_brute_force(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet").collect()
    got = queries.op1_secret_scan(spark, medium).collect()
    check_secrets(docs, got)
    assert sum(r["n_assign"] for r in got) > 0


def test_secrets_many_matches_unicode_and_odd_rows(spark):
    text = "é🙂 " + "api_key='abcdefghijklmnop' x " * 1500 + "AKIA" + "A" * 14 + " " + "deadbeef" * 3
    docs = odd(spark).unionByName(spark.createDataFrame([(9, text, "en", "z", 0)], odd(spark).schema))
    got = secrets.digest(secrets.scan(docs, F.col("source"), F.col("source"))).collect()
    check_secrets(docs.collect(), got)
    assert secrets.scan(empty(spark), F.col("source"), F.col("source")).count() == 0


def test_ownership_separates_copied_from_owned(spark):
    opaque = "aB3" * 12
    rows = [(i, f"see {opaque} here", "en", f"s{i}", 0) for i in range(6)] + [(9, "mine " + "zQ7" * 12, "en", "s1", 0)]
    got = {r["doc_id"]: r for r in secrets.digest(secrets.scan(spark.createDataFrame(rows, odd(spark).schema), F.col("source"), F.col("source"))).collect()}
    assert got[9]["spans"] == "opaque:5:41" and got[9]["n_live"] == 1
    assert all(got[i]["spans"] == "" for i in range(6))


def measure(text):
    text = text or ""
    words = [w for w in re.split("[ \t\n\x0b\f\r]+", text) if w]
    windows = defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i : i + 3])].append(i)
    marked = {i + k for v in windows.values() if len(v) > 1 for i in v for k in range(3)}
    lines = [x for x in text.split("\n") if re.search("[^ \t\n\x0b\f\r]", x)]
    n, r = len(words), len(marked)
    return n, sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), r, n < 50 or 100 * r > 50 * n


def check_quality(docs, got):
    fields = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((tuple(r[f] for f in fields) for r in got), key=key) == sorted(((r["doc_id"], *measure(r["text"])) for r in docs), key=key)
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_quality_matches_brute_force(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet").collect()
    got = queries.op10_quality_rules(spark, medium).collect()
    check_quality(docs, got)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{medium}/labels.parquet").collect()}
    fine = [r for r in got if labels.get(r["doc_id"]) == 1 and not r["base_failed"]]
    assert sum(not r["kept"] for r in fine) <= 0.01 * len(fine)


def test_quality_odd_rows(spark):
    docs = odd(spark, kept="x", n_words=7)
    check_quality(docs.collect(), quality.judge(docs).collect())
    assert quality.keep(docs).columns == docs.columns
    assert quality.judge(empty(spark)).count() == 0


def test_quality_plan_has_no_python_or_shuffle(spark, small):
    plan = queries.op10_quality_rules(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def check_shards(docs, got, even=None):
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    assert all(0 <= k < 24 for k in by)
    for rs in by.values():
        assert sorted(r["slot"] for r in rs) == list(range(len(rs)))
    if even:
        loads = [sum(r["size"] for r in rs) for rs in by.values()]
        assert len(loads) == 24 and max(loads) - min(loads) <= even * sum(loads) / 24


def test_one_value_in_every_row(spark):
    """A copied example on all rows and a live one on a third of them, joined to their verdicts by broadcast and by shuffle."""
    copied, live = "password = EXAMPLEexample0123", "token: Zq9Zq9Zq9Zq9Zq9Zq9"
    rows = [(i, f"{copied} and {live if i % 3 == 0 else 'no more'}", f"s{0 if i % 3 == 0 else i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = secrets.scan(docs, repo=F.col("source"), owner=F.col("source")).collect()
    assert len(got) == 3000
    for r in got:
        assert [x["live"] for x in r["base"]] == ([False, True] if r["doc_id"] % 3 == 0 else [False])
    many = spark.createDataFrame([("h", f"r{i}", "o") for i in range(31)] + [("g", f"r{i}", "o") for i in range(30)], "hash string, repo string, owner string")
    assert {r["hash"]: r["live"] for r in secrets.ownership(many).collect()} == {"h": False, "g": True}


def test_sharding_is_even_and_gapless(spark, medium):
    check_shards(spark.read.parquet(f"{medium}/documents.parquet").collect(), queries.op7_sharding(spark, medium).collect(), 0.02)


def test_sharding_spreads_a_repeated_row(spark):
    rows = [(7, "the same row " * 40)] * 2000 + [(100 + k, f"own {k} " * (k % 90)) for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    check_shards(docs.collect(), sharding.shard(docs, 24).collect(), 0.05)


def test_sharding_odd_rows(spark):
    docs = odd(spark, slot="x", shard="y", vslot=1, size=3)
    check_shards(docs.collect(), sharding.shard(docs, 24).collect())
    assert sharding.shard(empty(spark), 24).count() == 0


def test_slot_map_versions_and_edits(spark, tmp_path):
    path, weights = f"file://{tmp_path}/map", [((i * 37) % 101) + 1 for i in range(512)]
    first = sharding.SlotMap.first(512, 4)
    second = first.rebalanced(weights)
    third = second.rebalanced(weights, 5)
    for m in (first, second, third):
        m.save(spark, path)
    assert sharding.SlotMap.load(spark, path) == third and sharding.SlotMap.load(spark, path, 1) == second
    assert max(third.loads(weights)) - min(third.loads(weights)) <= 101
    grown = [(a, b) for a, b in zip(second.shard_of, third.shard_of, strict=True) if a != b]
    assert grown and sum(b == 4 for _, b in grown) >= 0.9 * len(grown)


def test_marks_and_overlaps_as_by_hand(spark):
    rng = random.Random(9)
    rows = []
    for k in range(60):
        t = "".join(rng.choice("ab🙂é\n") for _ in range(rng.choice((0, 5, 900, 6000))))
        span = lambda n=len(t): sorted((lambda a: (a, rng.randrange(3), min(n, a + rng.randrange(1, 60))))(rng.randrange(max(1, n))) for _ in range(rng.choice((0, 1, 4, 700)) if n else 0))
        rows.append((k, t, span(), span()))
    kind = "array<struct<start:bigint,kind:int,end:bigint>>"
    df = spark.createDataFrame(rows, f"id long, t string, xs {kind}, base {kind}")
    got = df.select("id", secrets.put_marks(F.col("t"), F.col("xs"), "#").alias("m"), F.transform(secrets.free_of(F.col("xs"), F.col("base")), lambda x: F.struct(x["start"], x["kind"], x["end"])).alias("f")).collect()
    for r in got:
        _, t, xs, base = rows[r["id"]]
        out, at = "", 0
        for a, _, b in xs:
            out += t[at:a] + "#" if a >= at else ""
            at = max(at, b)
        assert r["m"] == out + t[at:]
        assert [tuple(x) for x in r["f"]] == [x for x in xs if not any(a < x[2] and x[0] < b for a, _, b in base)]


def test_twice_the_secrets_take_twice_the_time(spark):
    def spent(n):
        text = "\n".join(f"{i:032x} Abcdefghij{i:014d}Xyz" for i in range(n))
        docs = spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")
        at = time.time()
        assert secrets.redacted(docs, F.col("source"), F.col("source")).first()["text"].count("[SECRET]") == 2 * n
        assert secrets.digest(secrets.scan(docs, F.col("source"), F.col("source"))).first()["n_hex"] == n
        return time.time() - at

    spent(100)
    assert spent(32_000) < 3 * max(2.0, spent(16_000))
