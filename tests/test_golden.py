"""Small cases with known answers, and invariants."""

import ast
import io
import random
import re
import time
from datetime import UTC, datetime

import numpy as np
import pytest
from glyphmill.functions import detect, scores, text, tokens
from glyphmill.operators import code, fragments, graph, index, metrics, search, store, vectors
from glyphmill.plans import optimize
from glyphmill.sources import files
from glyphmill.streaming import changes
from pyspark.sql import functions as F


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("given", "want"),
    [("", 0), ("   \t  ", 0), ("hello", 1), ("the quick brown fox", 4), ("漢字仮名", 4), ("hello, world!", 4), ("1234567890", 4), ("internationalization", 5), (None, 0), ("a\n\n\nb", 4), ("it's", 1), ("a b　c", 3)],
)
def test_token_counts(spark, given, want):
    assert value(spark, tokens.count_heuristic(F.lit(given).cast("string"))) == want


def test_tokenizer_names():
    assert tokens.tokenizer("heuristic") is tokens.count_heuristic
    with pytest.raises(KeyError):
        tokens.tokenizer("Heuristic")


def test_budget_algebra(spark):
    five, nine = F.lit(5).cast("long"), F.lit(9).cast("long")
    assert value(spark, tokens.fits(five, five)) and not value(spark, tokens.fits(five, nine))
    assert value(spark, tokens.remaining(five, nine)) == 0 and value(spark, tokens.remaining(nine, five)) == 4
    assert [value(spark, x) for x in tokens.split_budget(nine, F.lit(0.5))] == [4, 5]


@pytest.mark.parametrize(
    ("given", "path", "want"),
    [
        ("a\0b", "x.md", "binary"), ("{}", "x.PY", "code"), ('{"a":1}', None, "json"), ("\x1b[31mred", None, "terminal"), ("2026-01-01 10:00 started\n2026-01-01 10:01 done", None, "log"),
        ("# h\n- a", None, "markdown"), ("fn x() {\n}", None, "code"), ("", None, "plain_text"), ("just words", ".bashrc", "plain_text"), ("[1, 2]", None, "json"), ("[x]", None, "plain_text"),
    ],
)
def test_detect(spark, given, path, want):
    assert value(spark, detect.detect(F.lit(given), F.lit(path).cast("string"))) == want


def test_fragments_round_trip(spark):
    docs = spark.createDataFrame([(1, "a\nb\n\n \nc\r\nd\n")], "doc_id long, text string")
    assert [r["content"] for r in fragments.split(docs, "blocks").orderBy("idx").collect()] == ["a\nb", "c\nd\n"]
    lines = fragments.split(docs, "lines")
    assert [r["content"] for r in lines.orderBy("idx").collect()] == list("abcd")
    assert fragments.join(lines).first()["text"] == "a\nb\nc\nd\n"


@pytest.mark.parametrize(("given", "want"), [("\x1b[32mok\x1b[0m", "ok"), ("\x1b]0;title\x07text", "text"), ("\x1b]0;t\x1b\\x", "x"), ("\x1bMx", "x"), ("a\x1b[1", "a"), ("plain", "plain")])
def test_strip_ansi(spark, given, want):
    assert value(spark, text.strip_ansi(F.lit(given))) == want


@pytest.mark.parametrize(("given", "want"), [("[=====>    ] 45%", True), ("45% complete", False), ("totals: 1 2 3", False), ("1 2 3", False), ("", True), ("█████ 10/20", True), ("---", True), ("--", False)])
def test_progress_noise(spark, given, want):
    assert value(spark, text.is_progress_noise(F.lit(given))) == want


@pytest.mark.parametrize(
    ("one", "two", "same"),
    [
        ("2026-01-01 10:00:00 WARN retry 3", "2026-01-02 11:30:05 WARN retry 77", True), ("[core] took 12ms", "[net] took 900ms", True), ("job 3fa85f64-5717 failed", "job 9bc41a20-0001 failed", True),
        ("100 items", "100 files", False),
    ],
)
def test_message_keys(spark, one, two, same):
    assert (value(spark, text.message_key(F.lit(one))) == value(spark, text.message_key(F.lit(two)))) == same


def test_log_pipeline_collapses_repeats(spark):
    log = "\n".join([*(f"2026-01-01 10:00:0{i} WARN slow query {i}" for i in range(3)), "[=====] 50%", "2026-01-01 10:00:09 ERROR disk full"])
    got = optimize.log(spark.createDataFrame([(1, log)], "doc_id long, text string")).first()
    assert got["text"] == "2026-01-01 10:00:00 WARN slow query 0  (repeated 3 times)\n2026-01-01 10:00:09 ERROR disk full\n"


def test_tool_pipeline_keeps_what_matters(spark):
    status = 'On branch main\n  (use "git add <file>..." to update)\n\tmodified:   a.rs\nno changes added to commit (use "git add" and/or "git commit -a")'
    tests = "test a ... ok\ntest b ... FAILED\nfailed with 3\nfailed with 4"
    docs = spark.createDataFrame([(1, status, "git status"), (2, tests, "cargo test")], "doc_id long, text string, command string")
    got = {r["doc_id"]: r["text"] for r in optimize.tool(docs).collect()}
    assert "modified" in got[1] and "use" not in got[1]
    assert got[2] == "test b ... FAILED\nfailed with 3\nfailed with 4\n"


def test_savings_always_sum_up(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet").limit(120)
    for budget in (None, 50):
        for r in optimize.optimize(docs, budget).collect():
            assert sum(r[s] for s in optimize.SAVINGS) == r["original_tokens"] - r["optimized_tokens"]
            if budget and r["optimizer"] == "text":
                assert r["optimized_tokens"] <= budget


def test_code_is_never_deduplicated(spark):
    source = "fn a() {\n}\n\nfn a() {\n}\n"
    got = optimize.conservative(spark.createDataFrame([(1, source)], "doc_id long, text string")).first()
    assert got["text"].count("fn a()") == 2


def test_json_pipeline(spark):
    import json

    big = json.dumps({"b": 1.50, "a": list(range(500)), "s": "x" * 900})
    docs = spark.createDataFrame([(1, '{ "b": 1,\n "a": [1, 2] }'), (2, big), (3, '{"a":1}\n\n{"b": 2}'), (4, "{nope}\n\n  x")], "doc_id long, text string")
    free = {r["doc_id"]: r["text"] for r in optimize.json_text(docs).collect()}
    assert free[1] == '{"b":1,"a":[1,2]}\n' and free[3] == '{"a":1}\n{"b":2}\n' and free[4] == "{nope}\n  x\n"
    tight = {r["doc_id"]: r for r in optimize.json_text(docs, 200).collect()}
    assert "more items omitted" in tight[2]["text"] and list(json.loads(tight[2]["text"])) == ["b", "a", "s"] and tight[2]["optimized_tokens"] <= 200


def test_compile_spends_in_order(spark):
    rows = spark.createDataFrame([(1, 0, 50), (1, 1, 100), (1, 2, 10)], "group_id long, position long, tokens long")
    got = [(r["position"], r["allowance"], r["used"]) for r in optimize.compile_sections(rows, 120, F.lit(5).cast("long")).orderBy("position").collect()]
    assert got == [(0, 115, 50), (1, 60, 60), (2, 0, 0)]


@pytest.mark.parametrize(("given", "want"), [("parseHttpResponse", ["parse", "http", "response"]), ("parse_http_response", ["parse", "http", "response"]), ("HTTPResponse", ["http", "response"]), ("value2Text", ["value2", "text"])])
def test_identifier_tokens(spark, given, want):
    assert value(spark, text.identifier_tokens(F.lit(given))) == want == vectors.tokenize(given)


def test_fnv_and_embeddings():
    assert [f"{vectors.fnv1a(x):x}" for x in (b"", b"a", b"authenticate")] == ["cbf29ce484222325", "af63dc4c8601ec8c", "4b2d077a4b387c2c"]
    one, same, other, none = (vectors.embed(t) for t in ("open the user session store", "the session store of a user", "banana bread with walnuts", ""))
    assert abs(one @ one - 1) < 1e-5 and one @ same > 0.3 > one @ other and not none.any()
    assert (vectors.decode(vectors.encode(one)) == one).all() and vectors.decode(b"abc") is None and vectors.decode(vectors.encode([float("nan")])) is None


def test_greedy_collapse_compares_with_kept_only():
    v = np.array([[1, 0], [0.96, 0.28], [0.8432, 0.5376]])
    assert vectors.collapse(v, 0.92) == ([0, 2], [0, 0, 2])
    rng = np.random.default_rng(0)
    w = rng.normal(size=(40, 8))
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    order = vectors.diverse(w, rng.random(40), 10)
    assert len(set(order)) == 10 and vectors.diverse(np.eye(3), np.array([1.0, 1.0, 1.0]), 1) == [2]


def test_query_parsing():
    q = search.Query.parse
    assert q('find "the user store" fast').terms == ("find", "the user store", "fast")
    assert q("the Session").terms == ("session",) and q("the of").terms == ("the", "of") and q("  ").terms == ()


def test_symbol_search_order(spark):
    symbols = spark.createDataFrame([(1, "load"), (2, "loader"), (3, "preload"), (4, "lo%ad")], "file_id long, name string").withColumn("line", F.lit(1))
    places = spark.createDataFrame([(i, "r", f"p{i}") for i in range(1, 5)], "file_id long, root string, path string")
    assert [r["name"] for r in search.symbol_search(symbols, places, "load").collect()] == ["load", "loader", "preload"]
    assert [r["name"] for r in search.symbol_search(symbols, places, "%").collect()] == ["lo%ad"]
    assert search.symbol_search(symbols, places, "load", "other").count() == 0


def test_graph(spark):
    e = spark.createDataFrame([("api", "auth", "imports"), ("api", "auth", "calls"), ("auth", "db", "imports"), ("web", "db", "imports"), ("jobs", "db", "imports"), ("db", "api", "calls")], "src string, dst string, kind string")
    assert [tuple(r) for r in graph.most_depended_on(e, 1).collect()] == [("db", 3)]
    start = spark.createDataFrame([("api",)], "node string")
    assert [r["node"] for r in graph.reachable(e, start, 1).collect()] == ["auth"]
    assert {r["node"] for r in graph.reachable(e, start, 9).collect()} == {"auth", "db"}
    assert tuple(graph.counts(e).first()) == (5, 6)


PYTHON = "import os\nfrom .database import Db\nfrom typing import Any\n\nclass SessionStore:\n    def get(self):\n        return load(self)\n\ndef authenticate(x):\n    return check(x)\n"


def test_code_extraction():
    got = code.extract("python", PYTHON)
    assert {(k, n) for w, k, _, n, *_ in got if w == "symbol"} == {("class", "SessionStore"), ("function", "get"), ("function", "authenticate")}
    assert {n for w, _, _, n, *_ in got if w == "import"} == {"os", ".database", "typing"}
    assert {(f, n) for w, _, f, n, *_ in got if w == "call"} == {("get", "load"), ("authenticate", "check")}
    assert code.extract("python", "def (") == []
    assert ("symbol", "function", None, "run", 1, 1) in code.extract("rust", "pub fn run(x: u8) {}")
    assert ("import", "imports", None, "./a.js", 1, 1) in code.extract("typescript", "import { x } from './a.js'")
    assert ast.parse(PYTHON)


def test_import_candidates():
    assert "src/a.ts" in code.candidates("typescript", "src/main.ts", "./a.js") and code.candidates("typescript", "src/main.ts", "react") == []
    assert code.candidates("python", "pkg/mod.py", ".db")[0] == "pkg/db.py" and "pkg/db/__init__.py" in code.candidates("python", "pkg/mod.py", ".db")
    assert "crates/my-core/src/token.rs" in code.candidates("rust", "crates/x/src/lib.rs", "my_core::token::Thing")
    assert code.candidates("go", "a.go", "fmt") == []


def test_globs_and_ignores(spark):
    assert files.glob_match("*.rs", "a.rs") and not files.glob_match("*.rs", "src/a.rs") and files.glob_match("**/*.rs", "src/x/a.rs") and files.glob_match("a?c", "abc") and not files.glob_match("a?c", "a/c")
    rules = files.ignore_rules(["*.log", "!keep.log", "build/", "/docs/*.md"])
    ignored = lambda p: value(spark, files.is_ignored(F.lit(p), rules))
    assert ignored("x/a.log") and not ignored("x/keep.log") and ignored("x/build/y") and not ignored("build") and ignored("docs/a.md") and not ignored("x/docs/a.md")


def test_walk_read_and_projects(spark, tmp_path):
    for path, data in {"Cargo.toml": "[x]", "src/a.rs": "fn a() {}\r\n", "target/b.rs": "x", "big.txt": "x" * 50, "bin.dat": "a\0b", "debug.log": "x"}.items():
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data.encode())
    walked = files.walk(spark, str(tmp_path), "*.log\n", max_bytes=40)
    assert tuple(files.walk_report(walked).first()) == (3, 2, 1)
    assert {re.sub(".*/", "", r["path"]): r["content"] for r in files.read(spark, str(tmp_path)).collect()}["a.rs"] == "fn a() {}\n"
    assert files.detect_projects(walked).first()["languages"] == ["rust"]


def test_rollups(spark):
    hour = 3_600_000
    rows = [(0, "optimize", None, 100, 40), (hour - 1, "optimize", None, 200, 100), (hour, "optimize", None, 50, 50), (0, "search", None, 0, 0), (0, "optimize", "acme", 10, 5)]
    events = spark.createDataFrame(rows, "ms long, operation string, project string, input_tokens long, output_tokens long").select(
        "*", F.timestamp_millis("ms").alias("ts"), F.lit(5).cast("long").alias("duration_ms"), F.lit(False).alias("failed"), F.lit(0).cast("long").alias("hits"), F.lit(0).cast("long").alias("lookups")
    )
    hourly = metrics.rollup(events, "hourly")
    assert hourly.count() == 4 and metrics.rollup(events, "daily").count() == 3
    first = hourly.where("operation = 'optimize' AND project = '' AND unix_millis(bucket) = 0").first()
    assert (first["operations"], first["input_tokens"], first["saved_tokens"]) == (2, 300, 160)
    again = metrics.refresh(events, hourly, "hourly")
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, hourly.collect()), key=str)
    late = events.where("ms < 1000").withColumn("ts", F.timestamp_millis(F.lit(-1)))
    assert metrics.refresh(late, hourly, "hourly").count() == 4 and metrics.refresh(late, hourly, "hourly", True).count() == 7
    series = metrics.timeseries(hourly, F.timestamp_millis(F.lit(-hour)), F.timestamp_millis(F.lit(2 * hour)), "HOUR").orderBy("bucket").collect()
    assert [r["operations"] for r in series] == [0, 4, 1, 0]
    assert metrics.summary(metrics.merge(hourly, "operation")).where("operation = 'search'").first()["hit_rate"] is None
    assert metrics.prune(hourly, "bucket", F.timestamp_millis(F.lit(hour))).count() == 1


def test_scores(spark):
    assert value(spark, scores.reduction_ratio(F.lit(10), F.lit(15))) == 0 and value(spark, scores.compression_ratio(F.lit(0), F.lit(3))) == 1 and value(spark, scores.compression_ratio(F.lit(7), F.lit(0))) == 7
    assert value(spark, scores.normalize_recency(F.lit(30.0), 30.0)) == 0.5 and value(spark, scores.normalize_recency(F.lit(1.0), 30.0, F.lit(0))) == 0
    assert value(spark, scores.cost_estimate(F.lit(2_000_000), 1.5)) == 3.0 and value(spark, scores.cost_estimate(F.lit(1), 0)) is None
    assert value(spark, scores.symbol_score(F.lit("LoadAll"), ["load", "x"])) == 0.7
    assert value(spark, scores.similarity(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(0.0)))) == 0
    with pytest.raises(ValueError, match="bad weight"):
        scores.validate({"keyword": -1})


def test_stores(spark):
    old = spark.createDataFrame([("p", "k", "a", 1, 1)], "project_id string, key string, value string, created_at long, updated_at long")
    new = spark.createDataFrame([("p", "k", "b", 5, 5), ("p", "l", "x" * 70_000, 5, 5)], old.schema)
    assert [tuple(r) for r in store.remember(old, new).collect()] == [("p", "k", "b", 1, 5)]
    tree = spark.createDataFrame([("r", "a_b/x"), ("r", "aXb/y"), ("r", "c")], "root string, path string")
    assert {r["path"] for r in store.delete_under(tree, "r", "a_b").collect()} == {"aXb/y", "c"}
    assert {r["path"] for r in store.rename(tree, "r", "c", "aXb/y").collect()} == {"a_b/x", "aXb/y"}
    projects = spark.createDataFrame([("1", "n", "/a"), ("2", "n", "/b"), ("3", "1", "/c")], "id string, name string, path string")
    assert store.resolve_project(projects, "1").first()["id"] == "1" and store.resolve_project(projects, "n").count() == 0 and store.resolve_project(projects, "/b").first()["id"] == "2"
    ident = value(spark, text.context_id(F.lit("x")))
    assert value(spark, text.parse_id(text.to_uri(F.lit(ident)))) == ident == value(spark, text.parse_id(F.lit(ident.upper()))) and value(spark, text.parse_id(F.lit("nope"))) is None


def test_symbols_once(spark):
    rows = spark.createDataFrame([(1, "a", "function", 3, 4), (1, "a", "method", 3, 4)], "file_id long, name string, kind string, start_line int, end_line int")
    assert [r["kind"] for r in index.deduplicate_symbols(rows).collect()] == ["method"]


def feed(spark, rows):
    return spark.createDataFrame([(p, k, None, t, i) for i, (p, k, t) in enumerate(rows)], "path string, kind string, from_path string, ms long, seq long").withColumn("ts", F.timestamp_millis("ms"))


def test_debounce_and_coalesce(spark):
    burst = [("a", "created" if i == 0 else "modified", 130 * i) for i in range(15)] + [("a", "deleted", 9_000), ("a", "created", 9_100)]
    got = [(r["changes"], r["kind"]) for r in changes.sessions(feed(spark, burst)).orderBy("first_seen").collect()]
    assert got == [(15, "created"), (2, "modified")]
    endless = [("b", "modified", 100 * i) for i in range(120)]
    assert changes.sessions(feed(spark, endless)).count() == 3
    assert changes.merged_kind("renamed", "modified") == "renamed" and changes.merged_kind("modified", "deleted") == "deleted"


def test_rename_pairing(spark):
    rows = spark.createDataFrame([("r", "old", "departed", 0, 0), ("r", "new", "arrived", 150, 1), ("r", "gone", "departed", 1000, 2), ("r", "late", "arrived", 1500, 3)], "root string, path string, kind string, ms long, seq long").withColumn("ts", F.timestamp_millis("ms"))
    assert [(r["kind"], r["path"], r["from_path"]) for r in changes.pair_renames(rows).orderBy("seq").collect()] == [("renamed", "new", "old"), ("deleted", "gone", None), ("created", "late", None)]


def test_the_longest_delay_starts_anew_after_a_release(spark):
    rows = [("a", "modified", 200 * k) for k in range(26)] + [("a", "modified", 5300 + 200 * k) for k in range(25)]
    assert [r["changes"] for r in changes.sessions(feed(spark, rows)).orderBy("first_seen").collect()] == [26, 25]


def test_one_departure_waits_whatever_else_happens(spark):
    data = [("r", "a", "departed", 0, 0), ("r", "z", "modified", 10, 1), ("r", "b", "arrived", 20, 2), ("r", "c", "departed", 30, 3), ("r", "d", "departed", 40, 4), ("r", "e", "arrived", 50, 5), ("r", "f", "arrived", 60, 6), ("q", "g", "departed", 60, 7)]
    rows = spark.createDataFrame(data, "root string, path string, kind string, ms long, seq long").withColumn("ts", F.timestamp_millis("ms"))
    got = [(r["kind"], r["path"], r["from_path"]) for r in changes.pair_renames(rows).orderBy("seq").collect()]
    assert got == [("modified", "z", None), ("renamed", "b", "a"), ("renamed", "e", "d"), ("created", "f", None), ("deleted", "g", None)]


def test_a_text_is_measured_once(spark):
    """Twice the lines take at most about twice the time, not four times."""

    def spent(n):
        docs = spark.createDataFrame([(1, "\n".join(f"line {i} of many words" for i in range(n)))], "doc_id long, text string")
        at = time.time()
        assert optimize.text(docs, 300, "lines").collect()[0]["original_tokens"] > n
        return time.time() - at

    spent(500)
    assert spent(8000) < 4 * max(1.0, spent(4000))


def test_json_refuses_what_is_none():
    for bad in ("NaN", "[Infinity]", "[-Infinity]", "[1e400]", "{'a': 1}", '{"a": NaN}\n1'):
        assert optimize.parse_json(bad) is None, bad
    assert optimize.parse_json('{"a":"x\u2028y"}\n{"b":1}') == [{"a": "x\u2028y"}, {"b": 1}]


def test_near_duplicates_of_the_text_pipeline(spark):
    text = "open the user session store\n\nthe session store of a user, open\n\nbanana bread with walnuts\n\nOpen the user session store!"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    plain = {r["doc_id"]: r for r in optimize.text(docs).collect()}
    near = {r["doc_id"]: r for r in optimize.text(docs, near=0.9).collect()}
    assert plain[1]["text"].count("session") == 3
    assert near[1]["text"] == "open the user session store\n\n(1 more alike)\n\nthe session store of a user, open\n\nbanana bread with walnuts\n"
    for r in (*plain.values(), *near.values()):
        assert r["original_tokens"] == sum(r[c] for c in optimize.SAVINGS) + r["optimized_tokens"]
    assert near[2]["text"] == near[3]["text"] == ""


def test_compiled_documents_match_a_model(spark):
    """Sections within what those before left, the whole measured anew, savings summed; against single optimisations."""
    rng = random.Random(4)
    rows = [(g, p, f"s{p}", "\n\n".join(f"part {rng.randrange(6)} of the text {p}" for _ in range(rng.randrange(0, 9)))) for g in range(4) for p in range(5)]
    docs = spark.createDataFrame(rows, "group_id long, position long, label string, text string")
    got = {r["group_id"]: r for r in optimize.compile_documents(docs, 150).collect()}
    count = lambda t: spark.createDataFrame([(t,)], "t string").select(tokens.count_heuristic(F.col("t"))).first()[0]
    for g in range(4):
        left, parts, sums = 150, [], dict.fromkeys(("original_tokens", *optimize.SAVINGS), 0)
        for r in sorted(r for r in rows if r[0] == g):
            header = f"=== {r[2]} ({[s for s in got[g]['sections'] if s['position'] == r[1]][0]['reference']}) ===\n"
            one = optimize.text(spark.createDataFrame([(1, r[3])], "doc_id long, text string"), max(0, left - count(header))).first()
            sums = {c: n + one[c] for c, n in sums.items()}
            if one["text"].strip():
                parts.append(header + one["text"])
            left = max(0, left - count(header) - one["optimized_tokens"])
        assert got[g]["text"] == "\n".join(parts)
        assert {c: got[g][c] for c in sums} == sums and got[g]["optimized_tokens"] == count(got[g]["text"])


def compiled_by_hand(spark, rows, budget):
    """The text, sums and sections of one compilation, each section by its own optimisation within what is left."""
    one = lambda p, c, t, room: optimize.optimize(spark.createDataFrame([(1, p, c, t)], "doc_id long, path string, command string, text string"), room).first()
    count = lambda t: spark.createDataFrame([(t,)], "t string").select(tokens.count_heuristic(F.col("t"))).first()[0]
    left, parts, sums, sections = budget, [], dict.fromkeys(("original_tokens", *optimize.SAVINGS), 0), []
    for path, command, t in rows:
        ref = spark.createDataFrame([(t,)], "t string").select(text.to_uri(text.context_id(F.col("t")))).first()[0]
        header = f"=== {path} ({ref}) ===\n"
        left = max(0, left - count(header))
        made = one(path, command, t, left)
        sums = {c: n + made[c] for c, n in sums.items()}
        if made["text"].strip():
            parts.append(header + made["text"])
        left = max(0, left - made["optimized_tokens"])
        sections.append((made["optimizer"], made["optimized_tokens"]))
    whole = "\n".join(parts)
    return whole, sums, count(whole), sections


CODE_SECTION = "fn a() {\n    b();\n}\n\nfn a() {\n    b();\n}\n"
LOG_SECTION = "\n".join(f"2024-01-01 10:00:0{k % 10} INFO request {k} served" for k in range(12)) + "\n2024-01-01 10:01:00 ERROR lost the store\n"
JSON_SECTION = '{"b": 1.5, "list": [' + ", ".join(str(k) for k in range(60)) + '], "a": "text"}'


@pytest.mark.parametrize("budget", [30, 90, 150, 260, 2000])
def test_sections_are_compiled_by_their_own_routes(spark, budget):
    """Code keeps its repeats, logs collapse, JSON shrinks, tool output loses its noise; what no budget shortens stays."""
    rows = [("a.rs", None, CODE_SECTION), ("b.log", None, LOG_SECTION), ("c.json", None, JSON_SECTION), ("d.txt", None, "same\n\nsame\n\nother words here\n"), ("out", "git status", "On branch main\n\nmodified: x\nmodified: x\n"), ("e.txt", None, ""), ("f.json", None, "{broken\n\n")]
    docs = spark.createDataFrame([(7, k, p, c, t, p) for k, (p, c, t) in enumerate(rows)], "group_id long, position long, label string, command string, text string, path string")
    got = optimize.compile_documents(docs, budget).first()
    whole, sums, n, sections = compiled_by_hand(spark, rows, budget)
    assert got["text"] == whole and {c: got[c] for c in sums} == sums and got["optimized_tokens"] == n
    assert [(s["optimizer"], s["optimized_tokens"]) for s in got["sections"]] == sections
    assert [s[0] for s in sections] == ["text-conservative", "log", "json", "text", "git", "text", "json"]
    if budget == 2000:
        assert whole.count("fn a()") == 2 and "(repeated 12 times)" in whole and '"list":[0,1,2' in whole and whole.count("same") == 1
    if budget == 260:
        assert "more items omitted" in whole


def test_the_budget_of_a_compilation_is_spent_in_order(spark):
    long = "\n\n".join(f"paragraph {k} with several words of content" for k in range(40))
    docs = spark.createDataFrame([(1, 0, "first.txt", long), (1, 1, "second.txt", long)], "group_id long, position long, label string, text string")
    got = optimize.compile_documents(docs, 120).first()
    assert got["optimized_tokens"] <= 120 and got["sections"][0]["optimized_tokens"] > 0 and got["sections"][1]["optimized_tokens"] == 0
    assert "first.txt" in got["text"] and "second.txt" not in got["text"]
    two = spark.createDataFrame([(1, 0, "a.txt", "repeated\n\nrepeated\n"), (1, 1, "b.txt", "words of its own\n")], "group_id long, position long, label string, text string")
    got = optimize.compile_documents(two, 32_000).first()
    assert got["deduplication"] > 0 and got["original_tokens"] == sum(s["original_tokens"] for s in got["sections"]) and len(got["sections"]) == 2
    assert optimize.compile_documents(two.where("false"), 100).count() == 0


def test_features_are_hashed_alike():
    data = [b"", b"a", b"authenticate", "é".encode(), b"a" * 40]
    assert vectors.fnv1a_all(data).tolist() == [vectors.fnv1a(x) for x in data]


def test_notes_are_recalled_and_forgotten(spark):
    notes = spark.createDataFrame([("p", "k", "a"), ("p", "l", "b"), ("q", "k", "c")], "project_id string, key string, value string")
    assert [r["value"] for r in store.recall(notes, "p", "k").collect()] == ["a"] and store.recall(notes, "p", "x").count() == 0
    assert sorted(r["value"] for r in store.forget(notes, "p", "k").collect()) == ["b", "c"]


def test_expressions_match_a_model_on_documents(spark, small):
    """Token counts and line keys against plain Python over every document."""

    def model(t):
        total = 0
        for m in re.finditer(r"[0-9]+|[\r\n]+|[^\W0-9]+(?:[^\W0-9]|')*|'(?:[^\W0-9]|')*|[^\w\s']+", t):
            n, c = len(m[0]), m[0][0]
            total += -(-n // 3) if c.isdigit() else -(-n // 2) if c in "\r\n" else (1 if n <= 5 else 2 if n <= 9 else -(-n // 4)) if c.isalpha() or c in "_'" else -(-n // 2)
        return total

    docs = spark.read.parquet(f"{small}/documents.parquet").select("text", tokens.count_heuristic(F.col("text")).alias("n")).collect()
    random.Random(0).shuffle(docs)
    assert all(model(r["text"]) == r["n"] for r in docs)


def test_project_file():
    from glyphmill.sources.config import ProjectFile, root_key

    assert ProjectFile.parse('name = "x"\nbudget = 5\nignore = ["*.log"]') == ProjectFile(name="x", budget=5, ignore=("*.log",))
    with pytest.raises(ValueError, match="unknown keys: nmae"):
        ProjectFile.parse('nmae = "x"')
    assert root_key("file:///a/b/") == "/a/b" and root_key("C:\\x\\") == "C:/x" and root_key("/") == "/"


def test_streaming_rollup_and_replay(spark, small, tmp_path):
    from glyphmill.streaming import metrics as stream

    raw = spark.read.parquet(f"{small}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("operation"), F.lit("p").alias("project"), F.lit(4).cast("long").alias("input_tokens"), F.lit(1).cast("long").alias("output_tokens"), F.lit(1).cast("long").alias("duration_ms"), F.lit(False).alias("failed"), F.lit(0).cast("long").alias("hits"), F.lit(0).cast("long").alias("lookups"))
    raw.repartition(3).write.parquet(f"{tmp_path}/in")
    events = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stream.refresh_each_batch(events, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in metrics.rollup(raw, "hourly").schema.fields)
    got = stream.rollup_table(spark, f"{tmp_path}/out", schema).read().select("bucket", "operation", "operations", "input_tokens")
    want = metrics.rollup(raw, "hourly").select("bucket", "operation", "operations", "input_tokens")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_nearest_takes_every_query(spark, tmp_path):
    from glyphmill import queries

    rows = [(50 * i, [float(np.cos(i)), float(np.sin(i))]) for i in range(1100)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.jn10_nearest(spark, str(tmp_path)).collect()
    assert {r["query_id"] for r in got} == {i for i, _ in rows}
    assert max(r["rank"] for r in got) == 10 and len(got) == 11000


def test_similar_items_are_found_for_every_item(spark, small):
    from glyphmill import queries

    items = {r["item_id"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    got = queries.p16_similar(spark, small).collect()
    assert len(items) > 5 and {r["query_id"] for r in got} == items


def test_spans_and_estimates(spark):
    at = lambda *x: datetime(2024, 1, *x, tzinfo=UTC)
    assert metrics.Span(at(2, 3, 4), at(3)).aligned("hourly") == metrics.Span(at(2, 3), at(3)) and metrics.Span(at(2, 3, 4)).aligned("daily") == metrics.Span(at(2))
    assert metrics.Span.last_days(2, at(9)) == metrics.Span(at(7), at(9)) and metrics.Span.all_time().aligned("daily") == metrics.Span()
    with pytest.raises(ValueError, match="runs backwards"):
        metrics.Span(at(3), at(2))
    rows = spark.createDataFrame([(1, at(1)), (2, at(2)), (3, at(3)), (4, None)], "n int, ts timestamp")
    assert [r["n"] for r in metrics.Span(at(1), at(3)).of(rows, "ts").collect()] == [1, 2] and metrics.Span.all_time().of(rows, "ts").count() == 4
    assert metrics.pruned(rows, "ts", F.lit(at(3))).first()["removed"] == 2


def test_projects_are_described(spark):
    manifest = '{"dependencies": {"react": "1", "x": {"y": 1}}, "devDependencies": {"typescript": "5", "vue": "3"}, "packageManager": "pnpm@9"}'
    rows = [
        ("a", "package.json", manifest), ("a", "yarn.lock", None), ("a", "sub/go.mod", None), ("b", "package.json", "{ not json"), ("b", "yarn.lock", None), ("b", ".git/HEAD", ""),
        ("c", "Cargo.toml", None), ("c", "setup.py", None), ("c", "uv.lock", None), ("d", "README.md", ""), ("e", "setup.py", None), ("e", "uv.lock", None), ("f", "package.json", '{"dependencies": [1]}'), ("g", ".git", None),
    ]
    got = {r["root"]: (r["languages"], r["frameworks"], r["package_manager"], r["git"]) for r in files.describe_projects(spark.createDataFrame(rows, "root string, path string, content string")).collect()}
    assert got == {
        "a": (["javascript", "typescript"], ["react", "vue"], "pnpm", False), "b": (["javascript"], [], "yarn", True), "c": (["python", "rust"], [], "cargo", False),
        "e": (["python"], [], "uv", False), "f": (["javascript"], [], "npm", False), "g": ([], [], None, True),
    }


def test_a_reader_gives_one_context(spark):
    assert files.from_reader(spark, io.BytesIO(b"a\r\nb")).select("content", "byte_len").first() == ("a\nb", 3)
    assert files.from_reader(spark, io.BytesIO(b"\xff")).count() == 0
    with pytest.raises(ValueError, match="more than 3 bytes"):
        files.from_reader(spark, io.BytesIO(b"abcd"), 3)


def test_store_writes(spark, tmp_path):
    vectors_ = spark.createDataFrame([("r", "a", "p", 2, "1"), ("r", "b", "q", 2, "1"), ("s", "a", "p", 2, "1")], "root string, path string, provider string, dimensions int, content_hash string")
    put = store.put_embeddings(vectors_, spark.createDataFrame([("r", "b", "p", 2, "2"), ("r", "c", "p", 3, "2")], vectors_.schema))
    assert {(r["path"], r["content_hash"]) for r in store.embeddings_of(put, "r", "p", 2).collect()} == {("a", "1"), ("b", "2")}
    assert store.embeddings_of(put, "r", "p", 2, spark.createDataFrame([("b",), ("z",)], "path string")).first()["path"] == "b"
    settings = spark.createDataFrame([("1", "k", "a"), ("1", "l", "b"), ("2", "k", "c")], "project_id string, key string, value string")
    after = store.put_settings(settings, spark.createDataFrame([("1", "k", None), ("1", "m", "d")], settings.schema))
    assert sorted(map(tuple, after.collect())) == [("1", "l", "b"), ("1", "m", "d"), ("2", "k", "c")]
    projects = spark.createDataFrame([("1", "active"), ("2", "active")], "id string, status string")
    assert sorted(map(tuple, store.set_project_status(projects, "2", "paused").collect())) == [("1", "active"), ("2", "paused")]
    assert [x.count() for x in store.remove_project(projects, settings, "1")] == [1, 1]
    store.append(projects, f"{tmp_path}/p")
    broken = projects.select(F.when(F.col("id") == "2", F.raise_error("no")).otherwise(F.col("id")).alias("id"), "status")
    with pytest.raises(Exception, match="no"):
        store.append(broken, f"{tmp_path}/p")
    assert spark.read.parquet(f"{tmp_path}/p").count() == 2


def test_events_are_translated_and_paired(spark):
    raw = [
        ("created", ["a"]), ("metadata", ["a"]), ("renamed_from", ["a"]), ("modified", ["build/x", "m"]), ("renamed_to", ["b"]), ("renamed_both", ["c", "d"]), ("renamed_both", ["build/c", "e"]),
        ("created_folder", ["f"]), ("removed_folder", ["f"]), ("renamed_from", ["g", "h"]), ("renamed_to", ["i"]), ("created", ["build/y"]), ("accessed", ["a"]), ("created", []), (None, ["n"]),
    ]
    rows = spark.createDataFrame([("r", e, p, i) for i, (e, p) in enumerate(raw)], "root string, event string, paths array<string>, seq long").withColumn("ts", F.timestamp_millis("seq"))
    told = changes.pair_renames(changes.translated(rows, files.ignore_rules(["build/"]))).orderBy("seq", "path")
    want = [("created", "a", None), ("modified", "m", None), ("renamed", "b", "a"), ("renamed", "d", "c"), ("modified", "e", None), ("deleted", "f", None), ("renamed", "i", "h")]
    assert [(r["kind"], r["path"], r["from_path"]) for r in told.collect()] == want


def test_collector_and_subscribers(spark, tmp_path):
    from glyphmill.streaming.metrics import Collector, since

    held = Collector("seq long, name string", capacity=3)
    for k in range(5):
        held.record((k, "x"))
    assert [e[0] for e in held.waiting] == [2, 3, 4] and held.dropped == 2
    (tmp_path / "file").write_text("")
    with pytest.raises(Exception):  # noqa: B017
        held.flush(spark, f"{tmp_path}/file/below")
    assert [e[0] for e in held.waiting] == [2, 3, 4]
    assert held.flush(spark, f"{tmp_path}/out") == 3 and held.flush(spark, f"{tmp_path}/out") == 0 and spark.read.parquet(f"{tmp_path}/out").count() == 3
    off = Collector("seq long", enabled=False)
    off.record((1,))
    assert not off.waiting
    events = spark.range(1, 11).select(F.col("id").alias("seq"))
    page, lost = since(events, 3, slots=4)
    assert [r["seq"] for r in page.collect()] == [7, 8, 9, 10] and lost.first()["lost"] == 3
    page, lost = since(events, 8, slots=4)
    assert [r["seq"] for r in page.collect()] == [9, 10] and lost.first()["lost"] == 0


def test_supervisor_replays_and_scans(spark, tmp_path):
    from glyphmill.streaming import supervisor

    disk = {"a": "1", "b": "1", "c": "1"}
    schema = "root string, path string, content_hash string"
    there = lambda: spark.createDataFrame([("r", p, h) for p, h in disk.items()], schema)
    now, broken = [0.0], [False]

    def read(touched):
        if broken[0]:
            raise RuntimeError("busy")
        return there().join(touched, ["root", "path"], "left_semi")

    step = supervisor.Supervisor(f"{tmp_path}/t", schema, read, there, every=300, clock=lambda: now[0])
    state = lambda: {r["path"]: r["content_hash"] for r in step.files(spark).collect()}
    batch = lambda *rows: spark.createDataFrame([("r", p, k, f, i) for i, (p, k, f) in enumerate(rows)], "root string, path string, kind string, from_path string, seq long").withColumn("ts", F.timestamp_millis("seq"))
    step(batch(), 0)
    assert state() == disk
    disk |= {"a": "2", "d": "1"}
    del disk["c"]
    change = batch(("a", "modified", None), ("a", "modified", None), ("d", "renamed", "c"))
    broken[0] = True
    with pytest.raises(RuntimeError, match="busy"):
        step(change, 1)
    broken[0] = False
    step(change, 1)
    step(change, 1)
    assert state() == disk
    disk["z"] = "9"
    step(batch(), 2)
    assert "z" not in state()
    now[0] = 301.0
    step(batch(), 3)
    assert state() == disk
    raw = batch(("b", "deleted", None))
    del disk["b"]
    raw.write.parquet(f"{tmp_path}/in")
    again = supervisor.Supervisor(f"{tmp_path}/u", schema, read, there)
    supervisor.supervise(spark.readStream.schema(raw.schema).parquet(f"{tmp_path}/in"), again, f"{tmp_path}/cp", availableNow=True).awaitTermination()
    assert {r["path"] for r in again.files(spark).collect()} == set(disk)


def test_only_new_content_is_embedded(spark, small):
    from glyphmill import queries

    items = {str(r["item_id"]): r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    got = {r["path"]: r["vector"] for r in queries.p15_embed_files(spark, small).collect()}
    assert set(got) == set(items) and all(np.allclose(v, vectors.embed(items[k], 64)) for k, v in got.items())
    known = spark.createDataFrame([("r", "a", "p", 8, [0.0] * 8, "1"), ("r", "b", "q", 8, [0.0] * 8, "1")], "root string, path string, provider string, dimensions int, vector array<float>, content_hash string")
    now = spark.createDataFrame([("r", "a", "1", "x"), ("r", "b", "1", "y"), ("r", "c", "1", None)], "root string, path string, content_hash string, content string")
    after, work = index.embed_files(now, known, "p", 8)
    assert tuple(work.first()) == (2, 1) and {(r["path"], r["provider"]) for r in after.collect()} == {("a", "p"), ("b", "p"), ("c", "p")}
