"""Content types are told once a document, and cheaper tests of lines and texts say what the plain patterns say."""

import random

from glyphmill.functions import detect, text
from glyphmill.plans import optimize as P
from pyspark.sql import functions as F

LOG = r"ERROR|WARN|INFO|DEBUG|TRACE|FATAL|error:|warning:|info:|debug:|panic:|^[0-9]{4}[-/][0-9]{2}.{3}|^[0-9]{2}:[0-9]{2}:.{2}"
MARKDOWN = r"^(?:#{1,3} |[-*>|] |```)"
CODE = r"^(?:fn |def |function |class |import |from |const |let |var |public |private |#include|package |return )|[{;]$|^\}$"
POOL = ["a", " ", " ", "\t", "\r", "\x85", " ", "\x0b", "\n", "\n", "{", "}", ";", ":", "#", "- ", "```", "error", "panic:", "WARN", "2024-01-02 x", "10:20:30", "fn ", "[", "]", ",", "é", "中"]


def texts():
    rng = random.Random(7)
    return ["".join(rng.choice(POOL) for _ in range(rng.randrange(9))) for _ in range(3000)]


def test_a_content_type_is_told_once(spark, monkeypatch):
    monkeypatch.setattr(P, "cut", lambda df: df)
    docs = spark.createDataFrame([(1, "a"), (2, "2024-01-02 10:00:00 up")], "doc_id long, text string")
    assert P.routed(docs)._jdf.queryExecution().optimizedPlan().toString().count("FATAL") == 1


def test_a_cost_is_counted_once(spark):
    """Beside the whole text's and each fragment's, only what is said anew is counted; it costs what its text does."""
    said = "2024-01-01 10:00:00 WARN disk full\n2024-01-01 10:00:01 WARN disk full\n2024-01-01 10:00:02 INFO up"
    got = P.log(spark.createDataFrame([(1, said)], "doc_id long, text string")).first()
    assert "(repeated 2 times)" in got["text"]
    whole = spark.createDataFrame([(got["text"],)], "t string").select(P.count_heuristic(F.col("t"))).first()[0]
    assert got["optimized_tokens"] == whole


def test_lines_as_the_patterns_say(spark):
    lines = spark.createDataFrame([(t.replace("\n", ""),) for t in texts()], "x string")
    x = F.col("x")
    pairs = ((x.rlike(LOG), x.rlike(detect.LOG_LINE)), (x.rlike(MARKDOWN), detect.is_markdown_line(x)), (x.rlike(CODE), detect.is_code_line(x)))
    for old, new in pairs:
        assert [r["x"] for r in lines.where(old != new).collect()] == []
        assert 0 < lines.where(new).count() < lines.count()


def test_texts_as_the_patterns_say(spark):
    x = F.col("x")
    t = F.regexp_replace(F.regexp_replace(x, r"^\s+", ""), r"\s+$", "")
    array = t.startswith("[") & t.endswith("]")
    json = ((t.startswith("{") & t.endswith("}")) | array) & (t.contains(":") | (array & t.contains(",")))
    bare = F.array_join(F.transform(F.split(x, "\n"), lambda a: F.regexp_replace(a, r"\s+$", "")), "\n")
    bare = F.regexp_replace(F.regexp_replace(bare, r"^\n+", ""), r"\n+$", "")
    blank = F.trim(F.regexp_replace(x, r"\s+", "")) == ""
    rows = spark.createDataFrame([(t,) for t in (*texts(), *map("".join, zip(" [{", texts(), "]} ", strict=False)))], "x string")
    for old, new in ((json, detect.looks_like_json(x)), (bare, text.trimmed(x)), (blank, text.is_blank(x)), (F.trim(F.regexp_replace(x, r"\s+", " ")), text.collapse_space(x))):
        assert [r["x"] for r in rows.where(~old.eqNullSafe(new)).collect()] == []
    assert re.search(r"\s", " ") and rows.where(text.is_blank(x)).count() > 0
