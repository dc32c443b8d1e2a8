"""The token estimate against a plain model, and how often it scans a text; trimmed lines of content types."""

import itertools
import random
import unicodedata

import pytest
from glyphmill.functions import detect, tokens
from pyspark.sql import functions as F

CJK = ((0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7AF), (0xF900, 0xFAFF))
BLANKS = " \t\x0b\f\x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B)))


def kinds(c):
    cjk = any(a <= ord(c) <= b for a, b in CJK)
    if c in "0123456789":
        kind = "digit"
    elif c in "\r\n":
        kind = "line"
    elif c in "_'" or unicodedata.category(c)[0] in "LNM":
        kind = "cjk" if cjk else "word"
    else:
        kind = "blank" if c in BLANKS else "mark"
    return kind, cjk


def model(text):
    total = sum(kinds(c)[1] for c in text)
    for kind, run in itertools.groupby(text, lambda c: kinds(c)[0]):
        n = len(list(run))
        total += {"word": 1 if n <= 5 else 2 if n <= 9 else -(-n // 4), "digit": -(-n // 3), "line": -(-n // 2), "mark": -(-n // 2)}.get(kind, 0)
    return total


def test_estimate_as_a_plain_model(spark):
    rng = random.Random(3)
    pool = ["a", "Z", "'", "_", "1", "234", "\n", "\r\n", "!", "--", "\x00", "\x7f", "é", "ß", "́", "Ж", "中", "ア", "・", "가", "😀", "𝐀", "²", "٣", *BLANKS]
    texts = ["".join(rng.choice(pool) * rng.choice([1, 2, 5]) for _ in range(rng.randrange(20))) for _ in range(500)]
    texts += [c * n + "!" * n for n in range(1, 30) for c in "b𝐀é"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tokens.count_heuristic(F.col("t")).alias("n")).collect()
    assert [(r["t"], r["n"]) for r in got if r["n"] != model(r["t"])] == []


def test_a_text_is_scanned_once(spark):
    """Once, and once more for CJK where it goes beyond ASCII."""
    plan = spark.range(1).select(tokens.count_heuristic(F.col("id").cast("string")).alias("n"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_") <= 2


@pytest.mark.parametrize(("given", "want"), [("let x = 1; ", "code"), ("  fn x() { \n  y\n", "code"), ("   \n \nwords", "plain_text"), ("0123-01-01 said", "log")])
def test_lines_lose_blanks_alone(spark, given, want):
    """A line's number is not what is trimmed off it."""
    assert spark.range(1).select(detect.detect(F.lit(given)).alias("x")).first()["x"] == want


def test_first_line_keeps_its_zeros(spark):
    assert spark.range(1).select(detect.by_lines(F.lit("00:00:00.1 up")).alias("x")).first()["x"] == "log"
