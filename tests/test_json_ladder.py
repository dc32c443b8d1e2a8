"""JSON's ladder makes a text once, and no text for a step that cuts nothing."""

from glyphmill.plans import optimize as P
from pyspark.sql import functions as F


def test_steps_that_say_the_same_are_one():
    assert P.ladder([{"a": [1, 2]}]) == (['{"a":[1,2]}'], True)
    texts, spared = P.ladder([list(range(7))])
    assert spared and texts == ["[0,1,2,3,4,5,6]", '[0,1,2,3,4,"2 more items omitted"]', '[0,1,"5 more items omitted"]']
    texts, spared = P.ladder([["x" * 600] * 120])
    assert not spared and len(texts) == 1 + len({str(P.shrink_value(["x" * 600] * 120, *s)) for s in P.LADDER})


def test_choice_at_every_budget(spark):
    """As if every step of the ladder stood there: the compact text if it fits with its line feed, else the first step that
    fits without it, else the last."""
    texts = ["[%s]" % ",".join(str(k) for k in range(n)) for n in (0, 1, 3, 8, 40, 130)] + ['{"a": "%s", "b": [1, {"c": [1, 2, 3]}]}' % ("word " * n) for n in (1, 9, 70, 150)] + ["[1]\n[2, 3]\n", "no json"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    steps = [(i, k, P.render_json(v if k < 0 else [P.shrink_value(x, *P.LADDER[k]) for x in v])) for i, t in enumerate(texts) if (v := P.parse_json(t)) is not None for k in range(-1, len(P.LADDER))]
    counted = spark.createDataFrame(steps, "i int, k int, t string").select("i", "k", "t", P.count_heuristic(F.col("t")).alias("n")).collect()
    of = {i: sorted((r["k"], r["n"], r["t"]) for r in counted if r["i"] == i) for i in {r["i"] for r in counted}}
    for budget in (0, 1, 2, 6, 7, 8, 16, 17, 30, 60, 150, 262, 1000):
        got = {r["doc_id"]: (r["optimized_tokens"], r["text"]) for r in P.json_text(docs, budget).collect()}
        for i, rows in of.items():
            n, t = next(((n, t) for k, n, t in rows if n + (k < 0) <= budget), rows[-1][1:])
            assert got[i] == (n + 1, t + "\n"), (i, budget)
