"""Language identification and toxicity: held-out accuracy, and the parts against brute force."""

import itertools
import random
import zlib

import numpy as np
from glyphmill.llm import langid, queries, toxicity
from pyspark.sql import functions as F

from .helpers import empty, odd


def test_language_on_held_out_rows(spark, medium):
    got = queries.op2_language_id(spark, medium).collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{medium}/documents.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got) and len(got) == len(lang)


def test_every_label_and_every_script_is_learnt(spark):
    """More labels than the sample has room for at full size, most of them of few letters of their own."""
    rng = random.Random(2)
    rows = []
    for k in range(90):
        letters = [chr(0x4E00 + 150 * k + i) for i in range(140)]
        rows += [(1000 * k + i, "".join(rng.choice(letters) for _ in range(300)), f"l{k:02}") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(langid.sample(docs, F.col("doc_id") % 1000 < 3))
    assert len(model.languages) == 90
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, model).collect()}
    assert all(got[d] == lang for d, _, lang in rows)


def test_cross_parsing_counts_longest_phrases():
    rng = random.Random(1)
    sample = "".join(rng.choice("abc ") for _ in range(400))
    text = "".join(rng.choice("abcd ") for _ in range(3000)) + "abc" * 700 + "".join(rng.choice("abc") for _ in range(2000))
    look = langid.lookup({"a": 1, "b": 2, "c": 3})
    s, t = langid.classed(sample, look), langid.classed(text, look)
    data, want, at = bytes(s), 0, 0
    while at < len(t):
        n = 1
        while at + n < len(t) and bytes(t[at : at + n + 1]) in data:
            n += 1
        want += 1
        at += n
    got = langid.phrases([langid.parser(s, langid.CLASSES)], [t, t[:0]])
    assert got[0, 0] == want and got[1, 0] == 0


def test_language_odd_rows(spark):
    model = langid.fit([("de", "das ist nicht gut und der mann"), ("en", "this is not good and the man")])
    got = {r["doc_id"]: r for r in langid.predict(odd(spark, lang_pred="x", score=1), model).collect()}
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == got[3]["lang_pred"] == "und" and got[1]["score"] == 0.0
    assert langid.predict(empty(spark), model).count() == 0
    assert {r["lang_pred"] for r in langid.predict(odd(spark), langid.fit([])).collect()} == {"und"}


def test_toxicity_on_held_out_rows(spark, medium):
    got = {r["doc_id"]: r for r in queries.op6_toxicity(spark, f"{medium}/../sf0.1").collect()}
    labels = spark.read.parquet(f"{medium}/../sf0.1/labels.parquet").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got.values())
    held = [(r["toxic"], got[r["doc_id"]]["predicted"], got[r["doc_id"]]["score"]) for r in labels if got[r["doc_id"]]["held_out"] and r["toxic"] is not None]
    caught = sum(p for t, p, _ in held if t) / sum(t for t, _, _ in held)
    false = sum(p for t, p, _ in held if not t) / sum(1 - t for t, _, _ in held)
    assert caught >= 0.9 and false <= 0.03, (caught, false)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())


def test_decoder_restores_disguised_words():
    text = "the idiot said stupid things and the trash was worthless but the moron was a loser again " * 40
    look, counts = toxicity.letter_classes(), np.zeros(toxicity.CLASSES**3, dtype=np.int64)
    x = toxicity.classed(f" {text}  ", look).astype(np.int64)
    x = np.repeat(x, np.where(x == 0, 2, 1))
    np.add.at(counts, (x[:-2] * toxicity.CLASSES + x[1:-1]) * toxicity.CLASSES + x[2:], 1)
    lm = toxicity.LanguageModel.of(counts).known()
    for given, want in (("1d10t", "idiot"), ("stuuuupid", "stupid"), ("tr@sh", "trash"), ("m0r0n", "moron"), ("w0rthle$$", "worthless"), ("i.d.i.o.t", "idiot"), ("things,", "things"), ("que###", "que")):
        assert toxicity.restored(given, lm) == want, given
    restore = toxicity.Restorer(lm)
    assert toxicity.stretches("you i d i o t here") == ["i d i o t"]
    assert restore("\0i d i o t") == ["idiot"] and restore("\0t.h.e  1 d 1 0 t") == ["the", "idiot"]
    assert toxicity.stretches("i am") == [] and toxicity.stretches("a b c") == ["a b c"]
    assert restore("\0t h e i d i o t s a i d s t u p i d t h i n g s") == ["the", "idiot", "said", "stupid", "things"]
    assert toxicity.restored("iidiot", lm) == "idiot" and toxicity.restored("idi" + "o" * 200 + "t", lm) == "idiot"
    assert toxicity.restored("m0r0n" * 3000, lm) == "moron" * 3000  # any length, in linear time
    assert toxicity.stretches("-" * 60 + "ab") == [] and not toxicity.disguised("é" + "ab" * 500_000)


def spelled(lm, steps):
    """The least cost of all spellings, one by one."""
    best = None
    for way in itertools.product(*steps):
        a = b = 0
        cost = sum(p for _, p in way)
        for c in "".join(x for x, _ in way) + " ":
            k = lm.look.get(c, 0 if c == " " else toxicity.OTHER)
            cost += float(lm.cost[a, b, k])
            a, b = (0, 0) if c == " " else (b, k)
        best = cost if best is None else min(best, cost)
    return best


def test_viterbi_is_as_good_as_all_spellings():
    rng = random.Random(6)
    counts = np.array([rng.randrange(50) for _ in range(toxicity.CLASSES**3)])
    lm = toxicity.LanguageModel.of(counts).known()
    for _ in range(60):
        word = "".join(rng.choice("abco01!$.|") for _ in range(7))
        steps = list(lm.offers(word))
        said = lm.likeliest(steps)
        ways = [w for w in itertools.product(*steps) if "".join(x for x, _ in w) == said]
        assert ways and abs(min(spelled(lm, [[c] for c in w]) for w in ways) - spelled(lm, steps)) < 1e-3, word
    for text in ("a b  c d", "1 d  0 t"):
        steps = list(lm.spaced_offers(text))
        said = lm.likeliest(steps)
        ways = [w for w in itertools.product(*steps) if "".join(x for x, _ in w) == said]
        assert ways and abs(min(spelled(lm, [[c] for c in w]) for w in ways) - spelled(lm, steps)) < 1e-3, text


def test_toxicity_of_an_id_that_many_rows_share(spark):
    """The label's id is on half of all rows; the sample has one text of it."""
    rows = [(1, f"you are an idiot {k}") for k in range(200)] + [(k, "a fine day" if k % 2 else "what an idiot you are") for k in range(2, 202)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), *((k, int(k % 2 == 0)) for k in range(2, 202))], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    got = toxicity.score(docs, model).collect()
    assert len(got) == 400 and all(r["predicted"] == 1 for r in got if r["doc_id"] == 1)


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(4, 0), (6, 1), (5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(odd(spark), labels, F.lit(True))
    got = toxicity.score(odd(spark, score="x"), model).collect()
    assert len(got) == 8 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(empty(spark), model).count() == 0
    none = toxicity.fit(odd(spark), labels.where("false"), F.lit(True))
    assert all(r["predicted"] == 0 for r in toxicity.score(odd(spark), none).collect())
