"""Toxicity by noisy-channel deobfuscation.

A character language model (trigrams, counted over all training documents) decodes disguised words: a lattice offers,
for each character, what leetspeak may stand for and, for a run, its shorter spellings; Viterbi's path is the likeliest
word. Single letters with spaces or marks between them are one lattice, in which every gap may be nothing or a word's
edge, so that path parts the words too. The restored words are then
scored: features of a word are itself and its beginnings, weighed by the log ratio of their shares in toxic and clean
training documents; a logistic regression over a document's strongest words gives the score. While it is fitted, a
document's own counts are left out of its weights.

Labels come only from a bounded sample of training rows (the SAMPLE rows of least hash). A null text is empty; a text
without words has the score that the regression gives to no evidence. Labels that are null are ignored; without a label
of either class the score is the share of toxic labels, or 0. Repeated rows are scored one by one, an empty table gives
an empty result, further columns are not read. Words and spaced
stretches of any length are decoded, in time linear in their length; of equally likely spellings the first one offered wins.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, share, slices

#: Labelled rows that the classifier is fitted on.
SAMPLE = 20_000
#: Features of toxic sample rows that are weighed, most frequent first.
FEATURES = 60_000
LEAST_SUPPORT = 2
LEAST_WEIGHT = 1.0
STRONG = 3.0
STARTS = range(4, 10)
WORDS_KEPT = 500_000

# What leetspeak characters may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "€": "e", "(": "c"}
_LETTER, _LEET = re.compile(r"[^\W\d_]"), re.compile(r"[0-9@$!|+€(]")
#: A run of three of a letter, a doubled letter at the beginning, or marks between letters.
_BENT = re.compile(r"([^\W\d_])\1\1|^([^\W\d_])\2|[^\W\d_][*._~^-]+[^\W\d_]")
SPACED = re.compile(r"(?<![^\s])(?:[^\s.*_-][ .*_-]{1,2}+){2,}[^\s.*_-](?![^\s.,;:!?])")
EDGE = ".,;:!?#%&*$|<>\"'()[]{}…-_~^"
#: Classes of the language model: 0 is a word's edge, 1-26 letters, then Latin letters with marks, and all others.
CLASSES = 64
OTHER = 63
CHANNEL = 0.7  # what a substitution or a shortened run costs, in nats
PARTED = 2.0  # what a word's edge in a narrow gap costs, or none in a wide one


def disguised(word: str) -> bool:
    return bool((_LETTER.search(word) and _LEET.search(word)) or _BENT.search(word))


def letter_classes() -> np.ndarray:
    out = np.zeros(0x110000, dtype=np.uint8)
    for c in range(0x30000):
        if chr(c).isalpha():
            out[c] = OTHER
    out[ord("a") : ord("z") + 1] = np.arange(1, 27)
    out[0xDF:0x100] = np.arange(27, 60)
    return out


def classed(text: str, look: np.ndarray) -> np.ndarray:
    return look[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]


def trigram_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Trigrams of letter classes over all texts of docs; a partition gives at most CLASSES ** 3 counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, total = letter_classes(), np.zeros(CLASSES**3, dtype=np.int64)
        for rows in slices(batches):
            x = classed(" ".join(["", *(t for t in rows["text"] if t), "", ""]).lower(), look).astype(np.int32)
            x = x[np.concatenate(([True], (x[1:] > 0) | (x[:-1] > 0)))]
            x = np.repeat(x, np.where(x == 0, 2, 1))  # two edges between words, so that a word starts without context
            total += np.bincount((x[:-2] * CLASSES + x[1:-1]) * CLASSES + x[2:], minlength=CLASSES**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["code", "n"])

    counted = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))
    out = np.zeros(CLASSES**3, dtype=np.int64)
    for r in counted.collect():
        out[r["code"]] = r["n"]
    return out


@dataclass
class LanguageModel:
    """Negative log probabilities of a class after two others, smoothed by shorter contexts."""

    cost: np.ndarray
    look: dict[str, int] = field(default_factory=dict)

    @staticmethod
    def of(counts: np.ndarray) -> LanguageModel:
        three = counts.reshape(CLASSES, CLASSES, CLASSES).astype(float)
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        p1 = (one + 1) / (one.sum() + CLASSES)
        p2 = (two + 8 * p1) / (two.sum(axis=1, keepdims=True) + 8)
        p3 = (three + 4 * p2[None]) / (three.sum(axis=2, keepdims=True) + 4)
        return LanguageModel(-np.log(p3).astype(np.float32))

    def known(self) -> LanguageModel:
        classes = letter_classes()
        self.look = {chr(c): int(classes[c]) for c in np.flatnonzero(classes[:0x250])}
        return self

    def offers(self, word: str, first: bool = True) -> Iterator[list[tuple[str, float]]]:
        """What each run of a character may stand for, with its cost. first: word begins a word."""
        i = 0
        while i < len(word):
            j = i
            while j < len(word) and word[j] == word[i]:
                j += 1
            c, run = word[i], j - i
            if c.isalpha():
                own = [(c, 0.0)]
            elif c in LEET:
                own = [(x, CHANNEL) for x in LEET[c]]
            else:
                own = [("", CHANNEL)]
            if c in "!|$(+" and len(own[0][0]):
                own.append(("", 2 * CHANNEL))
            if run > 1 and own != [("", CHANNEL)]:
                either = run > 2 or not c.isalpha() or (first and i == 0)
                own = [(x * n, p + (CHANNEL if n < run else 0.0)) for x, p in own for n in ((1, 2) if either else (2,))]
            yield own
            i = j

    def spaced_offers(self, stretch: str) -> Iterator[list[tuple[str, float]]]:
        """The same for single characters with gaps between them: a narrow gap may be an edge, a wide one may be none."""
        at = 0
        for gap in re.finditer(r"[ .*_-]+", stretch):
            yield from self.offers(stretch[at : gap.start()], False)
            wide = gap[0].count(" ") > 1
            yield [("", PARTED if wide else 0.0), (" ", 0.0 if wide else PARTED)]
            at = gap.end()
        yield from self.offers(stretch[at:], False)

    def likeliest(self, steps: Iterable[list[tuple[str, float]]]) -> str:
        """Viterbi's path over steps of offers; a blank is a word's edge. Paths are linked backwards, so a step costs the same
        at any length."""
        paths: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        cost, look = self.cost, self.look
        for own in steps:
            new: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (spent, said) in paths.items():
                for x, p in own:
                    a2, b2, total = a, b, spent + p
                    for c in x:
                        if c == " ":
                            total += float(cost[a2, b2, 0])
                            a2 = b2 = 0
                            continue
                        k = look.get(c, OTHER)
                        total += float(cost[a2, b2, k])
                        a2, b2 = b2, k
                    if (a2, b2) not in new or total < new[a2, b2][0]:
                        new[a2, b2] = (total, (said, x) if x else said)
            low = min(spent for spent, _ in new.values())
            paths = {s: (spent - low, said) for s, (spent, said) in new.items()}
        said = min(((spent + float(cost[a, b, 0]), said) for (a, b), (spent, said) in paths.items()), key=lambda x: x[0])[1]
        out = []
        while said:
            said, x = said
            out.append(x)
        return "".join(reversed(out))

    def decode(self, word: str) -> str:
        """The likeliest spelling of word without leetspeak, marks inside it and long runs."""
        return self.likeliest(self.offers(word))

    def parted(self, stretch: str) -> list[str]:
        """The likeliest words of a spaced stretch."""
        return self.likeliest(self.spaced_offers(stretch)).split()


def restored(word: str, lm: LanguageModel) -> str:
    """A word in lower case without marks at its edges, decoded if it looks disguised."""
    bare = word.strip(EDGE)
    if disguised(word):
        inner = word.strip(".,;:?#%&*|<>\"'[]{}…-_~^") if word[:1] in "$@!(|" or word[-1:] in "$!" else bare
        inner = re.sub(r"^[$!|(]{3,}|[$!|(]{3,}$|[!(]+$", "", inner)
        if disguised(inner):
            return lm.decode(inner)
    return bare


def stretches(text: str) -> list[str]:
    """Runs of single characters with spaces or marks between them."""
    return [m[0] for m in SPACED.finditer(text)]


def features(word: str) -> list[str]:
    """The word and its beginnings."""
    return [f"^{word}$", *(f"^{word[:k]}" for k in STARTS if k <= len(word))] if len(word) > 2 else []


def words_of(text: str | None) -> list[str]:
    low = (text or "").lower()
    return low.split() + [f"\0{w}" for w in stretches(low)]


class Restorer:
    def __init__(self, lm: LanguageModel):
        self.lm, self.kept = lm.known(), {}

    def __call__(self, word: str) -> list[str]:
        """The restored words that word, or a spaced stretch behind a \\0, stands for."""
        got = self.kept.get(word)
        if got is None:
            if len(self.kept) > WORDS_KEPT:
                self.kept.clear()
            got = self.lm.parted(word[1:]) if word[0] == "\0" else [restored(word, self.lm)]
            self.kept[word] = got
        return got


def weights(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> np.ndarray:
    return np.log((np.maximum(toxic, 0) + 0.5) / (n_toxic + 1)) - np.log((np.maximum(clean, 0) + 0.5) / (n_clean + 1))


def evidence(values: list[float], n_words: int) -> list[float]:
    """What the regression sees: the strongest words' weights, how many are strong, and how dense they are."""
    top = sorted(values, reverse=True)[:8] + [0.0] * 8
    strong = sum(v >= STRONG for v in values)
    return [top[0], top[1], sum(top[2:8]) / 6, float(np.log1p(strong)), float(np.log1p(100 * strong / (n_words + 20)))]


@dataclass
class Model:
    lm: LanguageModel
    table: dict[str, float]
    mean: np.ndarray
    spread: np.ndarray
    coef: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(((x - self.mean) / self.spread) @ self.coef[1:] + self.coef[0], -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method with a ridge on all but the constant."""
    x = np.hstack([np.ones((len(x), 1)), x])
    coef, penalty = np.zeros(x.shape[1]), np.diag([1e-3, *[ridge] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ coef, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ coef)
        coef += step
        if abs(step).max() < 1e-8:
            break
    return coef


def fit(docs: DataFrame, labels: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """training: a Boolean expression over id_col, for rows whose labels and texts may be learnt from."""
    spark = docs.sparkSession
    fold = docs.where(training)
    lm = LanguageModel.of(trigram_counts(fold, text_col))
    told = labels.where(training).where(F.col("toxic").isin(0, 1)).groupBy(id_col).agg(F.max("toxic").alias("toxic"))
    picked = told.orderBy(F.xxhash64(id_col, F.lit("fit")), id_col).limit(SAMPLE)
    rows = picked.collect()
    n_toxic, n_clean = sum(r["toxic"] for r in rows), sum(1 - r["toxic"] for r in rows)
    if not n_toxic or not n_clean:
        part = n_toxic / max(1, n_toxic + n_clean)
        return Model(lm, {}, np.zeros(5), np.ones(5), np.array([np.log((part + 1e-9) / (1 - part + 1e-9)), *[0.0] * 5]))
    ids = F.broadcast(spark.createDataFrame([(r[id_col], r["toxic"]) for r in rows], "id long, toxic int"))
    text = F.col(f"`{text_col}`").cast("string")
    # one text an id, that of least hash: an id that many rows share counts once, like its label
    least = F.min(F.struct(F.xxhash64(text).alias("h"), text.alias("text"))).alias("x")
    chosen = cut(fold.join(ids, F.col(f"`{id_col}`") == F.col("id")).groupBy("id", "toxic").agg(least).select("id", "toxic", F.col("x.text").alias("text")))
    get_lm = share(spark, lm)

    def counted(only: int, among: set[str] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            restore, total = Restorer(get_lm()), Counter()
            for rows in slices(batches):
                for text in rows["text"]:
                    own = {f for w in {x for w in set(words_of(text)) for x in restore(w)} for f in features(w)}
                    total.update(own if among is None else own & among)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["feature", "n"])

        return chosen.where(F.col("toxic") == only).select("text").mapInArrow(run, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))

    toxic = {r["feature"]: r["n"] for r in counted(1, None).where(F.col("n") >= LEAST_SUPPORT).orderBy(F.desc("n"), "feature").limit(FEATURES).collect()}
    clean = {r["feature"]: r["n"] for r in counted(0, set(toxic)).collect()}
    names = sorted(toxic)
    t, c = np.array([toxic[x] for x in names], dtype=float), np.array([clean.get(x, 0) for x in names], dtype=float)
    full = weights(t, c, n_toxic, n_clean)
    held = full >= LEAST_WEIGHT
    without_one = {1: weights(t - 1, c, n_toxic - 1, n_clean), 0: weights(t, c - 1, n_toxic, n_clean - 1)}
    tables = {k: {x: float(w) for x, w, h in zip(names, v, held, strict=True) if h} for k, v in without_one.items()}
    table = {x: float(w) for x, w, h in zip(names, full, held, strict=True) if h}
    get_tables = share(spark, (lm, tables))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm, tables = get_tables()
        restore = Restorer(lm)
        for rows in slices(batches):
            made = [(k, evidence(*strengths(t, restore, tables[k], {}))) for k, t in zip(rows["toxic"], rows["text"], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in made], pa.int32()), pa.array([x for _, x in made], pa.list_(pa.float64()))], names=["toxic", "x"])

    made = chosen.select("toxic", "text").mapInArrow(seen, "toxic int, x array<double>").collect()
    x, y = np.array([r["x"] for r in made]), np.array([r["toxic"] for r in made], dtype=float)
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    return Model(lm, table, mean, spread, logistic((x - mean) / spread, y))


def strengths(text: str | None, restore: Restorer, table: dict[str, float], kept: dict[str, float]) -> tuple[list[float], int]:
    """The weights of the text's distinct restored words that have one, and how many words it has."""
    words = words_of(text)
    distinct = set(words)
    new = distinct.difference(kept)
    if new:
        if len(kept) > WORDS_KEPT:
            kept.clear()
            new = distinct
        for w in new:
            kept[w] = max((table.get(f, 0.0) for x in restore(w) for f in features(x)), default=0.0)
    return [v for v in map(kept.__getitem__, distinct) if v > 0], len(words)


def score(docs: DataFrame, model: Model, keep: dict | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, the columns of keep (name to expression), score and predicted."""
    get = share(docs.sparkSession, model)
    keep = keep or {}
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), *[e.alias(k) for k, e in keep.items()], F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, restore, known = get(lambda m: (m, Restorer(m.lm), {}))
        restore.kept.clear()  # each word is kept once, with its weight
        for batch in batches:
            x = [evidence(*strengths(t, restore, model.table, known)) for t in batch.column("text").to_pylist()]
            s = model.score(np.array(x).reshape(-1, 5))
            rest = batch.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*rest.schema.names, "score", "predicted"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])
    return narrow.mapInArrow(run, f"{kinds}, score double, predicted int")
