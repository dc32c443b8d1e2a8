"""Language identification by cross-parsing entropy.

For every language a suffix automaton is built of a bounded sample of labelled text. A text is parsed greedily into the
longest phrases that occur in the sample; the language that needs the fewest phrases, times the bits that name a phrase
in a sample of its size, wins. The automaton and the greedy restart together are a finite automaton, kept as one table,
so a batch of texts is parsed in step: one table look-up a letter and language. Every letter of every text is parsed as
one text: blocks of BLOCK letters are parsed side by side, and again from the state the block before ended in, until
every block began where the one before it ended. Every label is learnt, and each language has letter classes of its own.

A text that is null, empty or without letters is `und` with score 0. Ties go to the language that sorts first. Rows
without a language are no training rows; without any training row all texts are `und`. Repeated rows are judged one by
one, an empty table gives an empty result, further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import share

#: The sample: up to DRAWS texts of a language, of each up to DRAW_CHARS from a random place, joined and cut to SAMPLE.
DRAWS = 96
DRAW_CHARS = 600
SAMPLE = 24_000
#: Beyond so many languages the samples shrink, so that all tables together stay bounded (about 150 MB).
ALIKE = 8
#: Letters that a language tells apart; rarer ones of its sample share a class, and so do letters that it lacks. Class 0
#: is whatever is no letter.
CLASSES = 96
BLOCK = 512
#: Letters of a batch that are parsed at a time.
LETTERS = 4_000_000


def automaton(sample: np.ndarray, classes: int) -> tuple[np.ndarray, int]:
    """The suffix automaton of sample as a table [state, class] -> next state; -1 where there is none."""
    size = 2 * len(sample) + 1
    step = [[-1] * classes]
    link, longest = [-1] * size, [0] * size
    last, made = 0, 1
    for c in sample.tolist():
        new = made
        made += 1
        step.append([-1] * classes)
        longest[new] = longest[last] + 1
        p = last
        while p != -1 and step[p][c] == -1:
            step[p][c] = new
            p = link[p]
        if p == -1:
            link[new] = 0
        else:
            q = step[p][c]
            if longest[p] + 1 == longest[q]:
                link[new] = q
            else:
                clone = made
                made += 1
                step.append(step[q].copy())
                longest[clone], link[clone] = longest[p] + 1, link[q]
                while p != -1 and step[p][c] == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return np.array(step, dtype=np.int32), made


def parser(sample: np.ndarray, classes: int) -> np.ndarray:
    """table[state * classes + class] = 2 * (next state * classes) + 1 if this letter begins a phrase. Where the phrase
    can't go on, the letter begins the next one from the start; an unknown letter is a phrase of its own."""
    step, _ = automaton(sample, classes)
    root = np.where(step[0] < 0, 0, step[0])
    broken = step < 0
    begun = broken.copy()
    begun[0] = True  # the start state is left by a letter that begins a phrase
    return (2 * classes * np.where(broken, root[None, :], step) + begun).astype(np.int32).reshape(-1)


@dataclass
class Model:
    """The samples as classes of their language's letters; workers build the tables, which are larger."""

    languages: list[str]
    letters: list[dict[str, int]]
    samples: list[np.ndarray]
    bits: list[float]

    def tables(self) -> list[np.ndarray]:
        return [parser(x, CLASSES) for x in self.samples]

    def lookups(self) -> list[np.ndarray]:
        return [lookup(x) for x in self.letters]


#: Code points from here on are no letters.
LETTERS_END = 0x30000
_ALPHA: list[np.ndarray] = []


def alpha() -> np.ndarray:
    """Whether each code point up to LETTERS_END is a letter."""
    if not _ALPHA:
        _ALPHA.append(np.array([chr(c).isalpha() for c in range(LETTERS_END)] + [False]))
    return _ALPHA[0]


def lookup(letters: dict[str, int]) -> np.ndarray:
    """Class of every code point: 0 for no letter, CLASSES - 1 for a letter that is not among letters."""
    out = np.where(alpha(), CLASSES - 1, 0).astype(np.uint8)
    for x, k in letters.items():
        out[ord(x)] = k
    return out


def fit(rows: list[tuple[str, str]]) -> Model:
    """rows: (language, text) pairs of the bounded sample, in the order in which they are taken."""
    texts: dict[str, list[str]] = {}
    for lang, text in rows:
        texts.setdefault(lang, []).append(text.lower())
    model = Model([], [], [], [])
    size = SAMPLE * ALIKE // max(ALIKE, len(texts))
    for lang in sorted(texts):
        text = coded(" ".join(texts[lang]))[:size]
        codes, n = np.unique(text[text > 0], return_counts=True)
        if len(codes):
            told = codes[np.lexsort((codes, -n))]
            letters = {chr(c): min(i + 1, CLASSES - 2) for i, c in enumerate(told.tolist())}
            model.languages.append(lang)
            model.letters.append(letters)
            model.samples.append(lookup(letters)[text])
            model.bits.append(float(np.log2(len(text) + 1)))
    return model


def coded(text: str) -> np.ndarray:
    """The code points of text's letters; a run of other characters is one 0."""
    x = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), LETTERS_END)
    x = np.where(alpha()[x], x, 0)
    return x[(x > 0) | np.concatenate(([True], x[:-1] > 0))]


def classed(text: str, look: np.ndarray) -> np.ndarray:
    return look[coded(text)]


def phrases(tables: list[np.ndarray], texts: list[np.ndarray]) -> np.ndarray:
    """Phrases that each text needs in each language, [text, language]."""
    blocks = [int(np.maximum(1, -(-len(x) // BLOCK))) for x in texts]
    owner = np.repeat(np.arange(len(texts)), blocks)
    total = sum(blocks)
    length = np.zeros(total, dtype=np.int64)
    flat = np.zeros((total, BLOCK), dtype=np.uint8)
    at = 0
    for x, n in zip(texts, blocks, strict=True):
        flat[at : at + n].reshape(-1)[: len(x)] = x
        length[at : at + n] = BLOCK
        length[at + n - 1] = len(x) - BLOCK * (n - 1)
        at += n
    # the block after each in its text, or -1
    after = np.where(np.append(owner[1:] == owner[:-1], False), np.arange(1, total + 1), -1) if total else owner
    out = np.zeros((len(texts), len(tables)))
    for k, table in enumerate(tables):
        start, begun = np.zeros(total, dtype=np.int32), np.zeros(total, dtype=np.int32)
        todo = np.argsort(-length, kind="stable")
        while len(todo):
            steps = np.ascontiguousarray(flat[todo].T)
            active = np.searchsorted(-length[todo], -np.arange(BLOCK), side="left")
            state, new = start[todo], np.zeros(len(todo), dtype=np.int32)
            for i in range(BLOCK):
                n = active[i]
                if not n:
                    break
                got = table[state[:n] + steps[i, :n]]
                new[:n] += got & 1
                state[:n] = got >> 1
            begun[todo] = new
            then = after[todo]
            wrong = (then >= 0) & (start[then] != state)
            start[then[wrong]] = state[wrong]
            todo = then[wrong]
            todo = todo[np.argsort(-length[todo], kind="stable")]
        out[:, k] = np.bincount(owner, weights=begun, minlength=len(texts))
    return out


def sample(docs: DataFrame, training, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """A bounded sample of the training rows: the row of least hash in each of DRAWS buckets a language, found on hashes
    first, so that only drawn texts are moved; in the order of the hashes, so that cutting the sample favours no text."""
    text = F.col(f"`{text_col}`").cast("string")
    hash_ = F.xxhash64(F.col(f"`{id_col}`"), text, F.lit("draw"))
    rows = docs.select(text.alias("text"), F.col(f"`{lang_col}`").alias("lang"), hash_.alias("h"), training.alias("t"))
    rows = rows.where("t AND lang IS NOT NULL AND text IS NOT NULL").withColumn("bucket", F.pmod("h", F.lit(DRAWS)))
    drawn = rows.groupBy("lang", "bucket").agg(F.min("h").alias("h")).select("lang", "h")
    start = F.pmod(F.col("h"), F.greatest(F.length("text") - DRAW_CHARS, F.lit(1))).cast("int") + 1
    picked = rows.join(F.broadcast(drawn), ["lang", "h"]).select("lang", "h", F.substring("text", start, F.lit(DRAW_CHARS)).alias("text"))
    return [(r["lang"], r["text"]) for r in picked.groupBy("lang", "h").agg(F.min("text").alias("text")).orderBy("lang", "h").collect()]


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: dict | None = None) -> DataFrame:
    """doc_id, the columns of keep (name to expression), lang_pred and score (how much fewer phrase bits than the next)."""
    get = share(docs.sparkSession, model)
    keep = keep or {}
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), *[e.alias(k) for k, e in keep.items()], F.col(f"`{text_col}`").cast("string").alias("text"))

    def judged(model: Model, looks: list[np.ndarray], tables: list[np.ndarray], texts: list[str | None]) -> tuple[list[str], list[float]]:
        codes = [coded((t or "").lower()) for t in texts]
        lettered = np.array([bool((c > 0).any()) for c in codes])
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not model.languages or not lettered.any():
            return names, scores
        bits = np.hstack([phrases([table], [look[c] for c in codes]) for look, table in zip(looks, tables, strict=True)]) * np.array(model.bits)
        best = bits.argmin(axis=1)
        low = np.take_along_axis(bits, best[:, None], 1)[:, 0]
        other = np.partition(bits, 1, axis=1)[:, 1] if bits.shape[1] > 1 else low * 2
        for i in np.flatnonzero(lettered):
            names[i], scores[i] = model.languages[best[i]], float(1 - low[i] / other[i]) if other[i] else 0.0
        return names, scores

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, looks, tables = get(lambda m: (m, m.lookups(), m.tables()))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            names: list[str] = []
            scores: list[float] = []
            at = 0
            while at < len(texts):
                end, letters = at, 0
                while end < len(texts) and (end == at or letters < LETTERS):
                    letters += len(texts[end] or "")
                    end += 1
                n, s = judged(model, looks, tables, texts[at:end])
                names += n
                scores += s
                at = end
            kept = batch.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*kept.schema.names, "lang_pred", "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])
    return narrow.mapInArrow(run, f"{kinds}, lang_pred string, score double")
