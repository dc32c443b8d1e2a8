"""Document quality from a linear-chain conditional random field over lines.

Each line of a document is good or bad. What a line looks like, and what the lines before and after it look like, decides
how much speaks for good; how lines follow each other is learnt as well. Forward and backward passes give each line's
chance to be good, and the mean over a document's lines, weighted by their length, is its quality, which a logistic curve
turns into a score. Labels are by document: the field is first learnt with every line labelled as its document, then again
with those lines of bad documents as good that look good by themselves, one at least staying bad.

The model is fitted on a bounded sample: SAMPLE labelled training documents of least hash, and of each a window of at most
WINDOW lines, whose place its hash decides; what lines look like, the curve, and every score come from whole texts.
Tasks hold a slice of documents at a time. Lines end at \\n.

A null text is an empty one; a text without anything but white space has the score that the curve gives to quality 0. Null
labels are ignored; without a label of either class the score is the share of good labels, or 0. Of rows that repeat a
labelled id one text, of least hash, is learnt from; every row is scored on its own. Texts and lines of any length count
whole, in time linear in their length. An empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, kept, share, slices
from .toxicity import logistic

#: Labelled documents that the model is fitted on, and lines of each.
SAMPLE, WINDOW = 6_000, 48
#: Rows whose lines a task holds at a time.
ROWS = 64
RIDGE = 1.0

#: Kinds of characters: a line's share of each is a feature. A blank is 0, and a letter that has no case is 3.
KINDS = ("upper", "lower", "caseless", "digit", "mark", "bar", "shout", "stop", "bracket", "quote", "other")
_MARKS = {"mark": "#*$%&@^~_\\", "bar": "|<>={}/+", "shout": "!", "stop": ".,;:?", "bracket": "()[]", "quote": "\"'’“”«»-–—…"}
OF_WORDS = ("words", "word length", "repeats", "commonest", "seen windows", "seen line", "same as before", "closed", "capital")
OWN = len(KINDS) + len(OF_WORDS) + 2


def kinds() -> np.ndarray:
    """The kind of every code point."""

    def make() -> np.ndarray:
        out = np.full(0x110000, KINDS.index("other") + 1, dtype=np.uint8)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                out[c] = 1 if x.isupper() else 2 if x.islower() else 3
            elif x.isdigit():
                out[c] = 4
            elif x.isspace():
                out[c] = 0
        for name, chars in _MARKS.items():
            out[[ord(x) for x in chars]] = KINDS.index(name) + 1
        return out

    return kept("glyphmill-line-kinds", make)


def of_words(lines: list[str]) -> list[tuple[float, ...]]:
    """What the words of each line of a document tell, also beside the lines before it."""
    out, seen, windows = [], set(), set()
    before: list[str] = []
    for line in lines:
        words = line.split()
        n = len(words)
        if not n:
            out.append((0.0,) * len(OF_WORDS))
            continue
        once = Counter(words)
        again = 0
        for w in zip(words, words[1:], words[2:], strict=False):
            if w in windows:
                again += 1
            else:
                windows.add(w)
        key = " ".join(words)
        out.append((
            np.log1p(n), min(sum(map(len, words)) / n, 30.0) / 10, 1 - len(once) / n, max(once.values()) / n if n > 4 else 0.0, again / max(1, n - 2),
            float(key in seen), float(words == before), float(words[-1][-1] in ".!?:"), float(words[0][0].isupper()),
        ))
        seen.add(key)
        before = words
    return out


@dataclass
class Lines:
    """The lines of some documents: own features, weights (characters that are not blank) and how many each document has."""

    own: np.ndarray
    weight: np.ndarray
    counts: np.ndarray

    def seen(self) -> np.ndarray:
        """Features of each line, the one before and the one after, and a constant."""
        n = len(self.own)
        firsts = np.cumsum(self.counts) - self.counts
        before, after = np.vstack([np.zeros((1, OWN)), self.own])[:n], np.vstack([self.own, np.zeros((1, OWN))])[1:]
        edges = np.zeros((n, 2))
        edges[firsts, 0] = edges[firsts + self.counts - 1, 1] = 1
        before[edges[:, 0] > 0] = after[edges[:, 1] > 0] = 0
        return np.hstack([self.own, before, after, edges, np.ones((n, 1))])


def lines_of(texts: list[str | None]) -> Lines:
    """The lines of texts; each text has at least one, which may be empty."""
    parts = [(t or "").split("\n") for t in texts]
    counts = np.array([len(p) for p in parts], dtype=np.int64)
    joined = "".join(f"{t or ''}\n" for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    look, ends = kinds()[points], np.flatnonzero(points == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    held = np.stack([np.add.reduceat(look == k, starts, dtype=np.int64) for k in range(1, len(KINDS) + 1)], axis=1)
    weight = held.sum(axis=1)
    shares = np.sqrt(held / np.maximum(weight, 1)[:, None])
    worded = np.array([x for p in parts for x in of_words(p)]).reshape(-1, len(OF_WORDS))
    sizes = np.stack([np.log1p(weight), (weight == 0).astype(float)], axis=1)
    return Lines(np.hstack([shares, worded, sizes]), weight.astype(float), counts)


def onward(odds: np.ndarray, good: float, bad: float) -> np.ndarray:
    """Log odds of a line's state from those of its neighbour: staying good or bad counts good or bad more than a change."""
    return np.logaddexp(odds + good, 0.0) - np.logaddexp(odds, bad)


def marginals(said: np.ndarray, counts: np.ndarray, good: float, bad: float) -> np.ndarray:
    """The chance of every line to be good: said has each line's own log odds, lines of a document in a row. Documents go
    side by side, longest first, a place at a time."""
    order = np.argsort(-counts, kind="stable")
    first, size = (np.cumsum(counts) - counts)[order], counts[order]
    ahead, back = said.copy(), np.zeros(len(said))
    active = np.searchsorted(-size, -np.arange(1, size[0] + 1 if len(size) else 1), side="right")  # documents that reach a place
    for t in range(1, len(active)):
        at = first[: active[t]] + t
        ahead[at] += onward(ahead[at - 1], good, bad)
    for t in range(len(active) - 2, -1, -1):
        at = first[: active[t + 1]] + t
        back[at] = onward(said[at + 1] + back[at + 1], good, bad)
    return 1 / (1 + np.exp(-np.clip(ahead + back, -500, 500)))


def likelihood(said: np.ndarray, label: np.ndarray, mask: np.ndarray, good: float, bad: float) -> tuple[float, np.ndarray, float, float]:
    """Log likelihood of labels of padded chains (rows; mask: the lines there are), with what its gradient takes from each
    line, and for staying good and bad."""
    b, t = said.shape
    fore = np.zeros((t, b, 2))
    fore[0, :, 1] = said[:, 0]
    for k in range(1, t):
        new0 = np.logaddexp(fore[k - 1, :, 0] + bad, fore[k - 1, :, 1])
        new1 = said[:, k] + np.logaddexp(fore[k - 1, :, 0], fore[k - 1, :, 1] + good)
        fore[k] = np.where(mask[:, k, None], np.stack([new0, new1], axis=1), fore[k - 1])
    total = np.logaddexp(fore[-1, :, 0], fore[-1, :, 1])
    back = np.zeros((t, b, 2))
    stay_good = stay_bad = 0.0
    for k in range(t - 2, -1, -1):
        next0, next1 = back[k + 1, :, 0], back[k + 1, :, 1] + said[:, k + 1]
        here = mask[:, k + 1]
        back[k, :, 0] = np.where(here, np.logaddexp(bad + next0, next1), 0.0)
        back[k, :, 1] = np.where(here, np.logaddexp(next0, good + next1), 0.0)
        stay_good += float(np.exp(fore[k, here, 1] + good + next1[here] - total[here]).sum())
        stay_bad += float(np.exp(fore[k, here, 0] + bad + next0[here] - total[here]).sum())
    chance = np.exp(fore[:, :, 1] + back[:, :, 1] - total).T
    both, one = mask[:, 1:] & mask[:, :-1], label > 0.5
    n_good, n_bad = float((both & one[:, 1:] & one[:, :-1]).sum()), float((both & ~one[:, 1:] & ~one[:, :-1]).sum())
    value = float((said * label * mask).sum() + good * n_good + bad * n_bad - total.sum())
    return value, (label - chance) * mask, n_good - stay_good, n_bad - stay_bad


def climb(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int = 120, memory: int = 10) -> np.ndarray:
    """Limited-memory BFGS with backtracking, towards the maximum of a concave f that gives value and gradient."""
    value, slope = f(x)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        step, parts = slope.copy(), []
        for s, y in reversed(moves):
            a = float(s @ step) / float(s @ y)
            parts.append(a)
            step -= a * y
        if moves:
            s, y = moves[-1]
            step *= float(s @ y) / float(y @ y)
        for (s, y), a in zip(moves, reversed(parts), strict=True):
            step += (a - float(y @ step) / float(s @ y)) * s
        size = 1.0 if moves else 1.0 / max(1.0, float(np.abs(slope).sum()))
        gain = float(step @ slope)
        while size > 1e-10:
            new, new_slope = f(x + size * step)
            if new >= value + 1e-4 * size * gain:
                break
            size /= 2
        else:
            break
        moved, turned = size * step, slope - new_slope
        x, done = x + moved, new - value < 1e-7 * max(1.0, abs(new))
        value, slope = new, new_slope
        if float(moved @ turned) > 1e-12:
            moves = [*moves[-memory + 1 :], (moved, turned)]
        if done:
            break
    return x


def learn(seen: np.ndarray, counts: np.ndarray, label: np.ndarray, ridge: float = RIDGE, rounds: int = 120) -> np.ndarray:
    """Weights of the features seen, then those of staying good and bad, from lines with labels 0 or 1; counts: the lines
    of each chain."""
    b, t = len(counts), int(counts.max())
    mask = np.arange(t) < counts[:, None]
    padded = np.zeros((b, t))
    labels = padded.copy()
    labels[mask] = label

    def f(x: np.ndarray) -> tuple[float, np.ndarray]:
        said = padded.copy()
        said[mask] = seen @ x[:-2]
        value, from_lines, from_good, from_bad = likelihood(said, labels, mask, x[-2], x[-1])
        slope = np.concatenate([seen.T @ from_lines[mask], [from_good, from_bad]])
        return value - ridge / 2 * float(x @ x), slope - ridge * x

    return climb(f, np.zeros(seen.shape[1] + 2), rounds)


def relabelled(said: np.ndarray, counts: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Labels of lines: as their document, but for lines of bad documents that look good by themselves (said > 0). The worst
    line of a bad document stays bad."""
    out = np.repeat(good.astype(float), counts)
    firsts = np.cumsum(counts) - counts
    for at, n, g in zip(firsts, counts, good, strict=True):
        if not g:
            own = said[at : at + n] > 0
            own[said[at : at + n].argmin()] = False
            out[at : at + n] = own
    return out


@dataclass
class Model:
    """middle and spread of the features seen; the field's weights; the curve from quality to score."""

    middle: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    curve: np.ndarray
    fixed: float | None = None

    def said(self, lines: Lines) -> np.ndarray:
        return ((lines.seen() - self.middle) / self.spread) @ self.weights[:-2]

    def line_chances(self, lines: Lines) -> np.ndarray:
        return marginals(self.said(lines), lines.counts, self.weights[-2], self.weights[-1])

    def quality(self, texts: list[str | None]) -> np.ndarray:
        """The mean chance of each text's lines to be good, weighted by their characters."""
        lines = lines_of(texts)
        firsts = np.cumsum(lines.counts) - lines.counts
        good = np.add.reduceat(self.line_chances(lines) * lines.weight, firsts)
        return good / np.maximum(np.add.reduceat(lines.weight, firsts), 1)

    def score(self, quality: np.ndarray) -> np.ndarray:
        if self.fixed is not None:
            return np.full(len(quality), self.fixed)
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * bent(quality), -30, 30)))


def bent(quality: np.ndarray) -> np.ndarray:
    q = np.clip(quality, 1e-3, 1 - 1e-3)
    return np.log(q / (1 - q))


def fit(docs: DataFrame, labels: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """training: a Boolean expression over id_col, for rows whose labels and texts may be learnt from."""
    spark, width = docs.sparkSession, 3 * OWN + 3
    told = labels.where(training).where(F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).alias("good"))
    rows = told.orderBy(F.xxhash64(id_col, F.lit("lines")), id_col).limit(SAMPLE).collect()
    n_good = sum(r["good"] for r in rows)
    none = Model(np.zeros(width), np.ones(width), np.zeros(width + 2), np.zeros(2), n_good / max(1, len(rows)))
    if n_good in (0, len(rows)):
        return none
    kind = labels.schema[id_col].dataType.simpleString()
    ids = F.broadcast(spark.createDataFrame([(r[id_col], r["good"]) for r in rows], f"_id {kind}, good int"))
    text = F.col(f"`{text_col}`").cast("string")
    found = docs.where(training).join(ids, F.col(f"`{id_col}`") == F.col("_id")).groupBy("_id", "good").agg(F.min(F.struct(F.xxhash64(text).alias("h"), text.alias("text"))).alias("x"))
    chosen = cut(found.select("good", F.col("x.h").alias("h"), F.col("x.text").alias("text")))

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, ROWS):
            lines = lines_of(rows["text"])
            seen, goods, chains, at = lines.seen(), [], [], 0
            for good, h, n in zip(rows["good"], rows["h"], lines.counts.tolist(), strict=True):
                begin = at + h % (n - WINDOW + 1) if n > WINDOW else at
                chains.append(seen[begin : begin + min(n, WINDOW)].astype(np.float32).ravel())
                goods.append(good)
                at += n
            yield pa.RecordBatch.from_arrays([pa.array(goods, pa.int32()), pa.array(chains, pa.list_(pa.float32()))], names=["good", "seen"])

    # the windows of SAMPLE documents, so that what comes to the driver is bounded
    made = chosen.mapInArrow(shown, "good int, seen array<float>").toPandas()
    if made.empty:
        return none
    chains = [np.asarray(x, dtype=np.float64).reshape(-1, width) for x in made["seen"]]
    good, counts, seen = made["good"].to_numpy() > 0, np.array([len(x) for x in chains]), np.vstack(chains)
    middle, spread = seen.mean(axis=0), seen.std(axis=0)
    middle[-1], spread[spread < 1e-6] = 0.0, 1.0
    seen = (seen - middle) / spread
    label = np.repeat(good.astype(float), counts)
    alone = learn(seen, np.ones(len(seen), dtype=np.int64), label, rounds=60)
    weights = learn(seen, counts, relabelled(seen @ alone[:-2], counts, good))
    model = Model(middle, spread, weights, np.zeros(2))
    get = share(spark, model)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(rows["good"], pa.int32()), pa.array(get().quality(rows["text"]))], names=["good", "quality"])

    whole = chosen.select("good", "text").mapInArrow(measured, "good int, quality double").collect()
    model.curve = logistic(bent(np.array([r["quality"] for r in whole]))[:, None], np.array([r["good"] for r in whole], dtype=float), 1e-3)
    return model


def line_labels(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line (from 0) and p_good of every line."""
    get = share(docs.sparkSession, model)
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                lines = lines_of(part.column("text").to_pylist())
                whose = np.repeat(np.arange(part.num_rows), lines.counts)
                place = np.arange(len(whose)) - np.repeat(np.cumsum(lines.counts) - lines.counts, lines.counts)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(whose)), pa.array(place), pa.array(get().line_chances(lines))], names=["doc_id", "line", "p_good"])

    return narrow.mapInArrow(run, f"doc_id {kind}, line long, p_good double")


def score(docs: DataFrame, model: Model, keep: dict | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, the columns of keep (name to expression), score, predicted and the quality that the score comes from."""
    get, keep = share(docs.sparkSession, model), keep or {}
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), *[e.alias(k) for k, e in keep.items()], F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = get()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                quality = model.quality(part.column("text").to_pylist())
                s, rest = model.score(quality), part.drop_columns(["text"])
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(quality)], names=[*rest.schema.names, "score", "predicted", "quality"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])
    return narrow.mapInArrow(run, f"{columns}, score double, predicted int, quality double")
