"""Benchmark decontamination by the q-gram lemma.

Texts and benchmark items are normalised alike (lower case, letters and digits, runs of all else as one space). An item
of m characters within e edits of a region shares at least m - q + 1 - q * e of its q-grams with it, on diagonals that
differ by at most e. So the shared q-grams of a document and an item are counted in bands of diagonals that overlap by
half; runs of bands that reach the bound are kept, and one banded alignment of the item with the run's region verifies
each, unless the item stands there unchanged, which a plain search tells. Hits are found over whole texts by rolling
hashes, a bitmap and a sorted table of the items' q-grams, and counted HITS at a time, so repetitive texts need no memory
for all their hits.

Items are taken in blocks of bounded size, each sent to the executors; so a benchmark of any size is searched in whole.
The budget e is a share of m, less where the bound would not be positive; items of fewer than q normalised characters
are searched as whole words, unchanged. Items without an id are searched like others and reported with a null id; items
without a letter or digit are in no text. Null texts match nothing, very long texts are searched whole, an empty benchmark
or table gives an empty result, repeated rows are searched one by one, and further columns are not read. Of regions with
equally few edits, the first in the text is told.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import share

U = np.uint64
Q = 12
EDIT_SHARE = 0.06
#: Characters of the items of one block.
BLOCK_CHARS = 4_000_000
#: Characters that are searched, and shared q-grams that are counted, at a time.
PART_CHARS = 2_000_000
HITS = 1_000_000
_P = [pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in (1, 2, 4, 8)]
_LOOK: list[np.ndarray] = []


def folded() -> np.ndarray:
    """Each code point's lower-case form if that is one letter or digit; 32 for what is neither."""
    if not _LOOK:
        out = np.full(0x110000, 32, dtype=np.uint32)
        for c in range(0x30000):
            x = chr(c)
            if x.isalnum():
                low = x.lower()
                out[c] = ord(low[0])
        _LOOK.append(out)
    return _LOOK[0]


def normal(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Normalised characters, and the place of each in text."""
    x = folded()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    keep = np.flatnonzero((x != 32) | np.concatenate(([False], x[:-1] != 32)))
    return x[keep], keep


def grams(x: np.ndarray) -> np.ndarray:
    """The hash of the Q characters from each place on."""
    if len(x) < Q:
        return np.empty(0, dtype=U)
    h1 = x.astype(U) + U(1)
    h2 = h1[:-1] * U(_P[0]) + h1[1:]
    h4 = h2[:-2] * U(_P[1]) + h2[2:]
    h8 = h4[:-4] * U(_P[2]) + h4[4:]
    h = h8[:-4] * U(_P[2]) + h4[8:]
    return (h ^ (h >> U(29))) * U(0xFF51AFD7ED558CCD)


def budget(m: int) -> int:
    return max(0, min(int(EDIT_SHARE * m), (m - Q) // Q))


def folded_windows(x: np.ndarray, size: int) -> np.ndarray:
    """The hash of the size characters from each place on."""
    h = np.zeros(len(x) - size + 1, dtype=U)
    for k in range(size):
        h = h * U(_P[0]) + x[k : k + len(h)].astype(U) + U(1)
    return h


class Index:
    """The q-grams of a block of items, and the items that are shorter than a q-gram."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.ids, self.texts, owner, place, code = [], [], [], [], []
        self.short: dict[int, list[tuple[int | None, np.ndarray]]] = {}
        for item, text in items:
            x = normal(text)[0]
            x = x[1:] if len(x) and x[0] == 32 else x
            x = x[:-1] if len(x) and x[-1] == 32 else x
            if len(x) >= Q:
                g = grams(x)
                owner.append(np.full(len(g), len(self.ids)))
                place.append(np.arange(len(g)))
                code.append(g)
                self.ids.append(item)
                self.texts.append(x)
            elif len(x):
                self.short.setdefault(len(x), []).append((item, x))
        code_ = np.concatenate(code) if code else np.empty(0, dtype=U)
        order = np.argsort(code_, kind="stable")
        self.code = code_[order]
        self.owner = np.concatenate(owner)[order] if owner else np.empty(0, dtype=np.int64)
        self.place = np.concatenate(place)[order] if place else np.empty(0, dtype=np.int64)
        self.lengths = np.array([len(x) for x in self.texts], dtype=np.int64)
        self.widths = np.array([budget(len(x)) + 1 for x in self.texts], dtype=np.int64)
        self.seen = np.zeros(1 << 24, dtype=bool)
        self.seen[(self.code >> U(40)).astype(np.int64)] = True

    def hits(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Item, place in the item and place in x of every shared q-gram, about HITS at a time."""
        if not len(self.code):
            return
        g = grams(x)
        at = np.flatnonzero(self.seen[(g >> U(40)).astype(np.int64)])
        low = np.searchsorted(self.code, g[at], side="left")
        n = np.searchsorted(self.code, g[at], side="right") - low
        at, low, n = at[n > 0], low[n > 0], n[n > 0]
        done = np.cumsum(n)
        first = 0
        while first < len(at):
            last = max(first + 1, int(np.searchsorted(done, (done[first - 1] if first else 0) + HITS, side="right")))
            a, b, k = at[first:last], low[first:last], n[first:last]
            rows = np.repeat(b - np.concatenate(([0], np.cumsum(k)[:-1])), k) + np.arange(k.sum())
            yield self.owner[rows], self.place[rows], np.repeat(a, k)
            first = last

    def bands(self, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, band, shared q-grams) of every pair of a text (which begin at starts in x) and an item, by key, then band."""
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def counted(parts):
            key, band, n = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.lexsort((band, key))
            key, band, n = key[order], band[order], n[order]
            new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (band[1:] != band[:-1]))))
            return key[new], band[new], np.add.reduceat(n, new)

        for owner, place, at in self.hits(x):
            key = (np.searchsorted(starts, at, side="right") - 1) * len(self.ids) + owner
            parts.append(counted([(key, np.floor_divide(at - place, self.widths[owner]), np.ones(len(key), dtype=np.int64))]))
            if len(parts) > 16:
                parts = [counted(parts)]
        return counted(parts) if parts else (np.empty(0, np.int64),) * 3

    def whole_words(self, x: np.ndarray) -> Iterator[tuple[int | None, int, int]]:
        """(item id, start, end) of every short item that stands in x as whole words."""
        edge = np.concatenate(([True], (x == 32) | (x == 0), [True]))  # edge[i]: x[i - 1] is no letter or digit
        for size, items in self.short.items():
            if len(x) < size:
                continue
            code = folded_windows(x, size)
            fit = np.flatnonzero(edge[: len(code)] & edge[size + 1 : size + 1 + len(code)])
            wanted: dict[int, list[tuple[int | None, np.ndarray]]] = {}
            for item, own in items:
                wanted.setdefault(int(folded_windows(own, size)[0]), []).append((item, own))
            for at in fit[np.isin(code[fit], np.array(list(wanted), dtype=U))].tolist():
                for item, own in wanted[int(code[at])]:
                    if (x[at : at + size] == own).all():
                        yield item, at, at + size


def aligned(item: np.ndarray, x: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """The least edits between item and a region of x that starts on diagonals low to high, with the region; None if
    more than most. Only diagonals within most of those are filled."""
    low, high = low - most, high + most
    k = np.arange(high - low + 1)
    big = 1 << 20
    row, start = np.zeros(len(k), dtype=np.int64), low + k
    for i in range(len(item)):
        j = low + i + k
        fit = (j >= 0) & (j < len(x))
        y = np.where(fit, x[np.clip(j, 0, len(x) - 1)], 0)
        through = np.where(fit, row + (y != item[i]), big)
        skip = np.append(row[1:] + 1, big)
        came = np.where(skip < through, np.append(start[1:], 0), start)
        best = np.minimum(through, skip)
        left = np.minimum.accumulate(best - k)
        source = np.maximum.accumulate(np.where(best - k == left, k, 0))
        row, start = left + k, came[source]
    end = int(row.argmin())
    if row[end] > most:
        return None
    return int(row[end]), max(0, int(start[end])), min(len(x), low + len(item) + end)


def matches(index: Index, texts: list[str]) -> list[tuple[int, int | None, int, int, int, int]]:
    """(text, item id, start, end, edits, shared q-grams), one for each text and item: the region of fewest edits."""
    parts, places, offsets, n = [], [], [], 0
    for t in texts:
        x, keep = normal(t)
        parts += [x, np.array([0], dtype=np.uint32)]  # 0 is in no item
        places.append(keep)
        offsets.append(n)
        n += len(x) + 1
    joined, starts = np.concatenate(parts) if parts else np.empty(0, dtype=np.uint32), np.array(offsets)
    key, band, shared = index.bands(joined, starts)
    found: dict[tuple[int, int | None, int], tuple[int, int, int, int]] = {}
    cuts = np.flatnonzero(np.diff(key)) + 1
    for lo, hi in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(key)])), strict=True):
        if lo == hi:
            continue
        d, item = divmod(int(key[lo]), len(index.ids))
        m = int(index.lengths[item])
        e, width = budget(m), int(index.widths[item])
        bound = m - Q + 1 - Q * e
        if int(shared[lo:hi].sum()) < bound:
            continue
        number = dict(zip(band[lo:hi].tolist(), shared[lo:hi].tolist(), strict=True))
        pairs = {b: number.get(b, 0) + number.get(b + 1, 0) for b in {v for v in number} | {v - 1 for v in number}}
        full = sorted(b for b, n in pairs.items() if n >= bound)
        if not full:
            continue
        begin = int(starts[d])
        x = joined[begin : begin + len(places[d])]
        whole = exact(index.texts[item], x)
        if whole >= 0:
            found[d, index.ids[item], item] = (0, whole, whole + m, max(pairs[b] for b in full))
            continue
        best = None
        k = 0
        while k < len(full):
            j = k
            while j + 1 < len(full) and full[j + 1] == full[j] + 1:
                j += 1
            got = aligned(index.texts[item], x, full[k] * width - begin, (full[j] + 2) * width - 1 - begin, e)
            if got and (best is None or got < best[:3]):
                best = (*got, max(pairs[b] for b in full[k : j + 1]))
            k = j + 1
        if best:
            found[d, index.ids[item], item] = best
    if index.short:
        for item, start, end in index.whole_words(joined):
            d = int(np.searchsorted(starts, start, side="right")) - 1
            found.setdefault((d, item, -1 - end + start), (0, start - int(starts[d]), end - int(starts[d]), 0))
    out = []
    for (d, item, _), (edits, start, end, n) in sorted(found.items(), key=lambda kv: (kv[0][0], kv[0][2])):
        keep = places[d]
        out.append((d, item, int(keep[start]), int(keep[min(end, len(keep)) - 1]) + 1, edits, n))
    return out


def exact(item: np.ndarray, x: np.ndarray) -> int:
    """The first place at which item stands in x, or -1."""
    data, own, at = x.tobytes(), item.tobytes(), -1
    while True:
        at = data.find(own, at + 1)
        if at < 0 or at % 4 == 0:
            return at // 4 if at >= 0 else -1


def in_parts(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about PART_CHARS characters, with the number of the first."""
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or chars < PART_CHARS):
            chars += len(texts[end] or "")
            end += 1
        yield at, [t or "" for t in texts[at:end]]
        at = end


def blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[int | None, str]]]:
    """The items in blocks of about BLOCK_CHARS characters; the driver holds one at a time."""
    block, chars = [], 0
    rows = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t")).where("t IS NOT NULL")
    for r in rows.toLocalIterator():
        block.append((r["i"], r["t"]))
        chars += len(r["t"])
        if chars >= BLOCK_CHARS:
            yield block
            block, chars = [], 0
    if block:
        yield block


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document and item that it holds: doc_id, item_id, start, end (code points), edits, shared_grams."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, start long, end long, edits int, shared_grams int"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = spark.createDataFrame([], schema)
    for k, items in enumerate(blocks(benchmark)):
        get = share(spark, items)

        def run(batches: Iterator[pa.RecordBatch], get=get) -> Iterator[pa.RecordBatch]:
            index = get(Index)
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                for at, texts in in_parts(batch.column("text").to_pylist()):
                    found = matches(index, texts)
                    yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, (ids[at + d], *rest), strict=True)) for d, *rest in found], schema=arrow)

        made = narrow.mapInArrow(run, schema)
        out = made if not k else out.unionByName(made)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no item, with the columns of docs; no row is joined or moved."""
    spark = docs.sparkSession
    for items in blocks(benchmark):
        get = share(spark, items)

        def run(batches: Iterator[pa.RecordBatch], get=get) -> Iterator[pa.RecordBatch]:
            index = get(Index)
            for batch in batches:
                fine = np.ones(batch.num_rows, dtype=bool)
                for at, texts in in_parts(batch.column(text_col).to_pylist()):
                    for d, *_ in matches(index, texts):
                        fine[at + d] = False
                yield batch.filter(pa.array(fine))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
