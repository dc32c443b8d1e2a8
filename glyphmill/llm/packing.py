"""Packing by cutting-stock column generation.

Every document is tokenised once, closed with an end id, and cut every `capacity` ids; each piece's length and crc are
known from then on. Piece lengths fall into classes of `step` ids, whose histogram (at most capacity / step rows) is
all that the driver gets. There a linear program over patterns (how many pieces of each class share a sequence) is
solved by column generation: the simplex method holds one pattern a class, and a knapsack dynamic program prices the
best new pattern from the duals. Pattern counts are rounded down, the rest is put first-fit decreasing, and ranked
pieces of each class take the patterns' places in order. The classes round lengths up, so a pattern always fits.

A null text is empty and is one piece of the end id alone. A row with a null doc_id is packed too. Repeated rows are
packed one by one, and ranked apart by the partition they came in, so a row that is a third of the table is in no one
task's window; which sequence a piece gets therefore depends on the partitions. Ties, pieces of one class, take places in
order of id, start and crc. Texts of any length are encoded whole; a task holds a slice of rows and their ids at a time. What
spells one of the tokenizer's own special tokens becomes that token's id, as the tokenizer does by itself. An empty table
gives an empty result, further columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, kept, slices

CAPACITY = 2048
END_ID = 1
STEP = 8
#: Words whose ids a worker keeps; the store is emptied when it is full.
WORDS_KEPT = 600_000
#: Ranks are counted by class and salt; the number of salts follows the pieces between these bounds.
SALTS = (16, 512)
ROWS_A_SALT = 50_000

_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?#%&*$|]*)")


class WordIds:
    """The ids of texts, by the ids of their words. The tokenizer never joins what a space or line feed separates, so
    a text's ids are those of its words in order; words repeat, so most need no tokenizer. A plain word (Latin letters,
    then marks) is the ids of its letters in lower case and those of its marks, each kept on their own; their encoder
    has the same model without the steps that such letters pass unchanged. All other words take the tokenizer as it is."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # only words that spell a special token need the search for them
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokenizer.encode_special_tokens = True
        self.bare = Tokenizer.from_file(path)
        self.bare.encode_special_tokens = True
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, dtype=bool)
        for word, i in self.tokenizer.get_vocab().items():
            self.ends[i] = word.endswith("</w>")
        self.parts: dict[str, bytes] = {"": b""}
        self.kept: dict[str, bytes] = {"": b""}

    def learn_parts(self, parts: list[str]) -> None:
        """Letters and marks are encoded as one text, and told apart by the ids that end a part."""
        ids = np.array(self.bare.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) == len(parts) and ends[-1] == len(ids):
            data, at = ids.tobytes(), 0
            for part, end in zip(parts, (4 * ends).tolist(), strict=True):
                self.parts[part] = data[at:end]
                at = end
        else:
            for part, e in zip(parts, self.tokenizer.encode_batch_fast(parts, add_special_tokens=False), strict=True):
                self.parts[part] = np.array(e.ids, dtype="<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        plain, other, special = [], [], []
        for w in words:
            m = _PLAIN.fullmatch(w)
            if m:
                plain.append((w, m[1].lower(), m[2]))
            elif any(x in w for x in self.special):
                special.append(w)
            else:
                other.append(w)
        if len(self.parts) > WORDS_KEPT:
            self.parts = {"": b""}
        if new := {p for x in plain for p in x[1:]}.difference(self.parts):
            self.learn_parts(list(new))
        for w, letters, end in plain:
            self.kept[w] = self.parts[letters] + self.parts[end]
        for some, as_text in ((other, True), (special, False)):
            if some:
                self.tokenizer.encode_special_tokens = as_text
                for w, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                    self.kept[w] = np.array(e.ids, dtype="<u4").tobytes()
        self.tokenizer.encode_special_tokens = True

    def of(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        split = [x.replace("\n", " ").split(" ") for x in texts]
        if len(self.kept) > WORDS_KEPT:
            self.kept = {"": b""}
        if new := set().union(*split).difference(self.kept):
            self.learn(list(new))
        get = self.kept.__getitem__
        return [b"".join(map(get, ws)) for ws in split]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document cut every capacity ids: doc_id, start, length, ids_crc32, doc_tokens."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = kept(f"words of {tokenizer_path}", lambda: WordIds(tokenizer_path)), np.array([end_id], dtype="<u4").tobytes()
        for rows in slices(batches):
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, ids in zip(rows["doc_id"], coder.of([x or "" for x in rows["text"]]), strict=True):
                data = ids + end
                total = len(data) // 4
                for start in range(0, total, capacity):
                    piece = data[4 * start : 4 * (start + capacity)]
                    for column, v in zip(out, (doc, start, len(piece) // 4, zlib.crc32(piece), total), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], type=id_type), *[pa.array(x, type=pa.int64()) for x in out[1:]]], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(docs.schema[id_col].dataType)
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return narrow.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def best_pattern(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable multiset of sizes that fits, and how often each is in it."""
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        n = np.searchsorted(sizes, c, side="right")
        best[c] = best[c - 1]
        if n:
            made = best[c - sizes[:n]] + values[:n]
            k = int(made.argmax())
            if made[k] > best[c] + 1e-12:
                best[c], pick[c] = made[k], k
    counts, c = np.zeros(len(sizes)), room
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            counts[pick[c]] += 1
            c -= sizes[pick[c]]
    return float(best[room]), counts


def fractional(demand: np.ndarray, sizes: np.ndarray, room: int, rounds: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often each is used in a least total that covers demand: revised simplex with an
    explicit inverse, entering the pattern that the knapsack prices best, or a surplus where a dual is negative."""
    m = len(sizes)
    base = np.diag((room // sizes).astype(float))
    cost, inverse = np.ones(m), np.diag(1.0 / (room // sizes))
    x = inverse @ demand
    for _ in range(rounds):
        duals = cost @ inverse
        low = int(duals.argmin())
        if duals[low] < -1e-9:
            column, price = np.zeros(m), 0.0
            column[low] = -1
        else:
            value, column = best_pattern(duals, sizes, room)
            price = 1.0
            if value <= 1 + 1e-7:
                break
        step = inverse @ column
        ratio = np.full(m, np.inf)
        np.divide(x, step, out=ratio, where=step > 1e-9)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        base[:, out], cost[out] = column, price
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        x = np.maximum(inverse @ demand, 0)
    used = cost > 0
    return base[:, used], x[used]


def plan(histogram: dict[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    """Patterns {class size: pieces} with their whole numbers of uses; together they hold exactly the histogram."""
    sizes = np.array(sorted(s for s, n in histogram.items() if n > 0))
    if not len(sizes):
        return []
    left = np.array([histogram[s] for s in sizes], dtype=np.int64)
    columns, uses = fractional(left.astype(float), sizes, room)
    made: list[tuple[dict[int, int], int]] = []
    for column, use in zip(columns.T.round().astype(np.int64), uses, strict=True):
        held = column > 0
        times = int(min(np.floor(use + 1e-9), (left[held] // column[held]).min())) if held.any() else 0
        if times:
            left -= column * times
            made.append(({int(s): int(n) for s, n in zip(sizes[held], column[held], strict=True)}, times))
    while left.any():  # the rest is a few patterns a class at most: first-fit decreasing, as often as it repeats
        space, held = room, {}
        for k in range(len(sizes) - 1, -1, -1):
            if n := min(int(left[k]), space // int(sizes[k])):
                held[k] = n
                space -= n * int(sizes[k])
        times = min(int(left[k]) // n for k, n in held.items())
        for k, n in held.items():
            left[k] -= n * times
        made.append(({int(sizes[k]): n for k, n in held.items()}, times))
    return made


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, step: int = STEP, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Sequences hold at most
    capacity ids. To the driver come counts by class and salt alone, whose number is bounded."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    cuts = cut(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col).withColumn("class", F.ceil(F.col("length") / step).cast("int")))
    # one row repeated a million times has one hash: the checkpoint's partition, which no retry changes, parts its rows
    salts = int(min(max(cuts.count() // ROWS_A_SALT, SALTS[0]), SALTS[1]))
    cuts = cuts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.spark_partition_id()), F.lit(salts)).cast("int"))
    counts = sorted((r["class"], r["salt"], r["count"]) for r in cuts.groupBy("class", "salt").count().collect())
    histogram: dict[int, int] = {}
    before = []
    for size, salt, n in counts:
        before.append((size, salt, histogram.get(size, 0)))
        histogram[size] = histogram.get(size, 0) + n
    places, taken, first = [], dict.fromkeys(histogram, 0), 0
    for held, times in plan(histogram, capacity // step):
        seat = 0
        for size, n in held.items():
            places.append((size, taken[size], taken[size] + n * times, n, first, seat))
            taken[size] += n * times
            seat += n
        first += times
    starts = spark.createDataFrame(before, "class int, salt int, before long")
    seats = spark.createDataFrame(places, "class int, low long, high long, each long, first long, seat long")
    rank = F.row_number().over(Window.partitionBy("class", "salt").orderBy("doc_id", "start", "ids_crc32"))
    ranked = cuts.withColumn("_r", rank).join(F.broadcast(starts), ["class", "salt"]).withColumn("rank", F.col("before") + F.col("_r") - 1)
    placed = (
        ranked.join(F.broadcast(seats).withColumnRenamed("class", "class_"), (F.col("class") == F.col("class_")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
        .withColumn("sequence_id", F.col("first") + F.floor((F.col("rank") - F.col("low")) / F.col("each")))
        .withColumn("_seat", F.col("seat") + (F.col("rank") - F.col("low")) % F.col("each"))
    )
    ahead = Window.partitionBy("sequence_id").orderBy("_seat").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(
        F.col("doc_id").cast(kind), "start", "length", "ids_crc32", "doc_tokens", F.col("sequence_id").cast("long"), F.coalesce(F.sum("length").over(ahead), F.lit(0)).cast("long").alias("offset")
    )
