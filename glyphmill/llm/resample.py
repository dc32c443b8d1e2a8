"""Importance resampling towards a target distribution, from hashed features in sparse matrices.

Every document is a row of a document-by-bucket count matrix, kept in the shared folder as CSR blocks: a row of the table
is a block of documents with their ids, row ends, column indices and counts. Column sums of the corpus's matrix and of the
target's give both distributions; a bucket's gain is the log ratio of its smoothed shares, in thousandths, and the product
of a block with the vector of gains gives its documents' weights. Weights and a Gumbel draw that the document's id decides
make scores; the documents of highest score are the sample, which is drawn without replacement in proportion to the weights.

To the driver come column sums alone, at most as many as there are buckets. Ranks are places in a sort by range, so no
task sees more than its range, and a document repeated without end is parted over tasks.

A null text is an empty one: it has no feature, weight 0, and too few words to be drawn. A null id is drawn as an empty
text, before all others of its score; repeated rows are documents of their own, with ranks of their own. Texts of any
length count whole: one has at most as many counts as there are buckets. Ties go to smaller ids. An empty corpus gives an
empty result, an empty target the gains of no counts. Further columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh_path, numbered, share

#: Documents and counts that a block holds at most; a single document may hold as many counts as there are buckets.
BLOCK_ROWS, BLOCK_COUNTS = 64, 1 << 16
#: Blocks are read a row group at a time, unpacked: so row groups are small, whatever a task's share of the table is. Their
#: size is looked at after so many blocks at first.
GROUP_BYTES, GROUP_LOOK = 1 << 20, 16
WORDS_KEPT = 500_000

#: Upper case of ASCII to lower; what is no word to a blank. Bytes from 0x80 on belong to words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


@dataclass(frozen=True)
class Settings:
    """Features are runs of 1 to longest words. share: percent of the documents with at least least_words words."""

    longest: int = 1
    buckets: int = 10_000
    least_words: int = 20
    percent: int = 10
    seed: int = 2024


def features(text: str | None, longest: int = 1) -> tuple[Counter, int]:
    """The features of a text with their counts, and how many words it has."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()
    found = Counter(words)
    for n in range(2, longest + 1):
        found.update(b" ".join(x) for x in zip(*(words[k:] for k in range(n)), strict=False))
    return found, len(words)


def write_matrix(docs: DataFrame, path: str, settings: Settings, id_col: str | None = "doc_id", text_col: str = "text") -> DataFrame:
    """The count matrix of docs as a table of CSR blocks at path, read again: ids, words (each document's number), ends
    (where each document's counts end), buckets and counts. id_col None: the rows have no ids."""
    longest, width = settings.longest, settings.buckets
    narrow = docs.select((F.col(f"`{id_col}`") if id_col else F.lit(None).cast("long")).alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        names = ["ids", "words", "ends", "buckets", "counts"]
        for batch in batches:
            ids, at = batch.column("id"), 0
            words: list[int] = []
            ends: list[int] = []
            buckets: list[int] = []
            counts: list[int] = []
            for k in range(batch.num_rows):
                found, n = features(batch.column("text")[k].as_py(), longest)
                if len(known) > WORDS_KEPT:
                    known.clear()
                row: dict[int, int] = {}
                for f, c in found.items():
                    b = known.get(f)
                    if b is None:
                        b = known[f] = zlib.crc32(f) % width
                    row[b] = row.get(b, 0) + c
                buckets.extend(row)
                counts.extend(row.values())
                words.append(n)
                ends.append(len(buckets))
                if len(ends) >= BLOCK_ROWS or len(buckets) >= BLOCK_COUNTS or k == batch.num_rows - 1:
                    whole = lambda values, kind=pa.int64(): pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values if isinstance(values, pa.Array) else pa.array(values, kind))
                    yield pa.RecordBatch.from_arrays([whole(ids.slice(at, len(ends))), whole(words), whole(ends, pa.int32()), whole(buckets, pa.int32()), whole(counts)], names=names)
                    at, words, ends, buckets, counts = k + 1, [], [], [], []

    narrow.mapInArrow(run, f"ids array<{kind}>, words array<long>, ends array<int>, buckets array<int>, counts array<long>").write.options(**{"parquet.block.size": GROUP_BYTES, "parquet.page.size.row.check.min": GROUP_LOOK}).parquet(path)
    return docs.sparkSession.read.parquet(path)


def _vector(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    return batch.column(name)[row].values.to_numpy(zero_copy_only=False)


def column_sums(matrix: DataFrame, width: int) -> list[int]:
    """How often each bucket occurs in all blocks: each task gives at most one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, dtype=np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                np.add.at(total, _vector(batch, "buckets", row), _vector(batch, "counts", row))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    out = [0] * width
    for r in matrix.select("buckets", "counts").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: list[int], target: list[int]) -> np.ndarray:
    """The smoothed log ratio of a bucket's share in the target to that in the corpus, in thousandths, floored."""
    width, s_all, t_all = len(corpus), sum(corpus), sum(target)
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + width) / ((s + 1) * (t_all + width)))) for s, t in zip(corpus, target, strict=True)], dtype=np.int64)


def gumbel(doc_id: object, seed: int) -> int:
    """The draw of a document, in thousandths, floored: its id alone decides it. A null id counts as an empty text."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(matrix: DataFrame, gain: np.ndarray, settings: Settings) -> DataFrame:
    """doc_id, n_features, n_words, weight and score of every document: each block times the vector of gains."""
    get, longest, seed = share(matrix.sparkSession, gain), settings.longest, settings.seed
    kind = matrix.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = get()
        for batch in batches:
            for row in range(batch.num_rows):
                ids, words, ends = batch.column("ids")[row].values, _vector(batch, "words", row), _vector(batch, "ends", row)
                sums = np.concatenate(([0], np.cumsum(_vector(batch, "counts", row) * gain[_vector(batch, "buckets", row)])))
                weight = sums[ends] - sums[np.concatenate(([0], ends[:-1]))]
                score = weight + np.array([gumbel(i, seed) for i in ids.to_pylist()], dtype=np.int64)
                n = sum(np.maximum(words - k, 0) for k in range(longest))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(words), pa.array(weight), pa.array(score)], names=["doc_id", "n_features", "n_words", "weight", "score"])

    return matrix.mapInArrow(run, f"doc_id {kind}, n_features long, n_words long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Every document's doc_id, n_features, weight, score and rank: 1, 2, 3... by score among the drawn, null for the
    others. The matrices are kept under path, in the shared folder if none is given."""
    settings = settings or Settings()
    path = path or fresh_path(docs.sparkSession, "count-matrix")
    corpus = write_matrix(docs, f"{path}/corpus", settings, id_col, text_col)
    aim = write_matrix(target, f"{path}/target", settings, None, text_col)
    gain = gains(column_sums(corpus, settings.buckets), column_sums(aim, settings.buckets))
    scored = cut(weigh(corpus, gain, settings).withColumn("_able", F.col("n_words") >= settings.least_words))
    drawn = scored.where("_able").count() * settings.percent // 100
    placed = numbered(scored, [], [F.desc("_able"), F.desc("score"), F.col("doc_id").asc_nulls_first()], "_at")
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("_able") & (F.col("_at") < drawn), F.col("_at") + 1).alias("rank"))
