"""Vectors: hashed embeddings, their bytes, greedy collapse and the dense form of diverse selection."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from . import blocks

WORD_WEIGHT, GRAM_WEIGHT, PAIR_WEIGHT = 1.0, 0.3, 0.5
MAX_FEATURES = 20_000
THRESHOLD = 0.92
#: Vectors that a task makes before it gives them out.
EMBED_ROWS = 512


def fnv1a(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


def fnv1a_all(features: list[bytes]) -> np.ndarray:
    """fnv1a of every feature, a byte place of all of them at a time, longest first."""
    order = sorted(range(len(features)), key=lambda k: -len(features[k]))
    lengths = np.array([len(features[k]) for k in order])
    data = np.frombuffer(b"".join(features[k] for k in order), dtype=np.uint8)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else lengths
    h = np.full(len(features), 0xCBF29CE484222325, dtype=np.uint64)
    for place in range(int(lengths[0]) if len(lengths) else 0):
        n = int(np.searchsorted(-lengths, -place, side="left"))  # so many are longer than place
        h[:n] = (h[:n] ^ data[starts[:n] + place].astype(np.uint64)) * np.uint64(0x100000001B3)
    out = np.empty_like(h)
    out[order] = h
    return out


def tokenize(text: str) -> list[str]:
    """Lower-case words; identifiers split at case changes and at all but letters and digits."""
    out: list[str] = []
    for run in re.findall(r"[^\W_]+", text):
        start = 0
        for i in range(1, len(run)):
            camel = run[i].isupper() and not run[i - 1].isupper()
            acronym = run[i - 1].isupper() and run[i].islower() and i - start > 1 and run[i - 2 : i].isupper()
            if camel or acronym:
                at = i if camel else i - 1
                if at > start:
                    out.append(run[start:at].lower())
                    start = at
        out.append(run[start:].lower())
    return out


def embed(text: str, dims: int = 256) -> np.ndarray:
    """A signed hash of words, their 4-grams and adjacent pairs, damped by signed square roots, of length 1."""
    words = tokenize(text)
    features: list[tuple[str, float]] = []
    for w in words:
        features.append((w, WORD_WEIGHT))
        if len(w) > 4 and len(w.encode()) <= 32:
            features += [(w[i : i + 4], GRAM_WEIGHT) for i in range(len(w) - 3)]
        if len(features) >= MAX_FEATURES:
            break
    features += [(f"{a} {b}", PAIR_WEIGHT) for a, b in zip(words, words[1:], strict=False)][: max(0, MAX_FEATURES - len(features))]
    v = np.zeros(dims, dtype=np.float32)
    features = features[:MAX_FEATURES]
    if features:
        h = fnv1a_all([f.encode("utf-8", "surrogatepass") for f, _ in features])
        weight = np.array([w for _, w in features], dtype=np.float32)
        np.add.at(v, (h % np.uint64(dims)).astype(np.int64), np.where(h >> np.uint64(63), -weight, weight))
    v = np.sign(v) * np.sqrt(np.abs(v))
    norm = float(np.sqrt((v.astype(np.float64) ** 2).sum()))
    return v / np.float32(norm) if norm else v


def embedder(dims: int = 256):
    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([embed(t or "", dims).tolist() for t in texts])

    return run


def embed_batches(batches: Iterator[pa.RecordBatch], text_col: str, dims: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of at most EMBED_ROWS rows with a vector in the place of their text, so what is held is the batch that came
    and few vectors."""
    for batch in batches:
        for at in range(0, batch.num_rows, EMBED_ROWS):
            part = batch.slice(at, EMBED_ROWS)
            flat = np.concatenate([embed(t or "", dims) for t in part.column(text_col).to_pylist()])
            made = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * dims), pa.array(flat, pa.float32()))
            rest = [n for n in part.schema.names if n != text_col]
            yield pa.RecordBatch.from_arrays([*map(part.column, rest), made], names=[*rest, "v"])


def embedded(rows: DataFrame, text_col: str, dims: int = 256) -> DataFrame:
    """rows with v, their text's vector, in the place of the text."""
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != text_col]
    return rows.mapInArrow(lambda batches: embed_batches(batches, text_col, dims), ", ".join([*kinds, "v array<float>"]))


def encode(vector) -> bytes:
    return np.asarray(vector, dtype="<f4").tobytes()


def decode(data: bytes) -> np.ndarray | None:
    """A vector of little-endian 32-bit floats; None for a bad length or a number that is not finite."""
    if len(data) % 4:
        return None
    v = np.frombuffer(data, dtype="<f4")
    return v if np.isfinite(v).all() else None


def collapse(v: np.ndarray, threshold: float = THRESHOLD) -> tuple[list[int], list[int]]:
    """Greedy: each vector is compared with those kept so far; the first that is near enough takes it. Gives the kept
    rows and, for every row, the kept row it belongs to."""
    held, kept, owner = np.empty_like(v), [], []
    for i in range(len(v)):
        near = np.flatnonzero(held[: len(kept)] @ v[i] >= threshold)
        if not len(near):
            held[len(kept)] = v[i]
            kept.append(i)
        owner.append(kept[near[0]] if len(near) else i)
    return kept, owner


def collapse_redundant(vectors: DataFrame, group_col: str, order_col: str, vector_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """(grp, id, kept_id) by greedy collapse within each group. Groups of at most a block's rows are folded in one task;
    larger ones by rounds over pairs of blocks, with the same result."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        _, owner = collapse(np.stack(pdf["v"].to_numpy()).astype(np.float64), threshold)
        return pd.DataFrame({"grp": pdf["grp"], "id": pdf["id"], "kept_id": pdf["id"].to_numpy()[owner]})

    narrow = vectors.select(F.col(group_col).cast("long").alias("grp"), F.col(order_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    sizes = narrow.groupBy("grp").agg(F.count("*").alias("n"), F.count_distinct(F.size("v")).alias("kinds"), F.count("v").alias("some"))
    large = cut(sizes.where((F.col("n") > blocks.ROWS) | (F.col("kinds") > 1) | (F.col("some") < F.col("n"))).select("grp"))
    few = F.broadcast(large) if large.count() <= blocks.BROADCAST_ROWS else large
    small = narrow.join(few, "grp", "left_anti").groupBy("grp").applyInPandas(run, "grp long, id long, kept_id long")
    return small.unionByName(blocks.collapse(narrow.join(few, "grp", "left_semi"), threshold))


def diverse(v: np.ndarray, relevance: np.ndarray, k: int, weight: float = 0.25) -> list[int]:
    """Maximal marginal relevance: the most relevant first, then relevance less likeness to what is chosen; the last of
    equals wins."""
    chosen: list[int] = []
    while len(chosen) < min(k, len(v)):
        penalty = (v @ v[chosen].T).max(axis=1) if chosen else np.zeros(len(v))
        gain = (1 - weight) * relevance - weight * penalty if chosen else relevance.astype(float).copy()
        gain[chosen] = -np.inf
        chosen.append(len(gain) - 1 - int(gain[::-1].argmax()))
    return chosen
