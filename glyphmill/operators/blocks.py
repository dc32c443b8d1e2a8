"""Vectors in blocks: nearest neighbours, greedy collapse and diverse selection over sets of any size.

Rows are packed into blocks of at most ROWS vectors with a centre and a radius. No product of a vector of one block with one
of another exceeds what their centres and radii allow, so a pair of blocks that cannot reach a threshold is left out without
a look at its vectors, and exactly so. What pairs of blocks find is cut down where it is found: k best a query, the least
neighbour a row. No group meets in one task, and nothing of the rows comes to the driver but a bounded number of pivots.

Null vectors and those of another length than most are passed over in searches; a vector of zeros is near nothing in a
collapse. Groups and ids are whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut

ROWS = 1024
#: Vectors that rows are sorted by before they are packed, so that a block's vectors lie close together.
PIVOTS = 64
#: Bytes of packed queries that are sent to every task; more of them meet the vectors by a product of partitions.
BROADCAST_BYTES = 64 << 20
#: Rows of one group's or query's state (a bounded few columns each) that are sent to every task; more are joined by shuffle.
BROADCAST_ROWS = 50_000
SLACK = 1e-9
_BLOCK = "grp long, block long, lo long, hi long, ids array<long>, told array<double>, m binary, centre array<double>, radius double, norm double"


def pack(rows: DataFrame, ordered: bool = True, pivots: np.ndarray | None = None) -> DataFrame:
    """rows: grp, id, told (a number that goes with each), v. A row for each block of one grp: ids, told, m (the vectors as
    doubles), centre, radius and the centre's norm. ordered: blocks hold neighbours in order of id, from a sort by range; else
    rows stay where they are, and a task's rows are dealt to their nearest pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        made = TaskContext.get().partitionId() << 32

        def out(key: tuple) -> pa.RecordBatch:
            nonlocal made
            ids, told, vs = zip(*held.pop(key), strict=True)
            m = np.stack(vs)
            centre = m.mean(axis=0)
            made += 1
            values = ([key[0]], [made], [min(ids)], [max(ids)], [list(ids)], [list(told)], [m.tobytes()], [centre.tolist()], [float(np.sqrt(((m - centre) ** 2).sum(axis=1).max()))], [float(np.sqrt((centre**2).sum()))])
            kinds = (*[pa.int64()] * 4, pa.list_(pa.int64()), pa.list_(pa.float64()), pa.binary(), pa.list_(pa.float64()), pa.float64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=[x.split()[0] for x in _BLOCK.split(", ")])

        last = None
        for batch in batches:
            for grp, i, told, v in zip(*(batch.column(c).to_pylist() for c in ("grp", "id", "told", "v")), strict=True):
                x = np.array(v, dtype=np.float64)
                cell = int(((pivots - x) ** 2).sum(axis=1).argmin()) if pivots is not None and pivots.shape[1:] == x.shape else 0
                key = (grp, cell, len(x))
                if ordered and last is not None and key != last:
                    yield out(last)
                held.setdefault(key, []).append((i, told, x))
                last = key
                if len(held[key]) >= ROWS:
                    yield out(key)
                    last = None
        for key in list(held):
            yield out(key)

    kept = rows.select(F.col("grp").cast("long").alias("grp"), F.col("id").cast("long").alias("id"), F.col("told").cast("double").alias("told"), "v").where("v IS NOT NULL AND id IS NOT NULL")
    if ordered:
        kept = kept.withColumn("_d", F.size("v")).repartitionByRange("grp", "_d", "id").sortWithinPartitions("grp", "_d", "id").drop("_d")
    return cut(kept.mapInArrow(run, _BLOCK))


def most(a: str, b: str) -> Column:
    """What no product of a vector of block a with one of block b exceeds."""
    col = lambda t, c: F.col(f"{t}.{c}")
    between = F.aggregate(F.zip_with(col(a, "centre"), col(b, "centre"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return between + col(a, "norm") * col(b, "radius") + col(b, "norm") * col(a, "radius") + col(a, "radius") * col(b, "radius")


def reach(a: str, b: str, threshold: float) -> Column:
    """Blocks of vectors of the same length whose products may reach threshold."""
    return (F.size(F.col(f"{a}.centre")) == F.size(F.col(f"{b}.centre"))) & (most(a, b) >= F.lit(threshold - SLACK))


def _matrix(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.float64).reshape(n, -1)


def pivots_of(vectors: DataFrame, n: int = PIVOTS) -> np.ndarray | None:
    """n vectors of least hash, of the length of the first; this many come to the driver."""
    found = [r["v"] for r in vectors.where("v IS NOT NULL").orderBy(F.xxhash64("v", F.lit("pivot"))).limit(n).collect()]
    same = [v for v in found if len(v) == len(found[0])]
    return np.array(same, dtype=np.float64) if same else None


def nearest(vectors: DataFrame, queries: DataFrame, floor: float, k: int, id_col: str = "vec_id", vector_col: str = "embedding", query_id_col: str | None = None, query_vector_col: str | None = None) -> DataFrame:
    """(query_id, id, similarity, rank): of each query the k nearest at floor or above, of equals those of least id. A query
    without any has no row. Queries and vectors are packed where they are; each pair of blocks that may reach the floor is
    multiplied, and a task keeps its k best of each query before they are shuffled."""
    rows = lambda df, i, v: df.select(F.lit(0).alias("grp"), F.col(i).alias("id"), F.lit(0.0).alias("told"), F.col(v).alias("v"))
    there = rows(vectors, id_col, vector_col)
    near = pivots_of(there)
    v = pack(there, False, near).alias("v")
    q = pack(rows(queries, query_id_col or id_col, query_vector_col or vector_col), False, near)
    size = q.agg(F.coalesce(F.sum(F.octet_length("m")), F.lit(0))).first()[0]
    pairs = v.join((F.broadcast(q) if size <= BROADCAST_BYTES else q).alias("q"), reach("q", "v", floor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for qi, qm, vi, vm in zip(*(batch.column(c).to_pylist() for c in ("qi", "qm", "vi", "vm")), strict=True):
                ids = np.array(vi)
                sims = np.clip(_matrix(qm, len(qi)) @ _matrix(vm, len(vi)).T, -1, 1)
                for r in np.flatnonzero((sims >= floor).any(axis=1)):
                    at = np.flatnonzero(sims[r] >= floor)
                    s, i = np.round(sims[r, at], 6), ids[at]
                    if qi[r] in best:
                        s, i = np.concatenate([best[qi[r]][0], s]), np.concatenate([best[qi[r]][1], i])
                    order = np.lexsort((i, -s))[:k]
                    best[qi[r]] = (s[order], i[order])
        for query, (s, i) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([query] * len(s), pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "id", "similarity"])

    found = pairs.select(F.col("q.ids").alias("qi"), F.col("q.m").alias("qm"), F.col("v.ids").alias("vi"), F.col("v.m").alias("vm")).mapInArrow(run, "query_id long, id long, similarity double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _least_near(a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """(grp, id, near): for each row of b's blocks the least id below its own of a row of a's blocks of its grp that is near
    it. Pairs of blocks are told by their centres alone, then dealt out with their vectors: a pair is a task's unit of work."""
    pairs = a.drop("m", "ids", "told").alias("a").join(b.drop("m", "ids", "told").alias("b"), (F.col("a.grp") == F.col("b.grp")) & (F.col("a.lo") < F.col("b.hi")) & reach("a", "b", threshold))
    told = cut(pairs.select(F.col("a.block").alias("a_block"), F.col("b.block").alias("b_block")).repartition("a_block", "b_block"))
    left, right = a.select(F.col("block").alias("a_block"), F.col("ids").alias("ai"), F.col("m").alias("am")), b.select("grp", F.col("block").alias("b_block"), F.col("ids").alias("bi"), F.col("m").alias("bm"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for grp, ai, am, bi, bm in zip(*(batch.column(c).to_pylist() for c in ("grp", "ai", "am", "bi", "bm")), strict=True):
                earlier, own = np.array(ai), np.array(bi)
                hit = (_matrix(bm, len(bi)) @ _matrix(am, len(ai)).T >= threshold) & (earlier[None, :] < own[:, None])
                least = np.where(hit, earlier[None, :], np.iinfo(np.int64).max).min(axis=1)
                at = np.flatnonzero(hit.any(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array([grp] * len(at), pa.int64()), pa.array(own[at], pa.int64()), pa.array(least[at], pa.int64())], names=["grp", "id", "near"])

    met = told.join(left, "a_block").join(right, "b_block").select("grp", "ai", "am", "bi", "bm")
    return met.mapInArrow(run, "grp long, id long, near long").groupBy("grp", "id").agg(F.min("near").alias("near"))


def collapse(rows: DataFrame, threshold: float) -> DataFrame:
    """(grp, id, kept_id) for rows (grp, id, v), ids in order of rank: a row stays if no row of its group that stays before it
    is near it, else it belongs to the first such. Round by round: a row that no undecided row before it is near stays, and
    what is near one that stays is decided too; rounds are as many as the longest chain of rows that wait for each other,
    which is few, as a group of copies is decided by its first. In the end each decided row finds the first that took it."""
    given = cut(rows.select(F.col("grp").cast("long").alias("grp"), F.col("id").cast("long").alias("id"), "v"))
    packable = lambda df: pack(df.select("grp", "id", F.lit(0.0).alias("told"), "v"))
    undecided, stays = given.where("v IS NOT NULL"), []
    while not undecided.isEmpty():
        blocks = packable(undecided)
        waits = _least_near(blocks, blocks, threshold)
        new = cut(undecided.join(waits, ["grp", "id"], "left_anti"))
        taken = _least_near(packable(new), blocks, threshold)
        undecided = cut(undecided.join(new, ["grp", "id"], "left_anti").join(taken, ["grp", "id"], "left_anti"))
        stays.append(new)
    none = given.where("v IS NULL").select("grp", "id", F.col("id").alias("kept_id"))
    if not stays:
        return none
    kept = stays[0]
    for s in stays[1:]:
        kept = kept.unionByName(s)
    kept = cut(kept)
    rest = given.where("v IS NOT NULL").join(kept, ["grp", "id"], "left_anti")
    owners = _least_near(packable(kept), packable(rest), threshold).withColumnRenamed("near", "kept_id")
    return kept.select("grp", "id", F.col("id").alias("kept_id")).unionByName(owners).unionByName(none)


def diverse(candidates: DataFrame, k: int, weight: float = 0.25) -> DataFrame:
    """(query_id, id, position) for candidates (query_id, id, relevance, v): the most relevant first, then those of the best
    relevance less likeness to what is chosen, k in all; of equals the one of greatest id. A round sends each block what is
    chosen for its query and gets one candidate back, so k rows a block move and never the set."""
    blocks = pack(candidates.select(F.col("query_id").alias("grp"), "id", F.col("relevance").alias("told"), "v"))
    shape = "grp long, gain double, id long, v array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            for grp, ids, told, m, held, taken in zip(*(batch.column(c).to_pylist() for c in ("grp", "ids", "told", "m", "held", "taken")), strict=True):
                own, relevance, rows = np.array(ids), np.array(told, dtype=np.float64), _matrix(m, len(ids))
                gain = (1 - weight) * relevance - weight * (rows @ np.array(held).T).max(axis=1) if held else relevance.copy()
                gain[np.isin(own, taken or [])] = -np.inf
                best = np.lexsort((own, gain))[-1]
                if np.isfinite(gain[best]):
                    found.append((grp, float(gain[best]), int(own[best]), rows[best].tolist()))
            columns = list(zip(*found, strict=True)) if found else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.float64())), strict=True)], names=["grp", "gain", "id", "v"])

    chosen = None
    for position in range(k):
        if chosen is None:
            met = blocks.select("grp", "ids", "told", "m", F.lit(None).cast("array<array<double>>").alias("held"), F.lit(None).cast("array<long>").alias("taken"))
        else:
            so_far = chosen.groupBy("grp").agg(F.collect_list("v").alias("held"), F.collect_list("id").alias("taken"))
            few = F.broadcast(so_far) if chosen.count() <= BROADCAST_ROWS else so_far
            met = blocks.select("grp", "ids", "told", "m").join(few, "grp")
        best = met.mapInArrow(run, shape).groupBy("grp").agg(F.max_by(F.struct("id", "v"), F.struct("gain", "id")).alias("x"))
        new = cut(best.select("grp", "x.id", "x.v", F.lit(position).cast("long").alias("position")))
        if new.isEmpty():
            break
        chosen = cut(chosen.unionByName(new)) if chosen is not None else new
    if chosen is None:
        chosen = blocks.where("false").select("grp", F.col("lo").alias("id"), F.col("centre").alias("v"), F.lit(0).cast("long").alias("position"))
    return chosen.select(F.col("grp").alias("query_id"), "id", "position")
