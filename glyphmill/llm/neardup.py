"""Near duplicates by MinHash: many universal hash minima with banding, signature verification, an exact check on full
shingle sets, and connected components by alternating large-star and small-star.

Texts with equal shingle sets become one node first, so copies cost one row each. Nodes that share a band's bucket are
candidates. All pairs of a bucket are never made: first each member is compared with its bucket's hub, and links are
joined to components. Members that still share a bucket but not a component go into blocks of bounded size, whose full
sets a task compares at once; it gives out only the links that join its components, so nothing of the size of the pairs
is written. Buckets that overlap are compared as one area where that costs no more than bucket by bucket, so a large
group is sent once for each pair of blocks, not once for each of its bands. No link between different texts is lost but
by the banding's chance (under 1e-7 for a link at the threshold with the defaults) and, against hubs, by the
signature's margin (4.5 standard deviations); area comparisons are exact.

A null or empty text has no shingles and is linked with nothing; its component is its own id. Rows that share an id but
not their texts are judged each by its own text. Rows with a null id take part, and their component is null if it has no other id.
Very long texts are whole sets like others and fill blocks of their own. Ties do not occur: hubs and components are least
keys. Repeated rows are repeated in the result. An empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget, slices, with_facts

U = np.uint64
#: Words whose hashes a worker keeps.
WORDS_KEPT = 400_000
#: Nodes of a block, and bytes of their sets, that a task compares with another block's.
BLOCK, BLOCK_BYTES = 2048, 16 << 20
#: Columns of a task's matrix of shared shingles, and members above which a shingle is counted by it instead of in pairs.
COLUMNS, OFTEN = 1024, 16
#: Edges of a partition while components are found.
EDGES = 250_000
#: An area is compared as one if its pairs are at most so many times those of its buckets.
DENSE = 2
#: Up to so many candidate keys (8 bytes each) are sent to every executor; more are joined by shuffle.
BROADCAST_IDS = 1_000_000

_HASHES: dict[bytes, int] = {}


@dataclass(frozen=True)
class Settings:
    """words in a shingle; bands of rows minima; links at a similarity of percent / 100 or more."""

    words: int = 5
    percent: int = 80
    bands: int = 60
    rows: int = 6
    seed: int = 7

    @property
    def minima(self) -> int:
        return self.bands * self.rows

    @property
    def least_equal(self) -> float:
        """Share of equal signature bytes below which a pair can't be a link, but for 4.5 standard deviations."""
        j = self.percent / 100
        return j - 4.5 * (j * (1 - j) / self.minima) ** 0.5

    def functions(self) -> tuple[np.ndarray, np.ndarray]:
        """Multipliers (odd) and addends of the hash functions x -> a * x + b modulo 2 ** 32."""
        rng = np.random.default_rng(self.seed)
        return (rng.integers(0, 1 << 31, (self.minima, 1), dtype=np.uint32) << np.uint32(1)) | np.uint32(1), rng.integers(0, 1 << 32, (self.minima, 1), dtype=np.uint32)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def shingles(text: str | None, k: int) -> np.ndarray:
    """The distinct k-word shingles of text as sorted 64-bit hashes. Words are parted by ASCII white space, A-Z lower-cased."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, dtype=U)
    if len(_HASHES) > WORDS_KEPT:
        _HASHES.clear()
    for w in set(words).difference(_HASHES):
        _HASHES[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(_HASHES.__getitem__, words), dtype=U, count=len(words))
    n = len(words) - k + 1
    if n < 1:
        return np.array([xxhash.xxh3_64_intdigest(b"short " + h.tobytes())], dtype=U)
    x = h[:n].copy()
    for i in range(1, k):
        x *= U(0x9E3779B97F4A7C15)
        x += h[i : i + n]
    return np.unique(mixed(x))


class Signer:
    def __init__(self, settings: Settings):
        self.s = settings
        self.a, self.b = settings.functions()
        self.buffer = np.empty((settings.minima, 1024), dtype=np.uint32)

    def minima(self, shingle_set: np.ndarray) -> np.ndarray:
        x = ((shingle_set >> U(32)) ^ shingle_set).astype(np.uint32)
        low = np.full(self.s.minima, 0xFFFFFFFF, dtype=np.uint32)
        for at in range(0, len(x), 1024):
            part = x[at : at + 1024]
            made = self.buffer[:, : len(part)]
            np.multiply(self.a, part, out=made)
            made += self.b
            np.minimum(low, made.min(axis=1), out=low)
        return low

    def signed(self, shingle_set: np.ndarray) -> bytes:
        """A byte of every minimum. A band's rows together are its bucket, so that buckets need no bytes of their own."""
        return ((self.minima(shingle_set) * np.uint32(2654435769)) >> np.uint32(24)).astype(np.uint8).tobytes()


def set_key(shingle_set: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingle_set.tobytes(), digest_size=16).digest() if len(shingle_set) else None


def digests(docs: DataFrame, settings: Settings, id_col: str, text_col: str) -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, set_key (of the whole set), sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()  # tokenizers and models of other stages
        signer = Signer(settings)
        for rows in slices(batches):
            n, keys, sigs = [], [], []
            for text in rows["text"]:
                s = shingles(text, settings.words)
                n.append(len(s))
                keys.append(set_key(s))
                sigs.append(signer.signed(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows["doc_id"], pa.int64()), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())],
                names=["doc_id", "n_shingles", "set_key", "sig"],
            )
        _HASHES.clear()  # workers go on to other stages
        forget()

    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, sig binary")


def buckets(nodes: DataFrame, settings: Settings) -> DataFrame:
    """(node, bucket) for every band: the hash of the band's number and its rows' bytes."""
    r = settings.rows
    each = F.transform(F.sequence(F.lit(0), F.lit(settings.bands - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sig"), i * r + 1, F.lit(r))))
    return nodes.select("node", F.explode(each).alias("bucket"))


def full_sets(docs: DataFrame, wanted: DataFrame, settings: Settings, id_col: str, text_col: str) -> DataFrame:
    """(node, n, shingles): the whole shingle set of each wanted (doc_id, node, n_shingles), one row a node. Texts are
    read again, as few of them are candidates; doc_id tells the rows to read, and the set made there must be the node's."""
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    few = wanted.count() <= BROADCAST_IDS
    ids = wanted.select("doc_id").distinct()
    named = narrow.join(F.broadcast(ids) if few else ids, narrow["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            sets = [shingles(t, settings.words) for t in rows["text"]]
            yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["set_key", "shingles"])
        _HASHES.clear()

    made = named.mapInArrow(run, "set_key binary, shingles binary").select(node_of("set_key").alias("node"), "shingles")
    nodes = wanted.select("node", F.col("n_shingles").alias("n"))
    # repeated rows and copies among the ids read make the same set again
    return made.join(F.broadcast(nodes) if few else nodes, "node").dropDuplicates(["node"]).select("node", "n", "shingles")


def node_of(key: str):
    """The 64-bit node of a set: by its content alone, so that equal sets are one node whatever their ids."""
    return F.xxhash64(key)


def close(pairs: DataFrame, nodes: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (a, b) whose signatures agree enough."""
    least = settings.least_equal

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
                fit = pa.array((one == two).mean(axis=1) >= least)
                yield batch.select(["a", "b"]).filter(fit)

    sig = nodes.select("node", "sig")
    both = pairs.join(sig.withColumnsRenamed({"node": "a", "sig": "sa"}), "a").join(sig.withColumnsRenamed({"node": "b", "sig": "sb"}), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    percent = settings.percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fit = []
            for x, y in zip(batch.column("xa").to_pylist(), batch.column("xb").to_pylist(), strict=True):
                one, two = np.frombuffer(x, dtype=U), np.frombuffer(y, dtype=U)
                both = len(np.intersect1d(one, two, assume_unique=True))
                fit.append(100 * both >= percent * (len(one) + len(two) - both))
            yield batch.select(["a", "b"]).filter(pa.array(fit, pa.bool_()))

    held = sets.select("node", "shingles")
    both = pairs.join(held.withColumnsRenamed({"node": "a", "shingles": "xa"}), "a").join(held.withColumnsRenamed({"node": "b", "shingles": "xb"}), "b")
    return both.select("a", "b", "xa", "xb").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the least node that is reachable over edges (a, b), for every node of an edge, by alternating
    large-star and small-star until nothing changes. Every round is cut. Partitions are as many as the edges need, as
    rounds have many exchanges, and each leaves a file of every map task."""
    held = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        mark = held.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        parts = -(-mark[0] // EDGES)
        held = held.coalesce(parts)
        near = held.unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(parts).distinct().coalesce(parts)
        low = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        held = cut(small.coalesce(parts).distinct().coalesce(parts))
    return held.select(F.col("u").alias("node"), F.col("v").alias("comp"))


def shared_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many elements two sets left[i] and right[j] share, exactly (for a set with itself, no count is right). Elements of few members are counted in pairs of
    members, those of many by products of 0/1 matrices of bounded width; elements of one member are left out."""
    member = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, at, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(at, kind="stable")
    at, member = at[order], member[order]
    often = often[at]
    row, column = np.full(len(sets), -1), np.full(len(sets), -1)
    row[left], column[right] = np.arange(len(left)), np.arange(len(right))
    out = np.zeros(len(left) * len(right), dtype=np.int64)
    rare = (often > 1) & (often <= OFTEN)
    e, m = at[rare], member[rare]
    for step in range(1, OFTEN):
        same = np.flatnonzero(e[step:] == e[:-step]) if len(e) > step else e[:0]
        if not len(same):
            break
        for x, y in ((m[same], m[same + step]), (m[same + step], m[same])):
            fit = (row[x] >= 0) & (column[y] >= 0)
            out += np.bincount(row[x[fit]] * len(right) + column[y[fit]], minlength=len(out))
    out = out.reshape(len(left), len(right)).astype(np.float64)
    e, m = at[often > OFTEN], member[often > OFTEN]
    if len(e):
        e = np.unique(e, return_inverse=True)[1]
        for low in range(0, int(e[-1]) + 1, COLUMNS):
            part = slice(*np.searchsorted(e, (low, low + COLUMNS)))
            held = np.zeros((len(sets), COLUMNS), dtype=np.float32)
            held[m[part], e[part] - low] = 1
            out += held[left] @ held[right].T
    return out


def joining(node: np.ndarray, comp: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Of the links between left and right members of different components, as many as join the components: a forest."""
    n = np.array([len(s) for s in sets])
    found: list[np.ndarray] = []
    strip = max(1, (1 << 21) // max(1, len(right)))
    for low in range(0, len(left), strip):
        rows = left[low : low + strip]
        both = shared_counts(sets, rows, right)
        fit = (100 * both >= percent * (n[rows][:, None] + n[right][None, :] - both)) & (comp[rows][:, None] != comp[right][None, :])
        i, j = np.nonzero(fit)
        pairs = np.stack([rows[i], right[j]], axis=1)
        ends = np.sort(comp[pairs], axis=1)
        found.append(pairs[np.unique(ends, axis=0, return_index=True)[1]])
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while top.get(x, x) != x:
            top[x] = top.get(top[x], top[x])
            x = top[x]
        return x

    out = []
    for a, b in np.concatenate(found).tolist() if found else ():
        x, y = find(int(comp[a])), find(int(comp[b]))
        if x != y:
            top[max(x, y)] = min(x, y)
            out.append((int(node[a]), int(node[b])))
    return out


def areas(open_: DataFrame) -> DataFrame:
    """(kind, key, node, comp) from open_ (bucket, hub, node, comp), the members of buckets of several components: an
    area of overlapping buckets where its pairs are at most DENSE times its buckets' pairs, else each bucket."""
    group = components(open_.select(F.col("node").alias("a"), F.col("hub").alias("b")))
    area = open_.select("node").unionByName(open_.select(F.col("hub").alias("node"))).distinct().join(group, "node", "left").select("node", F.coalesce("comp", "node").alias("area"))
    area = cut(area)
    size = area.groupBy("area").agg(F.count("*").alias("m"))
    square = lambda c: F.col(c).cast("double") * F.col(c)
    pairs = open_.groupBy("bucket", "hub").agg(F.count("*").alias("n")).join(area.withColumnRenamed("node", "hub"), "hub").groupBy("area").agg(F.sum(square("n")).alias("pairs"))
    dense = cut(size.join(pairs, "area").select("area", "m", (square("m") <= DENSE * F.col("pairs")).alias("dense")))
    placed = with_facts(open_.join(area, "node"), dense, "area", "m")
    key = F.when(F.col("dense"), F.col("area")).otherwise(F.col("bucket"))
    return placed.select(F.when(F.col("dense"), 0).otherwise(1).alias("kind"), key.alias("key"), "node", "comp").distinct()


def block_links(placed: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """Links (a, b) that join the components of each area's members (kind, key, node, comp). Members are dealt into
    blocks of bounded size; a task compares two blocks on their full sets."""
    percent = settings.percent
    rows = cut(placed.join(sets.select("node", "n"), "node"))
    sized = rows.groupBy("kind", "key").agg(F.count("*").alias("m"), F.sum("n").alias("s"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("s") * 8 / BLOCK_BYTES)).cast("int")
    dealt = rows.join(sized.select("kind", "key", blocks.alias("blocks")), ["kind", "key"]).withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    spread = dealt.select("kind", "key", "node", "comp", "block", other).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    wide = spread.join(sets.select("node", "shingles"), "node").select("kind", "key", "i", "j", "node", "comp", "block", "shingles")

    def run(key, table):
        _, _, i, j = (k.as_py() for k in key)
        node, comp, block = (table.column(c).to_numpy() for c in ("node", "comp", "block"))
        made = [np.frombuffer(x, dtype=U) for x in table.column("shingles").to_pylist()]
        pairs = joining(node, comp, made, np.flatnonzero(block == i), np.flatnonzero(block == j), percent)
        return pa.table({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())})

    return wide.groupBy("kind", "key", "i", "j").applyInArrow(run, "a long, b long")


def linked(docs: DataFrame, nodes: DataFrame, settings: Settings, id_col: str, text_col: str) -> DataFrame | None:
    """(node, comp) of all nodes (node, n_shingles, sig, doc_id) with a link, or None if no two are linked."""
    all_buckets = buckets(nodes, settings)
    hubs = all_buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("hub")).where("n > 1").select("bucket", "hub")
    members = cut(all_buckets.join(hubs, "bucket").select("bucket", "hub", "node"))
    if members.isEmpty():
        return None
    wanted = cut(members.select("node").distinct().join(nodes.select("node", "doc_id", "n_shingles"), "node"))
    sets = cut(full_sets(docs, wanted, settings, id_col, text_col))
    pairs = members.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    first = components(confirmed(cut(close(pairs, nodes, settings)), sets, settings))
    at = members.join(first, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed_buckets = at.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("bucket")
    open_ = cut(at.join(mixed_buckets, "bucket"))
    if open_.isEmpty():
        return first
    found = cut(block_links(areas(open_), sets, settings))
    if found.isEmpty():
        return first
    # links of nodes become links of components, whose own components are put in their place
    end = lambda c: found.join(first.select(F.col("node").alias(c), F.col("comp").alias(f"{c}_")), c, "left").select("a", "b", F.coalesce(f"{c}_", c).alias(f"{c}_"))
    above = components(end("a").join(end("b"), ["a", "b"]).select(F.col("a_").alias("a"), F.col("b_").alias("b")).distinct())
    lower = first.join(above.select(F.col("node").alias("comp"), F.col("comp").alias("top")), "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))
    return lower.unionByName(above.join(first, "node", "left_anti"))


def near_duplicates(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B008
    """A row for each row of docs: doc_id, n_shingles, component_id (the least id reachable over links), kept."""
    digest = cut(digests(docs, settings, id_col, text_col))
    full = digest.where("n_shingles > 0").withColumn("node", node_of("set_key"))
    nodes = cut(full.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig")))
    comps = linked(docs, nodes, settings, id_col, text_col)
    placed = nodes.select("node", "doc_id", "copies")
    placed = placed.withColumn("comp", F.col("node")) if comps is None else placed.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = placed.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    group = cut(placed.join(least, "comp").select("node", "component_id", "copies"))
    rows = digest.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, node_of("set_key")).alias("node"))
    told = with_facts(rows, group, "node", "copies").withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return told.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("doc_id").isNull() & F.col("component_id").isNull()).alias("kept"))
