"""Merkle manifest of a dataset: a tree of hashes a source, and one tree over the sources' roots.

A leaf is the hash of a row's columns, each with its length, so that no two rows spell alike. Leaves get their places by
row number in a sort by source and id; a level is made from the one below by dividing places by the fanout, gathering
each parent's children (at most fanout of them) in order and hashing them. Sources whose tree is done leave the loop with
their subroot; the subroots, in order of source, make the last tree and the root. A proof is what a row's holder needs to
find the root again: the siblings of every level. Levels are joined from the root down, each child taking its siblings in
front of what its parent has, so a level's join has one row for each node that it makes and the whole costs a constant
times the number of leaves, not that times the height. Verification folds a leaf with its siblings.

No source is gathered: places come from a sort by range, equal rows being parted too, and everything else is keyed by
source and place. Only counts, and the root, come to the driver.

A null column is spelt `-`, so null and empty texts differ; null sources are one source of their own, the first; null ids
come first in theirs. Rows of equal ids are ordered by leaf; equal rows are leaves of their own, with proofs of their own.
A lone leaf is its source's subroot, a lone subroot the root. An empty table has no root: the result is empty. Very long
texts are hashed whole. Further columns are in no leaf unless they are named.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, numbered

#: Columns of a row that its leaf is made of, in order.
LEAF = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 3
#: Levels on the way down that one plan makes.
TOGETHER = 4


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def spelt(value: Column) -> Column:
    """A value with its UTF-8 length in front, or `-` if it is null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(columns: dict[str, Column]) -> Column:
    return digest(*(spelt(c) for c in columns.values()))


@dataclass
class Tree:
    """levels[l] holds the nodes made at step l from step l - 1: _g, idx, kids (their hashes in order), hash and size (how
    many nodes the group has at that step). tops: the root of every group, with the step it was done at."""

    levels: list[DataFrame]
    tops: DataFrame


def grow(nodes: DataFrame, fanout: int, tallest: int, carried: tuple[str, ...] = ()) -> Tree:
    """The trees of all groups of nodes (_g, idx, hash, size and the carried columns): tallest is the size of the largest.
    At the first step kids also keep the carried columns."""
    levels, every = [], nodes.where("size = 1").select("_g", "hash", F.lit(0).alias("step"))
    now, left = nodes, tallest
    while left > 1:
        kid = F.struct("idx", "hash", *(() if levels else carried))
        parents = now.where("size > 1").groupBy("_g", F.floor(F.col("idx") / fanout).alias("idx"), F.ceil(F.col("size") / fanout).alias("size")).agg(F.array_sort(F.collect_list(kid)).alias("kids"))
        now, left = cut(parents.withColumn("hash", digest(hashes(F.col("kids"))))), -(-left // fanout)
        levels.append(now)
        every = every.unionByName(now.where("size = 1").select("_g", "hash", F.lit(len(levels)).alias("step")))
    return Tree(levels, cut(every))


def hashes(kids: Column) -> Column:
    return F.array_join(F.transform(kids, lambda x: x["hash"]), "")


def descend(tree: Tree, tops: DataFrame, first: dict[str, str]) -> DataFrame:
    """From tops (_g, step, subroot, path) down to the leaves that tree was grown from: _g, subroot, path (the left and
    right siblings of every level, lowest first) and, of a leaf's kid, the columns that first names."""
    above = None
    for step in range(len(tree.levels), 0, -1):
        paths = tops.where(F.col("step") == step).select("_g", F.lit(0).cast("long").alias("idx"), "subroot", "path")
        paths = paths if above is None else paths.unionByName(above)
        told = tree.levels[step - 1].select("_g", "idx", "kids").join(paths, ["_g", "idx"]).select("_g", "subroot", "path", "kids", F.posexplode("kids").alias("_k", "_kid"))
        left, right = hashes(F.slice("kids", F.lit(1), F.col("_k"))), hashes(F.slice("kids", F.col("_k") + 2, F.size("kids")))
        kept = [F.col(f"_kid.{k}").alias(name) for k, name in first.items()] if step == 1 else [F.col("_kid.idx").alias("idx")]
        above = told.select("_g", *kept, "subroot", F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), "path").alias("path"))
        if step > 1 and step % TOGETHER == 1:
            above = cut(above)
    return above


def proof(path: Column) -> Column:
    """The hash of all siblings of a path, lowest level first, from left to right."""
    return digest(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda at, x: digest(x["left"], at, x["right"]))


def manifest(docs: DataFrame, changed: dict[str, Column] | None = None, columns: tuple[str, ...] = LEAF, group: str = "source", order: str = "doc_id", fanout: int = FANOUT) -> DataFrame:
    """A row for each of docs: order and group, leaf, subroot, root, path, proof_sha256, folded_root and verified. changed
    names expressions that stand for columns in the copy that is to be verified (none: the rows as they are): the fold
    begins with that copy's leaf and takes the manifest's siblings, and is verified if it ends at the root."""
    own, changed = {c: F.col(f"`{c}`") for c in columns}, changed or {}
    differs = F.lit(False)
    for c, new in changed.items():
        differs = differs | ~own[c].eqNullSafe(new)
    said = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))  # in the order of sources, null first
    leaves = docs.select(said.alias("_g"), F.col(f"`{order}`").alias("_o"), leaf_of(own).alias("hash"), F.when(differs, leaf_of(own | changed)).alias("_other"))
    leaves = cut(numbered(cut(leaves), ["_g"], [F.col("_o").asc_nulls_first(), F.col("hash")], "idx", "size"))
    tree = grow(leaves, fanout, leaves.agg(F.max("size")).first()[0] or 0, ("_o", "_other"))
    sources = cut(numbered(tree.tops, [], [F.col("_g").asc()], "idx", "size"))
    named = sources.select(F.lit(0).alias("_g"), "idx", "hash", "size", F.col("_g").alias("_source"), "step")
    over = grow(named, fanout, sources.count(), ("_source", "step"))
    top = over.tops.first()
    none = F.array().cast("array<struct<left:string,right:string>>").alias("path")
    paths = sources.select("_g", "step", F.col("hash").alias("subroot"), none)
    if over.levels:
        down = descend(over, over.tops.select("_g", "step", F.lit("").alias("subroot"), none), {"_source": "_source", "hash": "_hash", "step": "step"})
        paths = cut(down.select(F.col("_source").alias("_g"), "step", F.col("_hash").alias("subroot"), "path"))
    rows = leaves.where("size = 1").select("_g", "_o", "hash", "_other").join(paths.select("_g", "subroot", "path"), "_g")
    if tree.levels:
        rows = rows.unionByName(descend(tree, paths, {"_o": "_o", "hash": "hash", "_other": "_other"}))
    back = folded(F.coalesce("_other", "hash"), F.col("path"))
    source = F.when(F.col("_g") != "", F.substring("_g", 2, 2**31 - 1)).alias(group)
    told = rows.select(F.col("_o").alias(order), source, F.col("hash").alias("leaf"), "subroot", F.lit(top["hash"] if top else None).cast("string").alias("root"), "path", proof(F.col("path")).alias("proof_sha256"), back.alias("folded_root"))
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))
