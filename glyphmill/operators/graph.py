"""Relationship graphs as edge frames (src, dst, kind)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut


def degree(edges: DataFrame) -> DataFrame:
    """(node, dependents): distinct neighbours that depend on a node."""
    return edges.select("src", "dst").distinct().groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("dependents"))


def most_depended_on(edges: DataFrame, n: int) -> DataFrame:
    return degree(edges).orderBy(F.desc("dependents"), "node").limit(n)


def counts(edges: DataFrame) -> DataFrame:
    """Nodes are distinct, edges are rows."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().agg(F.count("*").alias("nodes"))
    return nodes.join(edges.agg(F.count("*").alias("edges")), F.lit(True))


def neighbours(edges: DataFrame, node) -> DataFrame:
    """(direction, node) of one node."""
    out = edges.where(F.col("src") == F.lit(node)).select(F.lit("depends_on").alias("direction"), F.col("dst").alias("node"))
    return out.unionByName(edges.where(F.col("dst") == F.lit(node)).select(F.lit("dependent").alias("direction"), F.col("src").alias("node"))).distinct()


def reachable(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(node, depth) of what start's nodes lead to, at the least depth; cycles end. Every hop is cut, and the walk stops
    when a hop finds nothing new."""
    seen = start.select("node", F.lit(0).alias("depth")).distinct()
    step, frontier = edges.select(F.col("src").alias("node"), "dst").distinct(), seen
    for d in range(1, depth + 1):
        frontier = frontier.select("node").join(step, "node").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").select("node", F.lit(d).alias("depth"))
        frontier = cut(frontier)
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
    return seen.join(start, "node", "left_anti")


def neighbour_pairs(edges: DataFrame) -> DataFrame:
    """(node, neighbour) in either direction, once."""
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("neighbour")).union(edges.select("dst", "src")).distinct()


def nodes(edges: DataFrame) -> DataFrame:
    """Every node that an edge touches."""
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def of_files(relationships: DataFrame, files: DataFrame, resolved: bool = False) -> DataFrame:
    """relationships (file_id and more) with their files' paths; resolved: those alone whose target is a known file."""
    rows = relationships.where(F.col("target_path").isNotNull()) if resolved else relationships
    return rows.join(files, "file_id")
