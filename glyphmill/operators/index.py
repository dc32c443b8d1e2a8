"""Incremental indexing: what changed between a stored state and a scan, and how imports resolve."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .vectors import embedder

DECISIONS = ("unchanged", "touched", "parsed", "removed")


def diff(stored: DataFrame, scanned: DataFrame) -> DataFrame:
    """(root, path, decision): unchanged if size and time agree, touched if only the content does, parsed if it is new
    or changed, removed if it is gone. One full join decides all four."""
    s = stored.select("root", "path", F.col("size").alias("s_size"), F.col("mtime_ms").alias("s_mtime"), F.col("content_hash").alias("s_hash"))
    w = scanned.select("root", "path", F.col("size").alias("w_size"), F.col("mtime_ms").alias("w_mtime"), F.col("content_hash").alias("w_hash"))
    decision = (
        F.when(F.col("w_hash").isNull(), "removed")
        .when(F.col("s_hash").isNull(), "parsed")
        .when((F.col("s_size") == F.col("w_size")) & (F.col("s_mtime") == F.col("w_mtime")), "unchanged")
        .when(F.col("s_hash") == F.col("w_hash"), "touched")
        .otherwise("parsed")
    )
    return s.join(w, ["root", "path"], "full_outer").select("root", "path", decision.alias("decision"))


def report(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("root").agg(*[F.count_if(F.col("decision") == d).alias(d) for d in DECISIONS])


def as_metric(reports: DataFrame) -> DataFrame:
    """An index pass as a metric event: files that need no work are hits."""
    return reports.select("root", F.lit("index").alias("operation"), F.col("unchanged").alias("hits"), (F.col("parsed") + F.col("touched") + F.col("unchanged")).alias("lookups"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports: (root, path, target, candidates in order). Each gets the first candidate that is a known file."""
    tried = imports.select("root", "path", "target", F.posexplode("candidates").alias("rank", "candidate"))
    known = files.select("root", F.col("path").alias("candidate")).distinct()
    found = tried.join(known, ["root", "candidate"]).groupBy("root", "path", "target").agg(F.min_by("candidate", "rank").alias("target_path"))
    return imports.select("root", "path", "target").distinct().join(found, ["root", "path", "target"], "left")


def unresolved(resolved: DataFrame) -> DataFrame:
    return resolved.where(F.col("target_path").isNull()).select("root", "path", "target").distinct().orderBy("root", "path", "target")


def stale(embedded: DataFrame, files: DataFrame) -> DataFrame:
    """Files whose current content has no embedding yet."""
    return files.join(embedded.select("root", "path", "content_hash"), ["root", "path", "content_hash"], "left_anti")


def embed_files(files: DataFrame, embedded: DataFrame, provider: str, dims: int) -> tuple[DataFrame, DataFrame]:
    """files: root, path, content_hash, content. (vectors after the pass, its (embedded, skipped)). Only content that has
    no vector of this provider and size is embedded; vectors of other files stay."""
    known = embedded.where((F.col("provider") == provider) & (F.col("dimensions") == dims))
    todo = stale(known, files)
    new = todo.select("root", "path", F.lit(provider).alias("provider"), F.lit(dims).alias("dimensions"), embedder(dims)("content").alias("vector"), "content_hash")
    work = todo.agg(F.count("*").alias("embedded")).join(files.agg(F.count("*").alias("all")), F.lit(True)).select("embedded", (F.col("all") - F.col("embedded")).alias("skipped"))
    return store.put_embeddings(embedded.select(*new.columns), new), work


def deduplicate_symbols(symbols: DataFrame) -> DataFrame:
    """One symbol for each file, line and name: that of the most specific kind."""
    order = F.when(F.col("kind") == "method", 0).when(F.col("kind").isin("class", "struct", "enum", "interface", "trait"), 1).when(F.col("kind") == "function", 2).when(F.col("kind") == "constant", 3).otherwise(4)
    rest = [c for c in symbols.columns if c not in ("file_id", "start_line", "name")]
    return symbols.groupBy("file_id", "start_line", "name").agg(F.min_by(F.struct(*rest), F.struct(order, "kind")).alias("r")).select("file_id", "start_line", "name", "r.*").select(*symbols.columns)


def deduplicate_relationships(rows: DataFrame) -> DataFrame:
    return rows.dropDuplicates(["file_id", "kind", "from_symbol", "target", "line"])


def gone(stored: DataFrame, walked: DataFrame) -> DataFrame:
    """What is stored and no longer there, once each."""
    return stored.subtract(walked)


def known(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """Candidates that are known files, once each."""
    return candidates.intersect(files)


def counts(files: DataFrame, symbols: DataFrame, relationships: DataFrame) -> DataFrame:
    """How many files, symbols and relationships an index holds, as one row."""
    one = lambda df, n: df.agg(F.count("*").alias(n))
    return one(files, "files").join(one(symbols, "symbols"), F.lit(True)).join(one(relationships, "relationships"), F.lit(True))
