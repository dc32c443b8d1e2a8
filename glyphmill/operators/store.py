"""Keyed tables on Parquet frames: upserts, point reads, deletes, and cache look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Table schemas, one constant a table; there are no migrations, as every write states its schema.
SCHEMAS = {
    "contexts": "id string, content string, source_kind string, source_ref string, content_type string, token_count long, byte_len long, created_at timestamp",
    "files": "id long, root string, path string, language string, size long, mtime_ms long, content_hash string, indexed_at timestamp",
    "symbols": "file_id long, name string, kind string, start_line int, end_line int",
    "relationships": "file_id long, kind string, from_symbol string, target string, target_path string, line int",
    "embeddings": "root string, path string, provider string, dimensions int, vector array<float>, content_hash string, updated_at timestamp",
    "memories": "project_id string, key string, value string, created_at timestamp, updated_at timestamp",
    "optimizations": "content_hash string, optimizer string, budget long, settings string, text string, original_tokens long, optimized_tokens long",
    "projects": "id string, name string, path string, status string, languages array<string>, frameworks array<string>, added_at timestamp, indexed_at timestamp",
    "project_settings": "project_id string, key string, value string",
    "index_state": "root string, last_indexed_at timestamp, file_count long, symbol_count long",
}
MAX_MEMORY_BYTES = 64 * 1024


def latest(rows: DataFrame, keys: list[str], order: Column, keep_first: tuple[str, ...] = ()) -> DataFrame:
    """The last row of every key by order; of keep_first columns the least value of the key stays. An aggregation, so
    rows of a key meet as partial results."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r"), *[F.min(c).alias(f"_first_{c}") for c in keep_first])
    return best.select(*keys, *[F.col(f"_first_{c}").alias(c) if c in keep_first else F.col(f"_r.{c}") for c in rest]).select(*rows.columns)


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], keep_first: tuple[str, ...] = ()) -> DataFrame:
    """existing with new's rows in the place of those of equal keys; keep_first columns stay as they were."""
    both = existing.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)))
    return latest(both, keys, F.col("_n"), keep_first).drop("_n")


def point(rows: DataFrame, **key) -> DataFrame:
    """The row of that key, or none; the filters reach the scan."""
    for column, value in key.items():
        rows = rows.where(F.col(column) == F.lit(value))
    return rows


def paths(files: DataFrame, root: str) -> DataFrame:
    return point(files, root=root).select("path").orderBy("path")


def fingerprints(files: DataFrame, root: str) -> DataFrame:
    """What a scan compares: size, time and content by path."""
    return point(files, root=root).select("path", "size", "mtime_ms", "content_hash")


def append(rows: DataFrame, path: str) -> None:
    """All rows or none: files appear when the whole job commits."""
    rows.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "1").parquet(path)


def put_embeddings(embeddings: DataFrame, new: DataFrame) -> DataFrame:
    """One vector a file; another provider's or size takes the place of what was there."""
    return upsert(embeddings, new, ["root", "path"])


def embeddings_of(embeddings: DataFrame, root: str, provider: str, dimensions: int, wanted: DataFrame | None = None) -> DataFrame:
    """Vectors that can be compared: a root's, by one provider and of one size; of wanted paths alone if there are any given."""
    rows = point(embeddings, root=root, provider=provider, dimensions=dimensions)
    return rows if wanted is None else rows.join(wanted.select("path").distinct(), "path", "left_semi").select(*embeddings.columns)


def set_project_status(projects: DataFrame, project: str, status: str) -> DataFrame:
    return projects.withColumn("status", F.when(F.col("id") == project, F.lit(status)).otherwise(F.col("status")))


def remove_project(projects: DataFrame, settings: DataFrame, project: str) -> tuple[DataFrame, DataFrame]:
    """A project goes with its settings."""
    return projects.where(F.col("id") != project), settings.where(F.col("project_id") != project)


def put_settings(settings: DataFrame, new: DataFrame) -> DataFrame:
    """A null value takes a setting back."""
    return upsert(settings, new, ["project_id", "key"]).where(F.col("value").isNotNull())


def delete(existing: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return existing.join(keys.select(*on).distinct(), on, "left_anti")


def delete_under(files: DataFrame, root: str, prefix: str) -> DataFrame:
    """Without the files below a directory; its name is taken as it is."""
    return files.where(~((F.col("root") == root) & F.col("path").startswith(prefix.rstrip("/") + "/")))


def rename(files: DataFrame, root: str, old: str, new: str) -> DataFrame:
    """A file takes the new path; what was there goes."""
    kept = files.where(~((F.col("root") == root) & (F.col("path") == new)))
    return kept.withColumn("path", F.when((F.col("root") == root) & (F.col("path") == old), new).otherwise(F.col("path")))


def replace_derived(existing: DataFrame, new: DataFrame, file_ids: DataFrame) -> DataFrame:
    """Derived rows of the given files are all replaced by new's."""
    return delete(existing, file_ids, ["file_id"]).unionByName(new)


def remember(memories: DataFrame, new: DataFrame) -> DataFrame:
    """Notes of up to 64 KiB; an update keeps created_at."""
    return upsert(memories, new.where(F.octet_length("value") <= MAX_MEMORY_BYTES), ["project_id", "key"], ("created_at",))


def newest_memories(memories: DataFrame, project: str | None, n: int) -> DataFrame:
    rows = memories if project is None else memories.where(F.col("project_id") == project)
    return rows.orderBy(F.desc("updated_at"), "key", "project_id").limit(n)


def recall(memories: DataFrame, project: str, key: str) -> DataFrame:
    """The note of that key, or no row."""
    return memories.where((F.col("project_id") == project) & (F.col("key") == key))


def forget(memories: DataFrame, project: str, key: str) -> DataFrame:
    """memories without the note of that key."""
    return memories.where(~((F.col("project_id") == project) & (F.col("key") == key)))


def cached(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Each request with its cached result, or nulls: a miss."""
    return requests.join(cache, ["content_hash", "optimizer", "budget", "settings"], "left")


def settings_fingerprint(**settings) -> Column:
    return F.sha2(F.lit("|".join(f"{k}={settings[k]}" for k in sorted(settings))), 256)


def embedding_state(embeddings: DataFrame) -> DataFrame:
    """Count and a checksum of update times, by which a reader sees a change."""
    return embeddings.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.unix_millis("updated_at")), F.lit(0)).alias("checksum"))


def resolve_project(projects: DataFrame, name: str) -> DataFrame:
    """The project of that id, else path, else name; a name that several share gives no row."""
    rank = F.when(F.col("id") == name, 0).when(F.col("path") == name, 1).when(F.col("name") == name, 2)
    hits = projects.withColumn("_rank", rank).where(F.col("_rank").isNotNull())
    best = hits.agg(F.min("_rank").alias("_best"))
    chosen = hits.join(F.broadcast(best), F.col("_rank") == F.col("_best")).drop("_best", "_rank")
    return chosen.join(F.broadcast(chosen.agg(F.count("*").alias("_n"))), F.col("_n") == 1).drop("_n")
