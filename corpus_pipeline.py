"""From raw documents to packed sequences: every stage works on what the one before it kept.

Every stage function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import decontam, neardup, packing, quality, queries, secrets
from glyphmill.llm.common import cut, fresh_path, ready


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five-word shingles, similarity 0.8) stays: that of the least id, a row
    without an id only if none has one; of equal ids, one text's. Texts are told apart by 64 bits of their hash, never by
    doc_id. Rows without words are in no group: all stay, but repeated rows with an id once."""
    marked = docs.withColumn("_t", F.xxhash64("text"))
    blank = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^ \t\n\r\x0B\f]")
    full = marked.where(~blank)
    found = neardup.near_duplicates(full.select("_t", "text"), id_col="_t").groupBy(F.col("doc_id").alias("_t")).agg(F.min("component_id").alias("_c"))
    rows = full.groupBy("_t", "doc_id").agg(F.count("*").alias("_n"))
    firsts = rows.groupBy("_t").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "_t", "_n")).alias("_f"))
    kept = cut(firsts.join(found, "_t").groupBy("_c").agg(F.min("_f").alias("_f")).select(F.col("_f.doc_id").alias("_id"), F.col("_f._t").alias("_u"), F.col("_f._n").alias("_n")))
    size = kept.agg(F.count("*").alias("ids"), F.max("_n").alias("most")).first()
    ids = F.broadcast(kept) if size["ids"] <= neardup.BROADCAST_IDS else kept
    named = full.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_u")))
    if (size["most"] or 0) > 1:  # only then are there repeated rows, whose texts must meet
        named = named.where("_n = 1").unionByName(named.where("_n > 1").dropDuplicates(["doc_id", "_t"]))
    empty = marked.where(blank)
    empty = empty.where("doc_id IS NULL").unionByName(empty.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "_t"]))
    return named.select(*docs.columns).unionByName(empty.select(*docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, rows without an id and repeated rows each by their own text; a null or empty
    text holds none and stays. Texts of any length are searched whole; clashing columns of docs are carried, not read."""
    return decontam.clean(docs, queries.table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is put as a mark; no document goes. Null texts stay null. Of overlapping spans one mark stays. Rows of one
    id share what further kinds were found live, where the value stands at the same place; a text of any length is rebuilt
    from pieces of blocks, in time linear in its spans."""
    return secrets.redacted(docs, repo=F.col("source"), owner=F.col("source"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and offsets; a null text is one piece, its end id. See packing."""
    return packing.pack(docs, queries.tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents; each result is written as Parquet and read again, so a lost executor costs no
    earlier stage. No document, or none that passes, gives an empty result."""
    docs = ready(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return made
        path = fresh_path(spark, f"pipeline-{name}")
        made.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Near-duplicate groups, alignment and packing plans are not SQL; tests hold every stage against brute force.
ORACLE_SQL = None
