"""Fragments of texts as rows, their exact duplicates, and prefixes that fit a budget.

Fragment frames have doc_id, idx (from 0), content. Duplicates are found by aggregation (partial sums before the
shuffle), not by a window, so a key of many rows stays small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.tokens import count_heuristic

LINE_TYPES = ("log", "terminal")


def strategy(content_type: Column) -> Column:
    return F.when(content_type.isin(*LINE_TYPES), "lines").otherwise("blocks")


def lines_of(text: Column) -> Column:
    return F.filter(F.split(T.normalize(text), "\n"), lambda x: ~T.is_blank(x))


def blocks_of(text: Column) -> Column:
    """Maximal runs of non-blank lines."""
    return F.filter(F.split(T.normalize(text), r"\n(?:[^\S\n]*\n)+"), lambda x: ~T.is_blank(x))


def split(docs: DataFrame, how: str = "lines", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    parts = lines_of(F.col(text_col)) if how == "lines" else blocks_of(F.col(text_col))
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(parts).alias("idx", "content"))


def join(fragments: DataFrame, separator: str = "\n") -> DataFrame:
    """The text of each document's fragments in order, closed by one line feed."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", "content")))
    return fragments.groupBy("doc_id").agg(F.concat(F.array_join(F.transform(ordered, lambda x: x["content"]), separator), F.lit("\n")).alias("text"))


def deduplicate(fragments: DataFrame, key: Column) -> DataFrame:
    """The first fragment of every key in a document, and how often the key occurs (repeats)."""
    keyed = fragments.withColumn("_k", key)
    kept = keyed.groupBy("doc_id", "_k").agg(F.min(F.struct("idx", "content")).alias("f"), F.count("*").alias("repeats"))
    return kept.select("doc_id", "f.idx", "f.content", "repeats")


def with_tokens(fragments: DataFrame) -> DataFrame:
    return fragments.withColumn("tokens", count_heuristic(F.col("content")))


def select_prefix(fragments: DataFrame, budget: Column) -> DataFrame:
    """The longest prefix of a document's fragments whose joined text fits. A separator, like the final line feed, costs
    one token; a document that fits as a whole is kept."""
    by_doc = Window.partitionBy("doc_id")
    running = F.sum(F.col("tokens") + 1).over(by_doc.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    return fragments.withColumn("_b", budget).withColumn("running", running).where(F.col("running") <= F.col("_b")).drop("_b")


def duplicate_report(fragments: DataFrame) -> DataFrame:
    """Fragments and how many of them repeat an earlier one of their document, blanks evened out."""
    once = fragments.groupBy("doc_id", T.collapse_space(F.col("content")).alias("k")).agg(F.count("*").alias("n"))
    return once.groupBy("doc_id").agg(F.sum("n").alias("fragments"), (F.sum("n") - F.count("*")).alias("duplicates"))
