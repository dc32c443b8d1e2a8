"""Full-text index and hybrid ranking: postings, BM25, symbol matches, graph expansion, budgets by rank."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from ..lineage import cut

K1, B = 1.2, 0.75
# Words that a query drops unless nothing else is left.
STOPWORDS = frozenset("a an and are as at be by for from how in is it of on or that the this to was what when where which who why with".split())


@dataclass(frozen=True)
class Query:
    terms: tuple[str, ...]

    @staticmethod
    def parse(text: str) -> Query:
        """Lower-case terms; a quote at a term's start groups words; stopwords go if something stays."""
        terms, rest = [], text.strip()
        while rest:
            m = re.match(r'"([^"]*)"?', rest) if rest[0] == '"' else re.match(r"\S+", rest)
            term = " ".join((m[1] if rest[0] == '"' else m[0]).lower().split())
            if term and term not in terms:
                terms.append(term)
            rest = rest[m.end() :].strip()
        kept = [t for t in terms if t not in STOPWORDS]
        return Query(tuple(kept or terms))


def terms_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, term, tf)"""
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(terms_of(F.col(text_col))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def doc_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.size(terms_of(F.col(text_col))).cast("long").alias("dl"))


def term_stats(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def occurrences(w: Column, phrase: list[str]) -> Column:
    """How often the words of a phrase stand side by side in an array of words."""
    first = F.filter(F.transform(w, lambda x, k: F.when(x == F.lit(phrase[0]), k)), lambda k: k.isNotNull())
    if len(phrase) == 1:
        return F.size(first)
    return F.size(F.filter(first, lambda k: F.slice(w, k + 1, F.lit(len(phrase))) == F.array(*[F.lit(x) for x in phrase])))


def may_hold(text: Column, phrases: list[list[str]]) -> Column:
    """Whether the letters of all words of a phrase are in a text: a quick test that no text with the phrase fails."""
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [low.contains(w) for w in p]) for p in phrases if p], F.lit(False))


def bm25_score(tf: list[Column], df: list[Column], dl: Column, n: Column, avgdl: Column) -> Column:
    """The sum over terms; a term that a document lacks adds nothing."""
    total = F.lit(0.0)
    for t, d in zip(tf, df, strict=True):
        idf = F.log1p((n - d + 0.5) / (d + 0.5))
        total = total + F.when(t > 0, idf * t * (K1 + 1) / (t + K1 * (1 - B + B * dl / avgdl))).otherwise(0.0)
    return total


def bm25(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, relevance) of documents that hold a term. The query's terms are counted in each text, so no posting of
    another word is made or shuffled; statistics are corpus-wide, and for scores only texts that may hold a term are cut
    into words again. A term of several words is a phrase, whose words stand side by side. For many searches of one corpus
    see textindex."""
    phrases = [re.findall(r"[^\W_]+", t.lower()) for t in terms]
    ks = range(len(phrases))
    # the words are made once for all that is counted in them
    times = lambda w: F.struct(F.size(w).alias("dl"), *[(occurrences(w, p) if p else F.lit(0)).alias(f"tf{k}") for k, p in enumerate(phrases)])
    tallied = lambda rows: rows.select(F.col(id_col).alias("doc_id"), F.element_at(F.transform(F.array(terms_of(F.col(text_col))), times), 1).alias("x")).select("doc_id", "x.*")
    stats = tallied(docs).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in ks])
    both = tallied(docs.where(may_hold(F.col(text_col), phrases))).where(F.greatest(F.lit(0), F.lit(0), *[F.col(f"tf{k}") for k in ks]) > 0).join(F.broadcast(stats), F.lit(True))
    return both.select("doc_id", bm25_score([F.col(f"tf{k}") for k in ks], [F.col(f"df{k}") for k in ks], F.col("dl"), F.col("n"), F.col("avgdl")).alias("relevance"))


def top_text(docs: DataFrame, query: str, limit: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return bm25(docs, list(Query.parse(query).terms), id_col, text_col).orderBy(F.desc("relevance"), "doc_id").limit(limit)


def symbol_search(symbols: DataFrame, files: DataFrame, term: str, root: str | None = None, limit: int = 50) -> DataFrame:
    """Symbols (file_id, name, line) whose name holds the term, exact ones first, then those that begin with it, shorter
    names first. % and _ are plain characters."""
    low = F.lower("name")
    hits = symbols.where(low.contains(term.lower())).join(files if root is None else files.where(F.col("root") == root), "file_id")
    order = F.when(F.col("name") == term.lower(), 0).when(low.startswith(term.lower()), 1).otherwise(2)
    return hits.withColumn("rank", order).orderBy("rank", F.length("name"), "path", "line").limit(limit)


def candidates(*found: DataFrame) -> DataFrame:
    """Paths that any of the ways to find them gave, once."""
    return reduce(DataFrame.union, [f.select("path") for f in found]).distinct()


def merge_hits(*found: DataFrame) -> DataFrame:
    """One row a path of what each way found, 0 where it found nothing."""
    return reduce(lambda a, b: a.join(b, "path", "full_outer"), found).na.fill(0)


def with_similarity(rows: DataFrame, near: DataFrame, key: str) -> DataFrame:
    """rows with the similarity that near has for their key, else 0."""
    return rows.join(near.select(key, "similarity"), key, "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))


def expand(found: DataFrame, edges: DataFrame, depth: int = 1) -> DataFrame:
    """(node, hops, source) of what is found and of its neighbours in either direction, at their least distance; the
    least source explains a neighbour."""
    seen = found.select("node", F.lit(0).alias("hops"), F.col("node").alias("source"))
    near = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()
    frontier = seen
    for hop in range(1, depth + 1):
        frontier = frontier.select(F.col("node").alias("a")).join(near, "a").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("source")).join(seen, "node", "left_anti").select("node", F.lit(hop).alias("hops"), "source")
        if hop < depth:
            frontier = cut(frontier)
        seen = seen.unionByName(frontier)
    return seen


def retrieve(texts: DataFrame, symbols: DataFrame, edges: DataFrame, ages: DataFrame, query: str, depth: int = 1, hits: int = 50, limit: int = 20) -> DataFrame:
    """(path, score, hops, related_to): what a query finds by text and by symbol, and what hangs together with it. texts:
    path, text; symbols: path, name; edges: src, dst of paths; ages: path, age_days of all files that may be found. At most
    hits files come by text and hits by symbol, those of the best match; so what graph and ranking then meet is bounded by
    hits and their neighbours."""
    terms = Query.parse(query).terms
    found = bm25(texts, list(terms), "path", "text").select(F.col("doc_id").alias("path"), F.round("relevance", 6).alias("relevance")).orderBy(F.desc("relevance"), "path").limit(hits)
    scored = symbols.select("path", scores.symbol_score(F.col("name"), list(terms)).alias("symbol")).where("symbol > 0")
    named = scored.groupBy("path").agg(F.max("symbol").alias("symbol")).orderBy(F.desc("symbol"), "path").limit(hits)
    direct = cut(found.join(named, "path", "full_outer"))
    near = expand(direct.select(F.col("path").alias("node")), edges, depth)
    dependents = edges.select("src", "dst").distinct().groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("dependents"))
    all_ = near.withColumnRenamed("node", "path").join(ages, "path").join(direct, "path", "left").join(dependents, "path", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    candidates = cut(all_.select("path", zero("relevance").cast("double").alias("relevance"), zero("symbol").cast("double").alias("symbol"), zero("dependents").alias("dependents"), F.col("age_days").cast("double").alias("age_days"), "hops", F.when(F.col("hops") > 0, F.col("source")).alias("related_to")))
    return rank(candidates, limit=limit).join(candidates.select("path", "hops", "related_to"), "path").orderBy(F.desc("score"), "path")


def rank(candidates: DataFrame, weights: dict[str, float] = scores.WEIGHTS, half_life_days: float = 30.0, limit: int = 20) -> DataFrame:
    """candidates: path, relevance, symbol, dependents, age_days, hops. Signals are normalised by the maxima over all
    candidates, weighed, and decayed by hops; what scores 0 is dropped."""
    best = candidates.agg(F.max("relevance").alias("best"), F.max("dependents").alias("most"))
    signals = {
        "keyword": scores.normalize_keyword(F.col("relevance"), F.col("best")),
        "symbol": F.col("symbol"),
        "graph": scores.normalize_graph(F.col("dependents"), F.col("most")),
        "recency": scores.normalize_recency(F.col("age_days"), half_life_days),
    }
    scored = candidates.join(F.broadcast(best), F.lit(True)).select("path", F.round(scores.score(signals, F.col("hops"), weights), 6).alias("score"))
    return scored.where("score > 0").orderBy(F.desc("score"), "path").limit(limit)


def within_budget(ranked: DataFrame, budget: int) -> DataFrame:
    """Ranked files (position, tokens) while the ones before leave something; the last may be cut. Over a ranked page."""
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy("query").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranked.withColumn("before", before).where(F.col("before") < budget).withColumn("allowed", F.least(F.col("tokens"), budget - F.col("before"))).drop("before")
