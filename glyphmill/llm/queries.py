"""Queries over the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crf, decontam, html, langid, licenses, merkle, neardup, packing, quality, resample, secrets, sharding, toxicity
from .common import ready

SHARDS = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.digest(secrets.scan(docs, repo=F.col("source"), owner=F.col("source")))


def fold(id_col: str, parts: int):
    """crc32 of the id as text, modulo parts; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % parts


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(langid.sample(docs, fold("doc_id", 5) != 0))
    return langid.predict(docs, model, keep={"held_out": fold("doc_id", 5) == 0})


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op5_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), neardup.Settings(words=2, percent=80))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs.select("doc_id", "text"), labels, fold("doc_id", 4) != 2)
    return toxicity.score(docs, model, keep={"held_out": fold("doc_id", 4) == 2})


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(fold("doc_id", 2) == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    made = merkle.manifest(table(spark, sf_dir, "documents"), {"text": tampered})
    return made.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = crf.fit(docs.select("doc_id", "text"), labels, fold("doc_id", 5) != 0)
    return crf.score(docs, model, keep={"held_out": fold("doc_id", 5) == 0})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_language_id": op2_language_id,
    "op3_packing": op3_packing,
    "op4_html_extraction": op4_html_extraction,
    "op5_minhash_near_dup": op5_minhash_near_dup,
    "op6_toxicity": op6_toxicity,
    "op7_sharding": op7_sharding,
    "op8_license_scan": op8_license_scan,
    "op9_decontamination": op9_decontamination,
    "op10_quality_rules": op10_quality_rules,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_quality_classifier": op13_quality_classifier,
}


def _quality_sql() -> str:
    """The base columns and the rule table in SQL."""
    words = r"list_filter(regexp_split_to_array(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')"
    stop = ",".join("'" + w + "'" for x in quality.STOP_WORDS for w in (x, x.capitalize(), x.upper()))
    bounds = " AND ".join(
        f"coalesce({r.measure}, 0.0) {op} {b}" for r in quality.RULES for op, b in ((">=", r.least), ("<=", r.most)) if b is not None
    )
    return rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, doc_id, t, {words} AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS l FROM d),
g AS (SELECT k, i, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS g FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT k, count(DISTINCT i + o) AS n FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM g), (VALUES (0), (1), (2)) AS v(o) WHERE c > 1 GROUP BY k),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, length(regexp_replace(t, '[ \t\n\x0B\f\r]', '', 'g')) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(l) AS n_lines, length(t) - length(translate(t, '!', '')) AS shouts,
  len(list_filter(w, lambda x: x IN ({stop}))) AS stops, length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS uppers FROM w LEFT JOIN r USING (k)),
q AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed, word_chars / nullif(n_words, 0) AS mean_word_chars, n_symbols / nullif(n_words, 0) AS symbol_ratio,
  shouts / nullif(n_words, 0) AS shout_ratio, uppers / nullif(word_chars, 0) AS upper_ratio, stops / nullif(n_words, 0) AS stop_word_ratio, n_dup_lines / nullif(n_lines, 0) AS dup_line_ratio FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {bounds} AS kept FROM q"""


#: crc32 of a text's bytes: a table made by the polynomial, then a fold over the bytes.
_CRC_TABLE = "(SELECT list(c ORDER BY i) FROM (SELECT i, list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, CAST(i AS BIGINT)) AS c FROM range(256) AS r(i)))"


def _crc_sql(text: str) -> str:
    """crc32 of text, where tbl.t is the table."""
    octets = f"list_transform(range(0, octet_length(encode({text}))), lambda i: CAST('0x' || substr(hex(encode({text})), CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT))"
    return f"xor(list_reduce({octets}, lambda a, b: xor(a >> 8, tbl.t[CAST(xor(a % 256, b) + 1 AS INTEGER)]), 4294967295), 4294967295)"


def _resample_sql(s: resample.Settings) -> str:
    """Features, buckets, gains, scores and ranks in SQL, for single words."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = rf"list_filter(regexp_split_to_array({lower}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    whole = f"list_reduce(range(0, 8), lambda a, i: a * 16 + instr('0123456789abcdef', substr(sha256('{s.seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), CAST(i + 1 AS INTEGER), 1)) - 1, CAST(0 AS BIGINT))"
    return rf"""
WITH tbl AS MATERIALIZED (SELECT {_CRC_TABLE} AS t),
d AS (SELECT row_number() OVER () AS k, doc_id, {words} AS w FROM documents),
b AS (SELECT {words} AS w FROM benchmark),
c AS MATERIALIZED (SELECT k, unnest(w) AS f FROM d),
t AS (SELECT unnest(w) AS f FROM b),
v AS MATERIALIZED (SELECT f, {_crc_sql("f")} % {s.buckets} AS bucket FROM (SELECT f FROM c UNION SELECT f FROM t), tbl),
s AS (SELECT bucket, count(*) AS s FROM c JOIN v USING (f) GROUP BY bucket),
u AS (SELECT bucket, count(*) AS t FROM t JOIN v USING (f) GROUP BY bucket),
g AS MATERIALIZED (SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * ((SELECT count(*) FROM c) + {s.buckets}) AS DOUBLE) / CAST((coalesce(s, 0) + 1) * ((SELECT count(*) FROM t) + {s.buckets}) AS DOUBLE))) AS BIGINT) AS gain FROM s FULL JOIN u USING (bucket)),
m AS (SELECT k, CAST(sum(gain) AS BIGINT) AS weight FROM c JOIN v USING (f) JOIN g USING (bucket) GROUP BY k),
x AS (SELECT k, doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, len(w) >= {s.least_words} AS able,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(({whole} + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM d LEFT JOIN m USING (k)),
r AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id NULLS FIRST) AS r, count(*) FILTER (WHERE able) OVER () AS n FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND r <= n * {s.percent} // 100 THEN r END AS rank FROM r"""


def _merkle_sql(fanout: int = merkle.FANOUT, height: int = 16) -> str:
    """Places, levels, siblings and folds in SQL, for trees of at most height levels: fanout ** height leaves."""
    spelt = lambda c: f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda **new: "sha256(" + " || ".join(spelt(new.get(c, c)) for c in merkle.LEAF) + ")"
    broken = f"CASE WHEN {_crc_sql('coalesce(CAST(doc_id AS VARCHAR), chr(0))')} % 2 = 0 OR doc_id IS NULL THEN replace(text, chr(10), '') ELSE text END"

    def levels(name: str, key: str) -> str:
        """name0 has key, i and h; level by level, a node's parent, and the hashes on its left and right."""
        out = []
        for k in range(height):
            a, b = f"{name}{k}", f"{name}{k + 1}"
            ahead = f"PARTITION BY {key}, i // {fanout} ORDER BY i ROWS BETWEEN"
            out.append(f"{a}s AS MATERIALIZED (SELECT *, n > 1 AS more, coalesce(string_agg(h, '') OVER ({ahead} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER ({ahead} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM (SELECT *, count(*) OVER (PARTITION BY {key}) AS n FROM {a}))")
            out.append(f"{b} AS MATERIALIZED (SELECT {key}, i // {fanout} AS i, CASE WHEN any_value(more) THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h FROM {a}s GROUP BY {key}, i // {fanout})")
        return ", ".join(out)

    def climbed(name: str, key: str, start: str) -> str:
        """start has pos, proof and f; each level adds siblings to proof and folds f."""
        out, now = [], start
        for k in range(height):
            new = f"{name}_up{k}"
            out.append(f"{new} AS MATERIALIZED (SELECT p.* REPLACE (p.pos // {fanout} AS pos, CASE WHEN s.more THEN p.proof || s.l || s.r ELSE p.proof END AS proof, CASE WHEN s.more THEN sha256(s.l || p.f || s.r) ELSE p.f END AS f) FROM {now} p JOIN {name}{k}s s ON p.{key} = s.{key} AND p.pos = s.i)")
            now = new
        return ", ".join(out)

    return f"""
WITH tbl AS MATERIALIZED (SELECT {_CRC_TABLE} AS t),
d AS MATERIALIZED (SELECT doc_id, coalesce('=' || source, '') AS g, {leaf()} AS h, {leaf(text=f'({broken})')} AS o FROM documents, tbl),
e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM d),
a0 AS (SELECT g, i, h FROM e), {levels("a", "g")},
b0 AS (SELECT 0 AS z, row_number() OVER (ORDER BY g) - 1 AS i, g, h FROM a{height}), {levels("b", "z")},
q AS (SELECT doc_id, g, h AS leaf, i AS pos, '' AS proof, o AS f FROM e), {climbed("a", "g", "q")},
w AS (SELECT u.doc_id, u.leaf, b0.h AS subroot, 0 AS z, b0.i AS pos, u.proof, u.f FROM a_up{height - 1} u JOIN b0 USING (g)), {climbed("b", "z", "w")}
SELECT doc_id, leaf, subroot, b{height}.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = b{height}.h AS verified FROM b_up{height - 1}, b{height}"""


SQL: dict[str, str] = {"op10_quality_rules": _quality_sql(), "op11_importance_resampling": _resample_sql(resample.Settings()), "op12_merkle_manifest": _merkle_sql()}
