"""Secret scans by corpus-wide ownership frequency, in DataFrame functions only.

Patterns find candidates with their places; each candidate's value is hashed, and the hashes are counted over the
whole corpus by distinct repositories and owners. A value that many owners hold, or that is in many repositories for each
owner, is a copied example; one that few hold is a live-looking credential of theirs. Base kinds are reported always; the further kinds are reported where their
value is owner-specific and no base span covers them.

A null text is empty. A null repository or owner is a value of its own. Repeated rows are scanned one by one; their
equal owners count once. An empty table gives an empty result; further columns are not read. Positions are code points,
ends exclusive. Of spans that begin alike the first-named kind comes first. The work on a text grows as its length and its
spans do (but for sorting them): places are prefix sums in blocks, overlaps are counts in one sorted list, and marks go
between pieces of blocks, so no list grows by copying.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, with_facts

# The patterns of the base kinds.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # a run of 18 or more; a shorter run holds no longer one
HEX = r"[0-9a-f]{16,}"  # runs are maximal, so this drops just those under 16
LEAST_VALUE = 12
# Further kinds, by the form of their values.
FURTHER = {
    "github": r"gh[pousr]_[A-Za-z0-9]{30,}",
    "jwt": r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
    "opaque": r"(?<![A-Za-z0-9+/_-])(?=[+/_-]*[A-Za-z0-9])[A-Za-z0-9+/_-]{24,}={0,2}",
}
KINDS = ("assign", "access", "hex", *FURTHER)
#: A value with at most so many distinct owners looks live; more widely copied ones are examples.
MAX_OWNERS = 3
#: So many repositories for each allowed owner still count as that owner's own use.
REPOS_AN_OWNER = 10
BLOCK = 128
#: Code points of the blocks that a text is cut into where spans are put as marks.
PIECE = 2048


def running(values: Column, zero: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each place of an array what join makes of all values before it (zero: of none), by blocks: what whole blocks come
    to first, then the part within a block."""

    def fold(xs: Column) -> Column:
        return F.aggregate(xs, zero, join)

    def summed(vs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(vs) - 1) / BLOCK).cast("int")), lambda b: fold(F.slice(vs, b * BLOCK + 1, F.lit(BLOCK))))
        return let(
            blocks,
            lambda bs: let(
                F.transform(bs, lambda _, b: fold(F.slice(bs, F.lit(1), b))),
                lambda before: F.transform(vs, lambda _, i: join(F.get(before, F.floor(i / BLOCK).cast("int")), fold(F.slice(vs, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK)))),
            ),
        )

    # values are computed once, not anew for each place
    return let(values, lambda vs: F.when(F.size(vs) == 0, F.array().cast("array<bigint>")).otherwise(summed(vs)))


def starts(lengths: Column) -> Column:
    """Exclusive prefix sums of an array of lengths."""
    return running(lengths, F.lit(0).cast("long"), lambda a, x: a + x)


def counted(points: Column, asked: Column, before: bool) -> Column:
    """For each of asked (places in a text) how many of points lie before it, or (not before) at it as well: both are sorted
    together, and points are summed up to each place asked for. In the order of asked."""
    marks = F.transform(points, lambda p: F.struct(p.alias("at"), F.lit(1 if before else 0).alias("turn"), F.lit(0).alias("k"), F.lit(1).cast("long").alias("n")))
    asks = F.transform(asked, lambda p, k: F.struct(p.alias("at"), F.lit(0 if before else 1).alias("turn"), k.alias("k"), F.lit(0).cast("long").alias("n")))
    ask = 0 if before else 1

    def told(events: Column) -> Column:
        sums = starts(F.transform(events, lambda e: e["n"]))
        both = F.zip_with(events, sums, lambda e, s: F.struct(e["turn"].alias("turn"), e["k"].alias("k"), s.alias("s")))
        return F.transform(F.array_sort(F.transform(F.filter(both, lambda x: x["turn"] == ask), lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s")))), lambda x: x["s"])

    return let(F.array_sort(F.concat(marks, asks)), told)


def free_of(xs: Column, base: Column) -> Column:
    """The spans of xs that overlap none of base: as many of base begin before its end as end by its start."""
    begun = counted(F.transform(base, lambda b: b["start"]), F.transform(xs, lambda x: x["end"]), True)
    ended = counted(F.transform(base, lambda b: b["end"]), F.transform(xs, lambda x: x["start"]), False)
    clear = F.zip_with(begun, ended, lambda a, b: a == b)
    return F.when((F.size(xs) == 0) | (F.size(base) == 0), xs).otherwise(let(clear, lambda c: F.filter(xs, lambda x, i: F.get(c, i))))


def spans(text: Column, pattern: str, kind: int, value_group: int = 0, least: int = 0) -> Column:
    """Leftmost non-overlapping matches as structs (start, kind, end, value), from the pieces between matches."""

    def placed(found: Column) -> Column:
        pieces = F.transform(F.split(text, pattern, -1), lambda p: F.length(p).cast("long"))
        gaps = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), F.transform(found, lambda m: F.length(m).cast("long")), lambda p, m: F.struct(p.alias("p"), m.alias("m")))
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else found

        def made(gs: Column) -> Column:
            before = starts(F.transform(gs, lambda g: g["p"] + g["m"]))
            return F.zip_with(
                F.zip_with(gs, before, lambda g, b: F.struct((b + g["p"]).alias("s"), (b + g["p"] + g["m"]).alias("e"))),
                values,
                lambda x, v: F.struct(x["s"].alias("start"), F.lit(kind).alias("kind"), x["e"].alias("end"), v.alias("value")),
            )

        return F.filter(let(gaps, made), lambda x: F.length(x["value"]) >= least) if least else let(gaps, made)

    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,value:string>>")
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(none))


def mixed(value: Column) -> Column:
    """A value of digits and letters of both cases: opaque strings of that form are seldom words or paths."""
    return value.rlike("[0-9]") & value.rlike("[A-Z]") & value.rlike("[a-z]")


def base_spans(t: Column) -> Column:
    return F.concat(spans(t, ASSIGN, 0, 2, LEAST_VALUE), F.when(t.contains("AKIA"), spans(t, ACCESS, 1)).otherwise(F.array()), spans(t, HEX, 2))


def found(docs: DataFrame, repo: Column, owner: Column, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row for each document: row (unique), doc_id, repo, owner, base and further (arrays of spans with value hashes)."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    scanned = docs.select(F.col(f"`{id_col}`").alias("doc_id"), repo.cast("string").alias("repo"), owner.cast("string").alias("owner"), text.alias("_t"))
    t = F.col("_t")
    github, jwt, opaque = (spans(t, p, 3 + k) for k, p in enumerate(FURTHER.values()))
    further = F.concat(F.when(t.contains("gh"), github).otherwise(F.array()), F.when(t.contains("eyJ"), jwt).otherwise(F.array()), F.filter(opaque, lambda x: mixed(x["value"])))
    hashed = lambda xs: F.transform(xs, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), F.sha2(x["value"], 256).alias("hash")))
    scanned = scanned.withColumn("base", F.sort_array(base_spans(t))).withColumn("further", further)
    free = free_of(F.col("further"), F.col("base"))
    kept = scanned.select("doc_id", "repo", "owner", hashed(F.col("base")).alias("base"), hashed(free).alias("further"))
    return cut(kept).withColumn("row", F.monotonically_increasing_id())


def ownership(hits: DataFrame, max_owners: int = MAX_OWNERS) -> DataFrame:
    """For each value hash: rows, distinct repositories and owners, and whether it looks live. Counted first by hash,
    repository and owner, so a value that is everywhere shrinks before it is dealt out."""
    once = hits.groupBy("hash", "repo", "owner").agg(F.count("*").alias("n"))
    counted = once.groupBy("hash").agg(F.sum("n").alias("n_hits"), F.count_distinct(F.coalesce("repo", F.lit("\0"))).alias("n_repos"), F.count_distinct(F.coalesce("owner", F.lit("\0"))).alias("n_owners"))
    return counted.withColumn("live", (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_owners * REPOS_AN_OWNER))


def scan(docs: DataFrame, repo: Column, owner: Column, text_col: str = "text", id_col: str = "doc_id", max_owners: int = MAX_OWNERS) -> DataFrame:
    """A row for each document: doc_id, base and spans (arrays of start, kind, end, hash, n_owners, live; by start, then
    kind). base holds the base kinds alone, spans the owner-specific further ones too."""
    digest = found(docs, repo, owner, text_col, id_col)
    hits = digest.select("row", "repo", "owner", F.explode(F.concat("base", "further")).alias("x")).select("row", "repo", "owner", "x.*")
    verdict = cut(ownership(hits, max_owners))
    told = with_facts(hits, verdict, "hash", "n_hits").select("row", F.struct("start", "kind", "end", "hash", "n_repos", "n_owners", "live").alias("x"))
    by_row = told.groupBy("row").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    none = F.array().cast(dict(by_row.dtypes)["xs"])
    xs = F.coalesce("xs", none)
    return digest.join(by_row, "row", "left").select(
        "doc_id", F.filter(xs, lambda x: x["kind"] < 3).alias("base"), F.filter(xs, lambda x: (x["kind"] < 3) | x["live"]).alias("spans")
    )


def joined(xs: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(xs, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """The digest columns of a scan."""
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return scanned.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda x: x["live"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda x: ~x["live"])).cast("long").alias("n_copied"),
    )


#: Up to so many further secrets (of about 100 bytes each) are sent to every executor; more are joined by shuffle.
BROADCAST_SPANS = 200_000


def in_blocks(text: Column) -> Column:
    """A text cut every PIECE code points, in one pass."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def piece(blocks: Column, a: Column, b: Column) -> Column:
    """The text from a to b; it costs what it is long and no more than two blocks beside."""
    i, j = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
    part = lambda k, at, n: F.substring(F.coalesce(F.get(blocks, k), F.lit("")), (at + 1).cast("int"), n.cast("int"))
    between = F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), "")
    return F.when(i == j, part(i, a % PIECE, b - a)).otherwise(F.concat(part(i, a % PIECE, F.lit(PIECE)), between, part(j, F.lit(0), b % PIECE)))


def put_marks(text: Column, xs: Column, mark: str) -> Column:
    """text with each of the sorted spans xs, or run of overlapping ones, put as mark."""

    def marked(blocks: Column, spans_: Column, reached: Column) -> Column:
        runs = F.zip_with(spans_, reached, lambda x, r: F.when(x["start"] >= r, F.concat(piece(blocks, r, x["start"]), F.lit(mark))).otherwise(F.lit("")))
        last = F.greatest(F.element_at(reached, -1), F.element_at(spans_, -1)["end"])
        return F.concat(F.array_join(runs, ""), piece(blocks, last, F.length(text).cast("long")))

    def over(spans_: Column) -> Column:
        reached = running(F.transform(spans_, lambda x: x["end"]), F.lit(0).cast("long"), lambda a, b: F.greatest(a, b))
        return let(in_blocks(text), lambda blocks: let(reached, lambda r: marked(blocks, spans_, r)))

    return let(xs, lambda spans_: F.when(F.size(spans_) > 0, over(spans_)).otherwise(text))


def redacted(docs: DataFrame, repo: Column, owner: Column, text_col: str = "text", id_col: str = "doc_id", mark: str = "[SECRET]", max_owners: int = MAX_OWNERS) -> DataFrame:
    """docs with every secret of scan() put as mark, in the columns of docs; no row goes. Base spans are found again in
    place; live further ones are joined by id, and by text where the id is null, and hold only where the value agrees."""
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.sha2(F.col(f"`{text_col}`"), 256)).alias("_key"), F.col(f"`{text_col}`").cast("string").alias("_text"), repo.alias("_repo"), owner.alias("_owner"))
    digest = found(named, F.col("_repo"), F.col("_owner"), "_text", "_key")
    hits = digest.select("repo", "owner", F.explode("further").alias("x")).select("repo", "owner", "x.hash")
    verdict = cut(ownership(hits, max_owners).select("hash", "n_hits", "live"))
    owned = with_facts(digest.select(F.col("doc_id").alias("_key"), F.explode("further").alias("x")).withColumn("hash", F.col("x.hash")), verdict, "hash", "n_hits").where("live")
    spans_of = cut(owned.groupBy("_key").agg(F.collect_set(F.struct("x.start", "x.kind", "x.end", "hash")).alias("_more")))
    small = (spans_of.agg(F.sum(F.size("_more"))).first()[0] or 0) <= BROADCAST_SPANS
    told = named.join(F.broadcast(spans_of) if small else spans_of, "_key", "left")
    text = F.coalesce("_text", F.lit(""))
    plain = lambda xs: F.transform(xs, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    agreed = F.when(F.size("_more") > 0, let(in_blocks(text), lambda blocks: F.filter("_more", lambda x: F.sha2(piece(blocks, x["start"], x["end"]), 256) == x["hash"])))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    told = told.withColumn("_spans", F.sort_array(F.concat(plain(base_spans(text)), F.coalesce(plain(agreed), none))))
    changed = F.when(F.col("_text").isNotNull(), put_marks(F.col("_text"), F.col("_spans"), mark))
    return told.withColumn("_new", changed).select(*[(F.col("_new") if c == text_col else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
