"""Main text of web pages by site template removal.

A page is parsed into a tree; every block-level subtree is hashed from its tags, classes and text. Spark counts, for each
host, on how many distinct pages a hash occurs outside articles, and in how many distinct articles inside; subtrees that
recur are templates and are deleted. Pages of the same text count once, and so do copies of an article. Inside, headings,
list items, table cells and paragraphs without class or id are no templates of their own, as texts repeat themselves too;
outside, such paragraphs must also be on a share of the host's pages. An article more than half of whose text recurs,
such paragraphs included, is a copy of others and stays whole. Of what is left, the blocks of all outermost articles are the text, in page order, or
those of the page if it has none: elements that by their kind or class are menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles or comments never count; but a paragraph within an article goes for its name only if it recurs.

A null html is empty, and its text is empty. A page without a host belongs to the host ''. Repeated pages are extracted
one by one and count once each for their host. Very long or broken pages are parsed in one pass, in linear time: what a
tag opens ends with its parent, a tag that the text ends in is dropped. Ties do not occur. An empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, share, slices

#: A subtree is a template if it is on so many distinct pages of its host (inside: articles), however large the host is;
#: on a host of fewer, if it is on all of them, but on LEAST_OUTSIDE or LEAST_INSIDE at least.
LEAST_PAGES = 5
LEAST_OUTSIDE = 2
LEAST_INSIDE = 3
#: A paragraph without class or id outside articles must also be on this share of the host's pages.
LEAST_SHARE = 0.1
#: Marks the hashes of subtrees inside articles, which are counted apart.
INSIDE = 0x5BD1E9955BD1E995
#: Up to so many template hashes are sent to every executor; more are joined by host.
BROADCAST_HASHES = 500_000
#: Parts that a host's pages are dealt in where hashes are joined.
HOST_SALTS = 64

#: Kinds of counted subtrees.
OUTSIDE, WITHIN, BARE = 0, 1, 2

# HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg xmp".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HASHED = BLOCKS - {"html", "body", "article", "main"}
HASHED_INSIDE = HASHED - set("h1 h2 h3 h4 h5 h6 li dt dd tr td th thead tbody tfoot hr figcaption summary".split())
TEXTUAL = frozenset("p pre blockquote address".split())
NEVER = frozenset("script style head title noscript template iframe svg nav aside footer form button select option textarea input dialog menu object embed canvas audio video".split())
#: A start tag of the key closes open elements of the value, up to the nearest scope.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table tbody thead tfoot article section div main body html blockquote nav aside header footer form".split())
#: The end of each raw element; only ASCII letters fold, so places are the text's own.
RAW_END = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}
CLOSE_P = BLOCKS - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "figcaption", "summary"}
# Words in class or id that name what is no main text.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices alert comment comments disqus respond reply replies "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead share sharing social newsletter subscribe subscription signup login related recommended popup modal overlay skip toolbar widget pagination pager".split()
)
# Words among them that articles use of themselves too; there such an element goes where it recurs or is no prose.
WEAK = frozenset("alert banner login menu notice notices promotion recommended related share sharing signup skip subscription widget".split())
# Words among them for what is never the page's frame.
OTHERS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr comment comments disqus respond reply replies newsletter subscribe".split())
# Words in class or id that name the text.
POSITIVE = frozenset("article body content entry main post story text".split())
#: Prose has so many words outside of links, and no more than this share within.
PROSE_WORDS, LINKED = 12, 0.4
#: Text outside articles that names itself the text counts instead if it is so many times theirs.
OUTWEIGHS = 4
#: A quote groups only behind =, and the end of the text ends any tag, so no start is scanned twice.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*+(?:>|\Z)|<\?[^>]*+(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[=\"'])*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?(?=[\s/]|$)", re.I)


class Node:
    __slots__ = ("children", "hash", "marks", "tag")

    def __init__(self, tag: str, marks: str = ""):
        self.tag, self.marks, self.children, self.hash = tag, marks, [], 0


def marks(attributes: str) -> str:
    """The attributes that say what an element is for: class, id, role, hidden and style, in order."""
    if not attributes or attributes.isspace():
        return ""
    return " ".join(f"{m[1].lower()}={(m[2] or '').strip(chr(34) + chr(39)).lower()}" for m in ATTRIBUTE.finditer(attributes))


def parse(text: str) -> Node:
    """A tree of nodes whose children are nodes and strings; end tags that open nothing are ignored, and what is not
    closed ends with its parent."""
    root = Node("#root")
    stack = [root]
    at, n = 0, len(text)
    while at < n:
        m = TOKEN.search(text, at)
        if m is None:
            stack[-1].children.append(text[at:])
            break
        if m.start() > at:
            stack[-1].children.append(text[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in SCOPE and tag not in SCOPE:
                    k = 0
                    break
            else:
                k = 0
            if not k and tag == "p":
                stack[-1].children.append(Node("p"))  # an end without a start still parts blocks
            continue
        if tag in CLOSE_P or tag in CLOSES:
            closing = CLOSES.get(tag, set()) | ({"p"} if tag in CLOSE_P else set())
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in closing:
                    del stack[k:]
                    break
                if stack[k].tag in SCOPE:
                    break
        node = Node(tag, marks(m[3]))
        stack[-1].children.append(node)
        if tag in RAW and not m[3].endswith("/"):
            end = RAW_END[tag].search(text, at)
            if end is None:
                at = n
            else:
                close = text.find(">", end.end())
                at = n if close < 0 else close + 1
        elif tag not in VOID:
            stack.append(node)
    return root


def hashed(root: Node) -> None:
    """Sets every node's hash from its tag, marks and children; without recursion, so depth doesn't matter."""
    todo = [(root, False)]
    while todo:
        node, done = todo.pop()
        if not done:
            todo.append((node, True))
            todo += [(c, False) for c in node.children if isinstance(c, Node)]
        else:
            parts = [node.tag, node.marks, *(f"{c.hash:x}" if isinstance(c, Node) else " ".join(c.split()) for c in node.children)]
            node.hash = xxhash.xxh3_64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass")) >> 1


def words_in(node: Node) -> list[str]:
    """The parts of the node's class and id."""
    values = re.findall(r"(?:class|id)=([^=]*)(?=\s\S+=|$)", node.marks)
    return [w for x in values for w in re.split(r"[\s_-]+", x)]


def named(node: Node) -> bool:
    """Whether class or id name what is no main text."""
    return any(w in NAMES for w in words_in(node))


def length(node: Node, linked: bool = True) -> int:
    """Characters of text below a node that are no white space, elements that never count left out; linked: also in links."""
    n, todo = 0, [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            n += len("".join(x.split()))
        elif x.tag not in NEVER and (linked or x.tag != "a"):
            todo += x.children
    return n


def prose(node: Node) -> bool:
    """Running text: words enough outside of links."""
    words, todo = 0, [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            words += len(x.split())
        elif x.tag not in NEVER and x.tag != "a":
            todo += x.children
    return words >= PROSE_WORDS and length(node, False) >= (1 - LINKED) * length(node)


def unwanted(node: Node, inside: bool, whole: int | None = None) -> bool:
    """Whether a node is, by its kind or marks, no part of the main text. inside: within the article. whole: how much text
    there is in all; a frame that holds more than half of it does not go for its name."""
    if node.tag in NEVER or (node.tag == "header" and not inside):
        return True
    if node.marks:
        if re.search(r"(?:^|\s)hidden=|aria-hidden=true|display\s*:\s*none|role=(?:navigation|banner|contentinfo|complementary|search|dialog|alert|menu)", node.marks):
            return True
        # a paragraph of the article goes for its name only where it recurs, as a template
        if node.tag in ("article", "main", "body", "html") or (inside and node.tag in TEXTUAL) or not named(node):
            return False
        if inside and all(w in WEAK for w in words_in(node) if w in NAMES) and prose(node):
            return False
        return whole is None or 2 * length(node) <= whole or not may_wrap(node)
    return False


def may_wrap(node: Node) -> bool:
    """Whether a node that holds most of the text may be the page's frame in spite of its names: it holds a main element or
    heading, or is not named for what readers and advertisers write."""
    todo = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, Node):
            if x.tag in ("article", "main", "h1"):
                return True
            todo += x.children
    return not any(w in OTHERS for w in words_in(node))


def articles(root: Node, whole: int) -> list[Node]:
    """The outermost article and main elements in page order; those named as comments or the like only if all are. None if
    they are empty, or if what names itself the text beside them outweighs them."""
    found, beside, todo = [], 0, [root]
    while todo:
        node = todo.pop()
        if node is not root and unwanted(node, False, whole):
            continue
        if node.tag in ("article", "main"):
            found.append(node)
        else:
            if node.tag != "body" and node.marks and any(w in POSITIVE for w in words_in(node)):
                held = length(node) - sum(length(a) for a in outermost(node))
                beside = max(beside, held)
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    chosen = [a for a in found if not named(a)] or found
    own = sum(map(length, chosen))
    return chosen if own and OUTWEIGHS * own >= beside else []


def outermost(root: Node) -> list[Node]:
    """The article and main elements below root that are in no other."""
    found, todo = [], list(root.children)
    while todo:
        node = todo.pop()
        if isinstance(node, Node):
            if node.tag in ("article", "main"):
                found.append(node)
            else:
                todo += node.children
    return found


def template(node: Node, templates: frozenset[int], inside: bool, bare: bool) -> bool:
    if inside:
        return node.hash ^ INSIDE in templates and node.tag in HASHED_INSIDE and (bare or bool(node.marks) or node.tag not in TEXTUAL)
    return node.hash in templates and node.tag in HASHED


def blocks(root: Node, templates: frozenset[int], inside: bool, bare: bool = False, whole: int | None = None) -> list[str]:
    """The texts of the blocks below root in page order, without unwanted and template subtrees; bare: nor, inside,
    recurring paragraphs without class or id."""
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        if run:
            text = " ".join("".join(run).split())
            if text:
                out.append(text)
            run.clear()

    todo: list = [root]
    while todo:
        x = todo.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            run.append(references.unescape(x))  # each on its own: a reference ends where a tag begins
        elif x.tag == "br":
            run.append(" ")
        elif x is root or not (unwanted(x, inside, whole) or (templates and template(x, templates, inside, bare))):
            if x.tag in BLOCKS:
                close()
                todo.append(None)
            todo += reversed(x.children)
        elif x.tag in BLOCKS:
            close()
    close()
    return out


def main_text(html: str | None, templates: frozenset[int] = frozenset()) -> str:
    root = parse(html or "")
    if templates:
        hashed(root)
    size = length(root)
    chosen = articles(root, size)
    if not chosen:
        return "\n\n".join(blocks(root, templates, False, whole=size))
    out: list[str] = []
    for a in chosen:
        whole = blocks(a, frozenset(), True, whole=size)
        left = blocks(a, templates, True, whole=size) if templates else whole
        copied = left != whole and 2 * sum(map(len, blocks(a, templates, True, True, size))) < sum(map(len, whole))
        out += whole if copied else left
    return "\n\n".join(out)


def digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def occurrences(html: str | None) -> set[tuple[int, int, int]]:
    """(hash, kind, of): the subtrees of a page and the digest of the page or article they are in; hash 0 is that itself."""
    root = parse(html or "")
    hashed(root)
    size = length(root)
    chosen = articles(root, size)
    texts = ["\n\n".join(blocks(a, frozenset(), True, whole=size)) for a in chosen] or ["\n\n".join(blocks(root, frozenset(), False, whole=size))]
    page = digest("\n\n".join(texts))
    own = {id(a): digest(t) for a, t in zip(chosen, texts, strict=False)}
    found: set[tuple[int, int, int]] = {(0, OUTSIDE, page)}
    todo: list[tuple[Node, int | None]] = [(root, None)]
    while todo:
        node, of = todo.pop()
        if node.tag in ("article", "main") and chosen:
            if of is None and id(node) not in own:
                continue
            of = own.get(id(node), node.hash)
            found.add((0, WITHIN, of))
        elif of is None and node.tag in HASHED:
            found.add((node.hash, BARE if node.tag in TEXTUAL and not node.marks else OUTSIDE, page))
        elif of is not None and node.tag in HASHED_INSIDE:
            found.add((node.hash ^ INSIDE, WITHIN, of))
        todo += [(c, of) for c in node.children if isinstance(c, Node)]
    return found


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def subtree_counts(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, kind, hash, n): on how many distinct pages, or in how many distinct articles, of its host a subtree is.
    What is counted is dealt by page and subtree and then added up, so a host of a third of all pages is no hot key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, 2048):
            found = list({(name, *x) for name, text in zip(rows["host"], rows["html"], strict=True) for x in occurrences(text)})
            host, hash_, kind, of = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(hash_, pa.int64()), pa.array(kind, pa.int32()), pa.array(of, pa.int64())], names=["host", "hash", "kind", "of"])

    narrow = pages.select(host(F.col(f"`{url_col}`")).alias("host"), F.col(f"`{html_col}`").cast("string").alias("html"))
    return narrow.mapInArrow(run, "host string, hash long, kind int, of long").distinct().groupBy("host", "kind", "hash").agg(F.count("*").alias("n"))


def templates(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, hash) of the subtrees that recur. Hash 0 stands for the page or article itself and is never one."""
    within = (F.col("kind") == WITHIN).alias("within")
    counts = cut(subtree_counts(pages, url_col, html_col).where((F.col("hash") == 0) | (F.col("n") >= F.when(within, LEAST_INSIDE).otherwise(LEAST_OUTSIDE))))
    whole = counts.where("hash = 0").select("host", within, F.col("n").alias("pages"))
    need = F.greatest(F.least(F.lit(LEAST_PAGES), F.col("pages")), F.when(F.col("kind") == BARE, LEAST_SHARE * F.col("pages")).otherwise(0))
    return counts.where("hash <> 0").withColumn("within", within).join(whole, ["host", "within"]).where(F.col("n") >= need).select("host", "hash")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row for each page: page_id, url, text, n_chars."""
    spark = pages.sparkSession
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    schema = f"page_id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars long"
    found = cut(templates(pages, url_col, html_col))
    narrow = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), host(F.col(f"`{url_col}`")).alias("host"), F.col(f"`{html_col}`").cast("string").alias("html"))

    def made(batch: pa.RecordBatch, sets) -> pa.RecordBatch:
        texts = [main_text(h, s) for h, s in zip(batch.column("html").to_pylist(), sets, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    if found.count() <= BROADCAST_HASHES:
        by_host: dict[str, set[int]] = {}
        for r in found.collect():
            by_host.setdefault(r["host"], set()).add(r["hash"])
        get = share(spark, {k: frozenset(v) for k, v in by_host.items()})

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = get()
            for batch in batches:
                yield made(batch, [known.get(h, frozenset()) for h in batch.column("host").to_pylist()])

        return narrow.mapInArrow(near, schema)

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield made(batch, [frozenset(x or ()) for x in batch.column("hashes").to_pylist()])

    # a host's pages are dealt over salts, each of which has the host's hashes: no host is one key
    salts = F.explode(F.sequence(F.lit(0), F.lit(HOST_SALTS - 1))).alias("_salt")
    lists = found.groupBy("host").agg(F.collect_set("hash").alias("hashes")).select("host", "hashes", salts)
    dealt = narrow.withColumn("_salt", F.pmod(F.xxhash64("html"), F.lit(HOST_SALTS)).cast("int"))
    return dealt.join(lists, ["host", "_salt"], "left").drop("_salt").mapInArrow(far, schema)
