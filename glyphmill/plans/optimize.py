"""The optimisation pipelines: log, tool output, text, conservative text, JSON and passthrough, and their router.

Every pipeline gives doc_id, optimizer, original_tokens, filtering, deduplication, compression, selection (signed
savings that sum to the total), optimized_tokens and text.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from ..functions import text as T
from ..functions.detect import detect
from ..functions.tokens import count_heuristic
from ..lineage import cut
from ..operators import fragments as R
from ..operators import vectors

SAVINGS = ("filtering", "deduplication", "compression", "selection")


TOOLS = ("git", "test", "build", "tool")


def _fragments(docs: DataFrame, route: Column, lines: bool = False, profile: Column | None = None, near: float | None = None) -> DataFrame:
    """The distinct fragments of each document, which also has its route, by_line and original_tokens: idx, content, cost,
    filtered (cost before duplicates went) and n. What a document's route asks for is chosen row by row, so all routes
    share one scan and one grouping by fragment key. A document without fragments keeps one empty row."""
    is_tool = route.isin(*TOOLS)
    by_line = is_tool | (route == "log") | F.lit(lines)
    parts = F.when(by_line, R.lines_of(F.col("text"))).otherwise(R.blocks_of(F.col("text")))
    # measured before the explosion: beside it, Spark would count the whole text once for every fragment
    measured = docs.select("doc_id", route.alias("route"), (profile if profile is not None else route).alias("profile"), by_line.alias("by_line"), count_heuristic(F.col("text")).alias("original_tokens"), parts.alias("parts"))
    rows = measured.select("doc_id", "route", "profile", "by_line", "original_tokens", F.posexplode_outer("parts").alias("idx", "content"))
    r, content = F.col("route"), F.col("content")
    cleaned = rows.withColumn("content", F.when((r == "log") | r.isin(*TOOLS), T.strip_ansi(content)).otherwise(content))
    noise = F.when(r == "log", T.is_progress_noise(content)).when(r.isin(*TOOLS), T.is_tool_noise(content, F.col("profile"))).otherwise(F.lit(False))
    kept = cleaned.withColumn("content", F.when(content.isNotNull() & ~noise, T.trimmed(content)))
    kept = kept.withColumn("content", F.when(~T.is_blank(content), content))
    key = F.when(content.isNull(), None).when(r == "log", T.message_key(content)).when(r == "text-conservative", F.col("idx").cast("string")).otherwise(T.collapse_space(content))
    kept = kept.withColumn("key", key).withColumn("cost", F.when(content.isNotNull(), count_heuristic(content) + 1).otherwise(0))
    once = kept.groupBy("doc_id", "route", "by_line", "original_tokens", "key").agg(F.min(F.struct("idx", "content", "cost")).alias("f"), F.count("*").alias("n"), F.sum("cost").alias("filtered"))
    told = r.isin("log", *TOOLS) & (F.col("n") > 1)
    said = F.when(told, T.repeated(F.col("f.content"), F.col("n"))).otherwise(F.col("f.content"))
    once = once.select("doc_id", "route", "by_line", "original_tokens", "filtered", "n", F.col("f.idx").alias("idx"), F.when(F.col("key").isNotNull(), said).alias("content"), F.when(~told, F.col("f.cost")).alias("cost"))
    once = once.withColumn("apart", content.isNotNull())
    if near is not None:
        alike = _collapsed(once.where((r == "text") & content.isNotNull()), near)
        once = once.where((r != "text") | content.isNull()).unionByName(alike)
    # what a fragment cost before stands where its text does
    return once.withColumn("cost", F.when(content.isNotNull(), F.coalesce(F.col("cost"), count_heuristic(content) + 1)).otherwise(0))


def _collapsed(once: DataFrame, threshold: float) -> DataFrame:
    """Fragments that say the same as an earlier one of their document lose their content, and that one says how many went.
    Documents are the groups, as likeness is only looked for within one; each gets a number, as its id may be anything."""
    rows = cut(once)
    numbers = cut(rows.select("doc_id").distinct().withColumn("grp", F.monotonically_increasing_id()))
    numbered = rows.join(numbers, "doc_id")
    embedded = cut(vectors.embedded(numbered.select("grp", F.col("idx").cast("long").alias("idx"), "content"), "content"))
    owned = cut(vectors.collapse_redundant(embedded, "grp", "idx", "v", threshold))
    alike = owned.groupBy("grp", F.col("kept_id").alias("idx")).agg((F.count("*") - 1).alias("_more"))
    told = numbered.join(alike, ["grp", "idx"], "left")
    said = F.when(F.col("_more") > 0, F.concat("content", F.lit("\n\n("), F.col("_more").cast("string"), F.lit(" more alike)"))).otherwise(F.col("content"))
    return told.withColumn("content", F.when(F.col("_more").isNotNull(), said)).withColumn("cost", F.when(F.col("_more") == 0, F.col("cost"))).select(*once.columns)


def _measured(docs: DataFrame, route: Column, budget: int | None, lines: bool = False, profile: Column | None = None, near: float | None = None) -> DataFrame:
    """The staged pipelines in one pass, with one more grouping by document."""
    once, content = _fragments(docs, route, lines, profile, near), F.col("content")
    fits = content.isNotNull()
    if budget is not None:
        running = F.sum("cost").over(Window.partitionBy("doc_id").orderBy(F.coalesce("idx", F.lit(-1))).rowsBetween(Window.unboundedPreceding, 0))
        once = once.withColumn("running", running)
        fits = fits & (F.col("running") <= budget)
    ordered = F.array_sort(F.collect_list(F.when(fits, F.struct("idx", "content"))))
    found = F.coalesce(F.sum(F.when(F.col("apart"), F.col("n"))), F.lit(0)).alias("fragments")
    apart = F.count_if("apart").alias("apart")
    whole = once.groupBy("doc_id", "route", "by_line", "original_tokens").agg(found, apart, F.sum("filtered").alias("f"), F.sum("cost").alias("d"), F.coalesce(F.sum(F.when(fits, F.col("cost"))), F.lit(0)).alias("s"), ordered.alias("kept"))
    said = F.transform("kept", lambda x: x["content"])
    joined = F.when(F.col("by_line"), F.array_join(said, "\n")).otherwise(F.array_join(said, "\n\n"))
    return whole.select(
        "doc_id",
        F.col("route").alias("optimizer"),
        "original_tokens",
        (F.col("original_tokens") - F.col("f")).alias("filtering"),
        (F.col("f") - F.col("d")).alias("deduplication"),
        F.lit(0).cast("long").alias("compression"),
        (F.col("d") - F.col("s")).alias("selection"),
        F.col("s").alias("optimized_tokens"),
        F.when(F.size("kept") > 0, F.concat(joined, F.lit("\n"))).otherwise(F.lit("")).alias("text"),
        "fragments",
        (F.col("fragments") - F.col("apart")).alias("duplicates"),
    )


def _staged(docs: DataFrame, route: Column, budget: int | None, lines: bool = False, profile: Column | None = None, near: float | None = None) -> DataFrame:
    return _measured(docs, route, budget, lines, profile, near).drop("fragments", "duplicates")


def log(docs: DataFrame, budget: int | None = None) -> DataFrame:
    return _staged(docs, F.lit("log"), budget)


def tool(docs: DataFrame, budget: int | None = None) -> DataFrame:
    """docs have a command column, whose profile names the noise."""
    return _staged(docs, F.lit("tool"), budget, profile=T.command_profile(F.col("command")))


def tool_lines(lines: DataFrame, order: list[str], budget: int | None = None) -> DataFrame:
    """The tool pipeline over documents that come as their lines (doc_id, command, line and what orders them in a document;
    a line is not empty, has no line ends and no byte order mark, or is null, which is none), without the text: no document
    is made whole, so what a task holds goes with a document's distinct lines. Its estimate is that of its lines and of a
    line feed between each two. A document has one command and a line at least."""
    rows, content = lines.where("line IS NOT NULL"), F.col("content")
    raw = rows.groupBy("doc_id", "command", F.col("line").alias("content")).agg(F.min(F.struct(*order)).alias("idx"), F.count("*").alias("n"))
    raw = raw.withColumn("tokens", count_heuristic(content))
    profile = T.command_profile(F.col("command"))
    cleaned = raw.withColumn("content", T.trimmed(T.strip_ansi(content)))
    noise = T.is_blank(content) | T.is_tool_noise(content, profile)
    kept = cleaned.withColumn("content", F.when(~noise, content))
    kept = kept.withColumn("key", F.when(content.isNotNull(), T.collapse_space(content))).withColumn("cost", F.when(content.isNotNull(), count_heuristic(content) + 1).otherwise(0))
    once = kept.groupBy("doc_id", "key").agg(F.min(F.struct("idx", "content", "cost")).alias("f"), F.sum("n").alias("n"), F.sum(F.col("tokens") * F.col("n")).alias("tokens"), F.sum(F.col("cost") * F.col("n")).alias("filtered"))
    said = T.repeated(F.col("f.content"), F.col("n"))
    once = once.withColumn("cost", F.when(F.col("key").isNull(), 0).when(F.col("n") > 1, count_heuristic(said) + 1).otherwise(F.col("f.cost")))
    fits = F.col("key").isNotNull()
    if budget is not None:
        running = F.sum("cost").over(Window.partitionBy("doc_id").orderBy(F.col("key").isNull(), "f.idx").rowsBetween(Window.unboundedPreceding, 0))
        once, fits = once.withColumn("running", running), fits & (F.col("running") <= budget)
    whole = once.groupBy("doc_id").agg((F.sum("tokens") + F.sum("n") - 1).alias("original_tokens"), F.sum("filtered").alias("f"), F.sum("cost").alias("d"), F.coalesce(F.sum(F.when(fits, F.col("cost"))), F.lit(0)).alias("s"))
    zero = F.lit(0).cast("long").alias("compression")
    return whole.select("doc_id", F.lit("tool").alias("optimizer"), "original_tokens", (F.col("original_tokens") - F.col("f")).alias("filtering"), (F.col("f") - F.col("d")).alias("deduplication"), zero, (F.col("d") - F.col("s")).alias("selection"), F.col("s").alias("optimized_tokens"))


def text(docs: DataFrame, budget: int | None = None, how: str = "blocks", near: float | None = None) -> DataFrame:
    """near: fragments whose hashed embeddings are that alike count as duplicates too, after the exact ones."""
    return _staged(docs, F.lit("text"), budget, lines=how == "lines", near=near)


def analyze(docs: DataFrame, how: str = "lines") -> DataFrame:
    """doc_id, original_tokens, optimized_tokens, fragments, duplicates of the text pipeline without a budget, from its
    one grouping; both counts are null for a document without fragments."""
    some = lambda c: F.when(F.col("fragments") > 0, F.col(c)).alias(c)
    return _measured(docs, F.lit("text"), None, lines=how == "lines").select("doc_id", "original_tokens", "optimized_tokens", some("fragments"), some("duplicates"))


def conservative(docs: DataFrame, budget: int | None = None) -> DataFrame:
    return _staged(docs, F.lit("text-conservative"), budget)


def passthrough(docs: DataFrame, budget: int | None = None) -> DataFrame:
    """Unchanged, whatever the budget."""
    n = F.col("original_tokens")
    counted = docs.select("doc_id", "text", count_heuristic(F.col("text")).alias("original_tokens"))
    return counted.select("doc_id", F.lit("passthrough").alias("optimizer"), n, *[F.lit(0).cast("long").alias(s) for s in SAVINGS], n.alias("optimized_tokens"), "text")


# Items of an array and characters of a string that are kept, step by step.
LADDER = ((100, 512), (50, 256), (20, 128), (10, 64), (5, 32), (2, 32))


def _refused(word: str):
    raise ValueError(word)


def _finite(digits: str) -> float:
    x = float(digits)
    return x if math.isfinite(x) else _refused(digits)


def _loads(data: str):
    """JSON and nothing beside it: no NaN or Infinity, and no number too large for a double."""
    return json.loads(data, parse_constant=_refused, parse_float=_finite)


def parse_json(data: str) -> list | None:
    """The values of a JSON text or of JSON lines, which end at line feeds alone; None if it is neither."""
    try:
        return [_loads(data)]
    except (ValueError, RecursionError):
        pass
    try:
        values = [_loads(x) for x in data.split("\n") if x.strip()]
        return values or None
    except (ValueError, RecursionError):
        return None


def render_json(values: list) -> str:
    return "\n".join(json.dumps(v, separators=(",", ":"), ensure_ascii=False) for v in values)


def shrink_value(value, items: int, chars: int):
    """Longer arrays and strings are cut, with a note of how much is left out."""
    if isinstance(value, list):
        kept = [shrink_value(v, items, chars) for v in value[:items]]
        return kept if len(value) <= items else [*kept, f"{len(value) - items} more items omitted"]
    if isinstance(value, dict):
        return {k: shrink_value(v, items, chars) for k, v in value.items()}
    if isinstance(value, str) and len(value) > chars:
        return f"{value[:chars]}... {len(value) - chars} more characters omitted"
    return value


def extent(values: list) -> tuple[int, int]:
    """The items of the longest array in some values and the characters of the longest string."""
    items = chars = 0
    left = list(values)
    while left:
        v = left.pop()
        if isinstance(v, list):
            items = max(items, len(v))
            left.extend(v)
        elif isinstance(v, dict):
            left.extend(v.values())
        elif isinstance(v, str):
            chars = max(chars, len(v))
    return items, chars


def ladder(values: list) -> tuple[list[str], bool]:
    """The compact text and what each step of the ladder makes of the values, without what says the same as the one before;
    and whether the first step says the same as the compact text. No text is made for a step that cuts nothing."""
    texts, spared = [render_json(values)], False
    longest = extent(values)
    for k, (items, chars) in enumerate(LADDER):
        cuts = longest[0] > items or longest[1] > chars
        text = render_json([shrink_value(v, items, chars) for v in values]) if cuts else texts[0]
        if text != texts[-1]:
            texts.append(text)
        elif k == 0:
            spared = True
    return texts, spared


def json_ladder(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, valid, spared, steps: the compact text, and the texts of the ladder's steps that differ from the one
    before; spared if the first step's is the compact one."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid, spared, steps = [], [], []
            for data in batch.column("text").to_pylist():
                values = parse_json(data or "")
                texts, same = ladder(values) if values is not None else ([data or ""], False)
                valid.append(values is not None)
                spared.append(same)
                steps.append(texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(valid, pa.bool_()), pa.array(spared, pa.bool_()), pa.array(steps, pa.list_(pa.string()))], names=["doc_id", "text", "valid", "spared", "steps"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, text string, valid boolean, spared boolean, steps array<string>")


def json_choices(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and more) with original_tokens, compact (the cost of the compact text; null for what is no JSON)
    and choices (need, cost, text): the text is that of the first choice whose need fits a budget, else of the last. A text
    ends with a line feed, which costs a token; whether a step of the ladder fits is asked without it, so a compact text
    that a step says again needs no more than that step. What is no JSON keeps its lines that are not blank, at the cost it
    had. A text's tokens are counted once."""
    made = json_ladder(docs).withColumn("original_tokens", count_heuristic(F.col("text")))
    tokens = lambda s: F.when(s == F.col("text"), F.col("original_tokens")).otherwise(count_heuristic(s))
    counted = F.transform("steps", lambda s: F.struct(tokens(s).alias("n"), s.alias("s")))
    at = F.transform(counted, lambda x, k: F.struct((x["n"] + F.when((k == 0) & ~F.col("spared"), 1).otherwise(0)).alias("need"), (x["n"] + 1).alias("cost"), F.concat(x["s"], F.lit("\n")).alias("text")))
    lines = R.lines_of(F.col("text"))
    kept = F.when(F.size(lines) > 0, F.concat(F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, r"\r+$", "")), "\n"), F.lit("\n"))).otherwise(F.lit(""))
    one = F.array(F.struct(F.lit(0).cast("long").alias("need"), F.col("original_tokens").alias("cost"), kept.alias("text")))
    made = made.withColumn("choices", F.when(F.col("valid"), at).otherwise(one))
    return made.select("doc_id", "original_tokens", F.when(F.col("valid"), F.col("choices")[0]["cost"]).alias("compact"), "choices")


def chosen(choices: Column, room: Column) -> Column:
    """The first choice that fits in room, else the last."""
    return F.coalesce(F.get(F.filter(choices, lambda x: x["need"] <= room), F.lit(0)), F.element_at(choices, -1))


def json_text(docs: DataFrame, budget: int | None = None) -> DataFrame:
    """Compact JSON; over a budget the first step of the ladder that fits, else the last. What is no JSON is unchanged but
    for its blank lines."""
    made = json_choices(docs)
    first = F.get("choices", F.lit(0))
    made = made.withColumn("chosen", chosen(F.col("choices"), F.lit(budget).cast("long")) if budget is not None else first)
    base = F.coalesce("compact", "original_tokens")
    return made.select(
        "doc_id",
        F.lit("json").alias("optimizer"),
        "original_tokens",
        F.lit(0).cast("long").alias("filtering"),
        F.lit(0).cast("long").alias("deduplication"),
        (F.col("original_tokens") - base).alias("compression"),
        (base - F.col("chosen.cost")).alias("selection"),
        F.col("chosen.cost").alias("optimized_tokens"),
        F.col("chosen.text").alias("text"),
    )


def route(content_type: Column, command: Column | None = None, disabled: bool = False) -> Column:
    """The first optimizer that takes a document: git, test, build, json, log, tool, text, text-conservative, passthrough."""
    if disabled:
        return F.lit("passthrough")
    profile = T.command_profile(command) if command is not None else F.lit(None).cast("string")
    has = command.isNotNull() if command is not None else F.lit(False)
    return (
        F.when(has & (content_type != "json") & profile.isin("git", "test", "build"), profile)
        .when(content_type == "json", "json")
        .when(content_type.isin("log", "terminal"), "log")
        .when(has, "tool")
        .when(content_type.isin("plain_text", "markdown"), "text")
        .when(content_type == "code", "text-conservative")
        .otherwise("passthrough")
    )


def routed(docs: DataFrame) -> DataFrame:
    """docs with their route, which is told once and kept: each route's branch reads its own rows from there. The content
    type is a column of its own, as a route asks for it several times."""
    command = F.col("command") if "command" in docs.columns else None
    path = F.col("path") if "path" in docs.columns else None
    typed = docs.withColumn("_type", detect(F.col("text"), path))
    return cut(typed.withColumn("route", route(F.col("_type"), command)).drop("_type"))


def optimize(docs: DataFrame, budget: int | None = None) -> DataFrame:
    """Every document by its own pipeline: one routing column, then a pass for the staged routes, one for JSON and one
    for what passes through."""
    told = routed(docs)
    staged = _staged(told.where(~F.col("route").isin("json", "passthrough")), F.col("route"), budget)
    return staged.unionByName(json_text(told.where("route = 'json'"), budget)).unionByName(passthrough(told.where("route = 'passthrough'"), budget))


def report(optimized: DataFrame) -> DataFrame:
    """Totals by optimizer; ratios come from sums."""
    sums = optimized.groupBy("optimizer").agg(F.count("*").alias("documents"), *[F.sum(c).alias(c) for c in ("original_tokens", *SAVINGS, "optimized_tokens")])
    return sums.withColumn("reduction", F.round(scores.reduction_ratio(F.col("original_tokens"), F.col("optimized_tokens")), 6))


def compile_sections(sections: DataFrame, budget: int, header_tokens: Column) -> DataFrame:
    """Documents of a compilation in order (group_id, position, tokens): each gets what the ones before it left, less its
    header. The recurrence is sequential, so a group's rows are folded in one array; groups are single requests."""
    rows = sections.withColumn("header", header_tokens)
    ordered = F.array_sort(F.collect_list(F.struct("position", "header", "tokens")))
    grouped = rows.groupBy("group_id").agg(ordered.alias("rows"))

    def step(acc, r):
        room = F.greatest(acc["left"] - r["header"], F.lit(0).cast("long"))
        used = F.least(room, r["tokens"])
        made = F.struct(r["position"].alias("position"), room.alias("allowance"), used.alias("used"))
        return F.struct(F.greatest(acc["left"] - r["header"] - used, F.lit(0).cast("long")).alias("left"), F.concat(acc["out"], F.array(made)).alias("out"))

    start = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast("array<struct<position:bigint,allowance:bigint,used:bigint>>").alias("out"))
    return grouped.select("group_id", F.explode(F.aggregate("rows", start, step, lambda a: a["out"])).alias("x")).select("group_id", "x.*")


def compile_documents(docs: DataFrame, budget: int) -> DataFrame:
    """One document for each group_id of docs (group_id, position, label, text, and command and path where there are any):
    sections by position, each under a header that names its label and reference, optimised by its own route within what
    the sections before it left. Gives group_id, text, original_tokens, optimized_tokens (of the whole document, headers
    included), the stages' merged savings and sections (position, label, reference, optimizer, original_tokens,
    optimized_tokens).

    What an allowance buys is only known in the recurrence, so each section comes with all it may cost: the running costs of
    its fragments as far as the budget can reach, or the steps of its JSON, or its whole text. Sections behind the headers
    that use up the budget by themselves bring no fragments and only the last of their choices, so what a group's fold holds
    is bounded by the budget but for texts that no budget shortens."""
    base = docs.withColumn("doc_id", F.struct("group_id", "position"))
    named = base.withColumn("reference", T.to_uri(T.context_id(F.col("text")))).withColumn("header", T.section_header(F.col("label"), F.col("reference")))
    headed = named.withColumn("head", count_heuristic(F.concat("header", F.lit("\n"))))
    in_order = Window.partitionBy("group_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    told = routed(headed.withColumn("room", F.greatest(F.lit(budget) - F.sum("head").over(in_order), F.lit(0).cast("long"))))
    pieces_type, choices_type = "array<struct<upto:bigint,content:string>>", "array<struct<need:bigint,cost:bigint,text:string>>"
    none = lambda kind: F.lit(None).cast(kind)

    staged = told.where(~F.col("route").isin("json", "passthrough"))
    once = _fragments(staged.withColumn("doc_id", F.struct("group_id", "position", "room")), F.col("route"))
    running = F.sum("cost").over(Window.partitionBy("doc_id").orderBy(F.coalesce("idx", F.lit(-1))).rowsBetween(Window.unboundedPreceding, 0))
    held = F.when(F.col("content").isNotNull() & (F.col("running") <= F.col("doc_id.room")), F.struct(F.col("running").alias("upto"), "content"))
    by_doc = once.withColumn("running", running).groupBy("doc_id", "by_line", "original_tokens").agg(F.sum("filtered").alias("f"), F.sum("cost").alias("d"), F.array_sort(F.collect_list(held)).alias("pieces"))
    saved = ((F.col("original_tokens") - F.col("f")).alias("filtering"), (F.col("f") - F.col("d")).alias("deduplication"), F.lit(0).cast("long").alias("compression"))
    by_doc = by_doc.select(F.struct("doc_id.group_id", "doc_id.position").alias("doc_id"), "original_tokens", "by_line", *saved, "pieces", none(choices_type).alias("choices"))

    zero = [F.lit(0).cast("long").alias(c) for c in ("filtering", "deduplication")]
    rest = (F.lit(True).alias("by_line"), *zero)
    json_docs = json_choices(told.where("route = 'json'").select("doc_id", "text"))
    by_json = json_docs.select("doc_id", "original_tokens", *rest, (F.col("original_tokens") - F.coalesce("compact", "original_tokens")).alias("compression"), none(pieces_type).alias("pieces"), F.col("choices").cast(choices_type).alias("choices"))
    n = count_heuristic(F.col("text"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("need"), n.alias("cost"), F.col("text").alias("text")))
    passed = told.where("route = 'passthrough'").select("doc_id", n.alias("original_tokens"), *rest, F.lit(0).cast("long").alias("compression"), none(pieces_type).alias("pieces"), whole.alias("choices"))
    per = by_doc.unionByName(by_json).unionByName(passed)

    heads = told.select("doc_id", "label", "reference", "header", "head", "room", F.col("route").alias("optimizer"))
    near = F.when((F.col("room") > 0) | (F.size("choices") <= 1), F.col("choices")).otherwise(F.slice("choices", -1, 1))
    section = F.struct("doc_id.position", "label", "reference", "header", "head", "optimizer", "original_tokens", "by_line", "filtering", "deduplication", "compression", "pieces", near.alias("choices"))
    ordered = F.array_sort(F.collect_list("s"), lambda a, b: F.when(a["position"] < b["position"], -1).when(a["position"] > b["position"], 1).otherwise(0))
    grouped = per.join(heads, "doc_id").select("doc_id.group_id", section.alias("s")).groupBy("group_id").agg(ordered.alias("rows"))

    def step(acc, r):
        room = F.greatest(acc["left"] - r["head"], F.lit(0).cast("long"))
        prefix = F.coalesce(F.array_max(F.transform(F.filter(r["pieces"], lambda p: p["upto"] <= room), lambda p: p["upto"])), F.lit(0).cast("long"))
        used = F.when(r["choices"].isNull(), prefix).otherwise(chosen(r["choices"], room)["cost"])
        return F.struct(F.greatest(acc["left"] - r["head"] - used, F.lit(0).cast("long")).alias("left"), F.concat(acc["out"], F.array(F.struct(room.alias("room"), used.alias("used")))).alias("out"))

    start = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast("array<struct<room:bigint,used:bigint>>").alias("out"))
    done = grouped.withColumn("out", F.aggregate("rows", start, step, lambda a: a["out"]))

    def part(r, o):
        said = F.transform(F.filter(r["pieces"], lambda p: p["upto"] <= o["used"]), lambda p: p["content"])
        joined = F.when(r["by_line"], F.array_join(said, "\n")).otherwise(F.array_join(said, "\n\n"))
        text = F.when(r["choices"].isNotNull(), chosen(r["choices"], o["room"])["text"]).when(F.size(said) > 0, F.concat(joined, F.lit("\n"))).otherwise(F.lit(""))
        return F.when(~T.is_blank(text), F.concat(r["header"], F.lit("\n"), text))

    total = lambda value: F.aggregate(F.zip_with("rows", "out", value), F.lit(0).cast("long"), lambda a, x: a + x)
    of = lambda c: lambda r, o: r[c]
    cost = lambda r, o: r["original_tokens"] - r["filtering"] - r["deduplication"] - r["compression"] - o["used"]
    said = lambda r, o: F.struct(r["position"].alias("position"), r["label"].alias("label"), r["reference"].alias("reference"), r["optimizer"].alias("optimizer"), r["original_tokens"].alias("original_tokens"), o["used"].alias("optimized_tokens"))
    return done.withColumn("text", F.array_join(F.array_compact(F.zip_with("rows", "out", part)), "\n")).select(
        "group_id",
        "text",
        total(lambda r, o: r["original_tokens"]).alias("original_tokens"),
        count_heuristic(F.col("text")).alias("optimized_tokens"),
        *[total(of(c)).alias(c) for c in ("filtering", "deduplication", "compression")],
        total(cost).alias("selection"),
        F.zip_with("rows", "out", said).alias("sections"),
    )
