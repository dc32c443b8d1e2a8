"""Content types: by NUL bytes, by extension, else by structure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_blank, starts_any

# Extensions of each content type.
EXTENSIONS = {
    "json": "json jsonl ndjson",
    "markdown": "md markdown mdx",
    "log": "log",
    "plain_text": "txt text rst",
    "code": "rs ts tsx js jsx mjs cjs py go java c h cc cpp cxx hpp cs php rb swift kt kts scala sh bash zsh fish ps1 sql html htm css scss sass less vue svelte toml yaml yml xml ini gradle lua dart ex exs hs ml r",
}
# A line of a log, a level's name or a date: only where a character stands that one may have, a name in small letters by its colon.
LOG_LINE = r"(?=[EWIDTF:0-9])(?:ERROR|WARN|INFO|DEBUG|TRACE|FATAL|(?<=error|warning|info|debug|panic):|^[0-9]{4}[-/][0-9]{2}.{3}|^[0-9]{2}:[0-9]{2}:.{2})"
MARKDOWN_STARTS = ("# ", "## ", "### ", "- ", "* ", "> ", "| ", "```")
CODE_STARTS = ("fn ", "def ", "function ", "class ", "import ", "from ", "const ", "let ", "var ", "public ", "private ", "#include", "package ", "return ")
WINDOW = 8192
BLANKS = " \t\n\x0b\f\r"


def is_markdown_line(line: Column) -> Column:
    return starts_any(line, *MARKDOWN_STARTS)


def is_code_line(line: Column) -> Column:
    """By how it begins, or by its last character, be there a line end behind it."""
    return starts_any(line, *CODE_STARTS) | F.substring(line, -2, 2).rlike(r"[{;]$") | (line.startswith("}") & line.rlike(r"^\}$"))


def by_extension(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))
    out = F.lit(None).cast("string")
    for kind, names in EXTENSIONS.items():
        out = F.when(ext.isin(*names.split()), kind).otherwise(out)
    return out


def looks_like_json(text: Column) -> Column:
    t = F.rtrim(F.ltrim(text, F.lit(BLANKS)), F.lit(BLANKS))
    array = t.startswith("[") & t.endswith("]")
    return ((t.startswith("{") & t.endswith("}")) | array) & (t.contains(":") | (array & t.contains(",")))


def by_lines(text: Column) -> Column:
    """log, markdown, code or plain_text by the shares of the first 200 lines that look so; blank lines don't count. The
    lines are split and trimmed once for all three shares."""
    lines = F.filter(F.transform(F.slice(F.split(text, r"\r?\n"), 1, 200), lambda x: F.trim(x)), lambda x: x != "")
    looks = {"log": lambda x: x.rlike(LOG_LINE), "markdown": is_markdown_line, "code": is_code_line}
    start = F.struct(*[F.lit(0).alias(c) for c in ("n", "log", "markdown", "code")])
    step = lambda a, x: F.struct((a["n"] + 1).alias("n"), *[(a[c] + F.when(like(x), 1).otherwise(0)).alias(c) for c, like in looks.items()])
    kind = lambda a: F.when(a["n"] == 0, "plain_text").when(a["log"] / a["n"] >= 0.3, "log").when(a["markdown"] / a["n"] >= 0.2, "markdown").when(a["code"] / a["n"] >= 0.2, "code").otherwise("plain_text")
    return F.aggregate(lines, start, step, kind)


def sniff(text: Column) -> Column:
    return (
        F.when(is_blank(text), "plain_text")
        .when(looks_like_json(text), "json")
        .when(text.contains("\x1b"), "terminal")
        .otherwise(by_lines(text))
    )


def detect(text: Column, path: Column | None = None) -> Column:
    """The content type of a text, helped by a path. Only the first 8 KiB of characters are looked at."""
    window = F.substring(F.coalesce(text, F.lit("")), 1, WINDOW)
    return F.when(window.contains("\0"), "binary").otherwise(F.coalesce(by_extension(path), sniff(window)) if path is not None else sniff(window))
