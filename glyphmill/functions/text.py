"""Text predicates, normalisers and keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ANSI = r"\x1b(?:\[[^@-~]*(?:[@-~]|$)|\](?s:.*?)(?:\x07|\x1b\\|$)|(?s:.))?"
_FIELD = r"(?=(?:[^\s0-9]*[0-9]){4})(?=(?:[^\s:./+TZ-]*[:./+TZ-]){2})[0-9:./+TZ-]+(?=\s|$)"
TIME_FIELDS = rf"^{_FIELD}\s*(?:{_FIELD}\s*)?"
VOLATILE = r"(?<!\S)(?=\S*[0-9])[0-9A-Fa-f_-]{8,}(?!\S)"
# What a progress bar is drawn with.
BAR_CHARS = "=#-█▓▒░━─>"
BAR_FRAME = r"\[\]\(\)\|%\s.:/"


def normalize(text: Column) -> Column:
    """Without a byte order mark, with line feeds for every kind of line end."""
    return F.regexp_replace(F.regexp_replace(text, "^\\x{FEFF}", ""), "\\r\\n?", "\n")


def strip_ansi(line: Column) -> Column:
    return F.regexp_replace(line, ANSI, "")


def is_progress_noise(line: Column) -> Column:
    """A blank line, or one of bar characters (a run of 3 at least), frames and digits alone."""
    t = F.trim(line)
    bars = "".join("\\" + c if c in "-" else c for c in BAR_CHARS)
    return (t == "") | (t.rlike(rf"^[{bars}{BAR_FRAME}0-9]+$") & t.rlike(rf"[{bars}]{{3,}}"))


def message_key(line: Column) -> Column:
    """A log line without its bracket prefix, leading time fields, numbers and volatile ids."""
    k = F.regexp_replace(F.trim(line), r"^\[[^\]]*\]\s*", "")
    for pattern, by in ((TIME_FIELDS, ""), (VOLATILE, "#"), ("[0-9]+", "#"), (r"\s", " ")):
        k = F.regexp_replace(k, pattern, by)
    return F.rtrim(k)


def collapse_space(text: Column) -> Column:
    # blanks that are one space stay as they are
    return F.trim(F.regexp_replace(text, r"\s{2,}|[^\S ]", " "))


def trimmed(text: Column) -> Column:
    """Every line without blanks at its end, without blank lines at the start and end. Lines are made only of what has such."""
    lines = F.array_join(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"\s+$", "")), "\n")
    bare = F.regexp_replace(F.regexp_replace(lines, r"^\n+", ""), r"\n+$", "")
    return F.when(text.rlike(r"\s(?:[\r\n\x{85}\x{2028}\x{2029}]|\z)|\A\n"), bare).otherwise(text)


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(r"\S")


def starts_any(line: Column, *prefixes: str) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | line.startswith(p)
    return out


# How lines of git begin that only give advice, and one such whole line.
GIT_NOISE = ('(use "git ', "(commit or discard", "nothing added to commit but untracked files present")
GIT_NOISE_LINE = 'no changes added to commit (use "git add" and/or "git commit -a")'
# How lines of test runners begin or end that tell of passed tests alone.
TEST_NOISE, TEST_PASSED, TEST_OK = ("✓ ", "PASS ", "--- PASS", "=== RUN"), " PASSED", ("test ", " ... ok")
# Programs that make a command a test or a build, alone or with a second word.
NODE_TOOLS = ("npm", "pnpm", "yarn", "bun")
TEST_TOOLS = ("pytest", "jest", "vitest", "gotestsum", "phpunit", "rspec")
BUILD_TOOLS = ("make", "gradle", "mvn", "tsc", "webpack", "vite", "docker")
BUILD_WORDS = {"cargo": ("build", "check", "clippy", "run"), "go": ("build", "vet"), "node": ("install", "ci", "run", "build")}


def is_git_noise(line: Column) -> Column:
    t = F.trim(line)
    return starts_any(t, *GIT_NOISE) | (t == GIT_NOISE_LINE)


# How lines of build tools begin that tell of progress alone.
BUILD_NOISE = ("Compiling ", "Downloading ", "Downloaded ", "Updating ", "Fresh ", "Installing ", "Blocking ", "Adding ")


def is_build_noise(line: Column) -> Column:
    return starts_any(F.trim(line), *BUILD_NOISE)


def is_test_noise(line: Column) -> Column:
    t = F.trim(line)
    return (t.startswith(TEST_OK[0]) & t.endswith(TEST_OK[1])) | starts_any(t, *TEST_NOISE) | t.endswith(TEST_PASSED) | is_build_noise(line)


def command_profile(command: Column) -> Column:
    """git, test, build or tool, by the first two words of a command."""
    ws = F.split(F.trim(command), r"\s+")
    first, second = F.coalesce(F.get(ws, F.lit(0)), F.lit("")), F.coalesce(F.get(ws, F.lit(1)), F.lit(""))
    node = first.isin(*NODE_TOOLS)
    test = first.isin(*TEST_TOOLS) | ((first.isin("cargo", "go") | node) & (second == "test"))
    build = first.isin(*BUILD_TOOLS) | (node & second.isin(*BUILD_WORDS["node"]))
    for tool in ("cargo", "go"):
        build = build | ((first == tool) & second.isin(*BUILD_WORDS[tool]))
    return F.when(first == "git", "git").when(test, "test").when(build, "build").otherwise("tool")


def is_tool_noise(line: Column, profile: Column) -> Column:
    return F.when(profile == "git", is_git_noise(line)).when(profile == "test", is_test_noise(line)).when(profile == "build", is_build_noise(line)).otherwise(F.lit(False))


def identifier_tokens(text: Column) -> Column:
    """Lower-case words of a text; identifiers split at case changes and at all but letters and digits."""
    t = F.regexp_replace(text, r"(?<=[\p{Ll}\p{N}])(?=\p{Lu})", " ")
    t = F.regexp_replace(t, r"(?<=\p{Lu}{2})(?=\p{Lu}\p{Ll})", " ")
    return F.filter(F.split(F.lower(t), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def ngrams(word: Column, n: int = 4, longest_bytes: int = 32) -> Column:
    """The n-character parts of a word that is longer than n characters and not longer than longest_bytes bytes."""
    made = F.transform(F.sequence(F.lit(1), F.length(word) - (n - 1)), lambda i: F.substring(word, i, F.lit(n)))
    return F.when((F.length(word) > n) & (F.octet_length(word) <= longest_bytes), made).otherwise(F.array().cast("array<string>"))


def content_hash(data: Column) -> Column:
    return F.sha2(data, 256)


def context_id(content: Column) -> Column:
    """32 hex digits of a tagged hash of the content."""
    return F.substring(F.sha2(F.concat(F.lit(b"context\0"), F.encode(content, "UTF-8")), 256), 1, 32)


def to_uri(ident: Column, scheme: str = "context") -> Column:
    return F.concat(F.lit(f"{scheme}://"), ident)


def parse_id(reference: Column) -> Column:
    """The id in a bare id or URI; null if there is none."""
    got = F.regexp_extract(F.lower(F.trim(reference)), r"^(?:[a-z]+://)?([0-9a-f]{32})$", 1)
    return F.when(got != "", got)


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def label(kind: Column, ref: Column) -> Column:
    """What names a source: its reference if it has one, else its kind."""
    return F.when(F.coalesce(ref, F.lit("")) != "", ref).otherwise(kind)


def section_header(kind: Column, ref: Column) -> Column:
    return F.when(F.coalesce(ref, F.lit("")) != "", F.concat(F.lit("=== "), kind, F.lit(" ("), ref, F.lit(") ==="))).otherwise(F.concat(F.lit("=== "), kind, F.lit(" ===")))


def repeated(content: Column, n: Column) -> Column:
    return F.when(n > 1, F.concat(content, F.lit("  (repeated "), n.cast("string"), F.lit(" times)"))).otherwise(content)


def escape_like(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\%_])", r"\\$1")


def first_match_line(text: Column, terms: list[str]) -> Column:
    """The 1-based number of the first line that holds a term, in lower case; null if none does."""
    hit = F.transform(F.split(F.lower(text), "\n"), lambda x: F.greatest(*[x.contains(t) for t in terms]) if len(terms) > 1 else x.contains(terms[0]))
    at = F.array_position(hit, F.lit(True))
    return F.when(at > 0, at)


def snippet(text: Column, line: Column, height: int = 3) -> Column:
    """The lines around a 1-based line, without blanks at their ends."""
    lines = F.split(text, "\n")
    start = F.greatest(F.lit(1), F.least(line - height // 2, F.size(lines) - (height - 1))).cast("int")
    return F.array_join(F.transform(F.slice(lines, start, F.lit(height)), lambda x: F.regexp_replace(x, r"\s+$", "")), "\n")
