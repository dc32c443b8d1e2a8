"""Files as frames: recursive scans with ignore rules and size caps, readers, project detection, sinks."""

from __future__ import annotations

import re
from typing import IO

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.detect import detect

MAX_SCANNED = 2 * 1024 * 1024
MAX_READ = 16 * 1024 * 1024
# What a scan leaves out before any ignore file is read.
DEFAULT_IGNORES = (
    ".git/ .hg/ .svn/ node_modules/ target/ dist/ build/ out/ .next/ .nuxt/ .svelte-kit/ .venv/ venv/ __pycache__/ .mypy_cache/ .pytest_cache/ .ruff_cache/ .tox/ .gradle/ vendor/ coverage/ .cache/ .idea/ .vscode/ *.min.js *.min.css"
).split()
# Marker files of languages and package managers.
MARKERS = {"Cargo.toml": "rust", "pyproject.toml": "python", "requirements.txt": "python", "setup.py": "python", "package.json": "javascript", "tsconfig.json": "typescript", "go.mod": "go"}

# Frameworks by package, and (ecosystem, markers, manager by lock file, usual manager).
FRAMEWORKS = {"next": "next.js", "nuxt": "nuxt", "react": "react", "vue": "vue", "svelte": "svelte", "@angular/core": "angular", "express": "express", "fastify": "fastify", "@nestjs/core": "nestjs", "astro": "astro"}
MANAGERS = (
    ("rust", ("Cargo.toml",), {}, "cargo"),
    ("go", ("go.mod",), {}, "go"),
    ("python", ("pyproject.toml", "requirements.txt", "setup.py"), {"poetry.lock": "poetry", "uv.lock": "uv", "Pipfile.lock": "pipenv"}, "pip"),
    ("node", ("package.json",), {"pnpm-lock.yaml": "pnpm", "yarn.lock": "yarn", "bun.lockb": "bun", "package-lock.json": "npm"}, "npm"),
)


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression: * stays in a path part, ** crosses parts, ? is one character but a slash."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(pattern[i], re.escape(pattern[i]))
            i += 1
    return out


def glob_match(pattern: str, text: str) -> bool:
    return re.fullmatch(glob_regex(pattern), text) is not None


def ignore_rules(*sources: str | list[str]) -> list[tuple[str, bool]]:
    """(regular expression over a path, ignored) of every rule in order. A rule with a slash inside is anchored; one
    that ends with a slash is for directories, so for whatever lies below; ! takes back."""
    rules = []
    for line in (x for s in sources for x in (s.splitlines() if isinstance(s, str) else s)):
        rule = line.strip()
        if not rule or rule.startswith("#"):
            continue
        ignored = not rule.startswith("!")
        rule = rule.lstrip("!")
        only_dir, body = rule.endswith("/"), rule.strip("/")
        anchored = "/" in rule.rstrip("/")
        rules.append((("^" if anchored else "^(?:.*/)?") + glob_regex(body) + ("/.*$" if only_dir else "(?:/.*)?$"), ignored))
    return rules


def is_ignored(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """The last rule that matches decides."""
    out = F.lit(False)
    for pattern, ignored in rules:
        out = F.when(path.rlike(pattern), F.lit(ignored)).otherwise(out)
    return out


def walk(spark: SparkSession, root: str, gitignore: str = "", extra: list[str] | None = None, max_bytes: int = MAX_SCANNED) -> DataFrame:
    """(root, path, size, mtime_ms, ignored, too_large) of every file below root; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    base = re.sub(r"^file:/+", "/", root).rstrip("/") + "/"
    path = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + re.escape(base), "")
    rules = ignore_rules(DEFAULT_IGNORES, gitignore, extra or [])
    return found.select(F.lit(root).alias("root"), path.alias("path"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime_ms")).withColumn("ignored", is_ignored(F.col("path"), rules)).withColumn("too_large", F.col("size") > max_bytes)


def walk_report(walked: DataFrame) -> DataFrame:
    return walked.agg(F.count_if(~F.col("ignored") & ~F.col("too_large")).alias("files"), F.count_if("ignored").alias("ignored"), F.count_if(~F.col("ignored") & F.col("too_large")).alias("too_large"))


def read(spark: SparkSession, root: str, max_bytes: int = MAX_READ) -> DataFrame:
    """(path, content) of text files up to max_bytes; binary ones and invalid UTF-8 are left out, line ends normalised."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= max_bytes)
    return from_bytes(found.select("path", F.col("content").alias("data")))


def from_bytes(rows: DataFrame) -> DataFrame:
    text = F.try_validate_utf8(F.col("data").cast("string"))
    return rows.where(text.isNotNull() & ~text.contains("\0")).withColumn("content", T.normalize(text)).drop("data")


def from_text(rows: DataFrame, text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """Contexts from texts: id, content, content type, byte length."""
    content = T.normalize(F.col(text_col))
    return rows.withColumn("content", content).withColumns({"id": T.context_id(F.col("content")), "content_type": detect(F.col("content"), F.col(path_col) if path_col else None), "byte_len": F.octet_length("content").cast("long")})


def from_reader(spark: SparkSession, reader: IO[bytes], max_bytes: int = MAX_READ) -> DataFrame:
    """One context of what a stream such as sys.stdin.buffer gives: no row for binary data or invalid UTF-8; more than
    max_bytes is an error, as cut text would be another text."""
    data = reader.read(max_bytes + 1)
    if len(data) > max_bytes:
        raise ValueError(f"more than {max_bytes} bytes to read")
    return from_text(from_bytes(spark.createDataFrame([(bytearray(data),)], "data binary")), "content")


def _objects_keys(text: Column, *paths: str) -> Column:
    """Names within the JSON objects at paths; none where text is no JSON or holds something else there."""
    return F.concat(*[F.coalesce(F.json_object_keys(F.get_json_object(text, p)), F.array().cast("array<string>")) for p in paths])


def describe_projects(files: DataFrame) -> DataFrame:
    """files: root, path, content (needed of package.json only). (root, languages, frameworks, package_manager, git) of
    roots with a marker file or a .git folder. One manager counts, in the order of MANAGERS; a lock file tells which of a
    language's it is, and a manifest that names its own is right."""
    at_root = files.where(~F.col("path").contains("/") | F.col("path").startswith(".git/"))
    seen = at_root.groupBy("root").agg(
        F.collect_set(F.when(F.col("path").isin(*MARKERS, *[x for _, _, locks, _ in MANAGERS for x in locks]), F.col("path"))).alias("marks"),
        F.bool_or((F.col("path") == ".git") | F.col("path").startswith(".git/")).alias("git"),
        F.max(F.when(F.col("path") == "package.json", F.col("content"))).alias("manifest"),
    )
    has = lambda *names: F.arrays_overlap("marks", F.array(*map(F.lit, names)))
    needs = _objects_keys(F.col("manifest"), "$.dependencies", "$.devDependencies")
    languages = [F.when(F.array_contains("marks", m), F.lit(lang)) for m, lang in MARKERS.items()] + [F.when(F.array_contains("needs", "typescript"), F.lit("typescript"))]
    tools = []
    for _, markers, locks, usual in MANAGERS:
        tool = F.lit(usual)
        for lock, name in reversed(locks.items()):
            tool = F.when(F.array_contains("marks", lock), name).otherwise(tool)
        tools.append(F.when(has(*markers), tool))
    declared = F.nullif(F.substring_index(F.get_json_object("manifest", "$.packageManager"), "@", 1), F.lit(""))
    known = [F.when(F.array_contains("needs", package), F.lit(name)) for package, name in FRAMEWORKS.items()]
    named = lambda found: F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))
    told = seen.withColumn("needs", needs).select("root", named(languages).alias("languages"), named(known).alias("frameworks"), F.coalesce(declared, *tools).alias("package_manager"), "git")
    return told.where((F.size("languages") > 0) | F.col("git"))


def detect_projects(files: DataFrame) -> DataFrame:
    """(root, languages) by the marker files at each root."""
    known = F.create_map(*[F.lit(x) for kv in MARKERS.items() for x in kv])
    return files.where(F.col("path").isin(*MARKERS)).groupBy("root").agg(F.array_sort(F.collect_set(F.element_at(known, F.col("path")))).alias("languages"))


def as_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct("*")).alias("value"))
