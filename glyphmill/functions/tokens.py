"""Token estimates and budgets as column expressions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}"
SPACE = r"\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _each(chars: str) -> str:
    """Characters of ASCII as a class's members one by one, which a matcher looks up in a table."""
    return "".join(f"\\x{ord(c):02x}" for c in chars)


_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_'"
_MARKS = "".join(c for c in map(chr, range(128)) if c not in f"{_LETTERS}0123456789 \t\n\x0b\f\r")
_WORD = rf"[{_each(_LETTERS)}[\x{{80}}-\x{{10FFFF}}&&[\p{{L}}\p{{N}}\p{{M}}]&&[^{CJK}]]]"
_PUNCTUATION = rf"[{_each(_MARKS)}[\x{{80}}-\x{{10FFFF}}&&[^\p{{L}}\p{{N}}\p{{M}}{SPACE}]]]"
#: A whole word, or what is one token of anything else but CJK.
PIECE = rf"{_WORD}++|{_PUNCTUATION}{{1,2}}+|[\r\n]{{1,2}}+|[0-9]{{1,3}}+"


def count_heuristic(text: Column) -> Column:
    """Tokens of a text by runs: a word of up to 5 characters is one token, up to 9 two, else a token every 4; digits a
    token every 3; line breaks and punctuation a token every 2; each CJK character one; blanks none. Null counts 0. A text
    is scanned once, and once more for CJK if it goes beyond ASCII."""
    t = F.coalesce(text, F.lit(""))
    cost = lambda n: F.when(n <= 5, 1).when(n <= 9, 2).otherwise(F.shiftright(n + 3, 2))
    pieces = F.aggregate(F.regexp_extract_all(t, F.lit(PIECE), F.lit(0)), F.lit(0).cast("long"), lambda a, p: a + cost(F.length(p)))
    cjk = F.when(F.octet_length(t) > F.length(t), F.size(F.regexp_extract_all(t, F.lit(f"[{CJK}]"), F.lit(0)))).otherwise(0)
    return pieces + cjk.cast("long")


TOKENIZERS: dict[str, Callable[[Column], Column]] = {"heuristic": count_heuristic}


def tokenizer(name: str) -> Callable[[Column], Column]:
    """The tokenizer of that exact name."""
    if name not in TOKENIZERS:
        raise KeyError(f"unknown tokenizer {name!r}; available: {', '.join(available())}")
    return TOKENIZERS[name]


def available() -> list[str]:
    return sorted(TOKENIZERS)


def bpe_counter(ranks_path: str, pattern: str) -> Callable[[Column], Column]:
    """An exact byte-pair counter over a rank file; the vocabulary is loaded once a worker, and no more than one text's ids
    are held at a time."""
    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        coder = _coder(ranks_path, pattern)
        return pd.Series([len(coder.encode_ordinary(t)) for t in texts.fillna("")], dtype="int64")

    return count


_CODERS: dict[str, object] = {}


def _coder(path: str, pattern: str):
    if path not in _CODERS:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _CODERS[path] = tiktoken.Encoding("glyphmill", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _CODERS[path]


def fits(budget: Column, used: Column) -> Column:
    return used <= budget


def remaining(budget: Column, used: Column) -> Column:
    """What is left of a budget, never under 0."""
    return F.greatest(budget - used, F.lit(0).cast("long"))


def split_budget(budget: Column, share: Column) -> tuple[Column, Column]:
    """A share of the budget (clamped to 0..1, rounded down) and the rest."""
    part = F.floor(budget * F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))).cast("long")
    return part, budget - part
