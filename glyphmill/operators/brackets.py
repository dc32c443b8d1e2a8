"""Tokens of a brace language and the tree of its brackets: what comments, strings, templates and regular expressions hide
is told apart in one pass, so that readers of code see words, marks and groups only."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}
_SPACE, _LINE = r"\s+", r"//[^\n]*"
_WORD = r"(?P<word>[^\W\d][\w]*)"
_NUMBER = r"(?P<number>\d(?:[\w]|\.(?=\d))*)"
_DOUBLE = r'"(?:\\(?s:.)|[^"\\\n])*"'
# What a language's tokens look like; block comments, templates and regular expressions have their own readers.
_TOKENS = {
    "rust": rf"""{_SPACE}|{_LINE}|(?P<string>[bc]?"(?:\\(?s:.)|[^"\\])*"|b?'(?:\\[^\n']*[^\n]|[^\\\n'])')|(?:'\w+)|(?:r\#)?{_WORD}|{_NUMBER}|(?P<mark>=>|->|::|==|<=|>=|!=|&&|\|\||(?s:.))""",
    "go": rf"""{_SPACE}|{_LINE}|(?P<string>{_DOUBLE}|`[^`]*`|'(?:\\[^\n']*[^\n]|[^\\\n'])')|{_WORD}|{_NUMBER}|(?P<mark>:=|==|<=|>=|!=|&&|\|\||<-|(?s:.))""",
    "typescript": rf"""{_SPACE}|{_LINE}|(?P<string>{_DOUBLE}|'(?:\\(?s:.)|[^'\\\n])*')|(?P<private>\#[\w$]+)|(?P<word>[^\W\d][\w$]*|\$[\w$]*)|{_NUMBER}|(?P<mark>=>|\?\.(?!\d)|===?|!==?|<=|>=|&&|\|\||\?\?|\.\.\.|\+\+|--|(?s:.))""",
}
_READERS = {lang: re.compile(p) for lang, p in _TOKENS.items()}
_READERS["tsx"] = _READERS["javascript"] = _READERS["typescript"]
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/\w*")
_TEMPLATE = re.compile(r"(?:\\(?s:.)|\$(?!\{)|[^`\\$])*(?:(?P<end>`)|(?P<hole>\$\{))?")
_COMMENT = re.compile(r"/\*|\*/")
_RAW = re.compile(r'[bc]?r(#*)"')
#: After these a slash begins a regular expression, and a brace a value.
BEFORE_VALUE = frozenset("return typeof case in of delete void throw new else do yield await instanceof default extends".split())
_HEADS = frozenset("if while for with switch catch".split())


@dataclass
class Tokens:
    """kinds: w word, s string, t template, n number, p private name, m mark. pair: of every bracket its partner, of what is
    never closed the end. block: opening braces that hold statements."""

    source: str
    texts: list[str] = field(default_factory=list)
    kinds: list[str] = field(default_factory=list)
    starts: list[int] = field(default_factory=list)
    lines: list[int] = field(default_factory=list)
    pair: dict[int, int] = field(default_factory=dict)
    parent: list[int] = field(default_factory=list)
    block: set[int] = field(default_factory=set)

    def __len__(self) -> int:
        return len(self.texts)

    def text(self, i: int) -> str:
        return self.texts[i] if 0 <= i < len(self.texts) else ""

    def kind(self, i: int) -> str:
        return self.kinds[i] if 0 <= i < len(self.kinds) else ""

    def after(self, i: int) -> int:
        """The token behind i, or behind the group that i opens."""
        return self.pair.get(i, i) + 1 if self.texts[i] in OPEN or self.texts[i] == "${" else i + 1

    def fresh(self, i: int) -> bool:
        """i is the first token of its line."""
        return i <= 0 or self.lines[i] > self.lines[i - 1]


def _comment_end(source: str, at: int, nested: bool) -> int:
    if not nested:
        end = source.find("*/", at + 2)
        return len(source) if end < 0 else end + 2
    depth = 0
    for m in _COMMENT.finditer(source, at):
        depth += 1 if m[0] == "/*" else -1
        if depth == 0:
            return m.end()
    return len(source)


def lex(lang: str, source: str) -> Tokens:
    """The tokens of source. A closing bracket that fits an outer one closes what stands open inside it; one that fits
    none is passed over."""
    out, at, line, counted = Tokens(source), 0, 1, 0
    reader, script = _READERS[lang], lang not in ("rust", "go")
    open_: list[int] = []
    held = dict.fromkeys((*OPEN, "${"), 0)

    def put(text: str, kind: str, start: int) -> int:
        nonlocal line, counted
        line, counted = line + source.count("\n", counted, start), start
        out.texts.append(text)
        out.kinds.append(kind)
        out.starts.append(start)
        out.lines.append(line)
        out.parent.append(open_[-1] if open_ else -1)
        return len(out.texts) - 1

    def template(start: int) -> int:
        m = _TEMPLATE.match(source, start)
        if m["hole"]:
            held["${"] += 1
            open_.append(put("${", "m", m.end() - 2))
        return m.end() if m.end() > start or m["end"] or m["hole"] else len(source)

    while at < len(source):
        if source.startswith("/*", at):
            at = _comment_end(source, at, lang == "rust")
            continue
        if lang == "rust" and source[at] in "rbc" and (m := _RAW.match(source, at)):
            put('"', "s", at)
            end = source.find(f'"{m[1]}', m.end())
            at = len(source) if end < 0 else end + 1 + len(m[1])
            continue
        if script and source[at] == "`":
            put("`", "t", at)
            at = template(at + 1)
            continue
        if script and source[at] == "/" and _begins_regex(out) and (m := _REGEX.match(source, at)):
            put("/", "s", at)
            at = m.end()
            continue
        m = reader.match(source, at)
        start, at = at, m.end()
        kind = m.lastgroup
        if kind is None:
            continue
        if kind in ("word", "private", "number", "string"):
            put(m["word"] if kind == "word" else m[0], kind[0], start)
            continue
        mark = m[0]
        if mark in OPEN:
            i = put(mark, "m", start)
            held[mark] += 1
            if mark == "{" and _is_block(out, i):
                out.block.add(i)
            open_.append(i)
        elif mark in CLOSE:
            fits = "${" if mark == "}" and held["${"] and not _brace_first(out, open_) else CLOSE[mark]
            if held[fits]:
                while True:
                    k = open_.pop()
                    held[out.texts[k]] -= 1
                    if out.texts[k] == fits:
                        break
                    out.pair[k] = len(out.texts)
                i = put(mark, "m", start)
                out.pair[k], out.pair[i] = i, k
                if fits == "${":
                    at = template(at)
        else:
            put(mark, "m", start)
    for k in open_:
        out.pair[k] = len(out.texts)
    return out


def _brace_first(out: Tokens, open_: list[int]) -> bool:
    """Of the braces that stand open, the innermost is a plain one."""
    for k in reversed(open_):
        if out.texts[k] in ("{", "${"):
            return out.texts[k] == "{"
    return False


def _begins_regex(out: Tokens) -> bool:
    i = len(out) - 1
    if i < 0:
        return True
    text, kind = out.texts[i], out.kinds[i]
    if kind == "w":
        return text in BEFORE_VALUE and out.text(i - 1) not in (".", "?.")
    if text == ")":  # behind the condition of a statement, not behind a call
        k = out.pair.get(i, 0)
        return out.text(k - 1) in _HEADS and out.text(k - 2) not in (".", "?.")
    if text == "}":
        return out.pair.get(i) in out.block
    if text == "<" and out.starts[i] + 1 == out.starts[i] + len(text) and out.source.startswith("/", out.starts[i] + 1):
        return False  # a closing tag
    return kind == "m" and text not in ("]", "++", "--")


def _is_block(out: Tokens, i: int) -> bool:
    """An opening brace holds statements, not a value: behind a condition, an arrow, a keyword or the end of a statement."""
    text, kind = out.text(i - 1), out.kind(i - 1)
    if i == 0 or text in (")", "=>", ";", "{", "}", "else", "do", "try", "finally"):
        return True
    return kind in ("w", "s", "n") and text not in BEFORE_VALUE or text in (">", "]")
