"""Symbols, imports and calls of source files. Python is parsed, and where its parser refuses, piece by piece; of the brace
languages the tokens are read and their brackets paired, and heads, bodies, owners and calls are told from those. A function
that a constant is bound to is a symbol, but its calls belong to the definition around it."""

from __future__ import annotations

import ast
import posixpath
import re
import textwrap
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .brackets import BEFORE_VALUE, CLOSE, OPEN, lex

# Languages by extension.
LANGUAGES = {"rust": "rs", "typescript": "ts mts cts", "tsx": "tsx", "javascript": "js jsx mjs cjs", "python": "py pyi", "go": "go"}


def language(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.lit(None).cast("string")
    for name, exts in LANGUAGES.items():
        out = F.when(ext.isin(*exts.split()), name).otherwise(out)
    return out


def _python(source: str) -> Iterator[tuple]:
    """Definitions, imports and calls of a Python source. What its parser refuses is parsed piece by piece."""
    try:
        yield from _of_tree(ast.parse(source), 0, None)
    except (SyntaxError, ValueError, RecursionError):
        yield from _pieces(source.replace("\0", " ").split("\n"), 0, None)


def _of_tree(tree: ast.AST, shift: int, owner: str | None) -> Iterator[tuple]:
    todo: list[tuple[ast.AST, str | None]] = [(tree, owner)]
    while todo:
        node, owner = todo.pop()
        outer = getattr(node, "decorator_list", ())  # a decorator is called by what is around the definition
        inner = node.name if isinstance(node, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef) else owner
        if inner is not owner or outer:
            yield "symbol", "class" if isinstance(node, ast.ClassDef) else "function", None, node.name, node.lineno + shift, (node.end_lineno or node.lineno) + shift
        elif isinstance(node, ast.Import):
            for a in node.names:
                yield "import", "imports", None, a.name, node.lineno + shift, node.lineno + shift
        elif isinstance(node, ast.ImportFrom) and node.module != "__future__":
            yield "import", "imports", None, "." * node.level + (node.module or ""), node.lineno + shift, node.lineno + shift
        elif isinstance(node, ast.Call):
            f = node.func
            name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
            if name:
                yield "call", "calls", owner, name, node.lineno + shift, node.lineno + shift
        todo += [(child, owner if any(child is d for d in outer) else inner) for child in reversed(list(ast.iter_child_nodes(node)))]


_DEFINITION = re.compile(r"\s*(?:async\s+)?(def|class)\s+(\w+)")
_INDENT = re.compile(r"[ \t]*")
#: Nested blocks that broken Python is parsed by.
DEEPEST = 40


def _pieces(lines: list[str], shift: int, owner: str | None, depth: int = 0) -> Iterator[tuple]:
    """Each statement of the least indent by itself. Of a definition that does not parse the head counts, and its body is
    read the same way; any other statement is passed over."""
    indents = [len(_INDENT.match(x)[0].expandtabs()) if x.strip() and not x.lstrip().startswith("#") else None for x in lines]
    least = min((n for n in indents if n is not None), default=0)
    starts = [k for k, n in enumerate(indents) if n is not None and n <= least]
    starts = [k for k, before in zip(starts, [None, *starts], strict=False) if before is None or not lines[before].lstrip().startswith("@")]
    for k, end in zip(starts, [*starts[1:], len(lines)], strict=True):
        while end > k + 1 and not lines[end - 1].strip():
            end -= 1
        own = lines[k:end]
        try:
            yield from _of_tree(ast.parse(textwrap.dedent("\n".join(own))), shift + k, owner)
            continue
        except (SyntaxError, ValueError, RecursionError):
            pass
        while len(own) > 1 and own[0].lstrip().startswith("@"):
            try:
                yield from _of_tree(ast.parse(own[0].strip()[1:]), shift + k, owner)
            except (SyntaxError, ValueError):
                pass
            own, k = own[1:], k + 1
        m, inner = _DEFINITION.match(own[0]), owner
        if m:
            inner = m[2]
            yield "symbol", "class" if m[1] == "class" else "function", None, m[2], shift + k + 1, shift + end
        if len(own) > 1 and depth < DEEPEST:
            yield from _pieces(own[1:], shift + k + 1, inner, depth + 1)


_KEYWORDS = {
    "rust": frozenset("as async await break const continue crate dyn else enum extern fn for if impl in let loop match mod move mut pub ref return static struct super trait type unsafe use where while".split()),
    "go": frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()),
    "typescript": frozenset("if for while switch catch with return typeof await function class new in of do else case throw delete void yield instanceof super import export default extends var let const".split()),
}
_KEYWORDS["tsx"] = _KEYWORDS["javascript"] = _KEYWORDS["typescript"]
#: Marks between which a line may end without ending a type or an expression.
_JOINS = frozenset("| & = => , : ? + - * % ( [ { < . ?. && || ?? === !== == != extends keyof is in instanceof typeof readonly".split())


#: Tokens within which angle brackets must close.
NEAR = 100


class Reader:
    """Heads of definitions, imports and calls over the tokens of one source. Every token is looked at a bounded number of
    times: a head is followed only to its body or to what cannot be part of it."""

    def __init__(self, lang: str, source: str):
        self.lang, self.k, self.source = lang, lex(lang, source), source
        self.found: list[tuple] = []
        self.owners: list[tuple[int, int, str]] = []
        self.heads: set[int] = set()  # names that are no calls
        self.quiet = [0] * (len(self.k) + 2)  # where calls begin (+1) and cease (-1) to be types, patterns or macros

    def hush(self, a: int, b: int) -> None:
        if a < b:
            self.quiet[a] += 1
            self.quiet[min(b, len(self.k))] -= 1

    def symbol(self, kind: str, name: int, first: int, last: int) -> None:
        k = self.k
        self.heads.add(name)
        self.found.append(("symbol", kind, None, k.texts[name], k.lines[first], k.lines[max(first, min(last, len(k) - 1))]))

    def bring(self, target: str, first: int) -> None:
        self.found.append(("import", "imports", None, target, self.k.lines[first], self.k.lines[first]))

    def until(self, i: int, stops: tuple[str, ...], words: tuple[str, ...] = ()) -> int:
        """The first token from i on, past whole groups, that is one of stops or of words, closes a group, or ends all."""
        k = self.k
        while i < len(k) and k.texts[i] not in stops and k.texts[i] not in words and k.texts[i] not in CLOSE:
            i = k.after(i)
        return i

    def angles(self, i: int) -> int:
        """Behind the angle brackets that open at i, where there are any that close within one statement."""
        k, depth, at = self.k, 0, i
        while at < len(k) and at - i < NEAR:
            x = k.texts[at]
            if x == "<":
                depth += 1
            elif x in (">", ">="):
                depth -= 1
                if depth == 0:
                    return at + 1
            elif x == ";" or x in CLOSE or depth == 0:
                return i
            at = k.after(at)
        return i

    def modifiers(self, i: int, words: frozenset[str]) -> int:
        """Where the words (and their groups) in front of i begin."""
        k = self.k
        while i > 0:
            if k.texts[i - 1] in words or (k.kinds[i - 1] == "s" and k.text(i - 2) == "extern"):
                i -= 1
            elif k.texts[i - 1] == ")" and k.text(k.pair.get(i - 1, 0) - 1) == "pub":
                i = k.pair[i - 1]
            else:
                break
        return i

    def calls(self) -> None:
        k, keywords = self.k, _KEYWORDS[self.lang]
        spans, inside, at, hushed = sorted(self.owners), [], 0, 0
        for i in range(len(k)):
            hushed += self.quiet[i]
            while at < len(spans) and spans[at][0] <= i:
                inside.append(spans[at])
                at += 1
            while inside and inside[-1][1] < i:
                inside.pop()
            if hushed or k.kinds[i] != "w" or i in self.heads or (k.texts[i] in keywords and k.text(i - 1) not in (".", "?.")) or not self.called(i):
                continue
            self.found.append(("call", "calls", inside[-1][2] if inside else None, k.texts[i], k.lines[i], k.lines[i]))

    def called(self, i: int) -> bool:
        k, n = self.k, i + 1
        if self.lang == "go":
            if k.text(n) == "[" and k.pair[n] < len(k) and all(k.kinds[x] == "w" or k.texts[x] in (".", ",", "*", "[", "]") for x in range(n, min(k.pair[n], n + 40))):
                n = k.after(n)
            return k.text(n) == "(" and k.text(i - 1) not in ("func", "]")  # []byte(x) converts
        if self.lang == "rust":
            return k.text(n) == "(" and k.text(i - 1) != "fn"
        if k.text(n) == "?." and k.text(n + 1) in ("(", "<"):
            n += 1
        if k.text(n) == "<" and k.starts[n] == k.starts[i] + len(k.texts[i]):
            n = self.angles(n)
        if k.kind(n) == "t" and not k.fresh(n):
            return True
        if k.text(n) != "(" or k.text(i - 1) in ("function", "new") or (k.texts[i] == "async" and k.text(k.after(n)) == "=>"):
            return False
        while k.text(i - 1) == "." and k.kind(i - 2) == "w":
            i -= 2
        return k.text(i - 1) != "new"

    def read(self) -> list[tuple]:
        {"rust": self.rust, "go": self.go}.get(self.lang, self.script)()
        self.calls()
        return self.found

    # Rust: items, patterns of let and match, macros and attributes.

    def rust(self) -> None:
        k, i = self.k, 0
        modifiers = frozenset("pub async const unsafe extern default".split())
        while i < len(k):
            x, nxt = k.texts[i], k.text(i + 1)
            if x == "#" and (nxt == "[" or (nxt == "!" and k.text(i + 2) == "[")):
                j = i + 1 if nxt == "[" else i + 2
                self.hush(i, k.after(j))
                i = k.after(j)
                continue
            if k.kinds[i] != "w":
                i += 1
                continue
            if nxt == "!" and k.text(i + 2) != "=":
                j, name = i + 2, None
                if x == "macro_rules" and k.kind(j) == "w":
                    name, j = j, j + 1
                if k.text(j) in OPEN:
                    if name is not None:
                        self.symbol("function", name, i, k.pair[j])
                    self.hush(i, k.after(j))
                    i = k.after(j)
                    continue
            named = k.kind(i + 1) == "w"
            first = self.modifiers(i, modifiers) if x in ("fn", "struct", "enum", "trait", "mod", "type", "const", "static", "use") and k.kind(i + 1) in ("w", "m") and nxt not in modifiers else i
            if x == "fn" and named:
                body = self.until(i + 2, ("{", ";"), ("fn",) if k.text(i + 2) == "fn" else ())
                self.hush(i, body)
                self.heads.add(i + 1)
                if k.text(body) == "{":
                    self.symbol("function", i + 1, first, k.pair[body])
                    self.owners.append((i, k.pair[body], nxt))
            elif x in ("struct", "enum", "union") and named:
                end = self.until(i + 2, ("{", ";"), ("fn", "struct", "enum"))
                end = k.pair[end] if k.text(end) == "{" else end
                if x != "union":
                    self.symbol(x, i + 1, first, end)
                self.hush(i, end)
            elif x in ("trait", "mod") and named:
                end = self.until(i + 2, ("{", ";"), ("trait", "mod"))
                self.symbol("trait" if x == "trait" else "module", i + 1, first, k.pair.get(end, end))
                self.hush(i, end)
            elif x == "type" and named:
                end = self.until(i + 2, ("=", ";", "{"), ("type",))
                if k.text(end) == "=":
                    end = self.until(end + 1, (";", "{"), ("type",))
                    self.symbol("type", i + 1, first, end)
                self.hush(i, end)
            elif x in ("const", "static") and k.text(i - 1) not in ("<", ",", "*", "&"):
                name = i + 2 if nxt == "mut" else i + 1
                if k.kind(name) == "w" and k.text(name + 1) == ":":
                    value = self.until(name + 2, ("=", ";", "{"), ("const", "static"))
                    self.hush(name, value)
                    self.symbol("constant", name, first, self.until(value, (";",), ("const", "static", "fn")))
            elif x == "impl" and (i == 0 or k.text(i - 1) in (";", "}", "{", "]", "unsafe", "default")):
                end = self.until(i + 1, ("{", ";"), ("impl",))
                self.hush(i, end)
                if k.text(end) == "{" and (name := self.implemented(i + 1, end)) is not None:
                    self.symbol("class", name, first, k.pair[end])
            elif x == "use" and (i == 0 or k.text(i - 1) in (";", "}", "{", "]", "pub", ")")):
                end = self.until(i + 1, (";",), ("use", "fn", "struct"))
                stop = k.starts[end] if end < len(k) else len(self.source)
                if end > i + 1:
                    self.bring(self.source[k.starts[i + 1] : stop].strip(), first)
                self.hush(i, end)
            elif x == "let":
                self.hush(i, self.until(i + 1, ("=", ";", "{"), ("let",)))
            elif x == "for" and nxt != "<":
                self.hush(i, self.until(i + 1, ("{", ";"), ("in", "for")))
            elif x == "match" and k.text(i - 1) != ".":
                body = self.until(i + 1, ("{", ";"), ("match",))
                if k.text(body) == "{":
                    self.arms(body + 1, k.pair[body])
            i += 1

    def implemented(self, i: int, end: int) -> int | None:
        """The name of the type that an impl is for, if it is a bare one."""
        k = self.k
        i = self.angles(i) if k.text(i) == "<" else i
        depth, start, stop = 0, i, end
        while i < end:
            x = k.texts[i]
            depth += (x == "<") - (x == ">")
            if depth == 0 and x == "for" and k.text(i + 1) != "<":
                start = i + 1
            elif depth == 0 and x == "where":
                stop = i
                break
            i = k.after(i)
        primitive = "bool char str u8 u16 u32 u64 u128 usize i8 i16 i32 i64 i128 isize f32 f64".split()
        return start if stop == start + 1 and k.kind(start) == "w" and k.texts[start] not in primitive else None

    def arms(self, i: int, end: int) -> None:
        """The patterns of a match are no calls; guards and results may hold some."""
        k = self.k
        while i < end:
            stop = i
            while stop < end and k.texts[stop] not in ("=>", "if"):
                stop = k.after(stop)
            self.hush(i, stop)
            while stop < end and k.texts[stop] != "=>":
                stop = k.after(stop)
            i = stop + 1
            if k.text(i) == "{":
                i = k.after(i)
                i += k.text(i) == ","
                continue
            while i < end and k.texts[i] != ",":
                i = k.after(i)
            i += 1

    # Go: declarations at the beginning of a line.

    def go(self) -> None:
        k, i = self.k, 0
        while i < len(k):
            x = k.texts[i]
            if k.kinds[i] != "w":
                i += 1
                continue
            if x == "func" and k.parent[i] < 0 and k.fresh(i):
                name, kind = i + 1, "function"
                if k.text(name) == "(":
                    name, kind = k.after(name), "method"
                if k.kind(name) == "w" and k.text(name + 1) in ("(", "["):
                    j = k.after(name + 1)
                    j = k.after(j) if k.text(name + 1) == "[" and k.text(j) == "(" else j
                    while j < len(k) and not (k.texts[j] == "{" and k.texts[j - 1] not in ("struct", "interface")) and not (k.fresh(j) and k.kinds[j] == "w"):
                        j = k.after(j)
                    body = j < len(k) and k.texts[j] == "{"
                    last = k.pair[j] if body else j - 1
                    self.symbol(kind, name, i, last)
                    self.owners.append((i, last, k.texts[name]))
                    self.hush(i, j)
            elif x in ("type", "const", "import") and k.fresh(i) and k.text(i - 1) not in (".", ","):
                group = k.text(i + 1) == "("
                last = k.pair[i + 1] if group else i + 1
                at = i + 2 if group else i + 1
                while at < len(k) and (at < last if group else at == i + 1):
                    nxt = at + 1
                    while nxt < len(k) and not k.fresh(nxt) and k.texts[nxt] != ";" and not (group and nxt >= last):
                        nxt = k.after(nxt)
                    if x == "import":
                        path = next((s for s in range(at, min(nxt, at + 3)) if k.kinds[s] == "s"), None)
                        if path is not None and k.texts[path][0] == '"':
                            self.bring(k.texts[path].strip('"'), at if group else i)
                        self.hush(at, nxt)
                    elif x == "const":
                        s = at
                        while k.kind(s) == "w" and s < nxt:
                            self.symbol("constant", s, at, s)
                            s += 1
                            if k.text(s) != ",":
                                break
                            s += 1
                    elif k.kind(at) == "w":
                        self.go_type(at, i, last if group else nxt - 1)
                    at = nxt + 1 if k.text(nxt) == ";" else nxt
            i += 1

    def go_type(self, name: int, first: int, last: int) -> None:
        k, at = self.k, name + 1
        if k.text(at) == "[" and k.pair[at] - at > 2 and k.kind(at + 1) == "w" and (k.kind(at + 2) == "w" or k.text(at + 2) in (",", "*", "~", "interface")):
            at = k.after(at)
        x = k.text(at)
        if x == "=":
            self.hush(name, last + 1)
            return
        self.symbol(x if x in ("struct", "interface") else "type", name, first, last)
        self.hush(name, k.after(at + 1) if x in ("struct", "interface") and k.text(at + 1) == "{" else at + 1)

    # TypeScript and JavaScript: declarations, members of classes and of object literals, functions bound to constants.

    def begins(self, i: int) -> int | None:
        """Where the statement begins that i's words stand at the head of; None if i is within an expression."""
        k = self.k
        first = self.modifiers(i, frozenset("export default declare abstract async public static const".split()))
        own = self.modifiers(i, frozenset("declare abstract async const".split()))
        before = k.text(first - 1)
        if first == 0 or before in (";", "{", "}", ")") or k.kind(first - 1) == "s" or (k.fresh(first) and before not in _JOINS and before not in BEFORE_VALUE):
            return own
        return own if before in ("else", "do") else None

    def typed(self, i: int) -> int:
        """Behind the type that a colon at i leads in."""
        k, prev = self.k, ":"
        i += 1
        while i < len(k):
            x = k.texts[i]
            if x in (";", "=", ",", "=>") and not (x == "=>" and prev == ")") or x in CLOSE or x in ("function", "class", "const", "return"):
                return i
            if x == "{" and prev not in (":", "|", "&", "=>", "<", ",", "is", "extends", "?"):
                return i
            if k.fresh(i) and prev not in _JOINS and x not in ("|", "&", "?", ":", "."):
                return i
            past = self.angles(i) if x == "<" else i
            prev, i = (">", past) if past > i else (")" if x == "(" else x, k.after(i))
        return i

    def body_of(self, i: int) -> int | None:
        """The brace of the body of a function whose type parameters or parameters begin at i."""
        k = self.k
        i = self.angles(i) if k.text(i) == "<" else i
        if k.text(i) != "(":
            return None
        i = k.after(i)
        i = self.typed(i) if k.text(i) == ":" else i
        return i if k.text(i) == "{" else None

    def statement_end(self, i: int, mark: str = "") -> int:
        """The last token of the expression or type that begins at i; mark ends it too."""
        k = self.k
        while i < len(k):
            x = k.texts[i]
            if x == mark:
                return i - 1
            if x == ";" or x in CLOSE or (k.fresh(i) and k.text(i - 1) not in _JOINS and x not in _JOINS):
                return i if x == ";" else i - 1
            if x in ("const", "let", "var", "function", "interface", "export", "import") and k.fresh(i):
                return i - 1
            if x in ("const", "let", "type") and k.kind(i + 1) == "w" and k.text(i - 1) in ("=", "=>"):
                return i - 1
            i = k.after(i)
        return len(k) - 1

    def is_function(self, i: int) -> bool:
        """A value is an arrow function or a function expression."""
        k = self.k
        i += k.text(i) == "async" and k.text(i + 1) != "=>"
        if k.text(i) == "function":
            return True
        i = self.angles(i) if k.text(i) == "<" else i
        if k.text(i) == "(":
            i = k.after(i)
            i = self.typed(i) if k.text(i) == ":" else i
            return k.text(i) == "=>"
        return k.kind(i) == "w" and k.text(i + 1) == "=>"

    def script(self) -> None:
        k, classes = self.k, set()
        typed = self.lang != "javascript"
        for i in range(len(k)):
            if k.kinds[i] != "w" or k.text(i - 1) in (".", "?."):
                continue
            x, nxt = k.texts[i], k.text(i + 1)
            if x == "function":
                name = i + 2 if nxt == "*" else i + 1
                if k.kind(name) == "w":
                    body, first = self.body_of(name + 1), self.begins(i)
                    self.heads.add(name)
                    if body is not None and first is not None:
                        self.symbol("function", name, first, k.pair[body])
                        self.owners.append((first, k.pair[body], k.texts[name]))
            elif x == "class" and nxt not in (":", "=", ",", ")"):
                body = i + 1
                while body < len(k) and k.texts[body] not in ("{", ";", "class") and k.texts[body] not in CLOSE:
                    body = max(body + 1, self.angles(body)) if k.texts[body] == "<" else k.after(body)
                if k.text(body) == "{":
                    classes.add(body)
                    first = self.begins(i)
                    if k.kind(i + 1) == "w" and nxt not in ("extends", "implements") and first is not None:
                        self.symbol("class", i + 1, first, k.pair[body])
            elif x in ("interface", "enum") and typed and k.kind(i + 1) == "w" and (first := self.begins(i)) is not None:
                body = self.until(i + 2, ("{", ";"), ("interface", "enum"))
                if k.text(body) == "{":
                    self.symbol(x, i + 1, first, k.pair[body])
                    if x == "interface":
                        self.hush(i, k.pair[body])
            elif x == "type" and typed and k.kind(i + 1) == "w" and (first := self.begins(i)) is not None:
                at = self.angles(i + 2) if k.text(i + 2) == "<" else i + 2
                if k.text(at) == "=":
                    end = self.statement_end(at + 1)
                    self.symbol("type", i + 1, first, end)
                    self.hush(i, end + 1)
            elif x in ("const", "let"):
                self.bound(i)
            elif x in ("import", "export") and self.begins(i) is not None and nxt not in ("(", "."):
                self.source_of(i)
            elif k.parent[i] >= 0 and k.texts[k.parent[i]] == "{":
                self.member(i, classes)

    def bound(self, i: int) -> None:
        """Functions that const or let binds to names: all span the whole declaration."""
        k, at, names, end = self.k, i + 1, [], i
        while k.kind(at) == "w" and k.texts[at] not in _KEYWORDS[self.lang]:
            value = self.typed(at + 1) if k.text(at + 1) == ":" else at + 1
            if k.text(value) != "=":
                break
            if self.is_function(value + 1):
                names.append(at)
            end = self.statement_end(value + 1, ",")
            if k.text(end + 1) != ",":
                break
            at = end + 2
        for name in names:
            self.symbol("function", name, i, end)

    def source_of(self, i: int) -> None:
        """The module that an import or export names."""
        k, x, at = self.k, self.k.texts[i], i + 1
        if x == "import" and k.kind(at) == "s":
            self.bring(k.texts[at][1:-1], i)
            return
        while at < len(k) and (k.kinds[at] == "w" or k.texts[at] in ("{", "*", ",")) and k.texts[at] not in ("import", "export", "const", "function", "class"):
            if k.texts[at] == "from" and k.kind(at + 1) == "s":
                self.bring(k.texts[at + 1][1:-1], i)
                return
            at = k.after(at)

    def member(self, i: int, classes: set[int]) -> None:
        """A method of a class or of an object literal; one without body, and what is declared, is no call either."""
        k, holder = self.k, self.k.parent[i]
        if k.text(i + 1) not in ("(", "<") or (holder not in classes and (holder in k.block or k.texts[i] in ("if", "for", "while", "switch", "catch", "with"))):
            return
        first = self.modifiers(i, frozenset("static async get set public private protected readonly override abstract declare * accessor".split()))
        before = k.text(first - 1)
        if not (before in ("{", "}", ";", ",") or (holder in classes and (before == ")" or k.fresh(first)) and before not in _JOINS)):
            return
        body = self.body_of(i + 1)
        if body is not None:
            self.symbol("method", i, first, k.pair[body])
            self.owners.append((first, k.pair[body], k.texts[i]))
        elif holder in classes:
            self.heads.add(i)


def _specific(rows: list[tuple]) -> Iterator[tuple]:
    """One symbol for each line and name: not a type alias or a variable if there is another; then imports and calls."""
    best: dict[tuple, tuple] = {}
    for r in rows:
        if r[0] == "symbol":
            key = (r[4], r[3])
            if key not in best or (best[key][1] in ("type", "variable") and r[1] not in ("type", "variable")):
                best[key] = r
    yield from (best[x] for x in sorted(best))
    yield from dict.fromkeys(r for r in rows if r[0] != "symbol")


def extract(lang: str | None, source: str) -> list[tuple[str, str, str | None, str | None, int, int]]:
    """(what, kind, from_symbol, name, start_line, end_line) of a source's symbols, imports and calls, each once."""
    if lang is None:
        return []
    return list(_specific(list(_python(source)) if lang == "python" else Reader(lang, source).read()))


def intelligence(files: DataFrame) -> DataFrame:
    """files: root, path, content. Their symbols, imports and calls as rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for root, path, lang, source in zip(*(batch.column(c).to_pylist() for c in ("root", "path", "language", "content")), strict=True):
                rows += [(root, path, lang, *x) for x in extract(lang, source or "")]
            names = ("root", "path", "language", "what", "kind", "from_symbol", "name", "start_line", "end_line")
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string() if i < 7 else pa.int32()) for i in range(9)], names=list(names))

    typed = files.select("root", "path", language(F.col("path")).alias("language"), "content").where("language IS NOT NULL")
    return typed.mapInArrow(run, "root string, path string, language string, what string, kind string, from_symbol string, name string, start_line int, end_line int")


def candidates(lang: str, path: str, target: str) -> list[str]:
    """The paths that an import may mean, likeliest first."""
    here = posixpath.dirname(path)
    if lang in ("javascript", "typescript", "tsx"):
        if not target.startswith("."):
            return []
        base = posixpath.normpath(posixpath.join(here, target))
        if base.startswith(".."):
            return []
        stem = re.sub(r"\.(?:js|jsx|mjs|cjs)$", "", base)
        exts = ("ts", "tsx", "js", "jsx", "mjs", "cjs")
        return list(dict.fromkeys([base, *(f"{stem}.{e}" for e in exts), *(f"{base}/index.{e}" for e in exts)]))
    if lang == "python":
        dots = len(target) - len(target.lstrip("."))
        parts = [p for p in target[dots:].split(".") if p]
        roots = []
        if dots:
            at = here
            for _ in range(dots - 1):
                at = posixpath.dirname(at)
            roots = [at]
        else:
            at = here
            while True:
                roots.append(at)
                if not at:
                    break
                at = posixpath.dirname(at)
            roots.append("src")
        out = []
        for r in roots:
            base = posixpath.join(r, *parts) if parts or r else ""
            out += [f"{base}.py", posixpath.join(base, "__init__.py")]
        return list(dict.fromkeys(x for x in out if x not in (".py", "__init__.py") or dots))
    if lang == "rust":
        parts = target.split("::")
        name = posixpath.basename(path)
        module = here if name in ("mod.rs", "lib.rs", "main.rs") else path[: -len(".rs")]
        head, *rest = parts
        if head == "crate":
            at = path.split("/src/")[0] + "/src" if "/src/" in path else "src"
        elif head == "self":
            at = module
        elif head == "super":
            at = posixpath.dirname(module)
            while rest and rest[0] == "super":
                at, rest = posixpath.dirname(at), rest[1:]
        else:
            at = f"crates/{head.replace('_', '-')}/src"
        out = []
        for n in range(len(rest), 0, -1):
            base = posixpath.join(at, *rest[:n])
            out += [f"{base}.rs", f"{base}/mod.rs"]
        return [*out, posixpath.join(at, "lib.rs"), f"{at}.rs", posixpath.join(at, "mod.rs")]
    return []


def import_candidates(found: DataFrame) -> DataFrame:
    """Imports of intelligence() with their candidate paths."""
    @F.pandas_udf("array<string>")
    def tried(lang: pd.Series, path: pd.Series, target: pd.Series) -> pd.Series:
        return pd.Series([candidates(*x) for x in zip(lang, path, target, strict=True)])

    return found.where("what = 'import'").select("root", "path", F.col("name").alias("target"), tried("language", "path", "name").alias("candidates"))
