"""Symbols, imports, calls and their owners in six languages."""

import time

import pytest
from glyphmill.operators import code


def told(lang, source):
    got = code.extract(lang, source)
    return [(k, n, a, b) for w, k, _, n, a, b in got if w == "symbol"], [(f, n) for w, _, f, n, *_ in got if w == "call"], [n for w, _, _, n, *_ in got if w == "import"]


def named(lang, source, kind):
    return sorted(n for k, n, _, _ in told(lang, source)[0] if k == kind)


RUST = """use crate::store::{A, B};
// fn hidden() {}
pub struct Point(u8, u8);
pub trait Shape {
    fn area(&self) -> f64;
    fn name(&self) -> String { label("{") }
}
impl<T: Ord> Shape for Point {
    fn area(&self) -> f64 {
        let q = |x| { helper(x) };
        self.scale(q('}'))
    }
}
mod tests {
    fn outer() {
        fn inner() { deep(); }
        shallow::call();
    }
}
pub fn last(x: [u8; 4]) -> u8 { pick(x) }
"""
TYPESCRIPT = """import {
  a,
} from "./x.js";
export class Store extends Base {
  constructor(x) { super(x); setup(); }
  async get(id: string): Promise<string> {
    if (id) { return this.load(id); }
    return `}${id}`;
  }
}
export const arrow = (x: number) => {
  return twice(new Thing(x));
};
interface Shape { area(): number }
"""
GO = """package main
import (
\t"fmt"
\tx "a/b"
)
type Reader interface {
\tRead(p []byte) int
}
const (
\tTwo = 2
)
func (s *Store) Get(id string) string {
\treturn fmt.Sprint(load(id), "}")
}
"""


def test_brackets_give_ends_and_owners():
    symbols, calls, imports = told("rust", RUST)
    assert symbols == [
        ("struct", "Point", 3, 3), ("trait", "Shape", 4, 7), ("function", "name", 6, 6), ("class", "Point", 8, 13), ("function", "area", 9, 12),
        ("module", "tests", 14, 19), ("function", "outer", 15, 18), ("function", "inner", 16, 16), ("function", "last", 20, 20),
    ]
    assert calls == [("name", "label"), ("area", "helper"), ("area", "scale"), ("area", "q"), ("inner", "deep"), ("outer", "call"), ("last", "pick")] and imports == ["crate::store::{A, B}"]
    symbols, calls, imports = told("typescript", TYPESCRIPT)
    assert symbols == [("class", "Store", 4, 10), ("method", "constructor", 5, 5), ("method", "get", 6, 9), ("function", "arrow", 11, 13), ("interface", "Shape", 14, 14)]
    assert calls == [("constructor", "setup"), ("get", "load"), (None, "twice")] and imports == ["./x.js"]
    symbols, calls, imports = told("go", GO)
    assert symbols == [("interface", "Reader", 6, 8), ("constant", "Two", 10, 10), ("method", "Get", 12, 14)]
    assert calls == [("Get", "Sprint"), ("Get", "load")] and imports == ["fmt", "a/b"]


def test_rust_definitions_imports_and_calls():
    source = "use crate::net::Link;\nuse std::collections::BTreeMap;\n\npub struct Login {\n    pub key: String,\n}\n\npub trait Check {\n    fn passes(&self) -> bool;\n}\n\npub fn admit(key: &str) -> bool {\n    let link = Link::dial();\n    link.ask(key)\n}\n"
    assert named("rust", source, "struct") == ["Login"] and named("rust", source, "trait") == ["Check"] and named("rust", source, "function") == ["admit"]
    _, calls, imports = told("rust", source)
    assert imports == ["crate::net::Link", "std::collections::BTreeMap"] and calls == [("admit", "dial"), ("admit", "ask")]


def test_typescript_definitions_and_imports():
    source = "import { Pool } from './pool';\nimport web from 'web';\n\nexport interface Person {\n  id: string;\n}\n\nexport type PersonId = string;\n\nexport class People {\n  find(id: PersonId): Person | undefined {\n    return this.pool.lookup(id);\n  }\n}\n\nexport const admit = async (key: string) => {\n  return check(key);\n};\n"
    symbols, calls, imports = told("typescript", source)
    assert [(k, n) for k, n, *_ in symbols] == [("interface", "Person"), ("type", "PersonId"), ("class", "People"), ("method", "find"), ("function", "admit")]
    assert imports == ["./pool", "web"] and calls == [("find", "lookup"), (None, "check")]


def test_python_definitions_and_imports():
    source = "import os\nfrom .net import Link\nfrom typing import Any\n\nclass Logins:\n    def get(self, key):\n        return self.kept.lookup(key)\n\ndef admit(key):\n    held = Logins()\n    return held.get(key)\n"
    symbols, calls, imports = told("python", source)
    assert symbols == [("class", "Logins", 5, 7), ("function", "get", 6, 7), ("function", "admit", 9, 11)]
    assert imports == ["os", ".net", "typing"] and calls == [("get", "lookup"), ("admit", "Logins"), ("admit", "get")]


def test_go_definitions_and_imports():
    source = 'package main\n\nimport (\n    "fmt"\n    "example.org/x/db"\n)\n\ntype Person struct {\n    ID string\n}\n\ntype Shelf interface {\n    Find(id string) (*Person, error)\n}\n\ntype PersonID string\n\ntype Same = PersonID\n\nfunc Admit(key string) bool {\n    fmt.Println(key)\n    return true\n}\n\nfunc (p *Person) Name() string {\n    return p.ID\n}\n'
    symbols, calls, imports = told("go", source)
    assert [(k, n) for k, n, *_ in symbols] == [("struct", "Person"), ("interface", "Shelf"), ("type", "PersonID"), ("function", "Admit"), ("method", "Name")]
    assert imports == ["fmt", "example.org/x/db"] and calls == [("Admit", "Println")]


def test_javascript_modules():
    source = "import { draw } from './draw.js';\n\nexport function mount(node) {\n  return draw(node);\n}\n\nexport class Box {\n  refresh() {}\n}\n"
    symbols, calls, imports = told("javascript", source)
    assert symbols == [("function", "mount", 3, 5), ("class", "Box", 7, 9), ("method", "refresh", 8, 8)] and calls == [("mount", "draw")] and imports == ["./draw.js"]


def test_line_ranges_recovery_and_nothing():
    assert told("rust", "\nfn first() {}\n\nfn second() {\n    ()\n}\n")[0] == [("function", "first", 2, 2), ("function", "second", 4, 6)]
    assert "good" in named("rust", "fn good() {}\n\nfn broken( {\n", "function")
    assert all(code.extract(lang, "") == [] for lang in code.LANGUAGES) and code.extract(None, "fn a() {}") == []


@pytest.mark.parametrize(
    ("source", "symbols", "calls"),
    [
        ("pub(crate) fn a() { b() }", ["a"], [("a", "b")]),
        ("pub(super) struct S(u8);", ["S"], []),
        ("fn a() { if let Some(x) = f() { Ok(x) } else { match y { Some(z) if ok(z) => go(z), None => { stop() } Err(e) => hid!(e()), } } }", ["a"], [("a", n) for n in ("f", "Ok", "ok", "go", "stop")]),
        ('macro_rules! m { () => { fn no() { x() } } }\n#[cfg(test)]\nfn t() { y(r#"fn no() {"#); let c = \'{\'; let l: &\'a str = z(); }', ["m", "t"], [("t", "y"), ("t", "z")]),
        ("impl<T> Vec<T> { fn f() {} }\nimpl fmt::Display for Bar {}\nimpl X for u8 {}", ["f", "Bar"], []),
        ("trait T { type A; const K: u8; fn d(&self) { e() } }\ntype B = Vec<u8>;\nstatic mut G: u8 = g();\nenum E { A(u8) }\nfn h<const N: usize>() { i::<N>(); j(N) }", ["K", "T", "d", "B", "G", "E", "h"], [("d", "e"), (None, "g"), ("h", "j")]),
        ("/* fn x() { /* nested */ */ fn y() {}", ["y"], []),
    ],
)
def test_rust_shapes(source, symbols, calls):
    got = told("rust", source)
    assert [n for _, n, *_ in got[0]] == symbols and got[1] == calls


@pytest.mark.parametrize(
    ("source", "symbols", "calls"),
    [
        ("const f = (\n a: string\n) => { return g(a) };", [("function", "f")], [(None, "g")]),
        ("class Q { m() { this.n(); } }", [("class", "Q"), ("method", "m")], [("m", "n")]),
        ('function h() { return s.replace(/"[{]/g, x()); }', [("function", "h")], [("h", "replace"), ("h", "x")]),
        ("const o = { go(a) { return deep(a) }, b: function() { y() } };", [("method", "go")], [("go", "deep"), (None, "y")]),
        ("abstract class Z<T extends {a: string}> extends B<{x: 1}> { abstract w(x): void; v = init(); static async u<S>(x: S): Promise<{a: S}> { await k<S>(x); new W(x).p(); } }", [("class", "Z"), ("method", "u")], [(None, "init"), ("u", "k"), ("u", "p")]),
        ("function over(a: string): void;\nexport default function r(): void { q() }", [("function", "r")], [("r", "q")]),
        ("const t = `a${`b${c()}`}` + tag`x`;", [], [(None, "c"), (None, "tag")]),
        ("type U = { m(): void } | {\n z(): string };\nrun()", [("type", "U")], [(None, "run")]),
        ("if (x) /re(/.test(y);\nconst half = a / 2 / b(1);", [], [(None, "test"), (None, "b")]),
        ("const a1 = 1,\n  a2 = () => two(),\n  a3 = function () { three() };", [("function", "a2"), ("function", "a3")], [(None, "two"), (None, "three")]),
        ("class A {\n get v(): number { return n(); }\n on = (e: E) => { fire(e); };\n [k]() { hid(); }\n #p() { own(); this.#p(); }\n}", [("class", "A"), ("method", "v")], [("v", "n"), (None, "fire"), (None, "hid"), (None, "own")]),
        ("function f() { return <p onClick={() => hit()}>Don't {say(1)} <b/></p> }", [("function", "f")], [("f", "hit"), ("f", "say")]),
        ("foo(function inner() { x() });\nfunction* gen() { y() }", [("function", "gen")], [(None, "foo"), (None, "x"), ("gen", "y")]),
    ],
)
def test_typescript_shapes(source, symbols, calls):
    got = told("tsx", source)
    assert sorted((k, n) for k, n, *_ in got[0]) == sorted(symbols) and got[1] == calls


def test_script_imports():
    assert told("typescript", 'export * from "./y";\nimport "side";\nimport type { K } from \'k\';\nexport { z };\nimport("lazy");\nconst from = "no";\n')[2] == ["./y", "side", "k"]


def test_go_shapes():
    source = 'package m\ntype (\n A struct { f func(int) }\n B = int\n C[T any] interface { M(x int) }\n)\nconst X, Y = 1, 2\nfunc G[T any](x T) (map[string]interface{}, error) { return mk[T](x), foo.Bar(func() { z() }) }\nvar v = func(a int) B { return q(a) }\nfunc (r *R) M() struct{} { go r.n([]byte(x)); arr[0](1) }\n'
    symbols, calls, _ = told("go", source)
    assert symbols == [("struct", "A", 2, 6), ("interface", "C", 2, 6), ("constant", "X", 7, 7), ("constant", "Y", 7, 7), ("function", "G", 8, 8), ("method", "M", 10, 10)]
    assert calls == [("G", "mk"), ("G", "Bar"), ("G", "z"), (None, "q"), ("M", "n")]


def test_broken_python_keeps_what_parses():
    source = "import a\nclass C:\n    @dec(1)\n    def m(self, x=d()):\n        return f(x)\n    def bad(self:\n        y(1)\n    def ok(self):\n        return g(self)\nfrom __future__ import x\ndef last():\n    z()\n"
    symbols, calls, imports = told("python", source)
    assert symbols == [("class", "C", 2, 9), ("function", "m", 4, 5), ("function", "bad", 6, 7), ("function", "ok", 8, 9), ("function", "last", 11, 12)]
    assert set(calls) == {("C", "dec"), ("m", "d"), ("m", "f"), ("bad", "y"), ("ok", "g"), ("last", "z")} and imports == ["a"]
    assert set(told("python", source.replace("self:", "self):"))[1]) == set(calls)


@pytest.mark.parametrize(
    ("lang", "piece"),
    [
        ("rust", "fn a(\n"), ("rust", "{"), ("rust", 'r#"'), ("rust", "fn f() { g() }\n"), ("rust", "match x { "), ("rust", "pub "), ("rust", "}{"), ("typescript", "import\n"), ("typescript", "x = new "),
        ("typescript", "class A "), ("typescript", "type A = "), ("typescript", "const a = () => "), ("typescript", "const a: {} = 1, "), ("typescript", "`${"), ("typescript", "a<"), ("typescript", "/[/"),
        ("typescript", "new a.a."), ("go", '"'), ("go", "const a, "), ("go", "type a \n"), ("python", " (\n"), ("python", "class A:\n  def b(:\n"),
    ],
)
def test_odd_sources_are_read_in_linear_time(lang, piece):
    began = time.time()
    code.extract(lang, piece * (200_000 // len(piece)))
    assert time.time() - began < 20
