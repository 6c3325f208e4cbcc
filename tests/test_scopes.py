"""Nested declarations in each language: where functions begin and end, whose they are, who calls."""

import random
import re

import pytest

from riskweave.sources import scopes, structure

SOURCES = {
    "javascript": """import x from "y"
function outer(a) {
  // function no() { fake() }
  const s = "function no2() { fake2() }";
  function inner(b) { return deep(b); }
  const t = `text ${ call_in(`n ${ deeper() }`) } fake3()`;
  if (a) { inner(a) }
  return after(a)
}
class K {
  async m(a, b) {
    const arrow = (x) => low(x)
    return list.map((y) => { high(y) })
  }
  static n() { q() }
}
module()
const f2 = async (a) => {
  g2(a)
}
top2(/fake4(/.test(x))
""",
    "java": """class A {
  int x = init();
  @GetMapping("/a") public String outer(int a) throws IOException {
    Runnable r = new Runnable() {
      public void run() { inside(); }
    };
    if (a > 1) { go(a); }
    /* void no() { fake() } */
    return "}" + tail('}');
  }
  abstract int none(int a);
  A(int a) { super(a); ctor(); }
}
""",
    "c": """#include <stdio.h>
#include "own.h"
struct P { int a; };
#define X(a) foo(a)
static int helper(int a, char *b);
int main(int argc, char **argv) {
  for (int i = 0; i < 3; i++) { printf("%d {", i); }
  char c = '{';
  while (x) { helper(1, c); }
  return 0;
}
void *alloc_it(size_t n)
{
  return malloc(n);
}
""",
    "cpp": """namespace n {
class Foo : public Bar {
 public:
  Foo(int a) : x(a), y{a} { start(a); }
  ~Foo() { stop(); }
  int get() const override { return val(); }
  int decl() const;
};
template <typename T> T twice(T a) { return add(a, a); }
int Foo::decl() const { auto l = [](int q) { return lam(q); }; return l(1); }
}
""",
    "csharp": """using System.IO;
namespace N {
  public class C : B {
    [HttpGet("/x")]
    public async Task<int> Get(int a) {
      int Local(int b) { return Deep(b); }
      using (var s = Open()) { Local(a); }
      foreach (var x in All()) { Use(x); }
      var t = @"a "" fake() {";
      return await Last(a);
    }
    public int P => Calc();
    int Arrow(int a) => Two(a);
  }
}
""",
    "kotlin": """import a.b.C
class A(val x: Int) {
  fun one(a: Int): Int = two(a)
  fun <T> three(a: T) {
    /* nested /* fake() */ fake() */
    fun inner() { four() }
    list.map { five(it) }
    inner()
  }
}
fun String.ext() = six()
""",
    "scala": """import a.b.C
object O extends App {
  def f(a: Int)(implicit b: Int): Int = {
    def g(x: Int) = h(x)
    g(a)
  }
  def k = m()
  trait T { def abs(a: Int): Int }
  z()
}
""",
    "swift": """import Foundation
class V: W {
  init(a: Int) { super.init(); setup() }
  func one(_ a: Int) -> Int {
    func two() { three() }
    let s = "\\(fake())"
    return two2(a) { four() }
  }
}
extension V { func more() { five() } }
protocol P { func none(a: Int) -> Int
  func none2() }
""",
    "go": """package p
import (
  "fmt"
  x "a/b"
)
type T struct { a int }
func (t *T) Run(a int) (int, error) {
  f := func(q int) { one(q) }
  s := `"fake" fake() {`
  if x := two(); x { three() }
  return f(1)
}
func Gen[K any](a K) K { return four(a) }
var z = five()
""",
    "rust": """use std::io;
struct S;
impl<T> Tr for S {
  fn new<'a>(x: &'a str) -> Self { one(x) }
  fn two(&self) { let c = '{'; let r = r#"fake( {"#; mac!(three()); fn inner() { four() } inner() }
}
fn main() { S::new("a"); five() }
""",
    "php": """<?php
use A\\B;
# fake()
class C {
  public function f($a) {
    $g = function ($b) { one($b); };
    return $this->two($a);
  }
}
function h() { three(<<<X
fake() }
X
); }
four();
""",
    "ruby": """require 'json'
class A
  def one(x)
    if x then two(x) end
    y = three(x) if x
    [1].each do |i|
      four(i)
    end
    while five(x) do
      six(x)
    end
  end
  def self.short(a) = seven(a)
  # def no; end
end
eight(1)
""",
}
#: Functions (name, class, first and last line) and calls (name, caller) of each source.
WANTED = {
    "javascript": ([("outer", None, 2, 9), ("inner", None, 5, 5), ("m", "K", 11, 14), ("arrow", "K", 12, 12), ("n", "K", 15, 15), ("f2", None, 18, 20)], [("deep", "inner"), ("call_in", "outer"), ("deeper", "outer"), ("inner", "outer"), ("after", "outer"), ("low", "arrow"), ("map", "m"), ("high", "m"), ("q", "n"), ("module", None), ("g2", "f2"), ("top2", None), ("test", None)]),
    "java": ([("outer", "A", 3, 10), ("run", "A", 5, 5), ("A", "A", 12, 12)], [("init", None), ("GetMapping", "outer"), ("Runnable", "outer"), ("inside", "run"), ("go", "outer"), ("tail", "outer"), ("ctor", "A")]),
    "c": ([("main", None, 6, 11), ("alloc_it", None, 12, 15)], [("printf", "main"), ("helper", "main"), ("malloc", "alloc_it")]),
    "cpp": ([("Foo", "Foo", 4, 4), ("Foo", "Foo", 5, 5), ("get", "Foo", 6, 6), ("twice", None, 9, 9), ("decl", None, 10, 10)], [("x", "Foo"), ("start", "Foo"), ("stop", "Foo"), ("val", "get"), ("add", "twice"), ("lam", "decl"), ("l", "decl")]),
    "csharp": ([("Get", "C", 5, 11), ("Local", "C", 6, 6), ("Arrow", "C", 13, 13)], [("HttpGet", None), ("Deep", "Local"), ("Open", "Get"), ("Local", "Get"), ("All", "Get"), ("Use", "Get"), ("Last", "Get"), ("Two", "Arrow")]),
    "kotlin": ([("one", "A", 3, 3), ("three", "A", 4, 9), ("inner", "A", 6, 6), ("ext", None, 11, 11)], [("two", "one"), ("four", "inner"), ("five", "three"), ("inner", "three"), ("six", "ext")]),
    "scala": ([("f", "O", 3, 6), ("g", "O", 4, 4), ("k", "O", 7, 7), ("abs", "T", 8, 8)], [("h", "g"), ("g", "f"), ("m", "k"), ("z", None)]),
    "swift": ([("init", "V", 3, 3), ("one", "V", 4, 8), ("two", "V", 5, 5), ("more", "V", 10, 10), ("none", "P", 11, 11), ("none2", "P", 12, 12)], [("init", "init"), ("setup", "init"), ("three", "two"), ("two2", "one"), ("four", "one"), ("five", "more")]),
    "go": ([("Run", "T", 7, 12), ("Gen", None, 13, 13)], [("one", "Run"), ("two", "Run"), ("three", "Run"), ("f", "Run"), ("four", "Gen"), ("five", None)]),
    "rust": ([("new", "S", 4, 4), ("two", "S", 5, 5), ("inner", "S", 5, 5), ("main", None, 7, 7)], [("one", "new"), ("three", "two"), ("four", "inner"), ("inner", "two"), ("five", "main")]),
    "php": ([("f", "C", 5, 8), ("h", None, 10, 13)], [("one", "f"), ("two", "f"), ("three", "h"), ("four", None)]),
    "ruby": ([("one", "A", 3, 12), ("short", "A", 13, 13)], [("two", "one"), ("three", "one"), ("four", "one"), ("five", "one"), ("six", "one"), ("seven", "short"), ("eight", None)]),
}


@pytest.mark.parametrize("language", SOURCES)
def test_nested_declarations(language):
    facts = list(structure.pattern_facts(SOURCES[language], language))
    assert [(f[1], f[3], f[4], f[5]) for f in facts if f[0] == "function"] == WANTED[language][0]
    assert [(f[1], f[3]) for f in facts if f[0] == "call"] == WANTED[language][1]
    assert not any("fake" in f[1] for f in facts)


@pytest.mark.parametrize("language", SOURCES)
def test_blanked_code_keeps_places(language):
    text = SOURCES[language]
    code = scopes.blanked(text, language)
    assert len(code) == len(text) and [i for i, c in enumerate(code) if c == "\n"] == [i for i, c in enumerate(text) if c == "\n"]
    assert all(a == b or a == " " for a, b in zip(code, text)) and "fake" not in code


def test_broken_and_long_sources():
    r = random.Random(4)
    for language in SOURCES:
        text = SOURCES[language]
        for _ in range(30):
            cut = text[: r.randrange(len(text))] + r.choice(["", "/*", '"', "`${", "{{{", ")]}", "'", '"""'])
            list(structure.pattern_facts(cut, language))
        long = list(structure.pattern_facts(text + "\nx(" * 3000 + "{" * 3000 + '"' * 3000 + "/*" * 3000, language))
        assert len(long) >= len(WANTED[language][0])
    assert list(structure.pattern_facts("f() {}", "text")) == [] and list(structure.pattern_facts("", "go")) == []


def test_innermost_scope_of_every_place():
    for language, text in SOURCES.items():
        code = scopes.blanked(text, language)
        found = scopes.scopes(code, language, [(k, m[1], m.start(), m.start(1)) for k, p in (("function", r"\b(?:function|fn|def|func)\s+(\w+)"), ("class", r"\bclass\s+(\w+)")) for m in re.finditer(p, code)], structure._call)
        index = scopes.Index(found)
        for at in range(len(code)):
            inside = [s for s in found if s.start <= at < s.end]
            assert index.around(at) is (max(inside, key=lambda s: (s.start, -s.end)) if inside else None), (language, at)
