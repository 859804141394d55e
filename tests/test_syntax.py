"""Parsers: metrics and symbols of small sources in four languages, and what broken ones give."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lineament.operators import attribution as at
from lineament.operators import syntax
from lineament.syntax import go, js, python, rust

PARSERS = {"rs": rust, "py": python, "js": js, "go": go}

RUST = '''use a::b;
use a::c;
use d::{e, f};
/// Doc.
#[inline]
pub fn first(x: u32) -> u32 {
    // note
    if x > 1 {
        match x { 2 => { 3 } _ => 4 }
    } else if x == 0 {
        loop { break 5; }
    } else {
        6
    }
}
impl<T> Foo for Bar<T> {
    fn method(&self) -> String { let c = |v| { v + 1 }; format!("{}", if self.x { 1 } else { 2 }) }
}
pub(crate) async fn second() { for i in 0..3 { while let Some(x) = it.next() { call(Foo { a: 1 }); } } }
trait Shape { fn area(&self) -> f64; fn twice(&self) -> f64 { 2.0 * self.area() } }
'''
PYTHON = '''import os
class A:
    """Doc."""
    def m(self, a: int, b=1, *args, **kw):
        """D."""
        if a:
            for i in b:
                pass
        elif b:
            while True:
                try:
                    x = f"{a}" + "%s" % b
                except ValueError:
                    pass
        # c
        def inner(): return 1
        return inner
async def top(x, y, z, w, v): return x
'''
JS = '''import x from 'y';
function decl(a, b = 1) {
  if (a) { for (const k of b) { while (k) { x(); } } }
  else if (b) return 2;
  return a ? 1 : `t${b?.c}`;
}
const arrow = async (z) => { await z; await fetch(u).then(r => r.json()); };
class A extends B {
  constructor(q) { super(q); switch (q) { case 1: break; } }
  static async get(x) { return /re"g/.test(x) }
}
const o = { m(p) { return p }, n: function () { return 1 } };
'''
GO = '''package main
// Doc comment.
func Exported(a int, b string) (out int, err error) {
	if err := do(); err != nil {
		return 0, err
	} else if a > 1 {
		for i := 0; i < 3; i++ {
			go run(i)
		}
	}
	switch v := b.(type) {
	case string:
		fmt.Println(v)
	}
	f := func(x int) int { if x > 0 { return 1 }; return 0 }
	return f(1), nil
}
func (s *Srv) lower() error { select { case <-s.c: }; return nil }
'''
SOURCES = {"rs": RUST, "py": PYTHON, "js": JS, "go": GO}


def metrics(kind, source):
    return PARSERS[kind].metrics(PARSERS[kind].parse(source))


def symbols(kind, source):
    return [(n, k, a + 1, b + 1) for n, k, a, b, _, _ in sorted(PARSERS[kind].parse(source).symbols, key=lambda s: s[4])]


def test_rust():
    m = metrics("rs", RUST)
    # first: if, match, else-if, loop; method: none (the one in the macro is no node); second: for, while; twice: none.
    assert m["avg_complexity"] == 6 / 4
    # The second if lies in the first: block 1, if 2, if 3, block 4, loop 5, block 6.
    assert m["avg_nesting_depth"] == (6 + 2 + 5 + 1) / 4
    assert m["doc_coverage_ratio"] == 1.0 and m["imports_sorted"] == 1.0 and m["avg_fn_length"] == (10 + 1 + 1 + 1) / 4
    assert symbols("rs", RUST) == [("first", "function", 6, 15), ("method", "method", 17, 17), ("second", "function", 19, 19), ("twice", "function", 20, 20)]
    assert metrics("rs", RUST.replace("/// Doc", "// Doc"))["doc_coverage_ratio"] == 0.0
    assert metrics("rs", "use z;\nuse a;\nuse b;\n")["imports_sorted"] == 0.0
    assert "avg_complexity" not in metrics("rs", "let x = 1;")


def test_python():
    m = metrics("py", PYTHON)
    assert m["avg_complexity"] == 5 / 3 and m["doc_coverage_ratio"] == 1 / 3 and m["fstring_ratio"] == 0.5 and m["type_annotation_ratio"] == 1 / 6
    # block, if, block (of the elif), while, block, try, block.
    assert m["avg_nesting_depth"] == (7 + 1 + 1) / 3
    assert symbols("py", PYTHON) == [("A", "class", 2, 17), ("m", "method", 4, 17), ("top", "function", 18, 18)]
    assert "fstring_ratio" not in metrics("py", "x = 1") and metrics("py", "x = '%s' % 1")["fstring_ratio"] == 0.0


def test_python_that_does_not_parse_is_read_by_indentation():
    m = metrics("py", "def f(:\n    if x:\n        return 1\nclass B:\n    def g(self):\n        for i in x:\n            pass\n")
    assert m["avg_complexity"] == 1.0 and m["avg_fn_length"] == 3.0
    assert symbols("py", "def f(:\n    pass\nclass B:\n    def g(self):\n        pass\n") == [("f", "function", 1, 2), ("B", "class", 3, 5), ("g", "method", 4, 5)]


def test_js():
    m = metrics("js", JS)
    assert m["arrow_fn_ratio"] == 2 / 5 and m["has_mixed_async"] == 1.0 and m["optional_chain_count"] == 1.0 and m["template_literal_ratio"] == 0.5
    # decl: if, for-of, while, else-if, ternary; constructor: switch; nothing in the two keywords, two arrows, two methods.
    assert m["avg_complexity"] == 6 / 8
    assert symbols("js", JS) == [("decl", "function", 2, 6), ("arrow", "function", 7, 7), ("constructor", "method", 9, 9), ("get", "method", 10, 10), ("m", "method", 12, 12)]
    only = metrics("js", "async function f() { await a; await b; }")
    assert only["await_only"] == 1.0 and "then_only" not in only and metrics("js", "a.then(b).then(c)")["then_only"] == 1.0


def test_go():
    m = metrics("go", GO)
    assert m["avg_complexity"] == (5 + 1) / 2 and m["err_nil_check_count"] == 1.0 and m["err_nil_check_ratio"] == 0.5 and m["goroutine_count"] == 1.0
    assert m["doc_coverage_ratio"] == 1.0 and m["exported_fn_count"] == 1.0 and m["named_return_count"] == 3.0
    assert symbols("go", GO) == [("Exported", "function", 3, 17), ("lower", "method", 18, 18)]


@pytest.mark.parametrize("kind", list(SOURCES))
def test_broken_sources_are_read(kind):
    r = random.Random(1)
    for _ in range(400):
        text = list(SOURCES[kind])
        for _ in range(r.randint(1, 40)):
            text[r.randrange(len(text))] = r.choice("(){}[]`\"'/\n<>=?;:|!\\")
        metrics(kind, "".join(text[: r.randint(0, len(text))]))


def test_units(spark):
    rows = [(1, "a.py", PYTHON), (2, "b.go", GO), (3, None, PYTHON), (4, "c.txt", "x"), (5, "d.rs", None), (6, "e.js", JS)]
    units = spark.createDataFrame(rows, "unit_id long, path string, source string")
    got = {r.unit_id: r for r in syntax.parsed(units, "metrics", "symbols", "kinds", "nodes").collect()}
    assert got[3].metrics == {} == got[4].metrics and got[5].metrics == {"imports_sorted": 0.0} and got[1].metrics == pytest.approx(metrics("py", PYTHON))
    assert [s.name for s in got[6].symbols] == ["decl", "arrow", "constructor", "get", "m"] and got[2].kinds[0] == "function_declaration" and got[2].nodes[0].end_line == 17
    fired = {r.unit_id: set(r.signals) for r in syntax.signals(units).collect()}
    assert "go_cst.doc_coverage.high" in fired[2] and "python_cst.inline_comments.high" not in fired[1]
    assert "js_cst.mixed_async" in fired[6] and not any("_cst." in s for s in fired[3])
    texts = {r.name: r.source for r in syntax.symbols(units.where("unit_id = 2")).collect()}
    assert texts["lower"].startswith("func (s *Srv) lower()") and texts["lower"].endswith("}")
    assert at.attributed(syntax.signals(units)).count() == 6
    names = spark.createDataFrame([("function", "a" * 40), ("class", "b")], "k string, n string").select(syntax.kind_label("k"), syntax.display_name("n", 10)).collect()
    assert [tuple(r) for r in names] == [("fn", "a" * 9 + "…"), ("class", "b")]


def test_metric_rules_need_their_metric(spark):
    units = spark.createDataFrame([(1, "a.py", "x = 1\n" * 40)], "unit_id long, path string, source string")
    (row,) = syntax.signals(units).select(F.expr("filter(signals, s -> contains(s, '_cst.'))").alias("s"), "metrics").collect()
    assert row.s == [] and "avg_fn_length" not in row.metrics
