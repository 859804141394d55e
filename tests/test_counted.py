"""Signals in one pass over lines: equal to the native expressions."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lineament.operators import counted, detect, syntax
from lineament.plans import queries
from lineament.plans.corpus import LINES

ODD = ["\r", "  x = 1\r", "abc\u0085 = 1", "let É = 2; // #12", "// see #4\r", "# @é", "// @", "type ABCDİ struct", "func abcdÉ()", "a, _b, c := f()", "　let x_y = 1", "K step 1.", "x" * 99 + "é", "'''doc", "_x: int = 3",
       "日本 = 4", "use b", "use a", "import b", "import a", '"b"', '"a"', "// - x", "#  - x", "", "", "\t", "pub fn main() {", "/// d", "#[derive(A, B)]", "func (s *S) Do()", "async def q():", "req_x = 3", "𝒜b = 1"]


def test_one_pass_gives_what_native_expressions_give(spark):
    rnd = random.Random(7)
    lines = [t.replace("{a}", "3").replace("{b}", "4") for v in LINES.values() for t in v] + ODD
    rows = [(i, rnd.choice(["a.rs", "b.py", "c.js", "d.go", "e.ts", "x.txt", None, "f.RS"]), "".join(rnd.choice(lines) + rnd.choice(["\n", "\n", "\r\n", "\n\n", "\r"]) for _ in range(rnd.randint(0, 45)))) for i in range(400)]
    units = spark.createDataFrame([*rows, (400, "a.py", None)], "unit_id long, path string, source string")
    table = lambda df: {r.unit_id: r for r in df.select("unit_id", "path", "language", "n", "hits").collect()}
    want = table(detect.native_hits(units))
    assert table(detect.hits(units)) == want and table(syntax.signals(units).withColumn("hits", F.expr("filter(hits, h -> NOT h.id LIKE '%\\_cst.%')"))) == want


def test_verdicts_take_no_expression_a_line(spark):
    """Of a line natively evaluated, hundreds of nodes were; they took most of the time."""
    plan = queries.QUERIES["attribution"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "regexp_replace" not in plan


def test_remembered_lines_are_bounded(monkeypatch):
    monkeypatch.setattr(counted, "MOST_LINES", 3)
    rules = counted.Rules("python", None)
    for k in range(20):
        rules.of(f"x{k} = 1\n{'y' * 300}")
    assert len(rules.lines) <= 3


def test_full_verdicts_and_trees_read_units_once(spark):
    plan = lambda name: queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan("attribution_full").count("MapInArrow") == 1 and "regexp_replace" not in plan("attribution_full")
    assert "lineitem" not in plan("flat_tree") and "tree-verdicts" in plan("flat_tree")
