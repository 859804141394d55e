"""The attribution engine: catalogue, detectors on small sources, verdicts, tables."""

from __future__ import annotations

from collections import Counter

import pytest

from lineament.operators import attribution as at
from lineament.operators import detect, tables
from lineament.plans.catalogue import FAMILIES, METRIC_RULES, SIGNALS
from lineament.streaming import watch

FILLER = ["x = 1"] * 31


def fired(spark, path, lines):
    units = spark.createDataFrame([(1, path, "\n".join(lines))], "unit_id long, path string, source string")
    (row,) = detect.signals(units).collect()
    return set(row.signals)


def test_catalogue_counts():
    families = Counter(s.family for s in SIGNALS) + Counter(m[1] for m in METRIC_RULES)
    assert len(SIGNALS) == 194 and len(METRIC_RULES) == 38 and len({s.id for s in SIGNALS}) == 194
    assert max(families.values()) <= 0.35 * 232


@pytest.mark.parametrize(
    ("path", "lines", "signal"),
    [
        ("a.py", [*FILLER, "except:", "except Exception:"], "python.errors.broad_except"),
        ("a.py", [*FILLER, "a.b()  # noqa"], "python.ai_signals.pragma"),
        ("a.rs", [*FILLER, *["a.unwrap()"] * 5], "rust.errors.many_unwraps"),
        (None, [*FILLER, "/// a", "fn a() {", "/// b", "fn b() {", "/// c", "pub fn c() {"], "rust.ai_signals.all_fns_documented"),
        ("a.go", [*FILLER, "defer a()", "defer b()"], "go.idioms.defer_stmts"),
        ("a.tsx", [*FILLER, "var a", "var b", "var c"], "js.idioms.var_declarations"),
    ],
)
def test_signal_fires(spark, path, lines, signal):
    assert signal in fired(spark, path, lines)
    assert signal not in fired(spark, path, FILLER)


def test_lines(spark):
    rows = spark.createDataFrame([("a\r\nb\n",), ("",), (None,), ("a\n\n",), ("a\r",)], "s string")
    got = [r[0] for r in rows.select(detect.lines_of(rows.s)).collect()]
    assert got == [["a", "b"], [], [], ["a", ""], ["a\r"]]


def test_verdicts(spark):
    sums = [(1, 20, 5, 0, 0, 0), (2, 20, 0, 0, 0, -10), (3, 0, 0, 0, 0, 0), (4, 10, 0, 0, 0, 10)]
    rows = at.verdict(spark.createDataFrame(sums, "unit_id int, " + ", ".join(f"t_{f} int" for f in FAMILIES)), ["unit_id"]).collect()
    got = {r.unit_id: r for r in rows}
    assert (got[1].primary, got[1].share_claude, got[1].share_gpt) == ("claude", 0.8, 0.2)
    assert (got[2].share_claude, got[2].share_gpt, got[2].share_human) == (0.5, 0.166667, 0.0)
    assert (got[3].primary, got[3].confidence) == ("human", 0.0)
    assert (got[4].primary, got[4].confidence) == ("human", 0.5)


def test_gate_rejects_unknown_family(spark):
    with pytest.raises(ValueError):
        at.gate(spark.range(1).selectExpr("1 AS signal_count", "'gpt' AS primary"), ["nobody"])


def test_ignore_rules(spark):
    paths = spark.createDataFrame([("target/a.rs",), ("src/a.rs",), ("src/keep.log",), ("x.log",), ("a/b/deep.tmp",)], "path string")
    got = {r.path for r in paths.where(tables.ignored(paths.path, ["target/", "*.log", "!keep.log", "a/**/*.tmp"])).collect()}
    assert got == {"target/a.rs", "x.log", "a/b/deep.tmp"}


def test_merkle_changes_propagate(spark):
    def root(h):
        files = spark.createDataFrame([("a/x", "00ff"), ("a/y", h), ("b", "11")], "path string, hash string")
        return {r.dir: r.hash for r in tables.merkle(files).collect()}

    one, two = root("aa"), root("ab")
    assert one[""] != two[""] and one["a"] != two["a"]


def test_cooldown_drops_saves(spark):
    events = spark.createDataFrame([(1, 0), (1, 1000), (1, 2000), (1, 3999), (1, 4000), (2, 5)], "path long, ms long")
    assert sorted(tuple(r) for r in watch.cooled(events).collect()) == [(1, 0), (1, 2000), (1, 4000), (2, 5)]


def test_long_conversations_keep_their_turns(spark, tmp_path):
    from lineament.plans.queries import QUERIES

    rows = [(1, 0, "user", "a"), (1, 1000, "user", "b"), (2, 0, "user", "c"), (2, 2001, "user", "d")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = QUERIES["history_delta"](spark, str(tmp_path)).collect()
    assert sorted((r.path, r.turn) for r in got) == [(1, 0), (1, 1000), (2, 0), (2, 2001)]
    assert sorted((r.turn, r.units) for r in QUERIES["trend_series"](spark, str(tmp_path)).collect()) == [(0, 2), (1000, 1), (2001, 1)]
