"""Reports, sources, caches, trees, watching, learning and the pipeline of replaceable parts."""

from __future__ import annotations

import json
import math
import subprocess
import time

import pytest
from pyspark.sql import functions as F

from lineament import pipeline as pl
from lineament.functions.written import Written
from lineament.operators import attribution as at
from lineament.operators import detect, learning, markov, reports, tables
from lineament.plans.catalogue import FAMILIES
from lineament.sources import files
from lineament.streaming import watch

UNITS = "unit_id long, path string, source string"
HUMAN = "\n".join(["fn f(x: u32) {", "    let x = 1;", "    let y = 2;", "    let z = 3;", "    // TODO hack", "    // fixme xxx", "    a.unwrap();", "    b.unwrap();", '    panic!("a");', '    panic!("b");', "}"] * 3)


def unit_rows(spark, *rows):
    return spark.createDataFrame(list(rows), UNITS)


# Reports. -------------------------------------------------------------------------------


def test_reports_in_every_form_and_back(spark):
    units = unit_rows(spark, (1, "a.rs", HUMAN), (2, None, None), (3, "b.py", "x = 1\n"))
    p = pl.Pipeline.with_defaults()
    made = {r.unit_id: r.report for r in p.reports(units).collect()}
    assert made[1].attribution.primary == "human" and made[1].metadata.file_path == "a.rs" and made[1].metadata.signal_count == len(made[1].signals) > 3
    assert {s.source for s in made[1].signals} >= {"comments", "rust_cst"} and made[2].signals == [] and made[2].metadata.lines_of_code == 0
    texts = {r.unit_id: r.report for r in p.written(units, "TEXT").collect()}
    assert texts[1].startswith("File: a.rs\nVerdict: Human (") and "\nScores:\n  Human      " in texts[1] and "[comments  ] +2.0 Human — terse markers" in texts[1]
    assert "Verdict: Insufficient data\nLines: 0 | Signals: 0\n" in texts[2] and "Signals:\n" not in texts[2].split("Scores:")[1]
    pretty = {r.unit_id: r.report for r in p.written(units, "pretty").collect()}
    assert "\x1b[33m" in pretty[1] and "█" in pretty[1] and "\x1b[1mVerdict:\x1b[0m" in pretty[1]
    sent = p.written(units, "json")
    parsed = json.loads(sent.where("unit_id = 1").first().report)
    assert list(parsed) == ["attribution", "signals", "metadata"] and parsed["attribution"]["scores"].keys() == set(FAMILIES)
    back = {r.unit_id: r.report for r in reports.from_json(sent).collect()}
    assert back == made
    one = json.loads(reports.as_one_json(p.reports(units.where("unit_id = 1"))).first().report)
    many = json.loads(reports.as_one_json(p.reports(units)).first().report)
    assert one["metadata"]["file_path"] == "a.rs" and len(many) == 3


def test_scores_of_equal_share_come_by_name(spark):
    sums = spark.createDataFrame([(1, "x", 5, 10, 10, 0, 0, 10)], "unit_id long, path string, n int, " + ", ".join(f"t_{f} int" for f in FAMILIES))
    empty = sums.withColumn("hits", F.expr(detect.NO_HITS))
    made = reports.reported(empty, lambda s, keep: at.verdict(s.withColumn("signal_count", F.lit(3)), [*keep, "signal_count"]))
    lines = reports.as_text(made).first().report.split("Scores:\n")[1].split("\n")
    assert [x.split()[0] for x in lines[:5]] == ["Claude", "GPT", "Human", "Copilot", "Gemini"] and lines[0] == "  Claude     33.3%"


def test_catalogue_forms_and_templates(spark):
    table, toml = reports.catalogue_table(), reports.catalogue_toml()
    assert table.count("\n") == 234 and toml.count('# "') == 232 and '# "rust.errors.zero_unwrap" = 0.8  # Claude: zero unwrap' in toml
    row = spark.range(1).select(reports.filled(F.lit("{value} {value:.0} {value:.2} {pct:.1}"), F.lit(0.75)).alias("a"), reports.date_of(F.lit(951782400)).alias("b"), reports.clock_now().alias("c")).first()
    assert row.a == "0.75 1 0.75 75.0" and row.b == "2000-02-29" and len(row.c) == 8


# Sources. -------------------------------------------------------------------------------


def test_directories_are_pruned_and_names_are_literal(spark, tmp_path):
    root = tmp_path / "C++ (x)[1]"
    for name, text in {"a.rs": "fn a() {}", "sub/b.py": "x = 1", "target/c.rs": "no", "deep/er/target/d.go": "no", "e.txt": "no", "sub/F.PY": "no", "kept.log.js": "y"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "bad.rs").write_bytes(b"\xff\xfe\xfa")
    got = {r.path: r.source for r in files.directory(spark, str(root), ["target/"]).collect()}
    assert got == {"a.rs": "fn a() {}", "sub/b.py": "x = 1", "kept.log.js": "y", "bad.rs": None}
    assert files.collected(spark, str(root / "e.txt"), ["*.txt"]).first().source == "no"
    assert files.collected(spark, str(root), ["*"]).count() == 0
    assert {r.path for r in files.all_files(spark, str(root), ["target/"]).collect()} == {"a.rs", "sub/b.py", "e.txt", "sub/F.PY", "kept.log.js", "bad.rs"}


def test_git_histories_and_trees(spark, tmp_path):
    def git(*a):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)

    git("init", "-q")
    for k, text in enumerate([HUMAN, "", "fn main() {}\n"]):
        (tmp_path / "a.rs").write_text(text)
        (tmp_path / "b.txt").write_text(str(k))
        git("add", ".")
        git("commit", "-qm", f"change {k}", "--date", f"2024-01-0{k + 1}T00:00:00Z")
    commits = files.history(spark, str(tmp_path), "a.rs", 2)
    assert [r.summary for r in commits.orderBy("place").collect()] == ["change 2", "change 1"]
    every = files.history(spark, str(tmp_path), "a.rs").withColumn("path", F.lit("a.rs"))
    rows = sorted(pl.Pipeline.with_defaults().history(every).collect(), key=lambda r: r.place)
    assert [r.primary for r in rows][1:] == ["human", "human"] and rows[1].confidence == 0.5 and rows[0].change == "" and rows[2].change in ("up", "down", "same")
    tree = files.tree_at(spark, str(tmp_path), "HEAD")
    assert [r.path for r in tree.collect()] == ["a.rs"]
    assert files.history(spark, str(tmp_path), "nothing.rs").count() == 0


def test_configuration_and_ignore_files(spark, tmp_path):
    (tmp_path / ".lineament.toml").write_text('[ignore]\npatterns = ["*.gen.rs"]\n[heuristics]\n"rust.errors.zero_unwrap" = 0.0\n[cache]\ndir = "/x"\n')
    (tmp_path / ".gitignore").write_text("# c\nbuild/\n\\#odd\nend\\ \n!build/keep.rs\n\n")
    (tmp_path / "sub").mkdir()
    config = files.configuration(str(tmp_path / "sub"))
    assert files.cache_folder(config) == "/x" and files.overrides(spark, config).collect()[0].weight == 0.0
    assert files.ignore_patterns(str(tmp_path), config) == ["build/", "\\#odd", "end\\ ", "!build/keep.rs", "*.gen.rs"]
    assert files.ignore_patterns(str(tmp_path), {"ignore": {"use_gitignore": False}}) == []


@pytest.mark.parametrize(
    ("patterns", "yes", "no"),
    [
        (["[a-c].rs"], ["a.rs", "x/b.rs"], ["d.rs", "-.rs"]),
        (["[!a-c].rs"], ["d.rs"], ["a.rs", "x/"]),
        (["[]x].rs"], ["].rs", "x.rs"], ["y.rs"]),
        (["a\\*b", "\\#x", "\\!y"], ["a*b", "#x", "!y"], ["axb", "x"]),
        (["[ab"], ["[ab"], ["a"]),
        (["/top.rs"], ["top.rs"], ["x/top.rs"]),
        (["doc/**/x.rs"], ["doc/x.rs", "doc/a/b/x.rs"], ["x.rs"]),
        (["*.log", "!keep.log"], ["a.log", "d/b.log"], ["keep.log"]),
        (["[[:x]"], ["[", ":", "x"], ["y"]),
    ],
)
def test_globs(spark, patterns, yes, no):
    paths = spark.createDataFrame([(p,) for p in yes + no], "path string")
    assert {r.path for r in paths.where(tables.ignored(F.col("path"), patterns)).collect()} == set(yes)


# Caches, stores, trees. --------------------------------------------------------------------


def test_cache_keeps_drops_and_tells_keys_apart(spark, tmp_path):
    cache = tables.ReportCache(spark, str(tmp_path), most=2)
    kv = lambda *rows: spark.createDataFrame(list(rows), "key string, value string")
    assert not cache.contains("a") and cache.missing(kv(("a", ""))).count() == 1
    cache.put(kv(("a", "1"), ("b", "2")))
    cache.put(kv(("a", "3")))
    assert cache.get_hot(["a"]) == {"a": "3"} == cache.get_hot(["a"]) and cache.contains("b")
    cache.delete(kv(("a", None)))
    assert not cache.contains("a") and {r.key for r in cache.rows().collect()} == {"b"} and cache.get_hot(["a"]) == {}
    source = spark.createDataFrame([("x",)], "s string").select(*[tables.content_key(F.col("s"), *a).alias(f"k{i}") for i, a in enumerate([(), (F.lit("rust"),), (None, {"a": 1.0}), (None, None, "other")])]).first()
    assert len(set(source)) == 4


class Counting:
    """An analyzer of one rule, whose lines are counted."""

    name = "counting"

    def rules(self):
        return [pl.Rule("own.counting.many", "gemini", 90, "size(filter(x, e -> contains(e.l, 'zz'))) >= 2")]


def test_pipeline_with_other_parts(spark, tmp_path):
    units = unit_rows(spark, (1, "a.rs", "zz\nzz\n" + "let a = 1;\n" * 12), (2, "b.rs", HUMAN), (3, "skip/c.rs", HUMAN), (4, "b2.rs", HUMAN))
    p = pl.Pipeline(more=[Counting()], ignore=pl.GlobIgnore(["skip/"]), cache=tables.ReportCache(spark, str(tmp_path)))
    v = {r.unit_id: r for r in p.verdicts(units).collect()}
    assert v[1].primary == "gemini" and 3 not in v and v[2].primary == "human"
    off = p.with_heuristics(pl.ConfiguredWeights({"own.counting.many": 0.0, "rust.comments.terse_markers": -1.0}))
    fired = {r.unit_id: r.signals for r in off.signals(units).collect()}
    assert "own.counting.many" not in fired[1] and "rust.comments.terse_markers" in fired[2]
    first = {r.unit_id: r.report for r in p.reports_json(units.where("unit_id <> 3")).collect()}
    assert p.cache.rows().count() == 2 and first[2] == first[4]
    again = {r.unit_id: r.report for r in p.reports_json(units.where("unit_id = 2")).collect()}
    assert again[2] == first[2] and p.cache.rows().count() == 2
    assert off.reports_json(units.where("unit_id = 2")).count() == 1 and p.cache.rows().count() == 3

    class Always:
        def rescore(self, signals):
            return signals.select("unit_id", *[F.lit(float(f == "copilot")).alias(f"share_{f}") for f in FAMILIES])

    for blend, primary in ((0.0, "human"), (1.0, "copilot"), (7.0, "copilot"), (-1.0, "human")):
        assert {r.unit_id: r.primary for r in p.with_model(Always(), blend).verdicts(units).collect()}[2] == primary
    half = {r.unit_id: r for r in p.with_model(Always(), 0.5).verdicts(units).collect()}[2]
    assert half.share_copilot == pytest.approx(0.5 + v[2].share_copilot / 2)
    names = {r.name for r in p.symbol_reports(units).collect()}
    assert names == {"f"}
    assert pl.parsed_families(["Claude", " GPT "]) == ["claude", "gpt"] and pl.parsed_format("Json") == "json"
    with pytest.raises(ValueError):
        pl.parsed_families(["x"])
    with pytest.raises(ValueError):
        pl.parsed_format("xml")


def test_stores_keep_the_first_write_and_trends_append(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "unit_id long, hash string")
    tables.corpus_insert(rows((2, "a"), (1, "a"), (3, "b")), str(tmp_path / "c"))
    tables.corpus_insert(rows((0, "a"), (4, "c")), str(tmp_path / "c"))
    assert sorted((r.hash, r.unit_id) for r in spark.read.parquet(str(tmp_path / "c")).collect()) == [("a", 1), ("b", 3), ("c", 4)]
    for _ in range(2):
        tables.trend_insert(rows((1, "a")), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_merkle_of_any_depth(spark):
    deep = "/".join(f"d{k}" for k in range(12)) + "/x.rs"
    make = lambda h, n=deep: spark.createDataFrame([(n, h), ("a.rs", "11"), ("b/y.rs", "22")], "path string, hash string")
    began = time.time()
    one, two, renamed = (tables.merkle(m) for m in (make("aa"), make("ab"), make("aa", deep.replace("x.rs", "z.rs"))))
    changed = {r.dir: r.change for r in tables.changed_dirs(two, one).collect()}
    assert set(changed) == {"", *("/".join(f"d{k}" for k in range(n)) for n in range(1, 13))} and set(changed.values()) == {"changed"}
    assert tables.root_unchanged(one, one) and not tables.root_unchanged(one, two) and tables.root_unchanged(one, renamed)
    assert one.count() == 14 and time.time() - began < 60
    assert tables.merkle(make("aa").where("false")).count() == 0


def test_flat_tree_walks_folders_first(spark):
    rows = [("z.rs", 10, "gpt", 1.0), ("a/b.rs", 30, "human", 0.5), ("a/c/d.rs", 10, "claude", 1.0), ("a/a.rs", 0, "claude", 1.0), ("a.rs", 1, "gpt", 0.2)]
    v = spark.createDataFrame(rows, "path string, n int, primary string, confidence double")
    got = [(r.path, r.depth, r.is_dir) for r in tables.walked(v).collect()]
    assert got == [("a", 0, True), ("a/c", 1, True), ("a/c/d.rs", 2, False), ("a/a.rs", 1, False), ("a/b.rs", 1, False), ("a.rs", 0, False), ("z.rs", 0, False)]
    commits = v.withColumn("commit", F.lit(1)).unionByName(spark.createDataFrame([(2, None, None, None, None)], "commit int, path string, n int, primary string, confidence double"))
    got = {r.commit: (r.files, r.primary, r.confidence) for r in tables.at_commits(commits).collect()}
    assert got[2] == (0, "human", 0.5) and got[1][:2] == (5, "human")


# Watching. -----------------------------------------------------------------------------------


def test_debounce_counts_from_the_first_save(spark):
    saves = [("w", "a", 0), ("w", "b", 250), ("w", "a", 299), ("w", "a", 300), ("w", "a", 599), ("v", "a", 10), ("w", "c", 2000)]
    got = sorted(tuple(r) for r in watch.debounced(spark.createDataFrame(saves, "watcher string, path string, ms long"), "watcher").collect())
    assert got == [("a", 300), ("a", 310), ("a", 600), ("b", 300), ("c", 2300)]


def test_an_edit_is_seen_again_and_an_error_does_not_end_the_watch(spark, tmp_path):
    folder, seen, errors = tmp_path / "saves", [], []
    folder.mkdir()

    def analyse(units):
        if units.where("source = 'bad'").count():
            raise ValueError("bad file")
        return units.select("path", "source")

    query = watch.watch(watch.source_stream(spark, str(folder), ["skip/"]), analyse, lambda df, n: seen.extend(map(tuple, df.collect())), str(tmp_path / "check"), lambda e, n: errors.append(str(e)))
    try:
        for source in ("one", "bad", "two"):
            watch.publish(str(folder), "a.rs", source)
            watch.publish(str(folder), "skip/b.rs", source)
            watch.publish(str(folder), "c.txt", source)
            query.processAllAvailable()
    finally:
        query.stop()
    assert seen == [("a.rs", "one"), ("a.rs", "two")] and errors == ["bad file"]


def test_streams_fold_as_tables_do(spark, tmp_path):
    folder = tmp_path / "saves"
    folder.mkdir()
    got = {"d": [], "c": []}
    for ms, path in ((0, "a"), (250, "b"), (300, "a"), (2500, "a")):
        watch.publish(str(folder), path, "x", "w", ms)
    stream = lambda: spark.readStream.schema(watch.SAVES).json(str(folder))
    queries = [
        fold(stream().select("watcher", "path", "ms")).writeStream.foreachBatch(lambda df, n, k=k: got[k].extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / k)).start()
        for k, fold in (("d", watch.debounced_stream), ("c", watch.cooled_stream))
    ]
    want = {"d": {("a", 300), ("b", 300), ("a", 600), ("a", 2800)}, "c": {("a", 0), ("b", 250), ("a", 2500)}}
    try:
        # A stream with a timeout is never through with what is available.
        until = time.time() + 60
        while time.time() < until and any(set(got[k]) != want[k] for k in got):
            time.sleep(0.5)
    finally:
        for q in queries:
            q.stop()
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


# Learning. ------------------------------------------------------------------------------------


def test_features_schema_and_models(spark):
    rows = [(k, f"f{k}.rs", HUMAN if k % 2 else "/// Doc.\nfn retrieve_entry_name() {}\n" * 8) for k in range(16)]
    signals = pl.Pipeline.with_defaults().signals(unit_rows(spark, *rows))
    features = learning.extracted(signals)
    schema = learning.schema_of(features)
    assert schema[: len(learning.IDS)] == learning.IDS and all(s.startswith("metric:") for s in schema[len(learning.IDS) :]) and "metric:avg_complexity" in schema
    x = learning.dataset(features, schema).where("unit_id = 1").first()
    assert len(x.x) == len(schema) and x.x[schema.index("rust.comments.terse_markers")] == 2.0
    labelled = features.withColumn("family", F.when(F.col("unit_id") % 2 == 1, "human").otherwise("claude"))
    model = learning.fit(labelled, "family", trained_at="2024-01-01")
    assert model.labels == ["claude", "human"] and model.metadata.training_samples == 16 and model.metadata.coverage == {"rust": {"claude": 8, "human": 8}}
    assert learning.ModelMetadata.from_json(model.metadata.to_json()) == model.metadata
    said = {r.unit_id: r.family for r in model.votes(features).where("share > 0.5").collect()}
    assert said == {k: "human" if k % 2 else "claude" for k in range(16)}
    scorer = pl.ModelScorer(model)
    assert {r.unit_id: r.primary for r in scorer.rescore(signals).collect()} == said


def test_splits():
    labels = [0] * 7 + [1] * 2 + [2]
    train, test = learning.lcg_split(labels, 0.2, 42)
    assert sorted(train + test) == list(range(10)) and len(test) == 2 and learning.lcg_split(labels, 0.2, 42) == (train, test) and 9 in train


def test_markov_backs_off_and_knows_unknown_tokens(spark):
    rows = [("r", f, f + str(s), i, t) for f, text in (("x", "ababababab"), ("y", "aabbaabbaabb")) for s in range(2) for i, t in enumerate(text)]
    train = spark.createDataFrame(rows, "language string, family string, seq_id string, pos int, token string")
    size = 3
    model = markov.trained_orders(markov.ngrams(train), size)
    total = model.groupBy("language", "family", "order", "context").agg(F.sum("prob").alias("p"), F.count(F.lit(1)).alias("k")).collect()
    assert all(r.p < 1 + 1e-9 for r in total)
    p = {(r.family, r.order, r.context, r.next): r.prob for r in model.collect()}
    assert p["x", 1, "a", "b"] == pytest.approx((10 + 0.5) / (10 + 0.5 * 3)) and p["y", 2, "a,a", "b"] == pytest.approx((6 + 0.5) / (6 + 0.5 * 3))
    new = [("r", "q1", i, t) for i, t in enumerate("abababab")] + [("r", "q2", i, t) for i, t in enumerate("aabb")] + [("r", "q3", i, t) for i, t in enumerate("ab")] + [("r", "q4", 0, "a"), ("r", "q5", 0, "a"), ("r", "q5", 1, "z")]
    seen = markov.encoded(spark.createDataFrame(new, "language string, seq_id string, pos int, token string"), train.select("token").distinct())
    got = {(r.seq_id, r.family): r for r in markov.backed_off(seen, model, size).collect()}
    assert got["q1", "x"].prob > 0.9 and got["q1", "x"].order == 3 and got["q2", "y"].prob > 0.7 and got["q3", "x"].order == 1
    assert got["q4", "x"].prob == got["q4", "y"].prob == 0.5 and got["q4", "x"].order is None
    rest = max((1 - p["x", 1, "a", "b"]) / 2, 1e-300)
    ratio = math.log(rest) - math.log(max((1 - p["y", 1, "a", "b"] - p["y", 1, "a", "a"]) / 1, 1e-300))
    assert math.log(got["q5", "x"].prob / got["q5", "y"].prob) == pytest.approx(ratio)


def test_overrides_stay_within_the_row(spark):
    signals = detect.signals(unit_rows(spark, (1, "b.rs", HUMAN)))
    given = spark.createDataFrame([("rust.comments.terse_markers", -5.0), ("none.such", 2.0)], "id string, weight double")
    plan = at.scored_with(signals, given)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert at.scored_with(signals, given).count() == 1


def test_written_tables_are_dropped(spark):
    table = Written(spark.range(3), "x")
    assert table.df.count() == 3
    table.drop()
    assert table.path not in Written.left


# Folders with state, and commands. ---------------------------------------------------------


def test_an_unchanged_folder_is_only_looked_up(spark, tmp_path, monkeypatch):
    root, state = tmp_path / "src", str(tmp_path / "state")
    (root / "x").mkdir(parents=True)
    (root / "a.rs").write_text(HUMAN)
    (root / "x" / "b.py").write_text("x = 1\n" * 12)
    p = pl.Pipeline.with_defaults()
    first = {r.path: r.report for r in p.directory(spark, str(root), state=state).collect()}
    assert set(first) == {"a.rs", "x/b.py"} and first == {r.path: r.report for r in p.directory(spark, str(root)).collect()}
    with monkeypatch.context() as m:
        m.setattr(pl.Pipeline, "reports_json", None)
        assert {r.path: r.report for r in p.directory(spark, str(root), state=state).collect()} == first
    (root / "x" / "b.py").write_text("y = 2\n")
    changed = {r.path: json.loads(r.report)["metadata"]["lines_of_code"] for r in p.directory(spark, str(root), state=state).collect()}
    assert changed == {"a.rs": 33, "x/b.py": 1}


def test_commands(spark, tmp_path, capsys):
    from lineament.__main__ import main

    (tmp_path / "a.rs").write_text(HUMAN)
    (tmp_path / "b.rs").write_text("let a = 1;\n")
    assert main(["analyze", str(tmp_path), "--format", "json", "--ignore", "b.rs"]) == 0
    assert json.loads(capsys.readouterr().out)["metadata"]["file_path"] == "a.rs"
    assert main(["analyze", str(tmp_path / "a.rs"), "--format", "text", "--assert-family", "claude,gpt"]) == 1
    out = capsys.readouterr()
    assert "File: a.rs" in out.out and out.err.strip().endswith("a.rs: human")
    assert main(["symbols", str(tmp_path)]) == 0 and "a.rs:1-11  function f" in capsys.readouterr().out
    assert main(["heuristics"]) == 0 and main(["heuristics", "--format", "toml"]) == 0
    with pytest.raises(ValueError):
        main(["analyze", str(tmp_path), "--assert-family", "nobody"])
