"""Commands: analyze, symbols, history, watch, heuristics. ``python -m lineament analyze src --format json``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lineament import pipeline as pl
from lineament.operators import reports
from lineament.sources import files
from lineament.streaming import watch


def session() -> SparkSession:
    spark = SparkSession.builder.appName("lineament").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def configured(folder: str, given: list[str]) -> tuple[pl.Pipeline, list[str]]:
    config = files.configuration(folder)
    p = pl.Pipeline.with_defaults()
    if weights := config.get("heuristics"):
        p = p.with_heuristics(pl.ConfiguredWeights({k: float(v) for k, v in weights.items()}))
    return p, files.ignore_patterns(folder, config) + given


def analyze(a: argparse.Namespace) -> int:
    """Reports in the order of paths; 1 if a family is asserted and some unit is of another."""
    form, allowed = pl.parsed_format(a.format), pl.parsed_families(a.assert_family.split(",")) if a.assert_family else None
    spark = session()
    p, patterns = configured(a.path, a.ignore or [])
    units = files.collected(spark, a.path, patterns).persist()
    if form == "json":
        print(reports.as_one_json(p.reports(units)).first().report)
    else:
        for r in units.select("unit_id", "path").join(p.written(units, form), "unit_id").orderBy("path").toLocalIterator():
            print(r.report)
    bad = p.failed_gate(units, allowed).join(units.select("unit_id", "path"), "unit_id").orderBy("path").collect() if allowed else []
    for r in bad:
        print(f"{r.path}: {r.primary}", file=sys.stderr)
    return 1 if bad else 0


def symbols(a: argparse.Namespace) -> int:
    p, patterns = configured(a.path, a.ignore or [])
    rows = p.symbol_reports(files.collected(session(), a.path, patterns))
    for r in rows.orderBy("path", "start_line").toLocalIterator():
        print(f"{r.path}:{r.start_line}-{r.end_line}  {r.kind} {r.name}  {r.primary} {r.confidence:.2f}")
    return 0


def history(a: argparse.Namespace) -> int:
    commits = files.history(session(), a.repository, a.path, a.limit).withColumn("path", F.lit(a.path))
    for r in pl.Pipeline.with_defaults().history(commits, a.limit, a.by_language).orderBy("place").collect():
        print(f"{r.commit[:8]}  {r.date}  {r.primary:<8}  {100 * r.confidence:.0f}%  {r.change}")
    return 0


def watching(a: argparse.Namespace) -> int:
    spark = session()
    p, patterns = configured(a.folder, a.ignore or [])
    show = lambda df, n: [print(r.report) for r in df.collect()]
    query = watch.watch(watch.source_stream(spark, a.folder, patterns), lambda u: p.written(u, "text"), show, a.checkpoint, lambda e, n: print(e, file=sys.stderr))
    query.awaitTermination()
    return 0


def heuristics(a: argparse.Namespace) -> int:
    print(reports.catalogue_toml() if a.format == "toml" else reports.catalogue_table(), end="")
    return 0


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lineament", description=__doc__)
    commands = parser.add_subparsers(required=True)

    def command(run, name: str, **options) -> None:
        c = commands.add_parser(name)
        for k, v in options.items():
            c.add_argument(k if k.startswith("-") else k.rstrip("_"), **v)
        c.set_defaults(run=run)

    ignore = {"action": "append", "metavar": "PATTERN"}
    command(analyze, "analyze", **{"path": {}, "--format": {"default": "pretty"}, "--assert-family": {}, "--ignore": ignore})
    command(symbols, "symbols", **{"path": {}, "--ignore": ignore})
    command(history, "history", **{"path": {}, "--repository": {"default": "."}, "--limit": {"type": int, "default": 20}, "--by-language": {"action": "store_true"}})
    command(watching, "watch", **{"folder": {}, "--checkpoint": {"required": True}, "--ignore": ignore})
    command(heuristics, "heuristics", **{"--format": {"default": "table"}})
    a = parser.parse_args(arguments)
    return a.run(a)


if __name__ == "__main__":
    sys.exit(main())
