"""Metrics, symbols and node sequences of sources, from light parsers.

Sources are parsed once, in Arrow batches on the executors; a unit without a known
language has no tree. A metric that a source does not have is absent, not zero, and
fires no rule. Parsers recover from broken code; what cannot be read at all has no
metrics. Null sources count as empty.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType

from lineament.functions.shipping import ship
from lineament.operators import counted, detect
from lineament.plans.catalogue import LANGUAGES, METRIC_RULES
from lineament.syntax import go, js, python, rust

PARSERS = {"rust": rust, "python": python, "js": js, "go": go}
SYMBOLS = "array<struct<name: string, kind: string, start_line: int, end_line: int, start: int, end: int>>"
NODES = "array<struct<kind: string, start_line: int, end_line: int, function: int, nesting: int, parent: int>>"
#: What ``parsed`` can add, and its type.
ADDED = {"metrics": "map<string, double>", "symbols": SYMBOLS, "kinds": "array<string>", "nodes": NODES}
ROWS = 128


def _one(language: str | None, source: str | None, wanted: Sequence[str]) -> list:
    empty = {"metrics": [], "symbols": [], "kinds": [], "nodes": []}
    if language not in PARSERS:
        return [empty[w] for w in wanted]
    parser = PARSERS[language]
    try:
        tree = parser.parse(source or "")
        found = {"metrics": list(parser.metrics(tree).items())} if "metrics" in wanted else {}
    except RecursionError:
        return [empty[w] for w in wanted]
    if "symbols" in wanted:
        found["symbols"] = [dict(name=n, kind=k, start_line=a + 1, end_line=b + 1, start=s, end=e) for n, k, a, b, s, e in sorted(tree.symbols, key=lambda x: x[4])]
    if "kinds" in wanted:
        found["kinds"] = tree.kinds()
    if "nodes" in wanted:
        found["nodes"] = [dict(kind=n.kind, start_line=n.row + 1, end_line=n.end_row + 1, function=n.function, nesting=n.nesting, parent=n.parent) for n in tree.nodes]
    return [found[w] for w in wanted]


def parsed(units: DataFrame, *wanted: str) -> DataFrame:
    """unit_id, path, source and each of ``wanted``: metrics, symbols, kinds (of nodes, in pre-order), nodes."""
    ship(units.sparkSession)
    kept = units.select("unit_id", "path", "source", detect.language_of(F.col("path")).alias("language"))
    schema = kept.drop("language").schema
    for w in wanted:
        schema = schema.add(w, DataType.fromDDL(ADDED[w]))
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                made = [_one(x, s, wanted) for x, s in zip(part.column(3).to_pylist(), part.column(2).to_pylist())]
                columns = [part.column(i).cast(arrow[i].type) for i in range(3)] + [pa.array([m[k] for m in made], arrow[3 + k].type) for k in range(len(wanted))]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return kept.mapInArrow(run, schema)


def metric_hits(language: str) -> str:
    """SQL of the metric rules that hold for the map ``metrics``, as hits."""
    cases = []
    for i, family, tenths, metric, op, threshold, most in METRIC_RULES:
        if i.startswith(f"{language}_cst."):
            bound = f"metrics['{metric}'] {op} {threshold}D" + (f" AND metrics['{metric}'] <= {most}D" if most is not None else "")
            cases.append(f"IF({bound}, named_struct('id', '{i}', 'family', '{family}', 'tenths', {tenths}), NULL)")
    return f"array_compact(array({', '.join(cases)}))"


def signals(units: DataFrame, languages: tuple[str, ...] = LANGUAGES, analyzers: tuple[str, ...] | None = None, more: str | None = None) -> DataFrame:
    """As ``detect.signals``, with the metric rules after the text rules of each unit, and the map ``metrics``.

    Units without a language follow the Rust text rules and have no metrics."""
    if more:
        found = detect.native_hits(parsed(units, "metrics"), analyzers, languages, ("metrics",), more)
    else:
        found = counted.hits(units, analyzers, languages, made={"metrics": (ADDED["metrics"], lambda language, source: _one(language, source, ("metrics",))[0])})
    every = f"concat(hits, {detect.by_language(languages, metric_hits, detect.NO_HITS)})"
    both = detect.once(found, ["unit_id", "path", "language", "n", "metrics"], hits=every)
    return both.select("unit_id", "path", "language", "n", F.expr("transform(hits, h -> h.id)").alias("signals"), "hits", "metrics")


def kinds(units: DataFrame) -> DataFrame:
    """unit_id, path, language, n, hits of the text rules, and ``kinds`` of nodes in pre-order, in one pass."""
    return counted.hits(units, made={"kinds": (ADDED["kinds"], lambda language, source: _one(language, source, ("kinds",))[0])})


def metrics(units: DataFrame) -> DataFrame:
    """unit_id, language, metric, value: one row a metric that the unit has."""
    rows = parsed(units, "metrics").select("unit_id", detect.language_of(F.col("path")).alias("language"), F.explode("metrics").alias("metric", "value"))
    return rows


def symbols(units: DataFrame) -> DataFrame:
    """unit_id, path, name, kind, start_line, end_line and source of every function, method and class."""
    rows = parsed(units, "symbols").select("unit_id", "path", "source", F.explode("symbols").alias("s"))
    return rows.select(
        "unit_id", "path", "s.name", "s.kind", "s.start_line", "s.end_line", F.expr("substring(source, s.start + 1, s.end - s.start)").alias("source")
    )


def symbol_units(units: DataFrame) -> DataFrame:
    """Symbols as units of their own: unit_id is (unit_id, start_line, name), the path is the file's."""
    return symbols(units).select(F.struct("unit_id", "start_line", "end_line", "name", "kind").alias("unit_id"), "path", "source")


def sequences(units: DataFrame) -> DataFrame:
    """unit_id, language, pos, token: node kinds in pre-order."""
    rows = parsed(units, "kinds").select("unit_id", detect.language_of(F.col("path")).alias("language"), F.posexplode("kinds").alias("pos", "token"))
    return rows


def kind_label(kind):
    """The short label of a symbol's kind."""
    k = F.col(kind) if isinstance(kind, str) else kind
    return F.when(k == "function", "fn").when(k == "method", "method").when(k == "class", "class").otherwise(k)


def display_name(name, most: int = 30):
    """A name of at most ``most`` characters; longer ones end in an ellipsis."""
    n = F.col(name) if isinstance(name, str) else name
    return F.when(F.length(n) > most, F.concat(F.substring(n, 1, most - 1), F.lit("…"))).otherwise(n)
