"""Signals of units in one pass over Arrow batches: the catalogue compiled to Python, each distinct line looked at once.

What a line adds to a unit's counts and name measures is one integer with a lane of 64
bits for each, so a unit's counts are the sum of its lines. What was found of a short
line is remembered, within a bound. Conditions of signals are the catalogue's own.
"""

from __future__ import annotations

import re
import struct
import sys
import unicodedata
from collections.abc import Callable, Sequence
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType

from lineament.functions.shipping import ship
from lineament.operators import detect
from lineament.plans.catalogue import COUNTS, DEFS, IMPORTS, LANGUAGES, SIGNALS

#: What is trimmed, as ``portable.WHITE``.
WHITE = " \t\r\f\x0b\x85\xa0\u2028\u2029\u3000"
#: Lines remembered by a task, and the longest of them.
MOST_LINES, LONGEST = 50_000, 200
ROWS = 512
ADDITIVE = ("names", "name_bytes", "single_names", "underscores", "camel_names", "snake_names", "short_words", "fn_names", "fn_bytes", "derive_commas")
#: Names that a condition may use beside counts and ADDITIVE.
GIVEN = ("n", "first_def", "imports", "imports_sorted", "blank_runs", "blank_runs_equal")


@cache
def letters(category: str) -> str:
    """The ranges of a Unicode category, for a class."""
    out, start = [], None
    for c in range(sys.maxunicode + 2):
        there = c <= sys.maxunicode and unicodedata.category(chr(c)).startswith(category)
        if there and start is None:
            start = c
        elif not there and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


#: Where Java's ``$``, ``.`` and ``\s`` differ from Python's.
ENDS = "\r\x85\u2028\u2029"


def translated(pattern: str) -> str:
    """A regular expression of the catalogue with Java's meaning."""
    out, i, inside = "", 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if pattern[i + 1] == "p":
                end = pattern.index("}", i)
                ranges = letters(pattern[i + 3 : end])
                out, i = out + (ranges if inside else f"[{ranges}]"), end + 1
                continue
            blank = " \\t\\n\\x0b\\f\\r"
            out += (blank if inside else f"[{blank}]") if pattern[i + 1] == "s" else pattern[i : i + 2]
            i += 2
            continue
        if inside:
            inside = c != "]" or pattern[i - 1] == "[" or pattern[i - 2 : i] == "[^"
            out += c
        elif c == "[":
            inside, out = True, out + c
        else:
            out += f"(?=[{ENDS}]?\\Z)" if c == "$" else f"[^\n{ENDS}]" if c == "." else c
        i += 1
    return out


class Searches(dict):
    def __missing__(self, pattern: str) -> Callable:
        self[pattern] = found = re.compile(translated(pattern)).search
        return found


def measured(every: list[str], fn: list[str], r: Searches) -> list[int]:
    """What names and function names of a line add, as ADDITIVE without its last."""
    size = lambda v: len(v) if v.isascii() else len(v.encode())
    sizes = [size(v) for v in every]
    both = every + fn
    return [
        len(every), sum(sizes), sum(s == 1 for s in sizes), sum(v.startswith("_") and s > 1 for v, s in zip(every, sizes)),
        sum(size(v) > 2 and "_" not in v and r[r"\p{Lu}"](v) is not None for v in both), sum("_" in v and r[r"^[\p{Ll}_\p{N}]+$"](v) is not None for v in both),
        sum(r[detect.SHORT](v.lower()) is not None for v in both), len(fn), sum(map(size, fn)),
    ]


def listed(parts: Sequence[tuple[str, str, str, bool]]) -> str:
    """An expression for the names of a line."""
    out = [f"[v for v in ({python}) if {f'R[{detect.PLAIN!r}](v) is not None' if plain else 'v'}]" for _, _, python, plain in parts]
    return " + ".join(out) or "[]"


def near(python: str) -> bool:
    return re.search(r"\b[pn]t is not None", python) is not None


class Rules:
    """The rules of one language, compiled: ``of`` gives the number of lines and the places in SIGNALS of what fires."""

    def __init__(self, language: str, analyzers: tuple[str, ...] | None):
        counts = COUNTS[language]
        known = {"R": Searches()}
        self.lanes = [*counts, *ADDITIVE]
        self.around = [(k, eval(f"lambda t, pt, nt: {p.python}", known)) for k, p in enumerate(counts.values()) if near(p.python)]
        alone = [(k, p.python) for k, p in enumerate(counts.values()) if not near(p.python)]
        kind = "t" if language == "rust" else "l"
        code = ["def look(l):", f" t = l.strip({WHITE!r}); lo = l.lower(); nb = len(l) if l.isascii() else len(l.encode())", " v = 0"]
        code += [f" if {p}: v += {1 << 64 * k}" for k, p in alone]
        code += [f" names = {listed(detect.NAMES[language])}", f" fn = {listed(detect.FN_NAMES) if language == 'rust' else '[]'}", " if names or fn:", f"  for k, m in enumerate(measured(names, fn, R), {len(counts)}): v += m << 64 * k"]
        code += [f" if '#[derive(' in l: v += l.count(',') << {64 * (len(self.lanes) - 1)}"]
        code += [f" return v, t, {DEFS[language].python}, {kind} if {IMPORTS[language].python} else None"]
        rules = [(k, s) for k, s in enumerate(SIGNALS) if s.language == language and (analyzers is None or s.analyzer in analyzers)]
        code += [f"def fired(v, {', '.join(GIVEN)}):", f" {', '.join(self.lanes)}, = v", " out = []"]
        code += [f" if {condition(s.when)}: out.append({k})" for k, s in rules]
        code += [" return out"]
        exec("\n".join(code), known | {"measured": measured}, made := {})
        self.look, self.fired = made["look"], made["fired"]
        self.lines: dict[str, tuple] = {}
        self.unpack = struct.Struct(f"<{len(self.lanes)}q").unpack

    def line(self, l: str) -> tuple:  # noqa: E741
        found = self.look(l)
        if len(l) <= LONGEST:
            if len(self.lines) >= MOST_LINES:
                self.lines.clear()
            self.lines[l] = found
        return found

    def of(self, source: str | None) -> tuple[int, list[int]]:
        lines = (source or "").replace("\r\n", "\n").split("\n")
        if not lines[-1]:
            lines.pop()
        get, line = self.lines.get, self.line
        found = [get(x) or line(x) for x in lines]
        total = sum(f[0] for f in found)
        texts = [f[1] for f in found]
        for k, holds in self.around:
            before, after = [None, *texts[:-1]], [*texts[1:], None]
            total += sum(map(holds, texts, before, after)) << 64 * k
        first = next((i for i, f in enumerate(found) if f[2]), -1)
        imports = [f[3] for f in found if f[3] is not None]
        runs = [len(r) - 1 for r in RUNS("".join(["x" if t else "b" for t in texts]))] if "" in texts else []
        v = self.unpack(total.to_bytes(8 * len(self.lanes), "little"))
        return len(lines), self.fired(v, len(lines), first, len(imports), imports == sorted(imports), len(runs), bool(runs) and min(runs) == max(runs))


RUNS = re.compile("b+x").findall


def condition(when: str) -> str:
    """A condition of the catalogue in Python."""
    out = re.sub(r"(\w+) BETWEEN (\d+) AND (\d+)", r"(\2 <= \1 <= \3)", when).replace(" = ", " == ")
    for a, b in (("AND", "and"), ("OR", "or"), ("NOT", "not"), ("false", "False")):
        out = re.sub(rf"\b{a}\b", b, out)
    return out


def hits(units: DataFrame, analyzers: tuple[str, ...] | None = None, languages: tuple[str, ...] = LANGUAGES, keep: Sequence[str] = (), made: dict[str, tuple[str, Callable]] | None = None) -> DataFrame:
    """As ``detect.hits``. ``made`` adds columns from language and source in the same pass: type and function."""
    ship(units.sparkSession)
    made = made or {}
    rows = units.select("unit_id", "path", *keep, detect.language_of(F.col("path")).alias("language"), F.col("source").cast("string").alias("source"))
    if set(languages) != set(LANGUAGES):
        rows = rows.where(F.coalesce("language", F.lit("rust")).isin(*languages))
    schema = rows.select("unit_id", "path", "language").schema.add("n", DataType.fromDDL("int"))
    for k in keep:
        schema = schema.add(k, rows.schema[k].dataType)
    for k, (ddl, _) in made.items():
        schema = schema.add(k, DataType.fromDDL(ddl))
    schema = schema.add("hits", DataType.fromDDL(f"array<{detect.HIT}>"))
    arrow = to_arrow_schema(schema)
    through = ["unit_id", "path", "language", *keep]
    functions = [f for _, f in made.values()]

    def run(batches):
        rules = {x: Rules(x, analyzers) for x in languages}
        item = arrow.field("hits").type.value_type
        signals = pa.array([{"id": s.id, "family": s.family, "tenths": s.tenths} for s in SIGNALS], item)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                part = whole.slice(at, ROWS)
                column = {name: part.column(i) for i, name in enumerate(part.schema.names)}
                spoken, texts = column["language"].to_pylist(), column["source"].to_pylist()
                lengths, ends, fired = [], [0], []
                for language, text in zip(spoken, texts):
                    n, own = rules[language or "rust"].of(text)
                    lengths.append(n)
                    fired += own
                    ends.append(len(fired))
                out = {k: column[k].cast(arrow.field(k).type) for k in through}
                out["n"] = pa.array(lengths, pa.int32())
                for k, f in zip(made, functions):
                    out[k] = pa.array([f(x, t) for x, t in zip(spoken, texts)], arrow.field(k).type)
                out["hits"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), signals.take(pa.array(fired, pa.int32()))).cast(arrow.field("hits").type)
                yield pa.RecordBatch.from_arrays([out[k] for k in arrow.names], schema=arrow)

    return rows.mapInArrow(run, schema)
