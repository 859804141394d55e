"""Signals of source texts: counts, names and layout as expressions over an array of lines.

A unit is a row (unit_id, path, source). Signals come from one pass over Arrow
batches (``lineament.operators.counted``), where every line is looked at once: a unit
never leaves its row and nothing is shuffled. Names and layout (``features``), and hits
with further rules (``more``), are native expressions over an array of lines; there every
line becomes a number with a bit for each predicate of the unit's language, and detectors
are counts of these bits. Spark evaluates functions of arrays a node at a time, which took
three times as long for the whole catalogue. ``signals_sql`` renders the same catalogue as
DuckDB SQL over a table of lines.

What several expressions use is made by a generator of one row (``once``): the
optimiser neither copies it into them nor looks for constraints among them, which
for some hundred columns took minutes.

A null source counts as empty, which has no lines and no signals. Units without
a known language follow the Rust rules.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineament.functions.portable import WHITE, P, duck_text, spark_text, starts
from lineament.plans.catalogue import ABBREVIATIONS, COUNTS, DEFS, IMPORTS, LANGUAGES, SIGNALS

EDGES = f"^{WHITE}+|{WHITE}+$"
PLAIN = r"^[\p{L}\p{N}_]+$"
SHORT = "^({0})$|^({0})_|_({0})$".format("|".join(ABBREVIATIONS))
EXTENSIONS = {"rs": "rust", "py": "python", "js": "js", "ts": "js", "jsx": "js", "tsx": "js", "go": "go"}

#: Names on a line: Spark, DuckDB and Python lists, and whether only plain names stay.
NAMES: dict[str, list[tuple[str, str, str, bool]]] = {}
#: Names of functions, which Rust counts apart.
FN_NAMES: list[tuple[str, str, str, bool]] = []


def extracted(when: P, pattern: str, group: int, plain: bool) -> tuple[str, str, str, bool]:
    spark = f"CASE WHEN {when.spark} THEN array(trim(regexp_extract(e.t, {spark_text(pattern)}, {group}))) ELSE CAST(array() AS array<string>) END"
    duck = f"CASE WHEN {when.duck} THEN [trim(regexp_extract(t, {duck_text(pattern)}, {group}))] ELSE [] END"
    python = f"[(R[{pattern!r}](t)[{group}] or '').strip(' ')] if {when.python} else []"
    return spark, duck, python, plain


NAMES["rust"] = [extracted(starts("let "), r"^let (mut )?([^:= ]*)", 2, False)]
FN_NAMES = [extracted(starts("pub fn ", "fn "), r"^(pub )?fn ([^(]*)", 2, False)]
NAMES["python"] = [
    extracted(~starts("#", "def ", "class ", "import ", "from ", "return ", "if ", "for ", "while "), r"^([^ :=]*)", 1, True),
    extracted(starts("def ", "async def "), r"^(async )?def ([^(]*)", 2, False),
]
NAMES["js"] = [extracted(starts("const ", "let ", "var ", "function "), r"^(const |let |var |function )([^ =(:]*)", 2, True)]
NAMES["go"] = [
    (
        "CASE WHEN contains(e.t, ' := ') THEN transform(split(substring_index(e.t, ' := ', 1), ','), p -> trim(p)) ELSE CAST(array() AS array<string>) END",
        "CASE WHEN contains(t, ' := ') THEN list_transform(string_split(string_split(t, ' := ')[1], ','), lambda p: trim(p)) ELSE [] END",
        "[p.strip(' ') for p in t.split(' := ', 1)[0].split(',')] if ' := ' in t else []",
        True,
    ),
    extracted(starts("func "), r"^func (\([^)]*\))? *([^(]*)", 2, False),
]


def lines_of(source: Column) -> Column:
    """Lines of a text: a final line end starts no line, and CR LF ends one."""
    pieces = F.split(F.replace(F.coalesce(source, F.lit("")), F.lit("\r\n"), F.lit("\n")), "\n", -1)
    return F.when(F.element_at(pieces, -1) == "", F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)


def language_of(path: Column) -> Column:
    """Language by extension; null when there is none or it is unknown. Case matters."""
    ext = F.regexp_extract(path, r"\.([^./]+)$", 1)
    out = F.lit(None).cast("string")
    for e, language in EXTENSIONS.items():
        out = F.when(ext == e, F.lit(language)).otherwise(out)
    return out


def once(df: DataFrame, keep: list[str], **made: str) -> DataFrame:
    """``keep`` and the expressions ``made``, each computed once whatever uses it later."""
    struct = ", ".join(f"'{k}', {v}" for k, v in made.items())
    rows = df.select(*keep, F.explode(F.expr(f"array(named_struct({struct}))")).alias("_made"))
    return rows.select(*keep, *[F.col(f"_made.{k}").alias(k) for k in made])


def with_lines(units: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Adds language, n and the array ``x`` of line structs; columns ``keep`` go along."""
    base = units.select("unit_id", "path", *keep, language_of(F.col("path")).alias("language"), lines_of(F.col("source")).alias("raw"))
    trimmed = f"transform(raw, l -> named_struct('l', l, 't', regexp_replace(l, {spark_text(EDGES)}, ''), 'lo', lower(l)))"
    lines = once(base, ["unit_id", "path", "language", *keep], n="size(raw)", y=trimmed)
    around = "transform(y, (e, i) -> named_struct('l', e.l, 't', e.t, 'lo', e.lo, 'pt', get(y, i - 1).t, 'nt', get(y, i + 1).t))"
    return once(lines, ["unit_id", "path", "language", "n", *keep], x=around)


def by_language(languages: Sequence[str], of: Callable[[str], str], other: str) -> str:
    """A CASE over the unit's language; units without one follow the Rust rules."""
    cases = " ".join(f"WHEN coalesce(language, 'rust') = '{x}' THEN {of(x)}" for x in languages)
    return f"CASE {cases} ELSE {other} END"


def _spark_names(parts: list[tuple[str, str, str, bool]]) -> str:
    lists = []
    for spark, _, _, plain in parts:
        test = f"v RLIKE {spark_text(PLAIN)}" if plain else "v <> ''"
        lists.append(f"filter(flatten(transform(x, e -> {spark})), v -> {test})")
    return lists[0] if len(lists) == 1 else f"concat({', '.join(lists)})"


def _name_measures(dialect: str, names: str, every: str, fn: str) -> dict[str, str]:
    if dialect == "spark":
        size, total = (lambda a, p: f"size(filter({a}, v -> {p}))"), (lambda a: f"aggregate({a}, 0, (s, v) -> s + octet_length(v))")
        rx, length, count, starts_with = "v RLIKE {}", "octet_length(v)", "size({})", "startswith(v, '_')"
        text = spark_text
    else:
        size, total = (lambda a, p: f"len(list_filter({a}, lambda v: {p}))"), (lambda a: f"coalesce(list_sum(list_transform({a}, lambda v: strlen(v))), 0)")
        rx, length, count, starts_with = "regexp_matches(v, {})", "strlen(v)", "len({})", "starts_with(v, '_')"
        text = duck_text
    under = "contains(v, '_')"
    short = rx.format(text(SHORT)).replace("v RLIKE", "lower(v) RLIKE").replace("regexp_matches(v", "regexp_matches(lower(v)")
    return {
        "names": count.format(names),
        "name_bytes": total(names),
        "single_names": size(names, f"{length} = 1"),
        "underscores": size(names, f"{starts_with} AND {length} > 1"),
        "camel_names": size(every, f"{length} > 2 AND {rx.format(text(r'\p{Lu}'))} AND NOT {under}"),
        "snake_names": size(every, f"{under} AND {rx.format(text(r'^[\p{Ll}_\p{N}]+$'))}"),
        "short_words": size(every, short),
        "fn_names": count.format(fn),
        "fn_bytes": total(fn),
    }


def _bits(language: str) -> str:
    """Each line as a number with a bit for each count of the language, and one for a definition."""
    tests = [*COUNTS[language].values(), DEFS[language]]
    return "transform(x, e -> " + " | ".join(f"IF({p.spark}, {1 << k}L, 0L)" for k, p in enumerate(tests)) + ")"


def _fired(language: str, analyzers: tuple[str, ...] | None) -> str:
    """The signals of a language that hold, as structs of id, family and tenths; counts stand by their name."""
    rules = [s for s in SIGNALS if s.language == language and (analyzers is None or s.analyzer in analyzers)]
    if not rules:
        return NO_HITS
    names = {k: f"size(filter(b, v -> v & {1 << i}L <> 0))" for i, k in enumerate(COUNTS[language])}
    used = sorted({w for s in rules for w in re.findall(r"[a-z_0-9]+", s.when)} & set(names))
    fields = ", ".join(f"'{k}', {names[k]}" for k in used) or "'none', 0"
    place = lambda when: re.sub(r"[a-z_][a-z_0-9]*", lambda m: f"c.{m[0]}" if m[0] in names else m[0], when)
    cases = ", ".join(f"IF({place(s.when)}, named_struct('id', '{s.id}', 'family', '{s.family}', 'tenths', {s.tenths}), NULL)" for s in rules)
    return f"flatten(transform(array(named_struct({fields})), c -> array_compact(array({cases}))))"


HIT = "struct<id: string, family: string, tenths: int>"
NO_HITS = f"CAST(array() AS array<{HIT}>)"
MEASURES = ("names", "name_bytes", "single_names", "underscores", "camel_names", "snake_names", "short_words", "fn_names", "fn_bytes")


def features(lines: DataFrame, languages: Sequence[str] = LANGUAGES, keep: Sequence[str] = ()) -> DataFrame:
    """unit_id, path, language, n, the bits ``b`` of every line, and every measurement, one row a unit."""
    none = "CAST(array() AS array<string>)"
    imports = lambda x: f"transform(filter(x, e -> {IMPORTS[x].spark}), e -> e.{'t' if x == 'rust' else 'l'})"
    wide = once(
        lines,
        ["unit_id", "path", "language", "n", *keep],
        b=by_language(languages, _bits, "CAST(array() AS array<bigint>)"),
        name_list=by_language(languages, lambda x: _spark_names(NAMES[x]), none),
        fn_list=by_language([x for x in languages if x == "rust"], lambda x: _spark_names(FN_NAMES), none) if "rust" in languages else none,
        import_list=by_language(languages, imports, none),
        run_list="regexp_extract_all(array_join(transform(x, e -> IF(e.t = '', 'b', 'x')), ''), '(b+)x', 1)",
        derive_commas="aggregate(filter(x, e -> contains(e.l, '#[derive(')), 0, (s, e) -> s + length(e.l) - length(replace(e.l, ',', '')))",
    )
    measures = _name_measures("spark", "name_list", "concat(name_list, fn_list)", "fn_list")
    marks = {x: 1 << len(COUNTS[x]) for x in languages}
    return once(
        wide,
        ["unit_id", "path", "language", "n", *keep, "b", "derive_commas", "name_list", "fn_list", "run_list"],
        first_def=by_language(languages, lambda x: f"int(array_position(transform(b, v -> v & {marks[x]}L <> 0), true) - 1)", "-1"),
        defs=by_language(languages, lambda x: f"size(filter(b, v -> v & {1 << list(COUNTS[x]).index('defs')}L <> 0))", "0"),
        **{k: f"int({measures[k]})" for k in MEASURES},
        imports="size(import_list)",
        imports_sorted="import_list = array_sort(import_list)",
        blank_runs="size(run_list)",
        blank_runs_equal="coalesce(array_min(transform(run_list, r -> length(r))) = array_max(transform(run_list, r -> length(r))), false)",
    )


def hits(units: DataFrame, analyzers: tuple[str, ...] | None = None, languages: tuple[str, ...] = LANGUAGES, keep: Sequence[str] = (), more: str | None = None) -> DataFrame:
    """unit_id, path, language, n and the array ``hits`` of fired signals: id, family, tenths. Units of other languages are left out.

    ``more`` is SQL of further hits over the line structs ``x``, n, path and language."""
    if more:
        return native_hits(units, analyzers, languages, keep, more)
    from lineament.operators import counted

    return counted.hits(units, analyzers, languages, keep)


def native_hits(units: DataFrame, analyzers: tuple[str, ...] | None = None, languages: tuple[str, ...] = LANGUAGES, keep: Sequence[str] = (), more: str | None = None) -> DataFrame:
    """The same by native expressions alone."""
    lines = with_lines(units, keep)
    if more:
        lines = once(lines, ["unit_id", "path", "language", "n", *keep, "x"], _more=more)
    if set(languages) != set(LANGUAGES):
        lines = lines.where(F.coalesce("language", F.lit("rust")).isin(*languages))
    along = (*keep, "_more") if more else tuple(keep)
    found = by_language(languages, lambda x: _fired(x, analyzers), NO_HITS)
    return once(features(lines, languages, along), ["unit_id", "path", "language", "n", *keep], hits=f"concat({found}, _more)" if more else found)


def signals(units: DataFrame, analyzers: tuple[str, ...] | None = None, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """unit_id, path, language, n, the array of fired signal ids, and ``hits``."""
    return hits(units, analyzers, languages).select("unit_id", "path", "language", "n", F.expr("transform(hits, h -> h.id)").alias("signals"), "hits")


# The same in DuckDB. ---------------------------------------------------------


def lines_sql(units: str) -> str:
    """CTEs from ``units`` (unit_id, path, source) to ``ls``, one row a line."""
    ext = "regexp_extract(path, '\\.([^./]+)$', 1)"
    language = "CASE " + " ".join(f"WHEN {ext} = '{e}' THEN '{v}'" for e, v in EXTENSIONS.items()) + " END"
    return f"""
u AS ({units}),
p AS (SELECT unit_id, path, {language} AS language, string_split(replace(coalesce(source, ''), chr(13) || chr(10), chr(10)), chr(10)) AS a FROM u),
q AS (SELECT unit_id, path, language, CASE WHEN a[len(a)] = '' THEN a[1:len(a) - 1] ELSE a END AS a FROM p),
l0 AS (SELECT unit_id, unnest(a) AS l, generate_subscripts(a, 1) - 1 AS i FROM q),
l1 AS (SELECT unit_id, i, l, regexp_replace(l, {duck_text(EDGES)}, '', 'g') AS t, lower(l) AS lo FROM l0),
ls AS (SELECT *, lag(t) OVER w AS pt, lead(t) OVER w AS nt FROM l1 WINDOW w AS (PARTITION BY unit_id ORDER BY i))"""


def features_sql(language: str) -> str:
    """CTE ``f_<language>`` with the counts and measurements of a language's units."""

    def listed(parts: list[tuple[str, str, str, bool]]) -> str:
        out = []
        for _, duck, _, plain in parts:
            test = f"regexp_matches(v, {duck_text(PLAIN)})" if plain else "v <> ''"
            out.append(f"list_filter(flatten(list({duck})), lambda v: {test})")
        return out[0] if len(out) == 1 else f"list_concat({', '.join(out)})"

    own = f"q.language = '{language}'" + (" OR q.language IS NULL" if language == "rust" else "")
    counts = ", ".join(f"count(*) FILTER (WHERE {p.duck})::INT AS {k}" for k, p in COUNTS[language].items())
    kind = "t" if language == "rust" else "l"
    none = "CAST([] AS VARCHAR[])"
    measures = _name_measures("duck", "a_names", "list_concat(a_names, a_fn)" if language == "rust" else "a_names", "a_fn")
    zero = ", ".join(f"coalesce({k}, 0) AS {k}" for k in (*COUNTS[language], "derive_commas"))
    return f"""
a_{language} AS (SELECT unit_id, {counts}, {listed(NAMES[language])} AS a_names, {listed(FN_NAMES) if language == 'rust' else none} AS a_fn,
  list({kind} ORDER BY i) FILTER (WHERE {IMPORTS[language].duck}) AS a_imports, string_agg(CASE WHEN t = '' THEN 'b' ELSE 'x' END, '' ORDER BY i) AS s_runs,
  min(i) FILTER (WHERE {DEFS[language].duck}) AS first_def, sum(length(l) - length(replace(l, ',', ''))) FILTER (WHERE contains(l, '#[derive(')) AS derive_commas
  FROM ls GROUP BY unit_id),
b_{language} AS (SELECT q.unit_id, q.path, q.language, len(q.a) AS n, {zero}, coalesce(first_def, -1) AS first_def,
  coalesce(a_names, {none}) AS a_names, coalesce(a_fn, {none}) AS a_fn, coalesce(a_imports, {none}) AS a_imports, regexp_extract_all(coalesce(s_runs, ''), '(b+)x', 1) AS a_runs
  FROM q LEFT JOIN a_{language} a ON q.unit_id = a.unit_id WHERE {own}),
f_{language} AS (SELECT *, {', '.join(f'{e} AS {k}' for k, e in measures.items())}, len(a_imports) AS imports, a_imports = list_sort(a_imports) AS imports_sorted,
  len(a_runs) AS blank_runs, coalesce(len(list_distinct(list_transform(a_runs, lambda r: length(r)))) = 1, false) AS blank_runs_equal FROM b_{language})"""


def signals_sql(units: str, analyzers: tuple[str, ...] | None = None, languages: tuple[str, ...] = LANGUAGES) -> str:
    """CTEs ending in ``sg`` (unit_id, path, language, n, signals)."""
    parts = []
    for language in languages:
        fired = ", ".join(f"CASE WHEN {s.when} THEN '{s.id}' END" for s in SIGNALS if s.language == language and (analyzers is None or s.analyzer in analyzers))
        parts.append(f"SELECT unit_id, path, language, n, list_filter([{fired}], lambda v: v IS NOT NULL) AS signals FROM f_{language}")
    return lines_sql(units) + "," + ",".join(features_sql(x) for x in languages) + ", sg AS (" + " UNION ALL ".join(parts) + ")"
