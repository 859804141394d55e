"""Reports: a verdict with its signals and metadata, as a struct, as JSON, text or coloured text.

Descriptions are made by rule from a signal's id; those of metric rules carry the
value. Percentages are rounded half up from the shares' six decimals. A report of a
unit without a path has a null file_path; one without signals an empty list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineament.operators.detect import once
from lineament.plans.catalogue import DISPLAY, FAMILIES, METRIC_RULES, SIGNALS

# A terminal colour and red, green and blue for each family.
COLOURS = {
    "claude": ("magenta", (210, 168, 255)),
    "gpt": ("green", (126, 231, 135)),
    "gemini": ("blue", (121, 192, 255)),
    "copilot": ("cyan", (57, 197, 207)),
    "human": ("yellow", (227, 179, 65)),
}
ANSI = {"bold": 1, "dimmed": 2, "red": 31, "green": 32, "yellow": 33, "blue": 34, "magenta": 35, "cyan": 36}

REPORT = (
    "struct<attribution: struct<primary: string, confidence: double, scores: map<string, double>>, "
    "signals: array<struct<id: string, source: string, description: string, family: string, weight: double>>, "
    "metadata: struct<file_path: string, lines_of_code: int, signal_count: int>>"
)


def template(signal_id: str, metric: str | None = None) -> str:
    """The description of a catalogue row; {value:.1} stands for the metric's value."""
    name = signal_id.split(".", 1 if metric else 2)[-1].replace("_", " ").replace(".", " ")
    return f"{name} ({metric.replace('_', ' ')} {{value:.1}})" if metric else name


def filled(text: Column, value: Column) -> Column:
    """A template with its value: {value}, {value:.0} to {value:.2}, {pct:.0}, {pct:.1}."""
    out = F.replace(text, F.lit("{value}"), value.cast("string"))
    for k in range(3):
        out = F.replace(out, F.lit(f"{{value:.{k}}}"), F.format_string(f"%.{k}f", value))
    for k in range(2):
        out = F.replace(out, F.lit(f"{{pct:.{k}}}"), F.format_string(f"%.{k}f", value * 100))
    return out


def catalogue_rows() -> list[tuple]:
    """id, language, analyzer, description, family, weight, metric, op, threshold, most of every row."""
    rows = [(s.id, s.language, s.analyzer, template(s.id), s.family, s.tenths / 10, None, None, None, None) for s in SIGNALS]
    return rows + [(i, i.split(".")[0], i.split(".")[0], template(i, m), f, w / 10, m, op, t, most) for i, f, w, m, op, t, most in METRIC_RULES]


def catalogue_table() -> str:
    """The catalogue as a table of text."""
    head = f"{'Language':<10}  {'Analyzer':<11}  {'Signal':<40}  {'Family':<7}  {'Weight':<6}  Description"
    return "\n".join([head, "─" * len(head), *(f"{r[1]:<10}  {r[2]:<11}  {r[0]:<40}  {DISPLAY[r[4]]:<7}  {r[5]:<6.2f}  {r[3]}" for r in catalogue_rows())]) + "\n"


def catalogue_toml() -> str:
    """The catalogue as a configuration file whose lines are commented out."""
    out, last = ["[heuristics]", "# Weights of signals; 0.0 disables one. Uncomment a line to change it."], None
    for r in catalogue_rows():
        if r[1] != last:
            out += ["", f"# -- {r[1]} --"]
            last = r[1]
        out.append(f'# "{r[0]}" = {r[5]:.1f}  # {DISPLAY[r[4]]}: {r[3]}')
    return "\n".join(out) + "\n"


_METRIC_OF = ", ".join(f"'{i}', '{m}'" for i, _, _, m, *_ in METRIC_RULES)


def described(hits: str = "hits", metrics: str | None = None) -> str:
    """SQL of the hits as signals: id, source, description, family, weight."""
    source = "IF(contains(h.id, '_cst.'), substring_index(h.id, '.', 1), split(h.id, '[.]')[1])"
    plain = "replace(replace(IF(contains(h.id, '_cst.'), substring(h.id, instr(h.id, '.') + 1), split(h.id, '[.]')[2]), '_', ' '), '.', ' ')"
    text = plain
    if metrics:
        name = f"element_at(map({_METRIC_OF}), h.id)"
        text = f"IF(contains(h.id, '_cst.'), concat({plain}, ' (', replace({name}, '_', ' '), ' ', format_string('%.1f', element_at({metrics}, {name})), ')'), {plain})"
    return f"transform({hits}, h -> named_struct('id', h.id, 'source', {source}, 'description', {text}, 'family', h.family, 'weight', h.tenths / 10D))"


def reported(signals: DataFrame, verdicts_of) -> DataFrame:
    """unit_id and report from signals (unit_id, path, n, hits, perhaps metrics) and a function that makes verdicts of them."""
    extra = ["metrics"] if "metrics" in signals.columns else []
    v = verdicts_of(signals, ("unit_id", "path", "n", "hits", *extra))
    scores = ", ".join(f"'{f}', share_{f}" for f in FAMILIES)
    report = (
        f"named_struct('attribution', named_struct('primary', primary, 'confidence', confidence, 'scores', map({scores})), "
        f"'signals', {described('hits', extra[0] if extra else None)}, 'metadata', named_struct('file_path', path, 'lines_of_code', n, 'signal_count', signal_count))"
    )
    return once(v, ["unit_id"], report=report)


def as_json(reports: DataFrame, pretty: bool = False) -> DataFrame:
    return reports.select("unit_id", F.to_json("report", {"ignoreNullFields": "false", "pretty": str(pretty).lower()}).alias("report"))


def as_one_json(reports: DataFrame) -> DataFrame:
    """A file's worth of reports: the report itself if there is one, else an array by path. Gathers all of them: for a command's output, not for a corpus."""
    one = F.struct(F.col("report.metadata.file_path").alias("path"), "unit_id", F.to_json("report", {"ignoreNullFields": "false"}).alias("json"))
    listed = F.transform(F.array_sort(F.collect_list(one)), lambda x: x["json"])
    both = reports.agg(listed.alias("r"))
    return both.select(F.when(F.size("r") == 1, F.get("r", F.lit(0))).otherwise(F.concat(F.lit("["), F.array_join("r", ","), F.lit("]"))).alias("report"))


def from_json(rows: DataFrame, column: str = "report") -> DataFrame:
    """The inverse of ``as_json``; a text that is no report gives null. A signal without an id has an empty one."""
    parsed = F.expr(f"from_json({column}, '{REPORT}')")
    return rows.select("unit_id", parsed.alias("report"))


def per_mille(x: str) -> str:
    """Tenths of a percent of a share, half up."""
    return f"int(floor((round({x} * 1000000) + 500) / 1000))"


def percent(x: str) -> str:
    return f"string(int(floor((round({x} * 1000000) + 5000) / 10000)))"


def _lines(bold, dim, coloured, signed, bar: bool, source) -> str:
    """SQL of the text of a report; the arguments wrap SQL in styles."""
    r, a, m = "report", "report.attribution", "report.metadata"
    name = lambda f: "element_at(map(" + ", ".join(f"'{k}', '{v}'" for k, v in DISPLAY.items()) + f"), {f})"
    verdict = f"concat({name(f'{a}.primary')}, ' (', {percent(f'{a}.confidence')}, '% confidence)')"
    scores = f"array_sort(transform(map_entries({a}.scores), e -> named_struct('k', -e.value, 'name', {name('e.key')}, 'family', e.key, 'share', e.value)))"
    tenths = per_mille("s.share")
    blocks = "repeat('█', int(s.share * 30))"
    bars = f", {coloured(blocks, 's.family')}, ' '" if bar else ""
    score = f"concat('  ', rpad(s.name, 10, ' '), ' '{bars}, string(int({tenths} / 10)), '.', string({tenths} % 10), '%')"
    sign = f"concat(IF(g.weight >= 0, '+', ''), format_string('%.1f', g.weight))"
    signal = f"concat('  ', {source('g.source')}, ' ', {signed(sign, 'g.weight')}, ' ', {bold(name('g.family'))}, ' — ', g.description)"
    parts = [
        f"IF({m}.file_path IS NULL, '', concat({bold(chr(39) + 'File:' + chr(39))}, ' ', {m}.file_path, '\\n'))",
        f"concat({bold(chr(39) + 'Verdict:' + chr(39))}, ' ', IF({a}.confidence > 0, {coloured(verdict, f'{a}.primary')}, {dim(chr(39) + 'Insufficient data' + chr(39))}), '\\n')",
        f"concat({dim(chr(39) + 'Lines:' + chr(39))}, ' ', {m}.lines_of_code, ' | ', {dim(chr(39) + 'Signals:' + chr(39))}, ' ', {m}.signal_count, '\\n')",
        f"concat('\\n', {bold(chr(39) + 'Scores:' + chr(39))}, '\\n', array_join(transform({scores}, s -> {score}), '\\n'), '\\n')",
        f"IF(size({r}.signals) = 0, '', concat('\\n', {bold(chr(39) + 'Signals:' + chr(39))}, '\\n', array_join(transform({r}.signals, g -> {signal}), '\\n'), '\\n'))",
    ]
    return f"concat({', '.join(parts)})"


def as_text(reports: DataFrame) -> DataFrame:
    """File, verdict or insufficient data, counts, scores from the greatest down (ties by name), signals."""
    same = lambda x, *_: x
    return reports.select("unit_id", F.expr(_lines(same, same, same, same, False, lambda x: f"concat('[', rpad({x}, 10, ' '), ']')")).alias("report"))


def painted(x: str, *styles: str) -> str:
    codes = ";".join(str(ANSI[s]) for s in styles)
    return f"concat(chr(27), '[{codes}m', {x}, chr(27), '[0m')"


def as_pretty(reports: DataFrame, theme: dict[str, str] | None = None) -> DataFrame:
    """The same in terminal colours, with a bar of up to thirty blocks for each score."""
    colours = theme or {f: c for f, (c, _) in COLOURS.items()}
    code = lambda f: "element_at(map(" + ", ".join(f"'{k}', '{ANSI[v]}'" for k, v in colours.items()) + f"), {f})"
    coloured = lambda x, f: f"concat(chr(27), '[', {code(f)}, 'm', {x}, chr(27), '[0m')"
    signed = lambda x, w: f"IF({w} >= 0, {painted(x, 'green')}, {painted(x, 'red')})"
    text = _lines(lambda x: painted(x, "bold"), lambda x: painted(x, "dimmed"), coloured, signed, True, lambda x: painted(f"concat('[', {x}, ']')", "dimmed"))
    return reports.select("unit_id", F.expr(text).alias("report"))


def colours(spark) -> DataFrame:
    """family, name, terminal, red, green, blue, hex."""
    rows = [(f, DISPLAY[f], c, *rgb, "#" + "".join(f"{x:02x}" for x in rgb)) for f, (c, rgb) in COLOURS.items()]
    return spark.createDataFrame(rows, "family string, name string, terminal string, red int, green int, blue int, hex string")


def date_of(seconds: Column) -> Column:
    """YYYY-MM-DD of seconds since 1970, in UTC whatever the session's zone."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int")), "yyyy-MM-dd")


def clock_now() -> Column:
    """HH:MM:SS of now, in UTC."""
    s = F.unix_timestamp(F.current_timestamp()) % 86400
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("int"), F.floor(s / 60).cast("int") % 60, (s % 60).cast("int"))
