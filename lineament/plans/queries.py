"""Registered queries of the attribution engine, each with its DuckDB SQL where it has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineament.functions.portable import duck_text
from lineament.functions.written import Written
from lineament.operators import attribution as at
from lineament.operators import detect, learning, markov, reports, syntax, tables
from lineament.plans.catalogue import ANALYZERS, DISPLAY, FAMILIES, LANGUAGES, METRIC_RULES, SIGNALS
from lineament.plans.corpus import CODE_SQL, TEXT_SQL, code_units, text_units
from lineament.streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SHARES = ", ".join(f"share_{f}" for f in FAMILIES)
OUT = [*(f"share_{f}" for f in FAMILIES), "primary", "confidence"]
LINES = "WITH " + detect.lines_sql(CODE_SQL)


def code_signals(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    return detect.signals(code_units(spark, sf_dir), **kw)


# Lines, languages, signals. ---------------------------------------------------


@register("split_lines", LINES + " SELECT unit_id, i::INT AS i, l AS line FROM ls")
def split_lines(spark, d):
    return code_units(spark, d).select("unit_id", F.posexplode(detect.lines_of(F.col("source"))).alias("i", "line"))


@register("loc", "WITH " + detect.lines_sql(TEXT_SQL) + " SELECT unit_id, len(a)::INT AS loc FROM q")
def loc(spark, d):
    return text_units(spark, d).select("unit_id", F.size(detect.lines_of(F.col("source"))).alias("loc"))


@register("detect_language", LINES + " SELECT unit_id, path, language FROM q")
def detect_language(spark, d):
    return code_units(spark, d).select("unit_id", "path", detect.language_of(F.col("path")).alias("language"))


def _signals(analyzer: str, language: str) -> None:
    sql = "WITH " + detect.signals_sql(CODE_SQL, (analyzer,), (language,)) + f" SELECT unit_id, unnest(signals) AS signal FROM sg WHERE language = '{language}'"

    @register(f"signals_{analyzer}_{language}", sql)
    def run(spark, d):
        return code_signals(spark, d, analyzers=(analyzer,), languages=(language,)).select("unit_id", F.explode_outer("signals").alias("signal")).where("signal IS NOT NULL")


for _a in ANALYZERS:
    for _l in LANGUAGES:
        _signals(_a, _l)


@register("signals_all", "WITH " + detect.signals_sql(CODE_SQL) + " SELECT unit_id, unnest(signals) AS signal FROM sg")
def signals_all(spark, d):
    return code_signals(spark, d).select("unit_id", F.explode_outer("signals").alias("signal")).where("signal IS NOT NULL")


@register("signals_text", "WITH " + detect.signals_sql(TEXT_SQL, None, ("rust",)) + " SELECT unit_id, unnest(signals) AS signal FROM sg")
def signals_text(spark, d):
    return detect.signals(text_units(spark, d), languages=("rust",)).select("unit_id", F.explode_outer("signals").alias("signal")).where("signal IS NOT NULL")


def _features(name: str, language: str, spark_columns: list[str], sql_columns: str) -> None:
    sql = LINES + "," + detect.features_sql(language) + f" SELECT unit_id, {sql_columns} FROM f_{language}"

    @register(f"{name}_{language}", sql)
    def run(spark, d):
        lines = detect.with_lines(code_units(spark, d)).where(F.col("language") == language)
        return detect.features(lines, (language,)).selectExpr("unit_id", *spark_columns)


for _l in LANGUAGES:
    _features("names_extracted", _l, ["array_join(name_list, '|') AS name_list", "array_join(fn_list, '|') AS fn_list"], "array_to_string(a_names, '|') AS name_list, array_to_string(a_fn, '|') AS fn_list")
    _features("layout", _l, ["blank_runs", "array_join(run_list, '|') AS runs", "imports", "imports_sorted", "defs", "cast(first_def AS int) AS first_def", "CASE WHEN defs > 0 THEN round((n - first_def) / defs, 6) END AS avg_gap"],
              "blank_runs::INT AS blank_runs, array_to_string(a_runs, '|') AS runs, imports::INT AS imports, imports_sorted, defs, first_def::INT AS first_def, CASE WHEN defs > 0 THEN round((n - first_def)::DOUBLE / defs, 6) END AS avg_gap")

_ENTROPY = LINES + "," + detect.features_sql("python") + """,
ch AS (SELECT unit_id, unnest(string_split(array_to_string(a_names, ''), '')) AS c FROM f_python WHERE len(a_names) >= 10),
ct AS (SELECT unit_id, c, count(*) AS k FROM ch WHERE c <> '' GROUP BY ALL), tt AS (SELECT unit_id, sum(k) AS n FROM ct GROUP BY 1)
SELECT unit_id, round(-sum(k / n::DOUBLE * log2(k / n::DOUBLE)), 6) AS entropy FROM ct JOIN tt USING (unit_id) GROUP BY unit_id"""


@register("identifier_entropy", _ENTROPY)
def identifier_entropy(spark, d):
    lines = detect.with_lines(code_units(spark, d)).where("language = 'python'")
    f = detect.features(lines, ("python",)).select("unit_id", F.explode_outer(F.expr("IF(names >= 10, filter(split(array_join(name_list, ''), ''), c -> c <> ''), NULL)")).alias("c")).where("c IS NOT NULL")
    counts = f.groupBy("unit_id", "c").agg(F.count(F.lit(1)).alias("k"))
    share = F.col("k") / F.sum("k").over(Window.partitionBy("unit_id"))
    return counts.select("unit_id", share.alias("p")).groupBy("unit_id").agg(F.round(-F.sum(F.col("p") * F.log2("p")), 6).alias("entropy"))


# Verdicts. --------------------------------------------------------------------


def verdict_query(units_sql: str, languages=LANGUAGES) -> str:
    return "WITH " + detect.signals_sql(units_sql, None, languages) + "," + at.verdict_sql(at.sums_sql(), "unit_id, path, n, signal_count")


CODE_VERDICTS, TEXT_VERDICTS = verdict_query(CODE_SQL), verdict_query(TEXT_SQL, ("rust",))
VERDICT = f"unit_id, path, n::INT AS n, signal_count, {SHARES}, primary_family AS \"primary\", confidence"


def code_verdicts(spark, d):
    return at.attributed(code_signals(spark, d))


def text_verdicts(spark, d):
    return at.attributed(detect.signals(text_units(spark, d), languages=("rust",)))


@register("attribution", f"{CODE_VERDICTS} SELECT {VERDICT} FROM v")
def attribution(spark, d):
    return code_verdicts(spark, d)


@register("attribution_text", f"{TEXT_VERDICTS} SELECT {VERDICT.replace('path, ', '')} FROM v")
def attribution_text(spark, d):
    return text_verdicts(spark, d).drop("path")


@register("attribution_scores_long", f"{CODE_VERDICTS} " + " UNION ALL ".join(f"SELECT unit_id, '{f}' AS family, share_{f} AS share FROM v" for f in FAMILIES))
def attribution_scores_long(spark, d):
    return code_verdicts(spark, d).select("unit_id", F.explode(F.array(*[F.struct(F.lit(f).alias("family"), F.col(f"share_{f}").alias("share")) for f in FAMILIES])).alias("r")).select("unit_id", "r.*")


TIES = ((1, (10, 0, 0, 0, 10)), (2, (0, 0, 0, 0, 0)), (3, (5, 5, 5, 5, 5)), (4, (20, 5, 0, 0, 0)), (5, (20, 0, 0, 0, -10)), (6, (7, 7, 0, 7, 0)))


@register("attribution_ties", f"WITH {at.verdict_sql('SELECT * FROM (VALUES ' + ', '.join(f'({i}, ' + ', '.join(map(str, t)) + ')' for i, t in TIES) + ') x(unit_id, ' + ', '.join(f't_{f}' for f in FAMILIES) + ')', 'unit_id')} SELECT unit_id::BIGINT AS unit_id, {SHARES}, primary_family AS \"primary\", confidence FROM v")
def attribution_ties(spark, d):
    return at.verdict(spark.createDataFrame([(i, *t) for i, t in TIES], "unit_id long, " + ", ".join(f"t_{f} int" for f in FAMILIES)), ["unit_id"])


OVERRIDES = [("rust.naming.medium_descriptive", 3.0), ("python.comments.low_density", 0.0), ("js.idioms.destructuring", -1.0), ("go.idioms.iota_constants", 2.5), ("unknown.signal", 4.0)]
_OV = "(SELECT * FROM (VALUES " + ", ".join(f"('{i}', {round(w * 10)})" for i, w in OVERRIDES) + ") o(oid, w)) o"
_OV_SUMS = at.sums_sql("coalesce(o.w, c.tenths)", f"LEFT JOIN {_OV} ON o.oid = g.id")
REWEIGHTED = "WITH " + detect.signals_sql(CODE_SQL) + "," + at.verdict_sql(_OV_SUMS, "unit_id")


def overrides(spark):
    return spark.createDataFrame(OVERRIDES, "id string, weight double")


@register("reweight_override", f"{REWEIGHTED} SELECT unit_id, {SHARES}, primary_family AS \"primary\", confidence FROM v")
def reweight_override(spark, d):
    return at.scored_with(code_signals(spark, d), overrides(spark))


@register("disable_signal", "WITH " + detect.signals_sql(CODE_SQL) + f", x AS (SELECT unit_id, unnest(signals) AS id FROM sg) SELECT unit_id, id, family, round(coalesce(w, tenths) / 10.0::DOUBLE, 1) AS weight FROM x JOIN {at.CATALOGUE_SQL} c USING (id) LEFT JOIN {_OV} ON oid = id WHERE coalesce(w, tenths) <> 0")
def disable_signal(spark, d):
    return at.weighted(code_signals(spark, d), overrides(spark)).withColumn("weight", F.round("weight", 1))


_LIT = [(1, "rust.errors.zero_unwrap"), (1, "no.such.signal"), (2, "unknown.signal")]


@register("unknown_id_weight", "SELECT * FROM (VALUES (1::BIGINT, 'rust.errors.zero_unwrap', 0.8::DOUBLE), (1, 'no.such.signal', 1.0), (2, 'unknown.signal', 4.0)) v(unit_id, id, weight)")
def unknown_id_weight(spark, d):
    rows = spark.createDataFrame(_LIT, "unit_id long, id string").groupBy("unit_id").agg(F.collect_list("id").alias("signals"))
    return at.weighted(rows, overrides(spark)).select("unit_id", "id", "weight")


@register("blend_scores", f"{CODE_VERDICTS}, w AS (SELECT unit_id, {', '.join(f'CASE WHEN unit_id % 5 = {k} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS m_{f}' for k, f in enumerate(FAMILIES))} FROM u), b AS (SELECT unit_id, {', '.join(f'round(share_{f} * 0.75 + m_{f} * 0.25, 8) AS share_{f}' for f in FAMILIES)} FROM v JOIN w USING (unit_id)) SELECT unit_id, {SHARES}, {at.primary_sql().replace('primary_family', chr(34) + 'primary' + chr(34))} FROM b")
def blend_scores(spark, d):
    given = [F.when(F.col("unit_id") % 5 == k, F.lit(1.0)).otherwise(F.lit(0.0)).alias(f"o_{f}") for k, f in enumerate(FAMILIES)]
    return at.mixed(code_verdicts(spark, d).select("*", *given), 0.25)


@register("assert_family_gate", f"{CODE_VERDICTS} SELECT unit_id, primary_family AS \"primary\" FROM v WHERE signal_count > 0 AND primary_family NOT IN ('claude', 'human')")
def assert_family_gate(spark, d):
    return at.gate(code_verdicts(spark, d), ["Claude", "human"]).select("unit_id", "primary")


_METRICS = [("rust", "avg_complexity", "l_quantity / 10"), ("rust", "identifier_entropy", "l_quantity / 12"), ("python", "doc_coverage_ratio", "l_discount * 10"), ("js", "arrow_fn_ratio", "l_tax * 12"), ("go", "err_nil_check_count", "l_linenumber")]
_RULES = ", ".join(f"('{i}', '{i.split('_cst')[0]}', '{m}', '{op}', {t}::DOUBLE, {'NULL' if most is None else most}::DOUBLE)" for i, _, _, m, op, t, most in METRIC_RULES)


@register("metric_rules", f"WITH m AS ({' UNION ALL '.join(f'''SELECT l_orderkey * 10 + l_linenumber AS unit_id, '{a}' AS language, '{b}' AS metric, ({c})::DOUBLE AS value FROM lineitem''' for a, b, c in _METRICS)}), r AS (SELECT * FROM (VALUES {_RULES}) r(id, language, metric, op, threshold, most)) SELECT unit_id, id FROM m JOIN r USING (language, metric) WHERE CASE op WHEN '>=' THEN value >= threshold WHEN '<=' THEN value <= threshold WHEN '>' THEN value > threshold ELSE value < threshold END AND (most IS NULL OR value <= most)")
def metric_rules(spark, d):
    items = read(spark, d, "lineitem")
    rows = items.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("unit_id"), F.explode(F.array(*[F.struct(F.lit(a).alias("language"), F.lit(b).alias("metric"), F.expr(c).cast("double").alias("value")) for a, b, c in _METRICS])).alias("m"))
    return at.metric_signals(rows.select("unit_id", "m.*"))


def text_reports(spark, d):
    return reports.reported(detect.signals(text_units(spark, d), languages=("rust",)), at.attributed)


_HITS = "h AS (SELECT unit_id, list({'id': id, 'source': analyzer, 'description': replace(split_part(id, '.', 3), '_', ' '), 'family': family, 'weight': tenths / 10.0::DOUBLE} ORDER BY k) AS signals FROM (SELECT unit_id, unnest(signals) AS id, generate_subscripts(signals, 1) AS k FROM sg) JOIN " + at.CATALOGUE_SQL + " USING (id) GROUP BY unit_id)"
_SCORES = ", ".join(f"'{f}': share_{f}" for f in FAMILIES)
_NO_SIGNALS = "[]::STRUCT(id VARCHAR, source VARCHAR, description VARCHAR, family VARCHAR, weight DOUBLE)[]"
_REPORTS = f"{TEXT_VERDICTS}, {_HITS}, rp AS (SELECT unit_id, path, n::INT AS n, signal_count, primary_family, confidence, {SHARES}, coalesce(signals, {_NO_SIGNALS}) AS signals FROM v LEFT JOIN h USING (unit_id))"


@register("report_json", f"{_REPORTS} SELECT unit_id, to_json({{'attribution': {{'primary': primary_family, 'confidence': confidence, 'scores': {{{_SCORES}}}}}, 'signals': signals, 'metadata': {{'file_path': path, 'lines_of_code': n, 'signal_count': signal_count}}}})::VARCHAR AS report FROM rp")
def report_json(spark, d):
    return reports.as_json(text_reports(spark, d))


_NAME = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in DISPLAY.items()) + " END"
_PM = "floor((round({0} * 1000000) + 500) / 1000)::INT"
_SCORE_LINES = " UNION ALL ".join(f"SELECT unit_id, share_{f} AS share, '{DISPLAY[f]}' AS name FROM rp" for f in FAMILIES)


@register("report_text", f"""{_REPORTS}, sc AS (SELECT unit_id, string_agg('  ' || rpad(name, 10, ' ') || ' ' || ({_PM.format('share')} // 10) || '.' || ({_PM.format('share')} % 10) || '%', chr(10) ORDER BY share DESC, name) AS scores FROM ({_SCORE_LINES}) GROUP BY unit_id)
SELECT unit_id, CASE WHEN path IS NULL THEN '' ELSE 'File: ' || path || chr(10) END || 'Verdict: ' || CASE WHEN confidence > 0 THEN {_NAME.format('primary_family')} || ' (' || floor((round(confidence * 1000000) + 5000) / 10000)::INT || '% confidence)' ELSE 'Insufficient data' END || chr(10)
 || 'Lines: ' || n || ' | Signals: ' || signal_count || chr(10) || chr(10) || 'Scores:' || chr(10) || scores || chr(10)
 || CASE WHEN len(signals) = 0 THEN '' ELSE chr(10) || 'Signals:' || chr(10) || array_to_string(list_transform(signals, lambda g: '  [' || rpad(g.source, 10, ' ') || '] ' || CASE WHEN g.weight >= 0 THEN '+' ELSE '' END || printf('%.1f', g.weight) || ' ' || {_NAME.format('g.family')} || ' — ' || g.description), chr(10)) || chr(10) END AS report FROM rp JOIN sc USING (unit_id)""")
def report_text(spark, d):
    return reports.as_text(text_reports(spark, d))


def _painted(code: str, text: str) -> str:
    return f"chr(27) || '[{code}m' || {text} || chr(27) || '[0m'"


_CODE = "CASE {0} " + " ".join(f"WHEN '{f}' THEN '{reports.ANSI[c]}'" for f, (c, _) in reports.COLOURS.items()) + " END"
_COLOURED = "chr(27) || '[' || {1} || 'm' || {0} || chr(27) || '[0m'"
_PRETTY_LINES = " UNION ALL ".join(f"SELECT unit_id, share_{f} AS share, '{DISPLAY[f]}' AS name, '{f}' AS family FROM rp" for f in FAMILIES)
_BAR = _COLOURED.format("repeat('█', floor(share * 30)::INT)", _CODE.format("family"))
_SIGN = "CASE WHEN g.weight >= 0 THEN '+' ELSE '' END || printf('%.1f', g.weight)"


@register("report_pretty", f"""{_REPORTS}, sc AS (SELECT unit_id, string_agg('  ' || rpad(name, 10, ' ') || ' ' || {_BAR} || ' ' || ({_PM.format('share')} // 10) || '.' || ({_PM.format('share')} % 10) || '%', chr(10) ORDER BY share DESC, name) AS scores FROM ({_PRETTY_LINES}) GROUP BY unit_id)
SELECT unit_id, CASE WHEN path IS NULL THEN '' ELSE {_painted('1', "'File:'")} || ' ' || path || chr(10) END || {_painted('1', "'Verdict:'")} || ' ' ||
 CASE WHEN confidence > 0 THEN {_COLOURED.format(_NAME.format('primary_family') + " || ' (' || floor((round(confidence * 1000000) + 5000) / 10000)::INT || '% confidence)'", _CODE.format('primary_family'))} ELSE {_painted('2', "'Insufficient data'")} END || chr(10)
 || {_painted('2', "'Lines:'")} || ' ' || n || ' | ' || {_painted('2', "'Signals:'")} || ' ' || signal_count || chr(10) || chr(10) || {_painted('1', "'Scores:'")} || chr(10) || scores || chr(10)
 || CASE WHEN len(signals) = 0 THEN '' ELSE chr(10) || {_painted('1', "'Signals:'")} || chr(10) || array_to_string(list_transform(signals, lambda g: '  ' || {_painted('2', "'[' || g.source || ']'")} || ' ' || CASE WHEN g.weight >= 0 THEN {_painted('32', _SIGN)} ELSE {_painted('31', _SIGN)} END || ' ' || {_painted('1', _NAME.format('g.family'))} || ' — ' || g.description), chr(10)) || chr(10) END AS report FROM rp JOIN sc USING (unit_id)""")
def report_pretty(spark, d):
    return reports.as_pretty(text_reports(spark, d))


@register("report_round_trip", f"{_REPORTS} SELECT unit_id, primary_family AS \"primary\", confidence, len(signals)::INT AS signals, n AS lines_of_code FROM rp")
def report_round_trip(spark, d):
    return reports.from_json(reports.as_json(text_reports(spark, d))).select("unit_id", "report.attribution.primary", "report.attribution.confidence", F.size("report.signals").alias("signals"), "report.metadata.lines_of_code")


@register("colour_lookup", "SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{DISPLAY[f]}', '{c}', {r}, {g}, {b}, printf('#%02x%02x%02x', {r}, {g}, {b}))" for f, (c, (r, g, b)) in reports.COLOURS.items()) + ") v(family, name, terminal, red, green, blue, hex)")
def colour_lookup(spark, d):
    return reports.colours(spark)


# Syntax: metrics, symbols, node sequences, and verdicts with metric rules. ------------


def full_verdicts(spark, d):
    return at.attributed(syntax.signals(code_units(spark, d)))


@register("attribution_full")
def attribution_full(spark, d):
    """All 232 rules: text rules, and metric rules over the sources' own syntax."""
    return full_verdicts(spark, d)


def _syntax(language: str) -> None:
    @register(f"cst_metrics_{language}")
    def run_metrics(spark, d):
        return syntax.metrics(code_units(spark, d)).where(F.col("language") == language)

    @register(f"symbols_{language}")
    def run_symbols(spark, d):
        units = code_units(spark, d)
        return syntax.symbols(units.where(detect.language_of(F.col("path")) == language))


for _l in LANGUAGES:
    _syntax(_l)


@register("symbol_reports")
def symbol_reports(spark, d):
    """A verdict for each symbol, by the rules of its file's language."""
    v = at.attributed(detect.signals(syntax.symbol_units(code_units(spark, d))))
    return v.select("unit_id.*", "path", "n", "signal_count", "primary", "confidence")


@register("node_sequences")
def node_sequences(spark, d):
    return syntax.sequences(code_units(spark, d))


# Trees, rollups, ignore rules, tools. --------------------------------------------

_DISPLAY_ORDER = sorted(FAMILIES, key=lambda f: DISPLAY[f], reverse=True)
_BEST = "greatest(" + ", ".join(f"w_{f}" for f in FAMILIES) + ")"


@register("dir_rollup", f"{CODE_VERDICTS}, e AS (SELECT unnest(['', 'src', 'src/' || string_split(path, '/')[2]]) AS dir, primary_family AS p, greatest(n, 1) AS loc, round(confidence * 1000000)::BIGINT * greatest(n, 1) AS w FROM v), g AS (SELECT dir, sum(loc)::BIGINT AS loc, count(*) AS files, {', '.join(f'''sum(CASE WHEN p = '{f}' THEN w ELSE 0 END)::BIGINT AS w_{f}''' for f in FAMILIES)} FROM e GROUP BY dir) SELECT dir, files, CASE {' '.join(f'''WHEN w_{f} = {_BEST} THEN '{f}' ''' for f in _DISPLAY_ORDER)} END AS \"primary\", round({_BEST} / loc::DOUBLE / 1000000, 4) AS confidence FROM g")
def dir_rollup(spark, d):
    return tables.rolled_up(code_verdicts(spark, d))


@register("family_share", f"{CODE_VERDICTS} " + " UNION ALL ".join(f"SELECT '{f}' AS family, floor(sum(round(share_{f} * 1000000)::BIGINT * n)::DOUBLE / sum(n) / 10000 + 0.5)::BIGINT AS percent FROM v WHERE n >= 1" for f in FAMILIES))
def family_share(spark, d):
    return tables.family_share(code_verdicts(spark, d))


PATTERNS = ["*.go", "!1*.go", "src/Brand#1*/", "**/2?.py"]


def _ignored_sql() -> str:
    out = "false"
    for p in PATTERNS:
        regex, verdict = tables.glob_regex(p)
        out = f"CASE WHEN regexp_matches(path, {duck_text(regex)}) THEN {str(verdict).lower()} ELSE {out} END"
    return out


@register("ignore_patterns", f"SELECT unit_id, path, {_ignored_sql()} AS ignored, contains(path, '#2') OR contains(path, '/33') AS by_part FROM ({CODE_SQL})")
def ignore_patterns(spark, d):
    p = F.col("path")
    return code_units(spark, d).select("unit_id", "path", tables.ignored(p, PATTERNS).alias("ignored"), tables.contains_any(p, ["#2", "/33"]).alias("by_part"))


PATHS = ["CLAUDE.md", "a/AGENTS.md", "a/b/.cursorrules", "a/.cursor/rules/x.md", "a/.cursor/rules/y.md", ".github/copilot-instructions.md", "b/GEMINI.md", "c/.windsurfrules", "c/.aider.conf", "c/.aider.chat", "src/main.rs", "xCLAUDE.md"]
_FOUND = [("", "claude", "CLAUDE.md"), ("a/", "claude", "a/AGENTS.md"), ("a/b/", "cursor", "a/b/.cursorrules"), ("a/", "cursor", "a/.cursor/rules"), ("", "copilot", ".github/copilot-instructions.md"), ("b/", "gemini", "b/GEMINI.md"), ("c/", "windsurf", "c/.windsurfrules"), ("c/", "aider", "c/.aider.chat")]


@register("project_tools", "SELECT * FROM (VALUES " + ", ".join(map(str, _FOUND)) + ") v(dir, tool, config_path)")
def project_tools(spark, d):
    return tables.project_tools(spark.createDataFrame([(p,) for p in PATHS], "path string"))


@register("catalogue_topk", f"SELECT language, id, family, tenths / 10.0::DOUBLE AS weight FROM {at.CATALOGUE_SQL} QUALIFY row_number() OVER (PARTITION BY language ORDER BY tenths DESC, id) <= 5")
def catalogue_topk(spark, d):
    rows = at.catalogue(spark).where("analyzer <> 'cst'")
    rank = F.row_number().over(Window.partitionBy("language").orderBy(F.desc("tenths"), "id"))
    return rows.withColumn("k", rank).where("k <= 5").select("language", "id", "family", (F.col("tenths") / 10).alias("weight"))


@register("catalogue_family_counts", f"SELECT family, count(*) AS signals, sum(tenths)::BIGINT AS tenths FROM {at.CATALOGUE_SQL} GROUP BY family")
def catalogue_family_counts(spark, d):
    return at.catalogue(spark).where("analyzer <> 'cst'").groupBy("family").agg(F.count(F.lit(1)).alias("signals"), F.sum("tenths").alias("tenths"))


# Hashes, caches, stores. -----------------------------------------------------------

_HASH = f"sha256('{tables.EPOCH}' || chr(10) || chr(10) || chr(10) || coalesce(text, ''))"


def hashed(spark, d):
    return read(spark, d, "documents").select(F.col("doc_id").alias("unit_id"), tables.content_key(F.col("text")).alias("hash"))


@register("content_hash", f"SELECT doc_id AS unit_id, {_HASH} AS hash FROM documents")
def content_hash(spark, d):
    return hashed(spark, d)


def cached(spark, d):
    """A cache that knows the texts of even documents."""
    return hashed(spark, d).where("unit_id % 2 = 0").groupBy("hash").agg(F.min("unit_id").alias("cached_by"))


_CACHE = f"h AS (SELECT doc_id AS unit_id, {_HASH} AS hash FROM documents), c AS (SELECT hash, min(unit_id) AS cached_by FROM h WHERE unit_id % 2 = 0 GROUP BY hash)"


@register("cache_hits", f"WITH {_CACHE} SELECT unit_id, hash, cached_by FROM h JOIN c USING (hash)")
def cache_hits(spark, d):
    return tables.cache_hits(hashed(spark, d), cached(spark, d))


@register("cache_misses", f"WITH {_CACHE} SELECT unit_id, hash FROM h WHERE hash NOT IN (SELECT hash FROM c)")
def cache_misses(spark, d):
    return tables.cache_misses(hashed(spark, d), cached(spark, d))


@register("corpus_dedup", f"SELECT {_HASH} AS hash, min(doc_id) AS unit_id, count(*) AS copies FROM documents GROUP BY 1")
def corpus_dedup(spark, d):
    return tables.first_by_hash(hashed(spark, d))


_MERKLE = f"""WITH f AS (SELECT path, unhex(sha256(source)) AS h, string_split(path, '/')[2] AS b FROM ({CODE_SQL})),
k2 AS (SELECT 'src/' || b AS dir, sha256(unhex(string_agg(hex(h), '' ORDER BY path))) AS hash, count(*)::INT AS children FROM f GROUP BY b),
k1 AS (SELECT 'src' AS dir, sha256(unhex(string_agg(hash, '' ORDER BY dir))) AS hash, count(*)::INT AS children FROM k2),
k0 AS (SELECT '' AS dir, sha256(unhex(hash)) AS hash, 1 AS children FROM k1)
SELECT * FROM k2 UNION ALL SELECT * FROM k1 UNION ALL SELECT * FROM k0"""


@register("merkle_dirs", _MERKLE)
def merkle_dirs(spark, d):
    return tables.merkle(code_units(spark, d).select("path", F.sha2("source", 256).alias("hash")))


@register("changed_dirs", _MERKLE.replace("sha256(source)", "sha256(CASE WHEN unit_id % 1000 = 0 THEN '' ELSE source END)").replace("SELECT * FROM k2 UNION ALL SELECT * FROM k1 UNION ALL SELECT * FROM k0", "SELECT DISTINCT dir, 'changed' AS change FROM (SELECT unnest(['', 'src', 'src/' || b]) AS dir FROM (SELECT string_split(path, '/')[2] AS b FROM (" + CODE_SQL + ") WHERE unit_id % 1000 = 0))"))
def changed_dirs(spark, d):
    """Directories that differ after every thousandth file was emptied."""
    units = code_units(spark, d)
    now = units.select("path", F.sha2(F.when(F.col("unit_id") % 1000 == 0, "").otherwise(F.col("source")), 256).alias("hash"))
    return tables.changed_dirs(tables.merkle(now), tables.merkle(units.select("path", F.sha2("source", 256).alias("hash"))))


@register("flat_tree", f"""{CODE_VERDICTS}, e AS (SELECT unnest(['src', 'src/' || string_split(path, '/')[2]]) AS dir, primary_family AS p, greatest(n, 1) AS loc, round(confidence * 1000000)::BIGINT * greatest(n, 1) AS w FROM v), g AS (SELECT dir, sum(loc)::BIGINT AS loc, {', '.join(f"sum(CASE WHEN p = '{f}' THEN w ELSE 0 END)::BIGINT AS w_{f}" for f in FAMILIES)} FROM e GROUP BY dir),
t AS (SELECT dir AS path, true AS is_dir, CASE {' '.join(f"WHEN w_{f} = {_BEST} THEN '{f}' " for f in _DISPLAY_ORDER)} END AS "primary", round({_BEST} / loc::DOUBLE / 1000000, 4) AS confidence FROM g UNION ALL SELECT path, false, primary_family, confidence FROM v)
SELECT path, string_split(path, '/')[-1] AS name, (len(string_split(path, '/')) - 1)::INT AS depth, is_dir, "primary", confidence FROM t""")
def flat_tree(spark, d):
    return tables.walked(code_verdicts(spark, d))


@register("tree_at_commits", f"""{CODE_VERDICTS}, x AS (SELECT unit_id % 7 AS commit, * FROM v), g AS (SELECT commit, sum(greatest(n, 1))::BIGINT AS loc, count(*) AS files, {', '.join(f"sum(CASE WHEN primary_family = '{f}' THEN round(confidence * 1000000)::BIGINT * greatest(n, 1) ELSE 0 END)::BIGINT AS w_{f}" for f in FAMILIES)} FROM x GROUP BY commit)
SELECT commit, files, CASE {' '.join(f"WHEN w_{f} = {_BEST} THEN '{f}' " for f in _DISPLAY_ORDER)} END AS "primary", round({_BEST} / loc::DOUBLE / 1000000, 4) AS confidence FROM g""")
def tree_at_commits(spark, d):
    return tables.at_commits(code_verdicts(spark, d).withColumn("commit", F.col("unit_id") % 7))


# Histories. -------------------------------------------------------------------------


def turn_units(spark, d):
    return read(spark, d, "conversations").select(F.struct(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn")).alias("unit_id"), F.lit(None).cast("string").alias("path"), F.col("text").alias("source"))


TURN_SQL = "SELECT {'c': conv_id, 't': turn} AS unit_id, CAST(NULL AS VARCHAR) AS path, text AS source FROM conversations"
_TURNS = verdict_query(TURN_SQL, ("rust",))


def turn_verdicts(spark, d):
    v = at.attributed(detect.signals(turn_units(spark, d), languages=("rust",)))
    return v.select(F.col("unit_id.conv_id").alias("path"), F.col("unit_id.turn").alias("turn"), "primary", "confidence")


@register("history_delta", f"{_TURNS}, h AS (SELECT unit_id.c AS path, unit_id.t AS turn, primary_family AS p, confidence AS c, lag(primary_family) OVER w AS np, lag(confidence) OVER w AS nc, row_number() OVER w AS k FROM v WINDOW w AS (PARTITION BY unit_id.c ORDER BY unit_id.t DESC)) SELECT path, turn, p AS \"primary\", c AS confidence, CASE WHEN np IS NULL THEN '' WHEN np <> p THEN np || ' to ' || p WHEN abs(round(c - nc, 6)) < 0.005 THEN 'same' WHEN c > nc THEN 'up' ELSE 'down' END AS change FROM h WHERE k <= 20")
def history_delta(spark, d):
    return tables.history(turn_verdicts(spark, d))


@register("trend_series", f"{_TURNS} SELECT unit_id.t AS turn, primary_family AS \"primary\", count(*) AS units, round(avg(confidence), 4) AS confidence FROM v GROUP BY ALL")
def trend_series(spark, d):
    return turn_verdicts(spark, d).groupBy("turn", "primary").agg(F.count(F.lit(1)).alias("units"), F.round(F.avg("confidence"), 4).alias("confidence"))


# Sequences and learning. ----------------------------------------------------------------


def sequences(spark, d):
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return read(spark, d, "events").select((F.col("user_id") % 5).alias("family"), F.col("user_id").alias("seq_id"), pos.alias("pos"), F.col("event_type").alias("token"))


_SEQ = "s AS (SELECT user_id % 5 AS family, user_id AS seq_id, event_type AS context, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events), c AS (SELECT family, context, nxt, count(*) AS k FROM s WHERE nxt IS NOT NULL GROUP BY ALL), z AS (SELECT count(DISTINCT event_type) AS v FROM events), t AS (SELECT *, (sum(k) OVER (PARTITION BY family, context))::BIGINT AS total FROM c), m AS (SELECT family, context, nxt, k, total, round((k + 0.5::DOUBLE) / (total + 0.5::DOUBLE * v), 6) AS prob FROM t, z)"


@register("transition_probs", f"WITH {_SEQ} SELECT family, context, nxt AS next, k AS count, total, prob FROM m")
def transition_probs(spark, d):
    return markov.transitions(sequences(spark, d))


_LL = f"WITH {_SEQ}, g AS (SELECT seq_id, context, nxt, count(*) AS times FROM s WHERE nxt IS NOT NULL GROUP BY ALL), b AS (SELECT family, context, sum(prob) AS mass, count(*) AS seen FROM m GROUP BY ALL), f AS (SELECT DISTINCT family FROM m), l AS (SELECT seq_id, f.family, sum(times * CASE WHEN mass IS NULL THEN ln(1.0::DOUBLE / v) ELSE ln(coalesce(prob, greatest((1 - mass) / greatest(v - seen, 1), 1e-12))) END) AS ll FROM g CROSS JOIN f CROSS JOIN z LEFT JOIN b ON b.family = f.family AND b.context = g.context LEFT JOIN m ON m.family = f.family AND m.context = g.context AND m.nxt = g.nxt GROUP BY ALL)"


@register("sequence_loglik", f"{_LL} SELECT seq_id, family, round(ll, 4) AS ll FROM l")
def sequence_loglik(spark, d):
    s = sequences(spark, d)
    size = s.select("token").distinct().count()
    return markov.likelihoods(s, markov.transitions(s), size).select("seq_id", "family", F.round("ll", 4).alias("ll"))


@register("markov_classify", f"{_LL}, e AS (SELECT seq_id, family, exp(ll - max(ll) OVER (PARTITION BY seq_id)) AS e FROM l) SELECT seq_id, arg_max(family, e) AS family, round(max(e) / sum(e), 6) AS prob FROM e GROUP BY seq_id")
def markov_classify(spark, d):
    s = sequences(spark, d)
    size = s.select("token").distinct().count()
    return markov.classified(markov.likelihoods(s, markov.transitions(s), size))


@register("label_index", f"{CODE_VERDICTS} SELECT primary_family AS label, (dense_rank() OVER (ORDER BY primary_family) - 1)::INT AS idx FROM (SELECT DISTINCT primary_family FROM v)")
def label_index(spark, d):
    labels = code_verdicts(spark, d).select(F.col("primary").alias("label")).distinct()
    # At most one row a family reaches the window.
    return labels.select("label", (F.dense_rank().over(Window.orderBy("label")) - 1).alias("idx"))


_VOTES = "SELECT unit_id, primary_family AS family, 2.0::DOUBLE AS weight FROM v UNION ALL SELECT unit_id, ['claude','gpt','gemini','copilot','human'][unit_id % 5 + 1], 1.0::DOUBLE FROM v"


@register("ensemble_vote", f"{CODE_VERDICTS}, x AS ({_VOTES}) SELECT unit_id, family, round(sum(weight) / 3.0, 6) AS share FROM x GROUP BY ALL")
def ensemble_vote(spark, d):
    other = F.element_at(F.lit(list(FAMILIES)), (F.col("unit_id") % 5 + 1).cast("int"))
    votes = F.array(F.struct(F.col("primary").alias("family"), F.lit(2.0).alias("weight")), F.struct(other.alias("family"), F.lit(1.0).alias("weight")))
    return markov.voted(code_verdicts(spark, d).select("unit_id", F.explode(votes).alias("v")).select("unit_id", "v.*"))


@register("accuracy", f"{CODE_VERDICTS} SELECT round(avg(CASE WHEN primary_family = ['claude','gpt','gemini','copilot','human'][unit_id % 5 + 1] THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy FROM v")
def accuracy(spark, d):
    v = code_verdicts(spark, d).withColumn("label", F.element_at(F.lit(list(FAMILIES)), (F.col("unit_id") % 5 + 1).cast("int")))
    return markov.accuracy(v, "label", "primary")


@register("stratified_split", "SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id::VARCHAR), doc_id) <= least(greatest(floor(count(*) OVER (PARTITION BY quality) * 0.2::DOUBLE + 0.5), 1), count(*) OVER (PARTITION BY quality) - 1) AS test FROM labels")
def stratified_split(spark, d):
    return markov.stratified(read(spark, d, "labels").select("doc_id", "quality"), F.col("doc_id"), "quality")


_IDS = [s.id for s in SIGNALS if s.language == "rust"]


@register("feature_vector", "WITH " + detect.signals_sql(TEXT_SQL, None, ("rust",)) + f" SELECT unit_id, array_to_string([{', '.join(f'''CASE WHEN list_contains(signals, '{i}') THEN '1' ELSE '0' END''' for i in sorted(_IDS))}], '') AS vector FROM sg")
def feature_vector(spark, d):
    s = detect.signals(text_units(spark, d), languages=("rust",))
    return s.select("unit_id", F.concat(*[F.when(F.array_contains("signals", i), F.lit("1")).otherwise(F.lit("0")) for i in sorted(_IDS)]).alias("vector"))


def full_signals(spark, d):
    """Signals of code units with all rules and metrics, written once: models are fitted on them and speak of them."""
    return Written(syntax.signals(code_units(spark, d)).select("unit_id", "path", "n", "language", "hits", "metrics"), "full-signals").df


def code_features(signals):
    """Features of units with signals, labelled by the text rules' verdict."""
    labelled = at.attributed(signals, ("unit_id", "path", "n", "language", "hits", "metrics")).where("signal_count > 0")
    return learning.extracted(labelled, ("primary",))


@register("trained_ensemble")
def trained_ensemble(spark, d):
    """Votes of three models fitted on the features of all code units."""
    rows = code_features(full_signals(spark, d))
    return learning.fit(rows, "primary").votes(rows)


@register("rescored_verdicts")
def rescored_verdicts(spark, d):
    """Verdicts blended with what the fitted models say of the same units."""
    signals = full_signals(spark, d)
    rows = code_features(signals)
    model = learning.rescored(learning.fit(rows, "primary").votes(rows))
    return at.blended(at.attributed(signals), model, 0.25)


_RAW_VOTES = [(1, "claude", 0.5), (1, "martian", 0.5), (2, "GPT", 0.25), (2, "human", 0.25), (2, "other", 0.5), (3, "other", 1.0), (4, "gemini", 1.0)]


@register("rescore_residual", "SELECT * FROM (VALUES (1::BIGINT, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 'claude', 1.0::DOUBLE), (2, 0, 0.25, 0, 0, 0.75, 'human', 0.75), (3, 0, 0, 0, 0, 1, 'human', 1), (4, 0, 0, 1, 0, 0, 'gemini', 1)) v(unit_id, share_claude, share_gpt, share_gemini, share_copilot, share_human, \"primary\", confidence)")
def rescore_residual(spark, d):
    return learning.rescored(spark.createDataFrame(_RAW_VOTES, "unit_id long, family string, share double"))


@register("feature_map", "WITH " + detect.signals_sql(TEXT_SQL, None, ("rust",)) + f" SELECT unit_id, id AS name, tenths / 10.0::DOUBLE AS value FROM (SELECT unit_id, unnest(signals) AS id FROM sg) JOIN {at.CATALOGUE_SQL} USING (id)")
def feature_map(spark, d):
    rows = learning.extracted(detect.signals(text_units(spark, d), languages=("rust",)))
    return rows.select("unit_id", F.explode("features").alias("name", "value"))


def spoken(spark, d):
    return sequences(spark, d).select(F.concat(F.lit("l"), (F.col("seq_id") % 2).cast("string")).alias("language"), F.col("family").cast("string").alias("family"), "seq_id", "pos", "token")


_W = "PARTITION BY user_id ORDER BY ts, event_id"
_GRAMS = f"""e AS (SELECT 'l' || user_id % 2 AS language, (user_id % 5)::VARCHAR AS family, user_id AS seq_id, event_type AS t0, lead(event_type, 1) OVER ({_W}) AS t1, lead(event_type, 2) OVER ({_W}) AS t2, lead(event_type, 3) OVER ({_W}) AS t3 FROM events),
g AS (SELECT language, family, seq_id, 1 AS ord, t0 AS context, t1 AS nxt FROM e WHERE t1 IS NOT NULL UNION ALL SELECT language, family, seq_id, 2, t0 || ',' || t1, t2 FROM e WHERE t2 IS NOT NULL UNION ALL SELECT language, family, seq_id, 3, t0 || ',' || t1 || ',' || t2, t3 FROM e WHERE t3 IS NOT NULL),
c AS (SELECT language, family, ord, context, nxt, count(*) AS k FROM g GROUP BY ALL), z AS (SELECT count(DISTINCT event_type) + 1 AS v FROM events),
m AS (SELECT *, (k + 0.5::DOUBLE) / (total + 0.5::DOUBLE * v) AS prob FROM (SELECT *, (sum(k) OVER (PARTITION BY language, family, ord, context))::BIGINT AS total FROM c), z)"""


@register("ngram_counts", f"WITH {_GRAMS} SELECT language, family, ord AS \"order\", context, nxt AS next, k AS count, total, round(prob, 6) AS prob FROM m")
def ngram_counts(spark, d):
    s = spoken(spark, d)
    size = s.select("token").distinct().count() + 1
    return markov.trained_orders(markov.ngrams(s), size).withColumn("prob", F.round("prob", 6))


@register("markov_backoff", f"""WITH {_GRAMS}, b AS (SELECT language, family, ord, context, sum(prob) AS mass, count(*) AS seen FROM m GROUP BY ALL), f AS (SELECT DISTINCT language, family, ord FROM m),
q AS (SELECT language, seq_id, ord, context, nxt, count(*) AS times FROM g GROUP BY ALL),
l AS (SELECT seq_id, f.family, ord, sum(times * CASE WHEN mass IS NULL THEN ln(1.0::DOUBLE / v) ELSE ln(coalesce(prob, greatest((1 - mass) / greatest(v - seen, 1), 2.2250738585072014e-308))) END) AS ll
  FROM q JOIN f USING (language, ord) CROSS JOIN z LEFT JOIN b USING (language, family, ord, context) LEFT JOIN (SELECT language, family, ord, context, nxt, prob FROM m) m USING (language, family, ord, context, nxt) GROUP BY ALL),
t AS (SELECT seq_id, family, max(ord) AS ord, arg_max(ll, ord) AS ll FROM l WHERE ll <> 0 GROUP BY ALL),
a AS (SELECT seq_id, f.family, t.ord, t.ll FROM (SELECT DISTINCT seq_id, language FROM e) JOIN (SELECT DISTINCT language, family FROM f) f USING (language) LEFT JOIN t USING (seq_id, family)),
x AS (SELECT *, max(ll) OVER w AS top, count(*) OVER w AS n FROM a WINDOW w AS (PARTITION BY seq_id)),
y AS (SELECT *, CASE WHEN top IS NULL THEN 1.0::DOUBLE / n ELSE coalesce(exp(ll - top), 0) END AS e FROM x)
SELECT seq_id, family, ord AS "order", round(e / sum(e) OVER (PARTITION BY seq_id), 6) AS prob FROM y""")
def markov_backoff(spark, d):
    rows = Written(markov.whole(spoken(spark, d)), "sequences").df
    size = rows.select(F.explode("tokens").alias("token")).distinct().count() + 1
    return markov.backed_off(rows, markov.smoothed(markov.counted_orders(rows), size), size).withColumn("prob", F.round("prob", 6))


@register("markov_nodes")
def markov_nodes(spark, d):
    """Families of code units by their node sequences: models of their own verdicts' families, by language."""
    verdicts = at.attributed(syntax.kinds(code_units(spark, d)), ("unit_id", "path", "n", "language", "kinds"))
    rows = Written(verdicts.select("language", F.col("primary").alias("family"), F.col("unit_id").alias("seq_id"), F.col("kinds").alias("tokens")), "node-sequences").df.where("size(tokens) > 0")
    size = rows.select(F.explode("tokens").alias("token")).distinct().count() + 1
    return markov.backed_off(rows, markov.smoothed(markov.counted_orders(rows), size), size)


# Watching. ---------------------------------------------------------------------------------


def saves(spark, d):
    return read(spark, d, "events").select(F.col("user_id").alias("path"), (F.col("user_id") % 10).alias("watcher"), F.expr("floor(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) / 1000)").alias("ms"))


_SAVES = "sv AS (SELECT user_id AS path, user_id % 10 AS watcher, floor(epoch_us(ts) / 1000)::BIGINT AS ms FROM events)"


@register("watch_debounced", f"""WITH RECURSIVE {_SAVES}, w AS (SELECT watcher, min(ms) AS opened FROM sv GROUP BY watcher
 UNION ALL SELECT w.watcher, (SELECT min(ms) FROM sv WHERE sv.watcher = w.watcher AND sv.ms >= w.opened + {watch.DEBOUNCE_MS}) FROM w WHERE w.opened IS NOT NULL)
SELECT DISTINCT sv.path, w.opened + {watch.DEBOUNCE_MS} AS ms FROM w JOIN sv ON sv.watcher = w.watcher AND sv.ms >= w.opened AND sv.ms < w.opened + {watch.DEBOUNCE_MS}""")
def watch_debounced(spark, d):
    return watch.debounced(saves(spark, d), "watcher")


@register("watch_cooled", f"""WITH RECURSIVE {_SAVES}, w AS (SELECT path, min(ms) AS ms FROM sv GROUP BY path
 UNION ALL SELECT w.path, (SELECT min(ms) FROM sv WHERE sv.path = w.path AND sv.ms >= w.ms + {watch.COOLDOWN_MS}) FROM w WHERE w.ms IS NOT NULL)
SELECT path, ms FROM w WHERE ms IS NOT NULL""")
def watch_cooled(spark, d):
    return watch.cooled(saves(spark, d))
