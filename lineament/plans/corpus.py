"""A synthetic code corpus from the given tables: each part is a file, each of its line items a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineament.functions.portable import duck_text, spark_text

EXT = ("rs", "py", "js", "go")
#: Line templates by language; {a} and {b} become numbers.
LINES = {
    "rs": (
        "use std::mod{a};", "/// Does step {a}.", "pub fn make_widget_number_{a}(x: u32) -> u32 {", "    let total_value_{a} = x + {b};", "    let i: u32 = {a};", "}", "", "// note that this ensures order {a}",
        "    let mut b = items.iter().map(|x| x + {a}).collect();", "    value_{a}.unwrap()", "fn f{a}(ctx: &Ctx) -> Option<u32> {", "    match kind { // see #{a}{b}", "        A{a} => {b},", "    if let Some(v) = get_{a}()? {",
        "\tpanic!(\"bad {a}\");", "#[derive(Debug, Clone, Eq, Hash, Ord)]", "    // TODO fix {a}", "    .expect(\"value {a}\")", "    let req_id = format!(\"x{}\", {a});", "#[allow(unused)]",
    ),
    "py": (
        "import mod{a}", "from pkg{a} import thing", "def compute_total_value_{a}(x):", "    \"\"\"Return {a}.\"\"\"", "    x = {a}", "    camelName{a} = {b}", "", "# note that step 1. is {a}", "    try:", "    except ValueError:",
        "    except:", "    return [i for i in range({a})]", "    msg = f\"{a}\"", "    with open('f{a}') as f:", "    # TODO {a}", "    y = 1 if x else {a}", "class Thing{a}:", "    raise KeyError from err{a}", "    total = sum(map(int, zip(a, b)))", "\tz = '%s' % (a,)  # noqa",
    ),
    "js": (
        "import a{a} from 'm{b}';", "const value{a} = {b};", "let x = {a};", "var old{a} = 1;", "function doThing{a}(y) {", "}", "", "// let's see {a}", "/** Doc {a}. */", "  } catch (e) {", "  promise.catch(e => log({a}));",
        "  console.log({a});", "  throw new Error('bad {a}');", "const { p{a} } = props;", "  await fetch(url?.q ?? {a});", "const g = (z) => {", "  // eslint-disable-line {a}", "  return a ? {a} : {b};", "  if (e instanceof TypeError) {", "  // - item {a}",
    ),
    "go": (
        "package p{a}", "\"fmt{a}\"", "func Handle{a}(w int) error {", "func (s *Srv) run{a}() {", "\tx, err := get({a})", "\tif err != nil { return err }", "", "// Handle{a} handles.", "\tdefer mu.Unlock()", "\tgo func() {}()", "\treturn fmt.Errorf(\"x %w\", err)",
        "\tif v := f({a}); v > 1 {", "type Box{a} struct {", "}", "\tpanic(\"no {a}\")", "const A{a} = iota", "\t// todo {a} @bob", "  ctxReq := {a}", "\tif errors.Is(err, ErrX{a}) {", "var _ I = (*T)(nil)",
    ),
}


def _line(text, cat) -> str:
    """A pure function of (l_orderkey, l_linenumber, l_partkey): equal keys give equal lines."""
    out = []
    for k, ext in enumerate(EXT):
        templates = LINES[ext]
        pick = f"(l_orderkey * 7 + l_linenumber * 3 + l_partkey) % {len(templates)}"
        body = " ".join(f"WHEN {i} THEN {text(t)}" for i, t in enumerate(templates))
        out.append(f"WHEN {k} THEN CASE {pick} {body} END")
    chosen = f"CASE l_partkey % 4 {' '.join(out)} END"
    return f"replace(replace({chosen}, '{{a}}', CAST(l_orderkey % 13 AS {cat})), '{{b}}', CAST(l_linenumber AS {cat}))"


def code_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit_id, path, source. Files of every fifth part have a third of their lines, so some are short."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_partkey % 5 <> 0 OR l_linenumber % 3 = 0").selectExpr("l_partkey", "l_orderkey", "l_linenumber", f"{_line(spark_text, 'STRING')} AS line")
    files = items.groupBy("l_partkey").agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "line"))).alias("x"))
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand")
    ext = F.element_at(F.lit(list(EXT)), (F.col("p_partkey") % 4 + 1).cast("int"))
    return files.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_partkey").alias("unit_id"),
        F.concat(F.lit("src/"), "p_brand", F.lit("/"), F.col("p_partkey").cast("string"), F.lit("."), ext).alias("path"),
        F.array_join(F.transform("x", lambda e: e["line"]), "\n").alias("source"),
    )


CODE_SQL = f"""SELECT p_partkey AS unit_id, 'src/' || p_brand || '/' || p_partkey || '.' || (['rs','py','js','go'])[p_partkey % 4 + 1] AS path, source
FROM (SELECT l_partkey, string_agg({_line(duck_text, 'VARCHAR')}, chr(10) ORDER BY l_orderkey, l_linenumber) AS source FROM lineitem WHERE l_partkey % 5 <> 0 OR l_linenumber % 3 = 0 GROUP BY l_partkey) JOIN part ON l_partkey = p_partkey"""


def text_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as units without a path."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("unit_id"), F.lit(None).cast("string").alias("path"), F.col("text").alias("source"))


TEXT_SQL = "SELECT doc_id AS unit_id, CAST(NULL AS VARCHAR) AS path, text AS source FROM documents"
