"""The catalogue: counts over lines, and the signals that follow from them.

For each language, ``COUNTS`` names how many lines satisfy a predicate, and
``SIGNALS`` gives each signal's family, weight and condition over the counts,
the number of lines ``n`` and the measurements of names and layout. Rules that
languages share are written once and made for each.
"""

from __future__ import annotations

from dataclasses import dataclass

from lineament.functions.portable import P, ends, equals, has, longer, low, matches, starts

LANGUAGES = ("rust", "python", "js", "go")
FAMILIES = ("claude", "gpt", "gemini", "copilot", "human")
#: Ties go to the greatest displayed name.
DISPLAY = {"claude": "Claude", "gpt": "GPT", "gemini": "Gemini", "copilot": "Copilot", "human": "Human"}
ANALYZERS = ("comments", "ai_signals", "errors", "naming", "structure", "idioms")

# Phrases, markers and abbreviations that signals look for.
TEACH = ("note that", "this ensures", "this allows", "we need to", "important:", "this is necessary", "here we", "this handles", "this converts", "this creates", "this returns")
STEPS = ("step 1", "step 2", "step 3", "step 4", "step 5", "1.", "2.", "3.")
HERES = ("here's", "let's", "here is", "let us")
ABBREVIATIONS = ("txn", "cfg", "ctx", "req", "resp", "db", "msg", "buf", "idx", "len", "err", "fmt", "cb", "ptr", "num", "tmp", "src", "dst", "prev", "cur")


@dataclass(frozen=True)
class Signal:
    id: str
    family: str
    tenths: int
    when: str

    @property
    def language(self) -> str:
        return self.id.split(".")[0]

    @property
    def analyzer(self) -> str:
        return self.id.split(".")[1]


COUNTS: dict[str, dict[str, P]] = {}
SIGNALS: list[Signal] = []
LONG = "n >= 10"


def add(language: str, analyzer: str, guard: str | None, rows: str) -> None:
    """Rows: ``name family weight: condition``, one a line."""
    for row in rows.strip().splitlines():
        head, when = row.split(":", 1)
        name, family, weight = head.split()
        when = f"({when.strip()})" + (f" AND {guard}" if guard else "")
        SIGNALS.append(Signal(f"{language}.{analyzer}.{name}", family, round(float(weight) * 10), when))


MARK = {"rust": "//", "js": "//", "go": "//", "python": "#"}
QUOTES3 = ('"""', "'''")
DEFS = {
    "rust": starts("fn ", "pub fn ", "pub(crate) fn ", "async fn ", "pub async fn "),
    "python": starts("def ", "async def "),
    "js": starts("function ") | has("=> {", "=> ("),
    "go": starts("func "),
}
IMPORTS = {"rust": starts("use "), "python": starts("import ", "from "), "js": starts("import "), "go": starts('"')}
BLANK = equals("")
LIMIT = {"rust": 100, "python": 88, "js": 100, "go": 120}

for lang in LANGUAGES:
    mark = MARK[lang]
    cl = starts(mark)
    code = ~cl
    c = COUNTS[lang] = {
        "cl": cl,
        "teach": cl & low(*(TEACH[:8] if lang == "python" else TEACH)),
        "terse": cl & low(*(("todo", "hack", "fixme", "xxx") if lang == "python" else ("todo", "hack", "fixme", "xxx", "wtf", "ugh"))),
        "steps": cl & low(*STEPS),
        "heres": cl & low(*HERES),
        "bullets": cl & matches(r"^#+\s*- " if lang == "python" else r"^(//)+\s*- "),
        "refs": cl & (matches(r"^[^#]*#([0-9][0-9]|[0-9]$|$)", "lo") | matches(r"^[^@]*@(\p{L}|$)", "lo")),
        "todo": low("todo", "fixme"),
        "end_spaces": ends(" ", column="l"),
        "filler": low(*(("lorem ipsum", "foo", "asdf", "placeholder") if lang == "rust" else ("lorem ipsum", "asdf", "placeholder"))),
        "backticks": starts("//", "#") & has("```"),
        "nonblank": ~BLANK,
        "tabs": starts("\t", column="l"),
        "spaces": starts("  ", column="l"),
        "wide": longer(LIMIT[lang]),
        "defs": DEFS[lang],
    }
    add(lang, "comments", "n > 0", f"""
        high_density claude 0.8: 100 * cl > 15 * n
        low_density human 1.0: 100 * cl < 3 * n AND n > 20
        teaching_voice claude 1.5: teach >= 3
        some_explanatory gpt 0.8: teach BETWEEN 1 AND 2
        terse_markers human 2.0: terse >= 2
        step_numbered gpt 1.5: steps >= 3
        heres_lets gpt 1.0: heres >= 3
        verbose_obvious gpt 1.2: n > 20 AND n > cl AND 5 * cl > 4 * (n - cl)
        bullet_style gemini 1.0: bullets >= 3
        minimal copilot 1.5: 100 * cl < n AND n > 30
        external_refs human 2.0: refs >= 2
    """)
    add(lang, "ai_signals", LONG, """
        no_todo claude 0.3: todo = 0 AND n > 30
        no_trailing_ws gpt 0.5: end_spaces = 0 AND n > 20
        no_placeholder gpt 0.3: filler = 0 AND n > 30
    """)
    names = {"rust": ("very_descriptive_vars", "descriptive_vars", "short_vars", "many_single_char_vars", "no_single_char_vars")}.get(
        lang, ("very_descriptive", "descriptive", "short_names", "many_single_char", "no_single_char")
    )
    add(lang, "naming", LONG + " AND names > 0", f"""
        {names[0]} claude 1.5: name_bytes > 12 * names
        {names[1]} gpt 1.0: name_bytes > 8 * names AND name_bytes <= 12 * names
        medium_descriptive gemini 1.0: name_bytes >= 5 * names AND name_bytes <= 8 * names
        {names[2]} human 1.5: name_bytes < 4 * names
        {names[3]} human 2.0: single_names >= 3
        {names[4]} claude 0.3: single_names = 0 AND names >= 5
        mixed_conventions copilot 1.5: camel_names >= 2 AND snake_names >= 2
        domain_abbreviations human 1.0: short_words >= 3
    """)
    add(lang, "structure", LONG, f"""
        sorted_imports gpt 0.5: imports >= 3 AND imports_sorted
        consistent_blank_lines gemini 0.5: blank_runs >= 3 AND blank_runs_equal
        lines_under_{LIMIT[lang]} gemini 0.4: nonblank >= 10 AND wide = 0
        compact_fns gemini 1.0: defs >= 2 AND n - first_def >= 10 * defs AND n - first_def <= 20 * defs
        very_short_fns copilot 1.2: defs >= 2 AND n - first_def < 10 * defs
        format_inconsistent copilot 1.2: tabs > 0 AND spaces > 0
    """)
    if lang in ("rust", "js"):
        add(lang, "structure", LONG, "many_long_lines human 1.0: wide >= 5")
    if lang != "rust":
        add(lang, "ai_signals", LONG, "triple_backtick gpt 1.5: backticks >= 1")
    else:
        add(lang, "ai_signals", None, "triple_backtick gpt 1.5: false")

    if lang == "rust":
        fn = starts("pub fn ", "fn ")
        c |= {
            "docs": starts("///"), "dead": has("allow(dead_code)", "allow(unused)", "#[cfg(dead_code)]"),
            "plain_fns": fn & ~starts("fn main"), "documented": fn & starts("///", column="pt"),
            "commented": starts("// let ", "// fn ", "// use ", "// println!", "// pub "),
            "pragmas": starts("#[allow(", "#[cfg(") | has("#![allow(", "// SAFETY:"),
            "unwraps": has(".unwrap()"), "expects": has(".expect("), "questions": has("?") & code,
            "matches": starts("match ") | ends("match {", column="t"), "wild": starts("_ =>", "_ ="), "panics": has("panic!(") & code,
            "lets": starts("let "), "annotated": starts("let ") & matches(r"^[^=]*:"), "arms": code & has(" => ", column="t"), "derives": has("#[derive("),
            "chains": code & has(".map(", ".filter(", ".flat_map(", ".collect()", ".fold(", ".filter_map("), "dots": starts("."),
            "displays": has("impl std::fmt::Display", "impl Display for"), "froms": has("impl From<", "impl Into<"), "selves": has("Self::", "Self {"),
            "lets_if": starts("if let ", "while let "), "formats": has("format!("), "concats": has('+ "', "+ &"), "traits": starts("pub trait ", "trait "),
        }
        add(lang, "comments", "n > 0", "doc_comments claude 1.5: docs >= 5")
        add(lang, "ai_signals", LONG, """
            no_dead_code claude 0.2: dead = 0 AND n > 30
            all_fns_documented claude 2.0: plain_fns >= 3 AND documented = plain_fns
            commented_out_code human 2.0: commented >= 2
            pragma human 1.5: pragmas >= 2
        """)
        add(lang, "errors", LONG, """
            zero_unwrap claude 0.8: unwraps = 0 AND n > 30
            many_unwraps human 1.5: unwraps >= 5
            few_unwraps copilot 0.5: unwraps BETWEEN 1 AND 3
            expect_calls claude 1.0: expects >= 2
            question_mark claude 1.0: questions >= 3
            exhaustive_match claude 0.5: matches >= 2 AND 2 * wild <= matches
            panic_calls human 1.5: panics >= 2
        """)
        add(lang, "naming", LONG + " AND names > 0", """
            underscore_bindings human 1.0: underscores >= 2
            descriptive_fn_names claude 1.0: fn_names >= 3 AND fn_bytes > 15 * fn_names
        """)
        add(lang, "structure", LONG, """
            high_type_annotation gpt 1.0: lets > 0 AND 10 * annotated > 7 * lets
            low_type_annotation gemini 0.8: lets >= 5 AND 10 * annotated < 2 * lets
            heavy_derive gpt 1.0: derives >= 3 AND derive_commas + derives >= 4 * derives
            ternary_heavy gemini 1.2: arms >= 5
        """)
        add(lang, "idioms", LONG, """
            iterator_chains claude 1.5: chains >= 5
            builder_pattern gpt 1.0: dots >= 8
            impl_display claude 1.0: displays >= 1
            from_into_impls claude 1.0: froms >= 2
            self_usage claude 0.8: selves >= 3
            pattern_matching claude 0.4: lets_if >= 3
            format_macro claude 0.8: formats >= 3 AND concats = 0
            string_concat human 1.0: NOT (formats >= 3 AND concats = 0) AND concats >= 3
            many_traits gpt 1.5: traits >= 3
        """)
    elif lang == "python":
        d = DEFS[lang]
        c |= {
            "docstrings": starts(*QUOTES3), "silenced": has("# noqa", "# type: ignore", "# pylint: disable"),
            "commented": starts("# def ", "# class ", "# import ", "# return ", "# print("), "documented": d & starts(*QUOTES3, column="nt"),
            "broad": equals("except:") | starts("except Exception:"), "specific": starts("except ") & ~starts("except Exception"), "tries": equals("try:"),
            "raises": starts("raise ") & has(" from ", column="t"), "ternaries": code & has(" if ", column="t") & has(" else ", column="t"),
            "loops": code & has(" for ", column="t") & has(" in ", column="t") & has("[", "{", column="t"), "arrows": d & has("->", column="t"), "withs": starts("with "),
            "builtins": code & has("enumerate(", "zip(", "any(", "all(", "sorted(", "reversed(", "filter(", "map(", column="t"),
            "fstrings": has('f"', "f'"), "old_formats": has("% (", '% "', ".format("),
        }
        add(lang, "comments", "n > 0", "docstring_blocks claude 1.5: docstrings >= 5")
        add(lang, "ai_signals", None, """
            no_linter_suppression claude 0.2: silenced = 0 AND n > 30
            commented_out_code human 2.0: commented >= 2
            all_fns_documented claude 2.0: defs >= 3 AND documented = defs
            pragma human 1.5: silenced >= 1
        """)
        add(lang, "errors", LONG, """
            broad_except human 1.5: broad >= 2
            specific_except claude 1.0: specific >= 2
            no_try_except claude 0.3: tries = 0 AND n > 40
            raise_from claude 1.0: raises >= 2
        """)
        add(lang, "structure", LONG, "ternary_heavy gemini 1.2: ternaries >= 3")
        add(lang, "idioms", LONG, """
            comprehensions claude 1.5: loops >= 3
            return_type_annotations claude 0.8: defs >= 3 AND arrows = defs
            context_managers claude 0.8: withs >= 2
            functional_builtins claude 1.0: builtins >= 4
            fstrings claude 0.8: fstrings >= 3 AND old_formats = 0
            old_format human 1.0: NOT (fstrings >= 3 AND old_formats = 0) AND old_formats >= 3
        """)
    elif lang == "js":
        c |= {
            "jsdocs": starts("/**"), "silenced": has("// eslint-disable", "@ts-ignore", "@ts-nocheck"),
            "commented": starts("// const ", "// let ", "// function ", "// import ", "// return ", "// console."), "logs": code & has("console.log(", column="t"),
            "error_logs": code & has("console.error(", "console.warn(", column="t"), "typed": has("instanceof ") & has("Error"), "promise_catches": has(".catch("),
            "catches": starts("} catch", "catch ("), "new_errors": has("new Error(", "new TypeError(", "new RangeError(", "new SyntaxError("),
            "ternaries": code & has(" ? ", column="t") & has(" : ", column="t"), "arrows": has("=>"), "functions": starts("function ") | has(" function(", " function ("),
            "vars": starts("var "), "consts": starts("const "), "null_safe": has("?.", "??"),
            "destructured": starts("const {", "let {", "const [", "let [") & has("=", column="t"), "asyncs": code & has("async ", "await ", column="t"),
        }
        add(lang, "comments", "n > 0", "jsdoc_blocks claude 1.5: jsdocs >= 5")
        add(lang, "ai_signals", None, """
            no_linter_suppression claude 0.5: silenced = 0 AND n > 30
            commented_out_code human 2.0: commented >= 2
            jsdoc_blocks claude 1.5: jsdocs >= 3
            console_log human 2.0: logs >= 3
            pragma human 1.5: silenced >= 1
        """)
        add(lang, "errors", LONG, """
            console_error human 1.0: error_logs >= 2
            typed_error_check claude 1.0: typed >= 2
            promise_catch human 0.8: promise_catches >= 2 AND catches = 0
            try_catch_blocks claude 0.8: catches >= 2 AND promise_catches = 0
            typed_error_construction claude 0.8: new_errors >= 2
        """)
        add(lang, "structure", LONG, "ternary_heavy gemini 1.2: ternaries >= 3")
        add(lang, "idioms", LONG, """
            arrow_fns_only claude 1.5: arrows >= 5 AND functions = 0
            regular_fns_only human 1.0: functions >= 3 AND arrows = 0
            var_declarations human 1.5: vars >= 3
            const_declarations copilot 1.0: vars = 0 AND consts >= 5
            null_safe_ops claude 1.0: null_safe >= 3
            destructuring gemini 0.8: destructured >= 3
            async_await gemini 0.8: asyncs >= 3
        """)
    else:
        upper6 = lambda column: matches(r"^.{5}\p{Lu}", column)
        c |= {
            "silenced": has("//nolint", "// nolint"), "commented": starts("// func ", "// var ", "// type ", "// import ", "// return ", "// fmt."),
            "exported": (starts("func ") & upper6("t")) | (starts("type ") & has(" struct", column="t")) | has(" interface", column="t"),
            "documented": starts("// ", column="pt") & ~starts("// nolint", column="pt") & starts("func ", "type ") & upper6("t"),
            "simple_returns": has("err != nil") & has("return err", "return nil, err"), "wraps": has("fmt.Errorf(") & has("%w"), "sentinels": has("errors.Is(", "errors.As("),
            "panics": code & has("panic(", column="t"), "short_ifs": starts("if ") & has(" := ", column="t") & ends("{"), "checks": has("var _") & has(")(nil)"),
            "goroutines": has("go func") | starts("go "), "defers": starts("defer "), "tables": has("testCases", "testcases", "cases := []struct {") | equals("tests := []struct {"), "iotas": has("iota"),
        }
        add(lang, "ai_signals", None, """
            no_nolint claude 0.5: silenced = 0 AND n > 30
            commented_out_code human 2.0: commented >= 2
            all_exported_documented claude 2.0: exported >= 3 AND documented = exported
            pragma human 1.5: silenced >= 1
        """)
        add(lang, "errors", LONG, """
            simple_err_return human 0.8: simple_returns >= 3
            errorf_wrap claude 1.0: wraps >= 2
            errors_sentinel claude 1.2: sentinels >= 2
            panic_calls human 1.5: panics >= 2
        """)
        add(lang, "structure", LONG, "ternary_heavy gemini 1.2: short_ifs >= 3")
        add(lang, "idioms", LONG, """
            interface_checks claude 1.5: checks >= 1
            goroutines gpt 0.8: goroutines >= 2
            defer_stmts gemini 0.8: defers >= 2
            table_driven_tests claude 1.5: tables >= 1
            iota_constants copilot 0.8: iotas >= 1
        """)

#: Rules over metrics of syntax trees: id, family, tenths, metric, low bound, high bound (inclusive unless said).
METRIC_RULES: list[tuple[str, str, int, str, str, float, float | None]] = []


def metric_rules(language: str, rows: str) -> None:
    """Rows: ``name family weight metric operator threshold [maximum]``."""
    for row in rows.strip().splitlines():
        name, family, weight, metric, op, threshold, *most = row.split()
        METRIC_RULES.append((f"{language}_cst.{name}", family, round(float(weight) * 10), metric, op, float(threshold), float(most[0]) if most else None))


metric_rules("rust", """
    complexity.low claude 0.5 avg_complexity <= 2
    complexity.medium gpt 1.0 avg_complexity >= 2.5 4
    complexity.high human 1.5 avg_complexity >= 5
    doc_coverage.high claude 1.5 doc_coverage_ratio >= 0.9
    doc_coverage.low copilot 1.0 doc_coverage_ratio <= 0.2
    entropy.high claude 0.8 identifier_entropy >= 4
    entropy.low human 1.0 identifier_entropy < 3
    nesting.low claude 0.5 avg_nesting_depth <= 3
    nesting.medium copilot 1.0 avg_nesting_depth >= 3 5
    imports.sorted claude 0.3 imports_sorted >= 1
    inline_comments.high gpt 1.5 inline_comment_ratio >= 0.3
    fn_length.short gemini 1.0 avg_fn_length <= 15
    fn_length.long gpt 1.0 avg_fn_length >= 30
""")
metric_rules("python", """
    doc_coverage.high claude 1.5 doc_coverage_ratio >= 0.85
    doc_coverage.low copilot 1.0 doc_coverage_ratio <= 0.2
    type_annotations.high claude 0.8 type_annotation_ratio >= 0.8
    type_annotations.low copilot 1.0 type_annotation_ratio <= 0.2
    fstrings.only claude 0.5 fstring_ratio >= 1
    old_style_strings human 1.0 fstring_ratio <= 0
    inline_comments.high gpt 1.5 inline_comment_ratio >= 0.3
    fn_length.short gemini 1.0 avg_fn_length <= 12
""")
metric_rules("js", """
    arrow_fns.high_ratio claude 1.5 arrow_fn_ratio >= 0.7
    arrow_fns.low_ratio copilot 1.0 arrow_fn_ratio <= 0.3
    async.await_only claude 1.5 await_only >= 1
    async.then_only human 1.0 then_only >= 1
    mixed_async copilot 1.0 has_mixed_async >= 1
    optional_chaining.high claude 0.3 optional_chain_count >= 3
    inline_comments.high gpt 1.5 inline_comment_ratio >= 0.3
    fn_length.short gemini 1.0 avg_fn_length <= 12
    template_literals.none human 1.0 template_literal_ratio <= 0
""")
metric_rules("go", """
    doc_coverage.high claude 1.5 doc_coverage_ratio >= 0.8
    doc_coverage.low copilot 1.0 doc_coverage_ratio <= 0.2
    goroutines.present claude 0.3 goroutine_count >= 2
    errors.nil_checks claude 1.5 err_nil_check_count >= 3
    errors.no_nil_checks copilot 1.0 err_nil_check_ratio <= 0.5
    inline_comments.high gpt 1.5 inline_comment_ratio >= 0.3
    fn_length.short gemini 1.0 avg_fn_length <= 15
    named_returns gpt 1.0 named_return_count >= 2
""")
