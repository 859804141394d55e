"""One source for each family and language, written in that family's manner: the verdict must name it."""

from __future__ import annotations

import pytest

from lineament.operators import attribution as at
from lineament.operators import detect, syntax
from lineament.plans.catalogue import FAMILIES

MARK = {"py": "#", "rs": "//", "js": "//", "go": "//"}


def assign(kind, name, value):
    return {"py": f"{name} = {value}", "rs": f"let {name} = {value};", "js": f"const {name} = {value};", "go": f"{name} := {value}"}[kind]


def function(kind, name, body, doc=None):
    """A function with its lines; ``doc`` is a line of documentation."""
    pad = "\t" if kind == "go" else "    "
    head = {"py": f"def {name}(value, other):", "rs": f"pub fn {name}(value: u32, other: u32) -> u32 {{", "js": f"function {name}(value, other) {{", "go": f"func {name}(value int, other int) int {{"}[kind]
    lines = [pad + x if x else "" for x in body]
    if kind == "py":
        return [head, *([f'    """{doc}"""'] if doc else []), *lines]
    return [*([("/// " if kind == "rs" else "/** " if kind == "js" else "// ") + doc + (" */" if kind == "js" else "")] if doc else []), head, *lines, "}"]


def claude(kind):
    m, out = MARK[kind], []
    imports = {"py": ["import alpha", "import beta", "from gamma import delta"], "rs": ["use alpha::one;", "use beta::two;", "use gamma::three;"], "js": [], "go": ["package cache"]}[kind]
    out += [*imports, ""]
    for k, word in enumerate(("insert", "retrieve", "evict", "promote")):
        name = f"{word}_least_recently_used" if kind in ("py", "rs") else f"{word.title()}LeastRecentlyUsedEntry" if kind == "go" else f"{word}LeastRecentlyUsed"
        note = ("Note that this ensures the order.", "This allows the caller to retry.", "We need to keep both structures.", "Here we update the order.")[k]
        body = [f"{m} {note}", assign(kind, f"remaining_capacity_{k}" if kind != "js" else f"remainingCapacity{k}", "value"), assign(kind, f"previous_position_{k}" if kind != "js" else f"previousPosition{k}", "other")]
        if kind == "js":
            body += ["const loader = async () => { await load(value); await load(other); };"]
        if kind == "go":
            body += ["if err != nil {", '\treturn fmt.Errorf("wrapped: %w", err)', "}"]
        if kind == "rs":
            body += ['let rendered_position = format!("{}", value);', "let found_entry = self.lookup(value)?;"]
        out += [*function(kind, name, [*body, f"return {body and 'value'}" + ("" if kind in ("py", "go") else ";")], f"Moves the entry {word}wards and keeps the order."), ""]
    return out


def gpt(kind):
    m, out = MARK[kind], []
    steps = [f"{m} Step {k}: here's what happens next, let's continue" for k in range(1, 6)]
    for k in range(2):
        body = []
        for i in range(12):
            body += [assign(kind, f"resultVal{'abcdefghijkl'[i]}" if kind in ("js", "go") else f"result_va{'abcdefghijkl'[i]}", "value")]
            if i % 3 == 0:
                body.append(steps[i // 3])
        out += [*function(kind, ("handleRequest", "formatAnswer")[k] if kind in ("js", "go") else ("handle_request", "format_answer")[k], [*body, "", "return value" + ("" if kind in ("py", "go") else ";")]), "", f"{m} 1. check the input", f"{m} This returns the output", ""]
    return out


def gemini(kind):
    m, out = MARK[kind], []
    for k in range(3):
        body = []
        for i in range(3):
            body += [f"{m} - keep the {('first', 'second', 'third')[i]} part"]
        more = {"py": [f"node{x} = value if value else other" for x in "abc"], "js": [f"const [node{x}] = value ? [value] : [other];" for x in "abc"], "go": [f"if node{x} := value; node{x} > 1 {{\n\t\tother = 1\n\t}}" for x in "abc"] + ["defer other()"], "rs": [f"match value {{ 1 => 2, _ => 3 }}"] + [f"let node{x} = value;" for x in "abcde"] + ["    1 => 2,", "    2 => 3,"]}[kind]
        body += [line for x in more for line in x.split("\n")] + [assign(kind, f"item{'abc'[k]}", "other")]
        out += [*function(kind, f"part{'abc'[k]}", [*body, "return value" + ("" if kind in ("py", "go") else ";")]), ""]
    return out


def copilot(kind):
    out = ["package cache", ""] if kind == "go" else []
    for k in range(7):
        name = ("getItem", "set_item", "addNode", "del_node", "hasKey", "get_size", "clearAll")[k]
        local = ("itemCount", "item_count", "nodeIndex", "node_index", "keyValue", "key_value", "allItems")[k]
        body = [assign(kind, local, "value"), *(["kind := iota"] if kind == "go" and k == 0 else [])]
        if kind == "rs" and k == 0:
            body.append("let item_value = value.checked_add(other).unwrap();")
        out += function(kind, name, [*body, "return value" + ("" if kind in ("py", "go") else ";")])
    out += [("  " if k % 2 else "\t") + assign(kind, f"otherCount{'ab'[k]}", "1") for k in range(2)]
    return out


def human(kind):
    m, out = MARK[kind], []
    old = {"py": "# def old(): pass", "rs": "// let old = 1;", "js": "// const old = 1;", "go": "// return old"}[kind]
    for k in range(3):
        body = [assign(kind, "xyz"[k], "value"), assign(kind, "abc"[k], "other"), f"{m} TODO hack, see #12 @bob", f"{m} fixme xxx", old]
        body += {"py": ["try:", "    f()", "except:", "    pass  # noqa"], "rs": ["f().unwrap();", "g().unwrap();", 'panic!("no");'], "js": ["console.log(x); // eslint-disable-line", "var q = 1;"], "go": ['panic("no") //nolint', "if err != nil { return err }"]}[kind]
        out += [*function(kind, "fgh"[k], [*body, "return value " + ("" if kind in ("py", "go") else ";")]), ""]
    return out


STYLES = {"claude": claude, "gpt": gpt, "gemini": gemini, "copilot": copilot, "human": human}


@pytest.fixture(scope="module")
def verdicts(spark):
    rows = [(k, f"{family}.{kind}", "\n".join(STYLES[family](kind)) + "\n") for k, (family, kind) in enumerate((f, x) for f in FAMILIES for x in MARK)]
    units = spark.createDataFrame(rows, "unit_id long, path string, source string")
    text = {r.path: r for r in at.attributed(detect.signals(units)).collect()}
    full = {r.path: r for r in at.attributed(syntax.signals(units)).collect()}
    return text, full


@pytest.mark.parametrize("kind", list(MARK))
@pytest.mark.parametrize("family", FAMILIES)
def test_primary_family(verdicts, family, kind):
    text, full = verdicts
    assert full[f"{family}.{kind}"].primary == family
    assert abs(sum(text[f"{family}.{kind}"][f"share_{f}"] for f in FAMILIES) - 1) < 1e-5
