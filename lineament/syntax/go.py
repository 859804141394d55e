"""Go."""

from __future__ import annotations

from .braces import Walker
from .tree import Context, Tree

FUNCTIONS = ("function_declaration", "method_declaration")
DECISIONS = ("if_statement", "for_statement", "expression_switch_statement", "type_switch_statement", "select_statement")
KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var nil true false iota".split())
TYPES = frozenset("bool byte complex64 complex128 error float32 float64 int int8 int16 int32 int64 rune string uint uint8 uint16 uint32 uint64 uintptr any".split())
BLOCK_BEFORE = frozenset((";", "{", ":", "else", ""))


class Go(Walker):
    language = "go"
    signs = frozenset("{")
    words = frozenset("func if for switch select go".split())

    def __init__(self, source: str):
        super().__init__(source, FUNCTIONS, DECISIONS, ("block", "if_statement", "for_statement", "expression_switch_statement"))
        self.tree.identifiers += [t.text for k, t in enumerate(self.t) if t.kind == "word" and t.text not in KEYWORDS and t.text not in TYPES and self.text(k - 1) not in ("type", "package")]

    def header(self, i: int) -> int:
        """The bracket that opens the body of what begins at i; literals and types in between are passed over."""
        while True:
            i = self.skip_to(i, ("{",))
            if self.text(i) != "{":
                return i
            before = self.text(i - 1)
            if before in ("struct", "interface") or (self.kind(i - 1) == "word" and self.text(i - 2) == "]") or before == "]":
                i = self.close[i] + 1
                continue
            return i

    def step(self, i: int, stop: int, at: Context) -> int:
        text, kind = self.text(i), self.kind(i)
        if kind == "sign" and text == "{":
            if self.text(i - 1) in BLOCK_BEFORE or (self.text(i - 1) == "}" and self.tree.row_of(self.start(i)) > self.tree.row_of(self.start(i - 1))):
                return self.block(i, at)
            self.walk(i + 1, self.close[i], at)
            return self.close[i] + 1
        if kind != "word":
            return i + 1
        if text == "func":
            return self.function(i, at)
        if text in ("if", "for", "switch", "select"):
            return self.construct(i, text, at)
        if text == "go" and (self.kind(i + 1) == "word" or self.text(i + 1) == "("):
            self.tree.counts["goroutines"] += 1
        return i + 1

    def function(self, i: int, at: Context) -> int:
        k, lists, kind, name = i + 1, [], "func_literal", ""
        if at.function < 0 and at.node < 0 and (self.kind(k) == "word" or (self.text(k) == "(" and self.kind(self.close[k] + 1) == "word" and self.text(self.close[k] + 2) in ("(", "["))):
            kind = FUNCTIONS[0]
            if self.text(k) == "(":
                kind = FUNCTIONS[1]
                lists.append(k)
                k = self.close[k] + 1
            name = self.text(k)
            k += 1
            if self.text(k) == "[":
                k = self.close[k] + 1
        if self.text(k) != "(":
            return i + 1
        lists.append(k)
        k = self.close[k] + 1
        if self.text(k) == "(":
            lists.append(k)
        # A function without a body (a type) ends with its line.
        body = self.header(k) if kind != "func_literal" else self.body_of(k)
        if kind == "func_literal":
            return self.block(body, at) if self.text(body) == "{" else k
        if self.text(body) != "{" or self.tree.row_of(self.start(body)) > self.tree.row_of(self.start(k)) + 20:
            return k
        inner = self.tree.open(kind, self.start(i), at)
        made, end = self.tree.nodes[inner.node], self.end(self.close[body])
        made.name, made.role, made.public = name, "method" if kind == FUNCTIONS[1] else "function", name[:1].isupper()
        before = self.previous(self.start(i))
        made.documented = before is not None and before.kind == "comment"
        self.tree.symbol(name, made.role, self.start(i), end)
        self.tree.counts["named_returns"] += sum(self.close[x] > x + 1 and self.text(x + 2 if self.kind(x + 1) == "word" else x + 1) != "..." for x in lists)
        self.block(body, inner)
        self.tree.close(inner, end)
        return self.close[body] + 1

    def body_of(self, k: int) -> int:
        """The bracket of a function literal's body, if its result is followed by one."""
        while k < len(self.t) and (self.kind(k) == "word" and self.text(k) not in KEYWORDS or self.text(k) in ("*", "[", "(", ".", "map", "chan", "error")):
            k = self.close[k] + 1 if self.text(k) in ("(", "[") else k + 1
        return k

    def construct(self, i: int, text: str, at: Context) -> int:
        k = self.header(i + 1)
        if self.text(k) != "{":
            return i + 1
        head = [self.text(j) for j in range(i, k)]
        kind = {"if": "if_statement", "for": "for_statement", "select": "select_statement"}.get(text)
        if kind is None:
            kind = "type_switch_statement" if any(head[j : j + 3] == [".", "(", "type"] for j in range(len(head))) else "expression_switch_statement"
        inner = self.tree.open(kind, self.start(i), at)
        self.walk(i + 1, k, inner)
        if text in ("if", "for"):
            after = self.block(k, inner)
        else:
            self.walk(k + 1, self.close[k], inner)
            after = self.close[k] + 1
        if text == "if":
            line = self.tree.source[self.start(i) : self.end(self.close[k])].split("\n", 1)[0]
            self.tree.counts["err_checks"] += "err" in line and "nil" in line
            if self.text(after) == "else":
                after = self.construct(after + 1, "if", inner) if self.text(after + 1) == "if" else self.block(after + 1, inner) if self.text(after + 1) == "{" else after + 1
        self.tree.close(inner, self.end(after - 1))
        return after


def parse(source: str) -> Tree:
    return Go(source).parse()


def metrics(tree: Tree) -> dict[str, float]:
    out = tree.averages() | tree.comments() | tree.entropy()
    fns = [n for n in tree.nodes if n.kind in FUNCTIONS]
    exported = [n for n in fns if n.public]
    if exported:
        out |= {"doc_coverage_ratio": sum(n.documented for n in exported) / len(exported), "exported_fn_count": float(len(exported))}
    out |= {"goroutine_count": float(tree.counts["goroutines"]), "err_nil_check_count": float(tree.counts["err_checks"]), "named_return_count": float(tree.counts["named_returns"])}
    if len(fns) >= 2:
        out["err_nil_check_ratio"] = tree.counts["err_checks"] / len(fns)
    return out
