"""JavaScript (TypeScript is read by the same rules)."""

from __future__ import annotations

from .braces import Walker
from .tree import Context, Tree

FUNCTIONS = ("function_declaration", "function", "arrow_function", "method_definition")
DECISIONS = ("if_statement", "for_statement", "for_in_statement", "while_statement", "switch_statement", "ternary_expression")
NESTING = ("statement_block", "if_statement", "for_statement", "for_in_statement", "while_statement", "switch_statement")
KEYWORDS = frozenset("async await break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof let new null of return static super switch this throw true try typeof undefined var void while with yield".split())
NOT_NAMES = frozenset("if for while switch catch with function return typeof await super".split())
OBJECT_BEFORE = frozenset("= ( , [ ? : return => && || ?? ! == === != !== + - in of default typeof yield throw ...".split())
GOES_ON = frozenset(". ?. ? : + - * / % && || ?? == === != !== < > <= >= = , ( [ ` in instanceof".split())


class Js(Walker):
    language = "js"
    signs = frozenset("({?")
    words = frozenset("function async class if for while switch with try finally else do catch const let var".split())
    marks = frozenset(("=>",))

    def __init__(self, source: str):
        super().__init__(source, FUNCTIONS, DECISIONS, NESTING)
        c = self.tree.counts
        words = [(k, t.text) for k, t in enumerate(self.t) if t.kind == "word"]
        self.tree.identifiers += [text for _, text in words if text not in KEYWORDS]
        c["await"] = sum(text == "await" for _, text in words)
        c["then"] = sum(text == "then" and self.text(k - 1) in (".", "?.") and self.text(k + 1) == "(" for k, text in words)
        c["templates"] = self.kinds.count("template")
        c["strings"] = self.kinds.count("string") + c["templates"]
        c["chains"] = source.count("?.")

    def begins(self, i: int) -> bool:
        """Whether a statement may begin at i."""
        before = self.text(i - 1)
        return i == 0 or before in (";", "{", "}", ")", "export", "default", ":") or self.tree.row_of(self.start(i)) > self.tree.row_of(self.end(i - 1) - 1) and before not in OBJECT_BEFORE

    def step(self, i: int, stop: int, at: Context, members: bool = False) -> int:
        text, kind = self.text(i), self.kind(i)
        if kind == "sign":
            if text == "(" and self.text(self.close[i] + 1) == "=>":
                return self.arrow(i, self.close[i], at)
            if text == "{":
                if self.text(i - 1) in OBJECT_BEFORE:
                    self.members(i + 1, self.close[i], at)
                    return self.close[i] + 1
                return self.block(i, at, "statement_block")
            if text == "?" and self.text(i + 1) not in (":", ")", ",", "="):
                inner = self.tree.open("ternary_expression", self.start(i), at)
                self.tree.close(inner, self.end(i))
            return i + 1
        if kind != "word":
            return i + 1
        if self.text(i - 1) in (".", "?."):
            return i + 1
        if text == "function" or (text == "async" and self.text(i + 1) == "function"):
            return self.function(i, at)
        if self.text(i + 1) == "=>" and text not in NOT_NAMES:
            return self.arrow(i, i, at)
        if text == "class":
            k = self.skip_to(i + 1, ("{",))
            if self.text(k) == "{":
                self.members(k + 1, self.close[k], at)
                return self.close[k] + 1
        if text in ("if", "for", "while", "switch", "with") and (self.text(i + 1) == "(" or self.text(i + 2) == "("):
            return self.statement(i, stop, at)
        if text in ("try", "finally", "else", "do") and self.text(i + 1) == "{":
            return self.block(i + 1, at, "statement_block")
        if text == "catch" and self.text(i + 1) in ("(", "{"):
            k = self.close[i + 1] + 1 if self.text(i + 1) == "(" else i + 1
            return self.block(k, at, "statement_block") if self.text(k) == "{" else k
        if text in ("const", "let", "var") and self.kind(i + 1) == "word":
            self.declarator(i + 1)
        return i + 1

    def declarator(self, i: int) -> None:
        """A name that is bound to a function is a symbol."""
        k = i + 2
        if self.text(i + 1) != "=":
            return
        k += self.text(k) == "async"
        if self.text(k) == "function":
            body = self.skip_to(k + 1, ("{",))
            if self.text(body) == "{":
                self.tree.symbol(self.text(i), "function", self.start(i), self.end(self.close[body]))
        elif (self.text(k) == "(" and self.text(self.close[k] + 1) == "=>") or (self.kind(k) == "word" and self.text(k + 1) == "=>"):
            arrow = (self.close[k] if self.text(k) == "(" else k) + 1
            self.tree.symbol(self.text(i), "function", self.start(i), self.end(self.arrow_end(arrow) - 1))

    def function(self, i: int, at: Context) -> int:
        word = i + (self.text(i) == "async")
        star = self.text(word + 1) == "*"
        k = word + 1 + star
        name = self.text(k) if self.kind(k) == "word" else ""
        k += bool(name)
        body = self.skip_to(self.close[k] + 1, ("{", ";")) if self.text(k) == "(" else k
        declared = bool(name) and self.begins(i)
        inner = at
        end = self.end(self.close[body]) if self.text(body) == "{" else self.end(k)
        if declared:
            self.tree.symbol(name, "function", self.start(i), end)
            if not star:
                inner = self.tree.open("function_declaration", self.start(i), at)
                self.tree.nodes[inner.node].name = name
        # The keyword counts as a function of its own.
        key = self.tree.open("function", self.start(word), inner)
        self.tree.close(key, self.end(word))
        if self.text(k) == "(":
            self.walk(k + 1, self.close[k], inner)
        after = self.block(body, inner, "statement_block") if self.text(body) == "{" else body
        if inner is not at:
            self.tree.close(inner, end)
        return after

    def arrow_end(self, arrow: int) -> int:
        """What follows the arrow function whose sign is at ``arrow``."""
        if self.text(arrow + 1) == "{":
            return self.close[arrow + 1] + 1
        k = arrow + 1
        while k < len(self.t):
            text = self.text(k)
            if self.kind(k) == "sign":
                if text in tuple("([{"):
                    k = self.close[k]
                elif text in (",", ";", ")", "]", "}"):
                    return k
            if k + 1 < len(self.t) and self.tree.row_of(self.start(min(k + 1, len(self.t) - 1))) > self.tree.row_of(self.end(k) - 1) and self.text(k + 1) not in GOES_ON and self.text(k) not in GOES_ON | {"=>"}:
                return k + 1
            k += 1
        return k

    def arrow(self, first: int, last: int, at: Context) -> int:
        begin = first - (self.text(first - 1) == "async")
        inner = self.tree.open("arrow_function", self.start(begin), at)
        if last > first:
            self.walk(first + 1, last, inner)
        after = self.arrow_end(last + 1)
        if self.text(last + 2) == "{":
            self.block(last + 2, inner, "statement_block")
        else:
            self.walk(last + 2, after, inner)
        self.tree.close(inner, self.end(after - 1))
        return after

    def members(self, i: int, stop: int, at: Context) -> None:
        """Inside a class or an object: what has parameters and a body is a method."""
        while i < min(stop, len(self.t)):
            named = self.kind(i) in ("word", "string", "number") or (self.text(i) == "]" and self.text(self.close[i] if self.close[i] > i else i) != "")
            if named and self.text(i + 1) == "(" and self.text(self.close[i + 1] + 1) == "{" and self.text(i) not in NOT_NAMES and self.text(i - 1) not in (".", "?.", "new"):
                first = i
                while self.text(first - 1) in ("static", "async", "get", "set", "*"):
                    first -= 1
                body = self.close[i + 1] + 1
                inner = self.tree.open("method_definition", self.start(first), at)
                self.tree.nodes[inner.node].name = self.text(i)
                if self.kind(i) == "word":
                    self.tree.symbol(self.text(i), "method", self.start(first), self.end(self.close[body]))
                self.walk(i + 2, self.close[i + 1], inner)
                self.block(body, inner, "statement_block")
                self.tree.close(inner, self.end(self.close[body]))
                i = self.close[body] + 1
            else:
                i = max(i + 1, self.step(i, stop, at))

    def statement(self, i: int, stop: int, at: Context) -> int:
        """The statement at i; returns what follows it."""
        text = self.text(i)
        if text == "{":
            return self.block(i, at, "statement_block")
        if text not in ("if", "for", "while", "switch", "with"):
            k = i
            while k < min(stop, len(self.t)) and self.text(k) != ";":
                after = max(k + 1, self.step(k, stop, at))
                if after < len(self.t) and self.tree.row_of(self.start(after)) > self.tree.row_of(self.end(after - 1) - 1) and self.text(after) not in GOES_ON and self.text(after - 1) not in GOES_ON:
                    return after
                k = after
            return k + (self.text(k) == ";")
        k = i + 1 + (self.text(i + 1) == "await")
        if self.text(k) != "(":
            return i + 1
        end = self.close[k]
        kind = f"{text}_statement"
        if text == "for":
            j = k + 1
            while j < end and self.text(j) not in ("in", "of", ";"):
                j = (self.close[j] if self.kind(j) == "sign" and self.text(j) in tuple("([{") else j) + 1
            kind = "for_in_statement" if j < end and self.text(j) in ("in", "of") else kind
        inner = self.tree.open(kind, self.start(i), at)
        self.walk(k + 1, end, inner)
        if text == "switch" and self.text(end + 1) == "{":
            self.walk(end + 2, self.close[end + 1], inner)
            after = self.close[end + 1] + 1
        else:
            after = self.statement(end + 1, stop, inner) if end + 1 < len(self.t) else end + 1
        if text == "if" and self.text(after) == "else":
            after = self.statement(after + 1, stop, inner)
        self.tree.close(inner, self.end(after - 1))
        return after


def parse(source: str) -> Tree:
    return Js(source).parse()


def metrics(tree: Tree) -> dict[str, float]:
    out = tree.averages() | tree.comments() | tree.entropy()
    c = tree.counts
    kinds = [n.kind for n in tree.nodes]
    arrows, named = kinds.count("arrow_function"), kinds.count("function_declaration") + kinds.count("function")
    if arrows + named >= 3:
        out["arrow_fn_ratio"] = arrows / (arrows + named)
    if c["await"] >= 2 and not c["then"]:
        out["await_only"] = 1.0
    elif c["then"] >= 2 and not c["await"]:
        out["then_only"] = 1.0
    if c["await"] and c["then"]:
        out["has_mixed_async"] = 1.0
    out["optional_chain_count"] = float(c["chains"])
    if c["strings"]:
        out["template_literal_ratio"] = c["templates"] / c["strings"]
    return out
