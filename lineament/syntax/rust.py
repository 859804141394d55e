"""Rust."""

from __future__ import annotations

from .braces import Walker
from .tree import Context, Tree

FUNCTION = "function_item"
DECISIONS = ("if_expression", "match_expression", "for_expression", "while_expression", "loop_expression")
KEYWORDS = frozenset("as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while union macro_rules".split())
PRIMITIVES = frozenset("u8 u16 u32 u64 u128 usize i8 i16 i32 i64 i128 isize f32 f64 bool char str".split())
BEFORE_FN = frozenset(("pub", "async", "unsafe", "const", "extern", "default"))
TYPE_BEFORE = frozenset((":", "->", "<", "&", "dyn", "impl", "struct", "enum", "trait", "union", "type", "as", "mut", "+"))
BLOCK_BEFORE = frozenset((";", "{", "}", "=>", "=", "(", ",", "|", "||", "unsafe", "async", "move", "else", "loop", "return", "const", "&&", "[", "in", "&", "!", ""))


class Rust(Walker):
    language = "rust"
    signs = frozenset("#{")
    words = frozenset("macro_rules fn if while match for loop impl trait mod extern struct enum union use".split())
    marks = frozenset("!")

    def __init__(self, source: str):
        super().__init__(source, (FUNCTION,), DECISIONS, ("block", *DECISIONS))
        for k, t in enumerate(self.t):
            if t.kind == "word" and t.text not in KEYWORDS and t.text not in PRIMITIVES and not (t.text[0].isupper() and self.text(k - 1) in TYPE_BEFORE):
                self.tree.identifiers.append(t.text)
        self.uses: list[str] = []

    def step(self, i: int, stop: int, at: Context) -> int:
        text, kind = self.text(i), self.kind(i)
        if kind == "sign":
            if text == "#" and self.text(i + 1) in ("[", "!"):
                k = i + 1 + (self.text(i + 1) == "!")
                return self.close[k] + 1
            if text == "{":
                if self.text(i - 1) in BLOCK_BEFORE:
                    return self.block(i, at)
                self.walk(i + 1, self.close[i], at)
                return self.close[i] + 1
            return i + 1
        if kind != "word":
            return i + 1
        if self.text(i + 1) == "!" and text not in KEYWORDS or text == "macro_rules":
            k = i + 2 + (self.kind(i + 2) == "word")
            return self.close[k] + 1 if self.text(k) in tuple("([{") else i + 2
        if text == "fn" and self.kind(i + 1) == "word":
            return self.function(i, at)
        if text in ("if", "while", "match") or (text == "for" and self.text(i + 1) != "<") or text == "loop":
            return self.construct(i, text, at)
        if text in ("impl", "trait", "mod", "extern") and self.text(i + 1) != "crate" and self.text(i - 1) not in (":", "->", "&", "<", "(", ","):
            k = self.skip_to(i + 1, ("{", ";"))
            if self.text(k) == "{":
                if text == "extern" and "fn" in (self.text(j) for j in range(i, k)):
                    return i + 1
                self.walk(k + 1, self.close[k], Context(at.node, at.function, at.nesting, at.inside or text == "impl"))
                return self.close[k] + 1
            return k + 1
        if text in ("struct", "enum", "union") and self.kind(i + 1) == "word":
            k = self.skip_to(i + 1, ("{", ";"))
            return self.close[k] + 1 if self.text(k) == "{" else k + 1
        if text == "use" and self.text(i - 1) in (";", "}", "{", "pub", ")", "]", ""):
            k = self.skip_to(i + 1, (";",))
            if at.node < 0 and not at.inside:
                first = self.front(i)
                self.uses.append(self.tree.source[self.start(first) : self.end(k)])
            return k + 1
        return i + 1

    def front(self, i: int) -> int:
        """Where an item begins: the first of the words before its keyword."""
        while i > 0:
            if self.text(i - 1) in BEFORE_FN:
                i -= 1
            elif self.kind(i - 1) == "string" and self.text(i - 2) == "extern":
                i -= 2
            elif self.text(i - 1) == ")":
                k = next((j for j in range(i - 2, max(-1, i - 12), -1) if self.close[j] == i - 1), -1)
                if k < 1 or self.text(k - 1) != "pub":
                    return i
                i = k - 1
            else:
                return i
        return i

    def function(self, i: int, at: Context) -> int:
        k = self.skip_to(i + 2, ("{", ";"))
        if self.text(k) != "{":
            return k + 1
        first = self.front(i)
        inner = self.tree.open(FUNCTION, self.start(first), at)
        made = self.tree.nodes[inner.node]
        made.name, made.role = self.text(i + 1), "method" if at.inside else "function"
        made.public = self.text(first) == "pub" and self.text(first + 1) != "("
        made.documented = self.documented(self.start(first))
        end = self.end(self.close[k])
        if at.function < 0:
            self.tree.symbol(made.name, made.role, self.start(first), end)
        self.block(k, inner)
        self.tree.close(inner, end)
        return self.close[k] + 1

    def documented(self, offset: int) -> bool:
        """Whether a doc comment stands before, attributes passed over."""
        before = self.previous(offset)
        while before is not None and before.text == "]":
            k = next((j for j in range(len(self.t)) if self.t[j].start == before.start), -1)
            begin = next((j for j in range(k - 1, -1, -1) if self.close[j] == k), -1)
            if begin < 1 or self.text(begin - 1) != "#":
                return False
            before = self.previous(self.start(begin - 1))
        return before is not None and before.kind == "comment" and before.text.startswith(("///", "/**"))

    def construct(self, i: int, text: str, at: Context) -> int:
        k = self.skip_to(i + 1, ("{", ";"))
        if self.text(k) != "{":
            return i + 1
        inner = self.tree.open(f"{text}_expression", self.start(i), at)
        self.walk(i + 1, k, inner)
        if text == "match":
            self.walk(k + 1, self.close[k], inner)
            after = self.close[k] + 1
        else:
            after = self.block(k, inner)
        if text == "if" and self.text(after) == "else":
            if self.text(after + 1) == "if":
                after = self.construct(after + 1, "if", inner)
            elif self.text(after + 1) == "{":
                after = self.block(after + 1, inner)
        self.tree.close(inner, self.end(after - 1))
        return after

    def parse(self) -> Tree:
        tree = super().parse()
        tree.counts["imports_sorted"] = len(self.uses) >= 3 and self.uses == sorted(self.uses, key=str.encode)
        return tree


def parse(source: str) -> Tree:
    return Rust(source).parse()


def metrics(tree: Tree) -> dict[str, float]:
    out = tree.averages() | tree.comments() | tree.entropy()
    public = [n for n in tree.nodes if n.kind == FUNCTION and n.public]
    if public:
        out["doc_coverage_ratio"] = sum(n.documented for n in public) / len(public)
    out["imports_sorted"] = float(tree.counts["imports_sorted"])
    return out
