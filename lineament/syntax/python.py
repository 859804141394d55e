"""Python: the standard parser and tokenizer; an indentation scanner where the source does not parse."""

from __future__ import annotations

import ast
import io
import keyword
import re
import tokenize

from .tree import Context, Tree

FUNCTION = "function_definition"
KINDS = {
    ast.If: "if_statement", ast.For: "for_statement", ast.AsyncFor: "for_statement", ast.While: "while_statement", ast.Try: "try_statement",
    ast.TryStar: "try_statement", ast.ExceptHandler: "except_clause", ast.With: "with_statement", ast.AsyncWith: "with_statement", ast.Match: "match_statement",
    ast.ClassDef: "class_definition", ast.FunctionDef: FUNCTION, ast.AsyncFunctionDef: FUNCTION,
}
#: Fields that hold a statement list, which is a block.
BLOCKS = ("body", "orelse", "finalbody", "handlers", "cases")


def empty(source: str) -> Tree:
    return Tree(source, frozenset([FUNCTION]), frozenset(["if_statement", "for_statement", "while_statement", "elif_clause", "except_clause"]),
                frozenset(["block", "if_statement", "for_statement", "while_statement", "try_statement"]), "#")


class Walk:
    def __init__(self, source: str):
        self.tree = empty(source)
        self.starts = [0, *(i + 1 for i in self.tree.breaks)]
        self.lines = source.split("\n")

    def offset(self, row: int, column: int) -> int:
        """Character offset of a row (from 1) and a column in bytes."""
        line = self.lines[row - 1] if row <= len(self.lines) else ""
        if not line.isascii():
            column = len(line.encode()[:column].decode(errors="ignore"))
        return self.starts[row - 1] + column if row <= len(self.starts) else len(self.tree.source)

    def span(self, node: ast.AST) -> tuple[int, int]:
        return self.offset(node.lineno, node.col_offset), self.offset(node.end_lineno, node.end_col_offset)

    def block(self, statements: list, at: Context) -> None:
        if statements:
            inner = self.tree.open("block", self.span(statements[0])[0], at)
            for s in statements:
                self.visit(s, inner)
            self.tree.close(inner, self.span(statements[-1])[1])

    def visit(self, node: ast.AST, at: Context, elif_of: bool = False) -> None:
        kind = "elif_clause" if elif_of else KINDS.get(type(node))
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Mod) and (isinstance(node.left, ast.JoinedStr) or (isinstance(node.left, ast.Constant) and isinstance(node.left.value, str | bytes))):
            self.tree.counts["old_format"] += 1
        if kind is None:
            for child in ast.iter_child_nodes(node):
                self.visit(child, at)
            return
        start, end = self.span(node)
        inner = self.tree.open(kind, start, at)
        made = self.tree.nodes[inner.node]
        if kind in (FUNCTION, "class_definition"):
            made.name = node.name
            symbol = kind == FUNCTION and at.function < 0
            if symbol or (kind != FUNCTION and at.function < 0):
                self.tree.symbol(node.name, "class" if kind != FUNCTION else "method" if at.inside else "function", start, end)
            inner.inside = at.inside or kind != FUNCTION
        if kind == FUNCTION:
            first = node.body[0]
            made.documented = isinstance(first, ast.Expr) and (isinstance(first.value, ast.JoinedStr) or (isinstance(first.value, ast.Constant) and isinstance(first.value.value, str | bytes)))
            self.parameters(node.args)
        for name, value in ast.iter_fields(node):
            if name in BLOCKS and isinstance(value, list) and value and not isinstance(value[0], ast.ExceptHandler | ast.match_case):
                if name == "orelse" and isinstance(node, ast.If) and len(value) == 1 and isinstance(value[0], ast.If) and self.is_elif(value[0]):
                    # Branches after the first stand beside each other in the statement of the first.
                    self.visit(value[0], Context(at.node, at.function, at.nesting, at.inside) if elif_of else inner, True)
                else:
                    self.block(value, inner if not elif_of or name != "orelse" else at)
            else:
                for child in value if isinstance(value, list) else [value]:
                    if isinstance(child, ast.match_case):
                        self.block(child.body, inner)
                    elif isinstance(child, ast.AST):
                        self.visit(child, inner)
        self.tree.close(inner, end)

    def is_elif(self, node: ast.If) -> bool:
        return self.lines[node.lineno - 1].lstrip().startswith("elif")

    def parameters(self, args: ast.arguments) -> None:
        plain = args.posonlyargs + args.args
        given = [None] * (len(plain) - len(args.defaults)) + args.defaults
        for a, default in [*zip(plain, given), *zip(args.kwonlyargs, args.kw_defaults), *((a, ...) for a in (args.vararg, args.kwarg) if a)]:
            if a.annotation is not None:
                self.tree.counts["typed"] += 1
                self.tree.counts["parameters"] += 1
            elif default is None and a.arg != "self":
                self.tree.counts["parameters"] += 1


def words(tree: Tree, source: str) -> None:
    """Identifiers and f-strings, from the tokens as far as they go."""
    try:
        for t in tokenize.generate_tokens(io.StringIO(source).readline):
            if t.type == tokenize.NAME and not keyword.iskeyword(t.string):
                tree.identifiers.append(t.string)
            elif t.type == tokenize.FSTRING_START and t.string[0] in "fF":
                tree.counts["fstrings"] += 1
    except (tokenize.TokenError, SyntaxError, ValueError):
        pass


HEAD = re.compile(r"(async\s+def|def|class|if|elif|else|for|while|try|except|finally|with)\b\s*(\w+)?")
BY_HEAD = {"if": "if_statement", "elif": "elif_clause", "for": "for_statement", "while": "while_statement", "try": "try_statement", "except": "except_clause"}


def scanned(source: str) -> Tree:
    """The same from indentation alone, for sources that do not parse."""
    tree = empty(source)
    open_: list[tuple[int, list[Context], tuple | None]] = []
    offset = last = 0

    def shut(indent: int) -> None:
        while open_ and open_[-1][0] >= indent:
            _, made, symbol = open_.pop()
            for c in reversed(made):
                tree.close(c, last)
            if symbol:
                tree.symbol(*symbol, last)

    for line in source.split("\n"):
        body = line.strip()
        if body and not body.startswith("#"):
            indent = len(line) - len(line.lstrip())
            shut(indent)
            last = offset + len(line.rstrip())
            if m := HEAD.match(body):
                word, at, start = m[1].split()[-1], open_[-1][1][-1] if open_ else Context(), offset + indent
                kind = FUNCTION if word == "def" else "class_definition" if word == "class" else BY_HEAD.get(word)
                made, symbol = [], None
                if kind:
                    made.append(tree.open(kind, start, at))
                    if word in ("def", "class"):
                        tree.nodes[made[-1].node].name = m[2]
                        if at.function < 0 and m[2]:
                            symbol = (m[2], "class" if word == "class" else "method" if at.inside else "function", start)
                        made[-1].inside = at.inside or word == "class"
                made.append(tree.open("block", start, made[-1] if made else at))
                open_.append((indent, made, symbol))
        offset += len(line) + 1
    shut(-1)
    return tree


def parse(source: str) -> Tree:
    try:
        walk = Walk(source)
        top = Context()
        for statement in ast.parse(source).body:
            walk.visit(statement, top)
        tree = walk.tree
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        tree = scanned(source)
    words(tree, source)
    return tree


def metrics(tree: Tree) -> dict[str, float]:
    out = tree.averages() | tree.comments() | tree.entropy()
    fns = tree.function_nodes()
    if fns:
        out["doc_coverage_ratio"] = sum(tree.nodes[k].documented for k in fns) / len(fns)
    if tree.counts["parameters"] >= 5:
        out["type_annotation_ratio"] = tree.counts["typed"] / tree.counts["parameters"]
    if total := tree.counts["fstrings"] + tree.counts["old_format"]:
        out["fstring_ratio"] = tree.counts["fstrings"] / total
    return out
