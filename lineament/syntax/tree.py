"""What the parsers make: a tree of the nodes that metrics and symbols need.

A node has a kind, rows (from 0), character offsets, the function that it belongs
to (the innermost, or -1) and its nesting there. Nodes stand in pre-order.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from dataclasses import dataclass, field

LINE_END = re.compile("\n").finditer


@dataclass
class Node:
    kind: str
    row: int
    end_row: int
    start: int
    end: int
    function: int
    nesting: int
    parent: int = -1
    name: str | None = None
    role: str | None = None
    documented: bool = False
    public: bool = False


@dataclass
class Context:
    """Where the parser is: the node around, its function, and the nesting in that function."""

    node: int = -1
    function: int = -1
    nesting: int = 0
    inside: bool = False


@dataclass
class Tree:
    source: str
    functions: frozenset[str]
    decisions: frozenset[str]
    nesting: frozenset[str]
    mark: str
    nodes: list[Node] = field(default_factory=list)
    identifiers: list[str] = field(default_factory=list)
    counts: Counter = field(default_factory=Counter)
    #: (name, kind, start row, end row, start, end)
    symbols: list[tuple[str, str, int, int, int, int]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.breaks = [m.start() for m in LINE_END(self.source)]

    def row_of(self, offset: int) -> int:
        return bisect.bisect_left(self.breaks, offset)

    def open(self, kind: str, start: int, at: Context) -> Context:
        """A node that begins here, and the context inside it; ``close`` sets its end."""
        k = len(self.nodes)
        row = self.row_of(start)
        if kind in self.functions:
            self.nodes.append(Node(kind, row, row, start, start, at.function, 0, at.node))
            return Context(k, k, 0, at.inside)
        level = at.nesting + (kind in self.nesting)
        self.nodes.append(Node(kind, row, row, start, start, at.function, level, at.node))
        return Context(k, at.function, level, at.inside)

    def close(self, at: Context, end: int) -> None:
        node = self.nodes[at.node]
        node.end = max(end, node.start)
        node.end_row = self.row_of(max(node.start, node.end - 1))

    def symbol(self, name: str, kind: str, start: int, end: int) -> None:
        self.symbols.append((name, kind, self.row_of(start), self.row_of(max(start, end - 1)), start, end))

    # Measures over the functions.

    def function_nodes(self) -> list[int]:
        return [k for k, n in enumerate(self.nodes) if n.kind in self.functions]

    def averages(self) -> dict[str, float]:
        fns = self.function_nodes()
        if not fns:
            return {}
        complexity, depth = Counter(), Counter()
        for n in self.nodes:
            if n.kind not in self.functions:
                complexity[n.function] += n.kind in self.decisions
                depth[n.function] = max(depth[n.function], n.nesting)
        return {
            "avg_complexity": sum(complexity[k] for k in fns) / len(fns),
            "avg_nesting_depth": sum(depth[k] for k in fns) / len(fns),
            "avg_fn_length": sum(self.nodes[k].end_row - self.nodes[k].row + 1 for k in fns) / len(fns),
        }

    def comments(self) -> dict[str, float]:
        """Comment lines to code lines in the functions' texts; nested functions count in each."""
        comment = code = 0
        for k in self.function_nodes():
            n = self.nodes[k]
            for line in self.source[n.start : n.end].split("\n"):
                if line := line.strip():
                    marked = line.startswith(self.mark)
                    comment += marked
                    code += not marked
        return {"inline_comment_ratio": comment / code} if code else {}

    def entropy(self) -> dict[str, float]:
        if len(self.identifiers) < 10:
            return {}
        counts = Counter("".join(self.identifiers))
        total = sum(counts.values())
        return {"identifier_entropy": -sum(c / total * math.log2(c / total) for c in counts.values())}

    def kinds(self) -> list[str]:
        return [n.kind for n in self.nodes]
