"""What the parsers of Rust, JavaScript and Go share: a walk over tokens by matching brackets."""

from __future__ import annotations

from .lexer import Token, matching, tokens
from .tree import Context, Tree


class Walker:
    """Subclasses say in ``step`` what begins at a token, and where something can begin: at ``signs`` and
    ``words``, and at a word before one of ``marks``. ``walk`` passes over all other tokens."""

    language = ""
    signs: frozenset[str] = frozenset()
    words: frozenset[str] = frozenset()
    marks: frozenset[str] = frozenset()

    def __init__(self, source: str, functions, decisions, nesting):
        self.tree = Tree(source, frozenset(functions), frozenset(decisions), frozenset(nesting), "//")
        every = tokens(source, self.language)
        self.t: list[Token] = [x for x in every if x.kind != "comment"]
        self.comments = {x.end: x for x in every if x.kind == "comment"}
        self.close = matching(self.t)
        self.every = every
        # Both end in an empty text, which is also what stands before the first token.
        self.texts = [x[1] for x in self.t] + [""]
        self.kinds = [x[0] for x in self.t] + [""]
        self.size = len(self.t)
        #: The next token at which something can begin, itself included.
        self.next = [self.size] * (self.size + 1)
        k = self.size
        for i in range(self.size - 1, -1, -1):
            kind, text = self.kinds[i], self.texts[i]
            if text in self.signs if kind == "sign" else kind == "word" and (text in self.words or self.texts[i + 1] in self.marks):
                k = i
            self.next[i] = k

    def text(self, i: int) -> str:
        return self.texts[i] if -1 <= i < self.size else ""

    def kind(self, i: int) -> str:
        return self.kinds[i] if -1 <= i < self.size else ""

    def end(self, i: int) -> int:
        """Offset after token i, or the end of the text."""
        return self.t[i].end if i < len(self.t) else len(self.tree.source)

    def start(self, i: int) -> int:
        return self.t[i].start if i < len(self.t) else len(self.tree.source)

    def previous(self, offset: int) -> Token | None:
        """What stands before an offset, comments among them."""
        lo, hi = 0, len(self.every)
        while lo < hi:
            mid = (lo + hi) // 2
            if self.every[mid].start < offset:
                lo = mid + 1
            else:
                hi = mid
        return self.every[lo - 1] if lo else None

    def skip_to(self, i: int, stops: tuple[str, ...]) -> int:
        """The first of ``stops`` from i on, groups in brackets passed over."""
        while i < len(self.t):
            text = self.text(i)
            if self.kind(i) == "sign":
                if text in stops:
                    return i
                if text in "([{" and text not in stops:
                    i = self.close[i]
                elif text in ")]}":
                    return i
            i += 1
        return i

    def walk(self, i: int, stop: int, at: Context) -> None:
        stop = min(stop, self.size)
        while i < stop and (i := self.next[i]) < stop:
            i = max(i + 1, self.step(i, stop, at))

    def step(self, i: int, stop: int, at: Context) -> int:
        raise NotImplementedError

    def block(self, i: int, at: Context, kind: str = "block") -> int:
        """The block whose bracket is at i; returns what follows it."""
        inner = self.tree.open(kind, self.start(i), at)
        self.walk(i + 1, self.close[i], inner)
        self.tree.close(inner, self.end(self.close[i]))
        return self.close[i] + 1

    def parse(self) -> Tree:
        self.walk(0, len(self.t), Context())
        return self.tree
