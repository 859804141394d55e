"""Tokens of Rust, JavaScript and Go, with the brackets that belong together."""

from __future__ import annotations

import re
from typing import NamedTuple

WORD = r"[^\W\d]\w*"
NUMBER = r"\d[\w.]*"
STRING = r'"(?:\\.|[^"\\])*"?'


class Token(NamedTuple):
    kind: str  # word, number, string, template, comment, sign
    text: str
    start: int
    end: int


PATTERNS = {
    "rust": rf"""(?P<comment>//[^\n]*|/\*)|(?P<string>b?r(?P<h>\#*)".*?"(?P=h)|b?{STRING}|b?'(?:\\[^\n]+?|[^'\\\n])')|(?P<life>'\w+)|(?P<word>(?:r\#)?{WORD})|(?P<number>{NUMBER})|(?P<sign>=>|->|::|\.\.=?|&&|\|\||[-+*/%&|^=!<>]=|\S)""",
    "js": rf"""(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z)|\A\#![^\n]*)|(?P<string>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)|(?P<template>`)|(?P<word>[#$]?(?:[^\W\d]|\$)[\w$]*|\$)|(?P<number>{NUMBER})|(?P<sign>=>|\?\.(?!\d)|\?\?=?|\.\.\.|===|!==|==|!=|<=|>=|&&|\|\||\+\+|--|[-+*%&|^]=|\S)""",
    "go": rf"""(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>"(?:\\.|[^"\\\n])*"?|`[^`]*`?|'(?:\\.|[^'\\\n])+')|(?P<word>{WORD})|(?P<number>{NUMBER})|(?P<sign>:=|\.\.\.|<-|&&|\|\||[-+*/%&|^=!<>]=|\+\+|--|\S)""",
}
PATTERNS = {k: re.compile(v, re.S) for k, v in PATTERNS.items()}
PATTERN = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
BEFORE_PATTERN = frozenset("( , = : [ ! & | ? { } ; + - * % ~ ^ < > => && || == === != !== return typeof case in of delete void throw new else do".split())


def nested_comment(text: str, at: int) -> int:
    """End of a block comment that may hold others."""
    depth = 0
    for m in re.compile(r"/\*|\*/").finditer(text, at):
        depth += 1 if m[0] == "/*" else -1
        if not depth:
            return m.end()
    return len(text)


def template(text: str, at: int) -> tuple[int, list[tuple[int, int]]]:
    """End of a template literal and the spans of its substitutions."""
    spans, depth, start = [], 0, 0
    i = at + 1
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 1
        elif depth == 0 and c == "`":
            return i + 1, spans
        elif depth == 0 and text.startswith("${", i):
            depth, start = 1, i + 2
            i += 1
        elif depth and c == "`":
            i = template(text, i)[0] - 1
        elif depth and c == "{":
            depth += 1
        elif depth and c == "}":
            depth -= 1
            if not depth:
                spans.append((start, i))
        i += 1
    return len(text), spans


def tokens(text: str, language: str, at: int = 0, stop: int | None = None) -> list[Token]:
    """All tokens in order, comments among them; white space is left out."""
    find, out = PATTERNS[language].finditer, []
    stop = len(text) if stop is None else stop
    make, add, last = tuple.__new__, out.append, ""
    rust, js = language == "rust", language == "js"
    while at < stop:
        # Matches follow each other until a token ends elsewhere than its match.
        for m in find(text, at, stop):
            kind, said, (start, end) = m.lastgroup, m[0], m.span()
            if kind == "h":
                kind = "string"
            if kind == "comment":
                if rust and said == "/*":
                    at = nested_comment(text, start)
                    add(Token(kind, text[start:at], start, at))
                    break
            elif kind == "template":
                at, spans = template(text, start)
                add(Token(kind, text[start:at], start, at))
                for a, b in spans:
                    out += tokens(text, language, a, b)
                last = "`"
                break
            elif js and said == "/" and (last in BEFORE_PATTERN or not last) and (p := PATTERN.match(text, start, stop)):
                last, at = p[0], p.end()
                add(Token("string_pattern", last, start, at))
                break
            else:
                last = said
            add(make(Token, (kind, said, start, end)))
        else:
            break
    return out


CLOSING = {")": "(", "]": "[", "}": "{"}


def matching(tokens: list[Token]) -> list[int]:
    """For each opening bracket the index of its closing one, for others their own; what is never closed ends with the text."""
    out = list(range(len(tokens)))
    stack: list[int] = []
    for i, t in enumerate(tokens):
        if t.kind == "sign":
            if t.text in "([{":
                stack.append(i)
            elif t.text in CLOSING:
                while stack and tokens[stack[-1]].text != CLOSING[t.text]:
                    out[stack.pop()] = i
                if stack:
                    out[stack.pop()] = i
    for i in stack:
        out[i] = len(tokens)
    return out
