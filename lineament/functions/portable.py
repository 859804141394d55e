"""Predicates over a line, written once and rendered for Spark SQL, for DuckDB and for Python.

The names a predicate may use: ``l`` the line, ``t`` the line without white
space around it, ``lo`` the line in lower case, ``pt`` and ``nt`` the trimmed
lines before and after (null at the ends). Python's forms also know ``nb``, the
bytes of the line, and ``R``, the compiled search of a regular expression.
"""

from __future__ import annotations

from dataclasses import dataclass

#: White space that trimming removes, as a regular-expression class.
WHITE = r"[ \t\r\f\x0B\x{85}\x{A0}\x{2028}\x{2029}\x{3000}]"


@dataclass(frozen=True)
class P:
    spark: str
    duck: str
    python: str

    def __and__(self, other: P) -> P:
        return P(f"({self.spark} AND {other.spark})", f"({self.duck} AND {other.duck})", f"({self.python} and {other.python})")

    def __or__(self, other: P) -> P:
        return P(f"({self.spark} OR {other.spark})", f"({self.duck} OR {other.duck})", f"({self.python} or {other.python})")

    def __invert__(self) -> P:
        return P(f"(NOT {self.spark})", f"(NOT {self.duck})", f"(not {self.python})")

    def of(self, dialect: str) -> str:
        return getattr(self, dialect)


def spark_text(s: str) -> str:
    for a, b in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\t", "\\t")):
        s = s.replace(a, b)
    return f"'{s}'"


def duck_text(s: str) -> str:
    parts = s.replace("'", "''").split("\n")
    return "(" + " || chr(10) || ".join(f"'{p}'" for p in parts) + ")" if len(parts) > 1 else f"'{parts[0]}'"


def both(spark: str, duck: str, python: str, column: str, value: str) -> P:
    there = f"{column} is not None and " if column in ("pt", "nt") else ""
    return P(spark.format(f"e.{column}", spark_text(value)), duck.format(column, duck_text(value)), f"({there}{python.format(column, repr(value))})")


def has(*values: str, column: str = "l") -> P:
    return any_of(both("contains({0}, {1})", "contains({0}, {1})", "{1} in {0}", column, v) for v in values)


def starts(*values: str, column: str = "t") -> P:
    return any_of(both("startswith({0}, {1})", "starts_with({0}, {1})", "{0}.startswith({1})", column, v) for v in values)


def ends(*values: str, column: str = "t") -> P:
    return any_of(both("endswith({0}, {1})", "ends_with({0}, {1})", "{0}.endswith({1})", column, v) for v in values)


def equals(*values: str, column: str = "t") -> P:
    return any_of(both("({0} = {1})", "({0} = {1})", "{0} == {1}", column, v) for v in values)


def matches(pattern: str, column: str = "t") -> P:
    return both("({0} RLIKE {1})", "regexp_matches({0}, {1})", "R[{1}]({0}) is not None", column, pattern)


def low(*values: str) -> P:
    return has(*values, column="lo")


def longer(n: int) -> P:
    return P(f"(octet_length(e.l) > {n})", f"(strlen(l) > {n})", f"(nb > {n})")


def any_of(parts) -> P:
    parts = list(parts)
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out
