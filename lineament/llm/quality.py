"""Quality rules as a bitmask ledger.

``ledger`` evaluates every rule once on every whole text and stores the bits of
the rules that fail beside the measurements. A policy is a versioned mask over
these bits: applying one, or comparing many, reads the ledger and never the
texts. ``ablations`` counts by distinct mask first, so it shuffles at most one
row for each mask and task however many rows there are.

Null and empty texts have no words: all measurements are zero and ``few_words``
fails. Repeated rows are judged each by itself. Very long texts are measured
whole. An empty table has an empty ledger, and its ablations are zeros. Columns of
the input keep their names; a column of the ledger whose name is kept already gets
an underscore before it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from .shared import Cut, enrich, free, named, table

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_digits")

#: Rules in the order of their bits: a name, and where it fails given the measurements.
RULES: tuple[tuple[str, Callable[[Callable[[str], Column]], Column]], ...] = (
    ("few_words", lambda m: m("n_words") < 50),
    ("repeated_words", lambda m: 100 * m("n_repeat_words") > 50 * m("n_words")),
    ("symbols", lambda m: 10 * m("n_symbols") > m("n_words")),
    ("shouting", lambda m: (m("n_upper") > m("n_lower")) & (m("n_upper") + m("n_lower") > 0)),
    ("repeated_lines", lambda m: (m("n_dup_lines") >= 5) & (100 * m("n_dup_lines") > 50 * m("n_lines"))),
    ("word_length", lambda m: (m("word_chars") < 2 * m("n_words")) | (m("word_chars") > 20 * m("n_words"))),
    ("digits", lambda m: 100 * m("n_digits") > 30 * m("word_chars")),
)
BITS = {name: 1 << i for i, (name, _) in enumerate(RULES)}
#: Versioned policies: the rules that reject a document.
POLICIES = {
    "base-1": ("few_words", "repeated_words"),
    "web-1": ("few_words", "repeated_words", "symbols", "shouting"),
    "web-2": tuple(BITS),
}
CURRENT = "web-2"

_WHITE = np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8)
_SYMBOL = np.frombuffer(SYMBOLS.encode(), np.uint8)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three which the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    numbers: dict[bytes, int] = {}
    put = numbers.setdefault
    ids = np.fromiter([put(w, len(numbers)) for w in words], np.int64, n)
    size = len(numbers)
    if size == n:
        return 0
    if size < 1 << 21:
        keys = (ids[:-2] * size + ids[1:-1]) * size + ids[2:]
    else:
        pairs = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)[1]
        keys = pairs[:-1] * size + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """MEASURES of one text."""
    if not text:
        return (0,) * len(MEASURES)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    seen: set[bytes] = set()
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
    seen.update(lines)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    return (
        len(words),
        int(counts.sum() - counts[128:192].sum() - counts[_WHITE].sum()),
        int(counts[_SYMBOL].sum()),
        len(lines) - len(seen),
        repeated_words(words),
        len(lines),
        int(counts[65:91].sum()),
        int(counts[97:123].sum()),
        int(counts[48:58].sum()),
    )


def measured(df: DataFrame, keep: Sequence[str], text: str = "text") -> DataFrame:
    def factory():
        def work(texts):
            rows = np.array([measure(t) for t in texts], np.int64).reshape(-1, len(MEASURES))
            return [pa.array(np.ascontiguousarray(rows[:, i])) for i in range(len(MEASURES))]

        return work

    return enrich(df, text, factory, [StructField(m, LongType()) for m in MEASURES], keep)


def policy_mask(version: str) -> int:
    return sum(BITS[name] for name in POLICIES[version])


def ledger_names(keep: Sequence[str]) -> dict[str, str]:
    """What the ledger's columns are called beside those kept."""
    names = (*MEASURES, "failed_bits")
    return dict(zip(names, free(keep, names)))


def ledger(df: DataFrame, keep: Sequence[str], text: str = "text") -> DataFrame:
    """``keep``, the measurements and ``failed_bits``: every rule is evaluated once."""
    names = ledger_names(keep)
    total = F.lit(0).cast("long")
    for name, fails in RULES:
        total = total + F.when(fails(lambda m: named(names[m])), F.lit(BITS[name])).otherwise(F.lit(0)).cast("long")
    return measured(df, keep, text).select("*", total.alias(names["failed_bits"]))


def passes(version: str, bits: str = "failed_bits") -> Column:
    return named(bits).bitwiseAND(F.lit(policy_mask(version))) == 0


def ablations(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """For each rule of a policy: rows it fails, rows that it alone rejects, and
    rows kept without it. An empty ledger gives zeros."""
    mask = policy_mask(version)
    masks = rows.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    columns = []
    for name in POLICIES[version]:
        bit = BITS[name]
        for kind, hit in (
            ("failed", F.col("bits").bitwiseAND(F.lit(bit)) != 0),
            ("alone", F.col("bits") == bit),
            ("kept_without", F.col("bits").bitwiseAND(F.lit(mask & ~bit)) == 0),
        ):
            columns.append(F.coalesce(F.sum(F.when(hit, F.col("n")).otherwise(F.lit(0))), F.lit(0)).alias(f"{name}.{kind}"))
    wide = masks.agg(*columns)
    return wide.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(name).alias("rule"), *[F.col(f"`{name}.{k}`").alias(k) for k in ("failed", "alone", "kept_without")])
                    for name in POLICIES[version]
                ]
            )
        ).alias("r")
    ).select("r.*")


def compared(rows: DataFrame, versions: Sequence[str] = tuple(POLICIES)) -> DataFrame:
    """version, documents, kept, and changed: rows judged otherwise by the version before."""
    masks = rows.groupBy("failed_bits").agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("long")
    columns = []
    for k, v in enumerate(versions):
        before = passes(versions[max(0, k - 1)])
        columns += [F.sum(F.when(passes(v), F.col("n")).otherwise(zero)).alias(f"kept{k}"), F.sum(F.when(passes(v) != before, F.col("n")).otherwise(zero)).alias(f"changed{k}")]
    wide = masks.agg(F.sum("n").alias("n"), *columns)
    each = [F.struct(F.lit(v).alias("version"), F.coalesce("n", zero).alias("documents"), F.coalesce(f"kept{k}", zero).alias("kept"), F.coalesce(f"changed{k}", zero).alias("changed")) for k, v in enumerate(versions)]
    return wide.select(F.explode(F.array(*each)).alias("r")).select("r.*")


def stored(spark, sf_dir: str) -> DataFrame:
    """The ledger of documents, written down: policies and ablations read it, never the texts."""
    return Cut(ledger(table(spark, sf_dir, "documents"), ["doc_id"]), "rule-ledger").df


def op3(spark, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir).select(
        "doc_id",
        *MEASURES[:5],
        (~passes("base-1")).alias("base_failed"),
        passes(CURRENT).alias("kept"),
        "failed_bits",
    )


def rule_policies(spark, sf_dir: str) -> DataFrame:
    return compared(stored(spark, sf_dir))


def rule_ablations(spark, sf_dir: str) -> DataFrame:
    rows = stored(spark, sf_dir)
    return reduce(DataFrame.unionByName, [ablations(rows, v).select(F.lit(v).alias("version"), "*") for v in POLICIES])


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps, with their columns."""
    bits = ledger_names(docs.columns)["failed_bits"]
    return ledger(docs, docs.columns).where(passes(CURRENT, bits)).select(*map(named, docs.columns))


_WORD_LIST = "filter(regexp_split_to_array(coalesce(text, ''), '[ \\x09-\\x0D]+'), lambda x: x <> '')"
_DIGIT_CLASS = {"n_upper": "[A-Z]", "n_lower": "[a-z]", "n_digits": "[0-9]"}


#: The rules once more, for DuckDB.
_RULES_SQL = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "shouting": "n_upper > n_lower AND n_upper + n_lower > 0",
    "repeated_lines": "n_dup_lines >= 5 AND 100 * n_dup_lines > 50 * n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
    "digits": "100 * n_digits > 30 * word_chars",
}


def _sql_bits() -> str:
    return " + ".join(f"CASE WHEN {rule} THEN {BITS[name]} ELSE 0 END" for name, rule in _RULES_SQL.items())


_LEDGER_SQL = f"""
WITH w AS (SELECT rowid AS r, doc_id, coalesce(text, '') AS t, {_WORD_LIST} AS ws FROM (SELECT row_number() OVER () AS rowid, * FROM documents)),
tri AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT r, i FROM tri QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY r),
m AS (SELECT w.r, doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  len(filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\x09-\\x0D]')))::BIGINT AS n_lines,
  len(list_distinct(filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\x09-\\x0D]'))))::BIGINT AS u_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  {', '.join(f"(length(t) - length(regexp_replace(t, '{c}', '', 'g')))::BIGINT AS {k}" for k, c in _DIGIT_CLASS.items())}
  FROM w LEFT JOIN rep ON w.r = rep.r),
d AS (SELECT *, n_lines - u_lines AS n_dup_lines FROM m),
b AS (SELECT *, ({_sql_bits()})::BIGINT AS failed_bits FROM d)
"""

#: DuckDB SQL for op3.
SQL = f"""{_LEDGER_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (failed_bits & {policy_mask('base-1')}) <> 0 AS base_failed, (failed_bits & {policy_mask(CURRENT)}) = 0 AS kept, failed_bits FROM b
"""


def _policies_sql() -> str:
    names = list(POLICIES)
    parts = []
    for k, v in enumerate(names):
        kept, before = (f"(failed_bits & {policy_mask(x)}) = 0" for x in (v, names[max(0, k - 1)]))
        parts.append(f"SELECT '{v}' AS version, count(*) AS documents, count(*) FILTER (WHERE {kept}) AS kept, count(*) FILTER (WHERE ({kept}) <> ({before})) AS changed FROM b")
    return _LEDGER_SQL + " UNION ALL ".join(parts)


def _ablations_sql() -> str:
    parts = []
    for v in POLICIES:
        for name in POLICIES[v]:
            bit, mask = BITS[name], policy_mask(v)
            parts.append(
                f"SELECT '{v}' AS version, '{name}' AS rule, count(*) FILTER (WHERE failed_bits & {bit} <> 0) AS failed, "
                f"count(*) FILTER (WHERE failed_bits & {mask} = {bit}) AS alone, count(*) FILTER (WHERE failed_bits & {mask - bit} = 0) AS kept_without FROM b"
            )
    return _LEDGER_SQL + " UNION ALL ".join(parts)


POLICIES_SQL, ABLATIONS_SQL = _policies_sql(), _ablations_sql()
