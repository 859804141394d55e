"""URL filter: host and path rules, then logistic regression on hashed character n-grams.

A rule names a host and the start of a path; it fits that host and all its
subdomains, and the longest fitting rule decides. Urls without one get the
model's verdict. The model is trained from a small labelled table of urls
(``labelled_urls.tsv``; at most ``MOST_LABELLED`` rows), once a process, on the
counts of host and path n-grams of ``GRAMS`` characters hashed into ``SLOTS`` slots.
Its weights, whole millionths, enter the plan as one constant array of that length,
and everything per row is a native expression.

A null url or one without "://" has an empty host and path, which no rule fits;
the model then sees no n-grams and its bias decides. Repeated rows are judged
each by itself, very long urls whole. An empty table gives no rows. Kept columns
stay; a made one of the same name gets an underscore before it.
"""

from __future__ import annotations

import csv
import functools
import re
from collections.abc import Sequence
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free, named, table

SLOTS = 4096
GRAMS = (2, 3, 4)
#: Multipliers of a gram's characters, and the start for host and for path.
FACTORS, START = (1, 31, 961, 1531), {"h": 7, "p": 1031}
UNIT = 1_000_000
MOST_LABELLED = 10_000
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)"

LABELLED = Path(__file__).with_name("labelled_urls.tsv")


def labelled(path: Path = LABELLED) -> list[tuple[str, int]]:
    """The labelled table: (url, label), 1 is to be blocked."""
    with path.open(encoding="utf-8") as f:
        return [(row["url"], int(row["label"])) for row in csv.DictReader(f, delimiter="\t")]


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; of equal lengths, the longer host wins."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1].index("/"))):
        own, start = text.split("/", 1)
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + start)
        name, verdict = F.when(fits, F.lit(text)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def slots(host: str = "host", path: str = "path") -> str:
    """SQL of the slots of every n-gram of host and path, which are told apart by their start."""

    def grams(column: str, kind: str, n: int) -> str:
        # Characters as numbers first: a place in an array is found at once, one in a text by walking there.
        codes = f"transform(filter(split(concat('^', {column}, '$'), ''), c -> c <> ''), c -> ascii(c))"
        place = " + ".join([str(START[kind] * n), *(f"{FACTORS[k]} * z[i + {k}]" for k in range(n))])
        return f"transform(array({codes}), z -> transform(filter(sequence(0, size(z) - 1), i -> i + {n} <= size(z)), i -> ({place}) % {SLOTS}))[0]"

    every = [f"IF({c} = '', CAST(array() AS array<int>), {grams(c, k, n)})" for c, k in ((host, "h"), (path, "p")) for n in GRAMS]
    return f"IF({host} = '', CAST(array() AS array<int>), concat({', '.join(every)}))"


def parts_of(url: str) -> tuple[str, str]:
    """Host and path of one url, as ``host_of`` and ``path_of`` have them."""
    found = re.match(PARTS, url)
    return (found[1].translate(str.maketrans(UPPER, LOWER)), found[2]) if found else ("", "")


def slots_of(url: str) -> list[int]:
    """``slots`` of one url."""
    host, path = parts_of(url)
    out = []
    for text, kind in ((host, "h"), (path, "p")) if host else ():
        marked = f"^{text}$"
        for n in GRAMS if text else ():
            out += [(START[kind] * n + sum(FACTORS[k] * ord(marked[i + k]) for k in range(n))) % SLOTS for i in range(len(marked) - n + 1)]
    return out


def train(urls: Sequence[tuple[str, int]], rounds: int = 2000, rate: float = 4.0, decay: float = 1e-4) -> tuple[list[int], int]:
    """Weights and bias in millionths, by gradient descent on normalised counts.

    The weights are sums of the rows, so the descent goes over one number a row."""
    if len(urls) > MOST_LABELLED:
        raise ValueError(f"the labelled table has {len(urls)} rows; the bound is {MOST_LABELLED}")
    x, y = np.zeros((len(urls), SLOTS)), np.array([label for _, label in urls], float)
    for k, (url, _) in enumerate(urls):
        found = slots_of(url)
        np.add.at(x[k], found, 1 / max(1, len(found)) ** 0.5)
    alike, share, b = x @ x.T, np.zeros(len(urls)), 0.0
    for _ in range(rounds if len(urls) else 0):
        p = 1 / (1 + np.exp(-(alike @ share + b)))
        share -= rate * ((p - y) / len(y) + decay * share)
        b -= rate / 8 * (p - y).mean()
    return [round(float(v) * UNIT) for v in share @ x], round(b * UNIT)


@functools.cache
def trained() -> tuple[list[int], int]:
    return train(labelled())


def model_margin(weights: Sequence[int], bias: int, found: str) -> Column:
    """The logit of "to be blocked", from SQL of slots: whole weights, so that their sum is exact in any order."""
    constant = f"from_json('[{','.join(map(str, weights))}]', 'array<bigint>')"
    return F.expr(f"aggregate({found}, 0L, (s, g) -> s + element_at({constant}, g + 1)) / {UNIT}D / sqrt(greatest(1, size({found}))) + ({bias / UNIT!r}D)")


def filtered(pages: DataFrame, keep: list[str], url: str = "url", rules=RULES, urls: Sequence[tuple[str, int]] | None = None) -> DataFrame:
    """``keep``, host, path, rule, score and verdict of every row."""
    weights, bias = trained() if urls is None else train(urls)
    kept = [named(c).alias(f"k{i}") for i, c in enumerate(keep)]
    parts = pages.select(*kept, host_of(named(url)).alias("host"), path_of(named(url)).alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = parts.select("*", name.alias("rule"), verdict.alias("ruled"), F.expr(slots()).alias("slots"))
    judged = ruled.select("*", model_margin(weights, bias, "slots").alias("margin"))
    out = judged.select(
        *[f"k{i}" for i in range(len(keep))], "host", "path", "rule", (1 / (1 + F.exp(-F.col("margin")))).alias("score"),
        F.coalesce("ruled", F.when(F.col("margin") >= 0, "block").otherwise("allow")).alias("verdict"),
    )
    return out.toDF(*keep, *free(keep, ["host", "path", "rule", "score", "verdict"]))


def op8(spark, sf_dir: str) -> DataFrame:
    return filtered(table(spark, sf_dir, "pages"), ["page_id"]).select("page_id", "host", "path", "rule", "verdict")


def sql() -> str:
    """DuckDB SQL for op8: rules as a table, the longest that fits; the model's weights as a list."""
    weights, bias = trained()
    rows = ", ".join(f"('{kind}', '{text}', '{text.split('/', 1)[0]}', '/{text.split('/', 1)[1]}')" for kind, text in RULES)

    def grams(column: str, kind: str, n: int) -> str:
        text = f"('^' || {column} || '$')"
        place = " + ".join([str(START[kind] * n), *(f"{FACTORS[k]} * unicode(substr({text}, i::BIGINT + {k}, 1))" for k in range(n))])
        return f"CASE WHEN {column} = '' THEN [] ELSE list_transform(range(1, length({text}) - {n - 2}), lambda i: ({place}) % {SLOTS}) END"

    every = ", ".join(grams(c, k, n) for c, k in (("host", "h"), ("path", "p")) for n in GRAMS)
    return f"""
WITH p AS (SELECT row_number() OVER () AS id, page_id, coalesce(translate(regexp_extract(url, '{PARTS}', 1), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(url, '{PARTS}', 2), '') AS path FROM pages),
r(kind, rule, own, first) AS (VALUES {rows}),
f AS (SELECT id, kind, rule FROM p JOIN r ON (host = own OR ends_with(host, '.' || own)) AND starts_with(path, first) QUALIFY row_number() OVER (PARTITION BY id ORDER BY length(rule) DESC, length(own) DESC) = 1),
g AS (SELECT *, CASE WHEN host = '' THEN [] ELSE flatten([{every}]) END AS slots FROM p),
s AS (SELECT id, page_id, host, path, coalesce(list_sum(list_transform(slots, lambda g: ([{','.join(map(str, weights))}]::BIGINT[])[g + 1])), 0)::DOUBLE / {UNIT} / sqrt(greatest(1, len(slots))) + ({bias / UNIT!r}::DOUBLE) AS margin FROM g)
SELECT page_id, host, path, rule, coalesce(kind, CASE WHEN margin >= 0 THEN 'block' ELSE 'allow' END) AS verdict FROM s LEFT JOIN f USING (id)
"""
