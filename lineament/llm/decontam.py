"""Benchmark decontamination by spaced seeds.

Words are runs of letters and digits, lower-cased. A seed looks at five words
through a fixed mask that ignores the positions between them, so a substituted
word does not hide a passage: the masks for an item's length leave no pattern of
substitutions that ``SIMILARITY`` allows without a seed. Items of five words have
masks of four, shorter ones (which allow no substitution) are matched whole. Seeds of the test items and of the documents are
joined on their hash. Around each hit the two texts are laid side by side, and
the hit counts if, in some window of ``WINDOW`` words (the whole item if it is
shorter) that holds the seed, at least ``SIMILARITY`` of the words agree.

Documents are read and split once. Two bitmaps of fixed size, of the items' words and of
their seeds, enter the plan as constants: places whose words or seeds they do not
know are passed over inside their row, and only the others are joined. Their size
bounds what is sent along, not what is found; with more items they let more places
through to the same join.

Null and empty texts and items have no words and no hits. Repeated rows of a document
give the same pair once. A null doc_id is reported as null. Empty tables give none.
Very long texts are searched whole. The stage keeps all columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Cut, fresh, named, table

#: For windows of WINDOW words, for items of six words to WINDOW - 1 besides, of five, and whole.
LONG = ((0, 1, 2, 3, 5), (0, 2, 5, 6, 7), (0, 1, 3, 4, 5))
SHORT = ((0, 1, 2, 3, 4), (0, 2, 3, 4, 5), (0, 1, 2, 4, 5))
FIVE = ((0, 1, 2, 3), (0, 2, 3, 4), (0, 1, 3, 4), (0, 1, 2, 4))
WHOLE = ((0,), (0, 1), (0, 1, 2), (0, 1, 2, 3))
MASKS = tuple(dict.fromkeys(LONG + SHORT + FIVE + WHOLE))
WINDOW = 10
SIMILARITY = 0.8
#: Bits of either bitmap, of words and of seeds.
BITS = 1 << 20
#: Rows of (doc_id, hash) that may be broadcast.
MOST_BROADCAST = 500_000


def word_hashes(text: Column) -> Column:
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def seed(mask: tuple[int, ...], h: str, i: str) -> str:
    """The hash of a mask laid on the array ``h`` from its element ``i`` (from 0)."""
    return "xxhash64(" + ", ".join(f"get({h}, {i} + {k})" for k in mask) + ")"


def masks_for(words: int) -> tuple[tuple[int, ...], ...]:
    """The masks that an item of so many words is searched by."""
    if words < 5:
        return WHOLE[words - 1 : words]
    return FIVE if words == 5 else LONG if words >= WINDOW else tuple(m for m in LONG + SHORT if max(m) < words)


def lengths_of(mask: tuple[int, ...]) -> list[int]:
    """The lengths of items that a mask is for; WINDOW stands for it and all above."""
    return [n for n in range(1, WINDOW + 1) if mask in masks_for(n)]


def item_seeds(words: DataFrame) -> DataFrame:
    """mask, hash, item_id, w (the window's words) and around each seed its place ``ip`` in ``inear``, a slice of the item's words.

    Input: item_id and the words' hashes ``iw``, one at least."""
    lists = []
    for k, mask in enumerate(MASKS):
        meant, span = ", ".join(map(str, lengths_of(mask))), max(mask) + 1
        places = f"transform(sequence(0, size(iw) - {span}), i -> named_struct('mask', {k}, 'hash', {seed(mask, 'iw', 'i')}, 'at', i))"
        lists.append(f"IF(least(size(iw), {WINDOW}) IN ({meant}), {places}, CAST(array() AS array<struct<mask: int, hash: bigint, at: int>>))")
    seeds = words.select("item_id", "iw", F.explode(F.expr(f"concat({', '.join(lists)})")).alias("s"))
    first = F.greatest(F.lit(0), F.col("s.at") - WINDOW)
    return seeds.select("s.mask", "s.hash", "item_id", F.least(F.lit(WINDOW), F.size("iw")).alias("w"), (F.col("s.at") - first).alias("ip"), F.slice("iw", first + 1, F.lit(3 * WINDOW)).alias("inear"))


def bitmap(hashes: DataFrame, bits: int) -> str:
    """SQL of a constant array whose 64-bit words mark the hashes: at most bits / 64 rows reach the driver."""
    marks = hashes.select(F.expr(f"int(shiftright(hash & {bits - 1}, 6))").alias("word"), F.expr("shiftleft(1L, int(hash & 63))").alias("bit"))
    words = [0] * (bits // 64)
    for r in marks.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():
        words[r.word] = r.bits
    return f"from_json('[{','.join(map(str, words))}]', 'array<bigint>')"


def marked(words: str, bits: int, h: str) -> str:
    return f"bit_get(element_at({words}, int(shiftright({h} & {bits - 1}, 6)) + 1), int({h} & 63)) = 1"


def document_hits(rows: DataFrame, words: DataFrame, seeds: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, key, mask, hash, and around each seed that the bitmap knows: its place ``at`` in ``near``, a slice of the words' hashes.

    A seed is hashed only where all its words occur in some item; every mask looks at its first place."""
    used = sorted(r["mask"] for r in seeds.select("mask").distinct().collect())
    own, known = bitmap(words.select(F.explode("iw").alias("hash")), bits), bitmap(seeds, bits)
    flagged = rows.select("doc_id", "key", "dw", F.expr(f"transform(dw, h -> {marked(own, bits, 'h')})").alias("v"))
    # Outside the text there is no flag; null counts as false. (The optimiser moves conditions, so none may guard another.)
    occur = lambda k: " AND ".join(f"get(v, i + {o})" for o in MASKS[k][1:]) or "true"
    tests = [f"({occur(k)} AND exists(array({seed(MASKS[k], 'dw', 'i')}), h -> {marked(known, bits, 'h')}))" for k in used]
    places = flagged.select("doc_id", "key", "dw", F.explode(F.expr(f"filter(transform(v, (x, i) -> i), i -> v[i] AND ({' OR '.join(tests) or 'false'}))")).alias("i"))
    laid = lambda k: f"IF(i + {max(MASKS[k])} < size(dw), {seed(MASKS[k], 'dw', 'i')}, NULL)"
    each = ", ".join(f"named_struct('mask', {k}, 'hash', {laid(k)})" for k in used) or "named_struct('mask', 0, 'hash', CAST(NULL AS bigint))"
    first = F.greatest(F.lit(0), F.col("i") - WINDOW)
    hits = places.select("doc_id", "key", (F.col("i") - first).alias("at"), F.slice("dw", first + 1, F.lit(3 * WINDOW)).alias("near"), F.explode(F.expr(f"filter(array({each}), s -> {marked(known, bits, 's.hash')})")).alias("s"))
    return hits.select("doc_id", "key", "at", "near", "s.mask", "s.hash")


def overlaps(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", bits: int = BITS) -> DataFrame:
    """doc_id, key (of the text), item_id, n_hits and matches, window of the best overlap: one row a pair."""
    rows = docs.select(named(doc_id).alias("doc_id"), F.xxhash64(named(text)).alias("key"), word_hashes(named(text)).alias("dw"))
    words = items.select(named(item_id).alias("item_id"), word_hashes(named(item_text)).alias("iw")).where("size(iw) > 0")
    seeds = item_seeds(words)
    hits = document_hits(rows, words, seeds, bits).join(seeds, ["mask", "hash"])
    spans = F.element_at(F.lit([max(m) + 1 for m in MASKS]), F.col("mask") + 1)
    # A window that starts ``o`` words before the seed, inside both texts.
    most = F.least(F.col("at"), F.col("ip"), F.col("w") - spans)
    offsets = F.when(most >= 0, F.sequence(F.lit(0), F.greatest(F.lit(0), most))).otherwise(F.array().cast("array<int>"))
    counted = hits.select("doc_id", "key", "item_id", "at", "ip", "near", "inear", "w", offsets.alias("offsets")).select(
        "doc_id", "key", "item_id", "w",
        F.expr(
            "array_max(transform(filter(offsets, o -> at - o + w <= size(near) AND ip - o + w <= size(inear)), "
            "o -> size(filter(sequence(0, w - 1), k -> near[at - o + k] = inear[ip - o + k]))))"
        ).alias("matches"),
    )
    good = counted.where(F.col("matches") >= F.ceil(F.col("w") * F.lit(SIMILARITY)))
    best = good.groupBy("doc_id", "key", "item_id").agg(F.count(F.lit(1)).alias("n_hits"), F.max(F.struct(F.col("matches") / F.col("w"), "matches", "w")).alias("best"))
    return best.select("doc_id", "key", "item_id", "n_hits", F.col("best.matches").cast("int").alias("matches"), F.col("best.w").alias("window"))


def op9(spark, sf_dir: str) -> DataFrame:
    found = overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    best = F.max(F.struct(F.col("matches") / F.col("window"), "matches", "window")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", F.col("best.matches").alias("matches"), F.col("best.window").alias("window"))


#: DuckDB SQL for op9, by another way: equal words of a document and an item lie on
#: diagonals, and the matches in windows along these are counted. No seed is used.
_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS a FROM documents),
b AS (SELECT row_number() OVER () AS q, item_id, {_WORDS} AS a FROM benchmark),
dw AS (SELECT r, doc_id, len(a) AS dn, unnest(a) AS word, generate_subscripts(a, 1) AS i FROM d),
bw AS (SELECT q, item_id, len(a) AS bn, least(len(a), {WINDOW}) AS k, unnest(a) AS word, generate_subscripts(a, 1) AS j FROM b),
m AS (SELECT r, doc_id, dn, q, item_id, bn, k, i - j AS diagonal, j FROM dw JOIN bw USING (word)),
g AS (SELECT * FROM m QUALIFY count(*) OVER (PARTITION BY r, q, diagonal) >= ceil(k * {SIMILARITY})),
s AS (SELECT *, least(j, bn - k + 1, dn - k + 1 - diagonal) AS first FROM g),
c AS (SELECT s.r, s.doc_id, s.q, s.item_id, s.diagonal, s.j, s.k, count(*) AS matches FROM s
  JOIN g ON g.r = s.r AND g.q = s.q AND g.diagonal = s.diagonal AND g.j BETWEEN s.first AND s.first + s.k - 1
  WHERE s.first >= 1 AND s.first + s.diagonal >= 1 GROUP BY ALL)
SELECT doc_id, item_id, arg_max(matches, (matches / k::DOUBLE, matches))::INT AS matches, arg_max(k, (matches / k::DOUBLE, matches))::INT AS "window"
FROM c WHERE matches >= ceil(k * {SIMILARITY}) GROUP BY doc_id, item_id
"""


def decontamination_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that overlap no benchmark item, with their columns.

    The rows to drop are written down; while they are few enough (``MOST_BROADCAST``)
    they are sent to the documents, so that texts are not shuffled."""
    a, b = fresh(docs, "_doc"), fresh(docs, "_key")
    bad = Cut(overlaps(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(a), F.col("key").alias(b)).distinct(), "benchmark-overlaps").df
    few = F.broadcast(bad) if bad.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else bad
    return docs.join(few, docs["doc_id"].eqNullSafe(few[a]) & F.xxhash64(docs["text"]).eqNullSafe(few[b]), "left_anti")
