"""SimHash near-duplicates by fuzzy Golay keys.

A fingerprint's 64 bits fall into three segments of 22, 21 and 21 bits, each a
word of the perfect binary Golay code of length 23 with zeros appended. Every
such word lies within distance 3 of exactly one codeword, and its keys are the
indices (12 bits) of the codewords nearest to it and to its neighbours at
distance 1: one index if the codeword is within 2, up to six otherwise. Two
words at distance 2 or less share a key: some word is a neighbour of both (or the
one of the other), and its codeword is among the keys of either.

Pigeonhole over segment errors: of at most 4 differing bits, either a segment has
none, and then one of the other two has at most two; or all three have some, and
then none has more than two. So fingerprints are joined on the whole value of a
segment with a Golay key of another (33 or 34 bits of key, about 32 keys) and on
Golay keys of all three (36 bits, about 150 keys), and every shared bucket is
verified by counting bits. No link is lost and none is guessed. Keys this wide keep
the buckets of unlike fingerprints short: of 10^10 of them, some twenty.

Only distinct fingerprints are joined, so exact copies cost nothing. A bucket
yields a forest (each member with a link and the smallest fingerprint that it
reaches inside the bucket), never all pairs. Buckets are dealt out as pairs of
blocks of about ``BUCKET_ROWS`` members (most have one block), so no task holds an
unbounded group and none is cut short. Components follow from rounds of large
and small stars over the forest's edges; joins whose keys may be hot are spread
over ``SPREAD`` shares of each key.

Null and empty texts have fingerprint zero and link like any other. Repeated
rows share their fingerprint. Rows with a null doc_id get a component too; a
component of none but such rows has a null component_id. Very long texts are hashed
whole, in bounded memory. An empty table gives no rows. Of other columns, the stage
keeps all, whatever their names.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField

from .shared import Cut, enrich, fresh, named, ship, table

WORDS = 4
SEED = 42
MOST_BITS = 4
SEGMENTS = ((42, 22), (21, 21), (0, 21))
BUCKET_ROWS = 8192
SPREAD = 8
#: Shingles hashed at once, so that very long texts stay in bounded memory.
CHUNK = 1 << 16


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of a whole text."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    total = max(1, n - WORDS + 1)
    first, last = starts[:total].tolist(), ends[min(WORDS, n) - 1 :].tolist()
    hashed = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, total, CHUNK):
        some = np.array([hashed(joined[a:b], SEED) for a, b in zip(first[at : at + CHUNK], last[at : at + CHUNK])], ">u8")
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big")


@functools.cache
def golay() -> tuple[np.ndarray, np.ndarray]:
    """For each 23-bit word the index of its nearest codeword, and the distance.

    Codewords are 11 shifts of the generator polynomial's multiples: index times
    x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 over GF(2).
    """
    generator = 0b101011100011
    index = np.arange(1 << 12, dtype=np.uint32)
    codewords = np.zeros(1 << 12, np.uint32)
    for bit in range(12):
        codewords ^= ((index >> bit) & 1) * np.uint32(generator << bit)
    near, far = np.zeros(1 << 23, np.uint16), np.zeros(1 << 23, np.uint8)
    singles = [1 << i for i in range(23)]
    patterns = {0: 0} | {a: 1 for a in singles}
    patterns |= {a | b: 2 for a in singles for b in singles if a < b}
    patterns |= {a | b | c: 3 for a in singles for b in singles if a < b for c in singles if b < c}
    for pattern, weight in patterns.items():
        at = codewords ^ np.uint32(pattern)
        near[at] = index
        far[at] = weight
    return near, far


def segment_keys(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of words, up to six each, and how many they are."""
    near, _ = golay()
    values = values.astype(np.uint32)
    every = np.empty((len(values), bits + 1), np.uint16)
    every[:, 0] = near[values]
    for i in range(bits):
        every[:, i + 1] = near[values ^ np.uint32(1 << i)]
    every.sort(axis=1)
    new = np.ones(every.shape, bool)
    new[:, 1:] = every[:, 1:] != every[:, :-1]
    count = new.sum(axis=1)
    keys = np.zeros((len(values), 6), np.uint64)
    row, column = np.nonzero(new)
    keys[row, (np.cumsum(new, axis=1) - 1)[row, column]] = every[row, column]
    return keys, count


def all_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every bucket key of each fingerprint as 64-bit numbers, one after another, and where each one's begin."""
    u = np.uint64
    parts = [(fingerprints >> u(low)) & u((1 << bits) - 1) for low, bits in SEGMENTS]
    coded = [segment_keys(p, bits) for p, (_, bits) in zip(parts, SEGMENTS)]
    there = [np.arange(6) < count[:, None] for _, count in coded]
    blocks, kept = [], []
    for kind, (i, j) in enumerate((i, j) for i in range(3) for j in range(3) if i != j):
        blocks.append(u(kind << 40) | parts[i][:, None] << u(12) | coded[j][0])
        kept.append(there[j])
    a, b, c = (keys for keys, _ in coded)
    x, y, z = there
    blocks.append((u(6 << 40) | a[:, :, None, None] << u(24) | b[:, None, :, None] << u(12) | c[:, None, None, :]).reshape(len(a), -1))
    kept.append((x[:, :, None, None] & y[:, None, :, None] & z[:, None, None, :]).reshape(len(a), -1))
    here = np.concatenate(kept, axis=1)
    return np.concatenate(blocks, axis=1)[here].astype(np.int64), np.concatenate(([0], np.cumsum(here.sum(axis=1))))


def bucket_forest(values: np.ndarray, others: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links of a bucket as a forest: (member, smallest member of its local component).

    With ``others``, links between the two blocks and within each.
    """
    rest = np.unique(values if others is None else np.concatenate((values, others)))
    out: list[tuple[int, int]] = []
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        queue = [root]
        while queue and len(rest):
            close = np.bitwise_count(rest ^ queue.pop()) <= MOST_BITS
            if close.any():
                found = rest[close]
                rest = rest[~close]
                out += [(int(x), int(root)) for x in found]
                queue += list(found)
    return out


def links(fingerprints: DataFrame, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, list[Cut]]:
    """Forest edges (a, b), a > b as unsigned numbers, between distinct fingerprints ``fp`` (signed)."""

    def factory():
        def work(values):
            keys, starts = all_keys(np.array(values, np.int64).view(np.uint64))
            return [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(keys))]

        return work

    spark = fingerprints.sparkSession
    ship(spark)
    # Some 180 keys follow from each of these few bytes: dealt out before, so that no task makes many of them.
    # (By a hash of their own: Spark would take a repartition by "fp" for the one that made them distinct.)
    shares = fingerprints.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp"))
    keyed = Cut(enrich(shares, "fp", factory, [StructField("keys", ArrayType(LongType()))], ["fp"]), "simhash-keys")
    rows = keyed.df.select(F.explode("keys").alias("key"), "fp")
    # One row for each bucket of more than a block, so few that Spark mostly sends them to the keys.
    heavy = Cut(rows.groupBy("key").count().where(F.col("count") > bucket_rows).select("key", F.ceil(F.col("count") / bucket_rows).cast("int").alias("blocks")), "simhash-heavy")
    blocks = F.coalesce("blocks", F.lit(1))
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    dealt = (
        rows.join(heavy.df, "key", "left")
        .select("key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    )
    sorted_rows = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").select("key", "i", "j", "fp")
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def out(pairs):
        return pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in zip(*pairs)], schema=arrow)

    def run(batches):
        held: list[np.ndarray] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)])
            fp = batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64)
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            bounds = np.concatenate(([0], cuts, [len(fp)]))
            pairs: list[tuple[int, int]] = []
            if last is not None and (key[:, 0] != last).any():
                pairs += bucket_forest(np.concatenate(held))
                held = []
            sizes = np.diff(bounds)
            # Buckets of two that end inside the batch, which are most, go together.
            inner = np.arange(len(sizes) - 1)[1 if held else 0 :]
            two = bounds[inner[sizes[inner] == 2]]
            close = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= MOST_BITS]
            pairs += [(max(x, y), min(x, y)) for x, y in zip(fp[close].tolist(), fp[close + 1].tolist()) if x != y]
            for k in inner[sizes[inner] > 2]:
                pairs += bucket_forest(fp[bounds[k] : bounds[k + 1]])
            if held and len(sizes) > 1:
                held.append(fp[: bounds[1]])
                pairs += bucket_forest(np.concatenate(held))
                held = []
            held.append(fp[bounds[-2] :].copy())
            last = key[:, -1]
            if pairs:
                yield out(pairs)
        if held and (pairs := bucket_forest(np.concatenate(held))):
            yield out(pairs)

    edges = Cut(sorted_rows.mapInArrow(run, "a long, b long").distinct(), "simhash-links")
    return edges.df, [keyed, heavy, edges]


def spread_join(rows: DataFrame, single: DataFrame, on: str, by: str, how: str = "inner") -> DataFrame:
    """Join with a frame that has one row a key; ``rows`` may have many of a key, and are
    dealt by a hash of ``by`` to ``SPREAD`` shares of it."""
    left = rows.withColumn("_share", F.pmod(F.xxhash64(by), F.lit(SPREAD)))
    right = single.withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))))
    return left.join(right, [on, "_share"], how).drop("_share")


def components(edges: DataFrame, name: str = "components") -> tuple[DataFrame, list[Cut]]:
    """``node`` and ``root`` (the least node that it reaches, as signed numbers) for nodes with edges (a, b).

    Alternating large and small stars: minima are pre-aggregated before they
    are shuffled, and a node's neighbours are never gathered. Each round is
    written to the shared folder.
    """
    both = edges.select("a", "b").where("a <> b")
    now = Cut(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    mark = None
    while True:
        e = now.df
        around = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = spread_join(around.where("b > a"), least, "a", "b").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        below = large.groupBy("a").agg(F.min("b").alias("m"))
        small = spread_join(large, below, "a", "b").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        after = Cut(small.where("a <> b").distinct(), name)
        seen = after.df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        now.drop()
        now = after
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    return now.df.select(F.col("a").alias("node"), F.col("b").alias("root")), [now]


def fingerprinted(df: DataFrame, keep: list[str], text: str = "text", name: str = "fp") -> DataFrame:
    """``keep`` and the fingerprint as a signed 64-bit number."""

    def factory():
        def work(texts):
            return [pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))]

        return work

    return enrich(df, text, factory, [StructField(name, LongType())], keep)


def classed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, key (of the text), fp, component_id and root (a fingerprint) of every row."""
    rows = docs.select(named(doc_id).cast("long").alias("doc_id"), named(text).alias("text"), F.xxhash64(named(text)).alias("key"))
    prints = Cut(fingerprinted(rows, ["doc_id", "key"]), "simhash-prints")
    distinct = prints.df.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows"))
    edges, cuts = links(distinct.select("fp"), bucket_rows)
    roots, more = components(edges)
    for cut in cuts:
        cut.drop()
    # Fingerprints of one row without a link are classes of their own and need no join.
    linked = roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
    rooted = distinct.join(linked, F.col("fp") == F.col("node"), "left").where("rows > 1 OR root IS NOT NULL").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    shared = Cut(spread_join(rooted, least, "root", "fp").select("fp", "component_id", "root"), "simhash-classes")
    for cut in more:
        cut.drop()
    found = spread_join(prints.df, shared.df, "fp", "doc_id", "left")
    return found.select("doc_id", "key", "fp", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("root", "fp").alias("root"))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, fp and component_id of every row."""
    return classed(docs, doc_id, text, bucket_rows).select("doc_id", "fp", "component_id")


def op2(spark, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: the one with the smallest doc_id (of equal ids, the
    least hash of the text); rows without doc_id come last."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")).alias("first")
    found = classed(docs).groupBy("root").agg(first)
    a, b, row = fresh(docs, "_id"), fresh(docs, "_key"), fresh(docs, "_row")
    kept = found.select(F.col("first.doc_id").alias(a), F.col("first.key").alias(b))
    # Equal texts have one class, so no (doc_id, text) is chosen twice.
    rows = docs.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col(a)) & (F.xxhash64("text") == F.col(b)))
    whole = F.struct(*map(named, docs.columns))
    once = rows.groupBy(a, b).agg(F.min_by(whole, F.coalesce("text", F.lit(""))).alias(row))
    return once.select(*[F.col(f"`{row}`.`{c}`").alias(c) for c in docs.columns])
