"""Token ids in patched frame-of-reference blocks.

File format. A table of Parquet files, sorted by document; a row is a segment of
whole consecutive documents with about ``SEGMENT_IDS`` ids:

* ``shard``, ``segment``: place in the order; ascending (shard, segment) is
  ascending (doc_id, hash of the text, text);
* ``doc_ids``, ``doc_lengths``: the documents and their numbers of ids;
* ``n_ids``: the sum of the lengths;
* ``data``: the blocks. Little-endian: u32 number of ids, u32 number of blocks,
  u32 start of each block within ``data`` (so block k, and with it id
  k * BLOCK, is found without reading others); then the blocks: u32 minimum, u8
  width, u16 number of exceptions, the low ``width`` bits of each id minus the
  minimum packed most significant bit first, u16 positions of the exceptions,
  u32 their whole values.

A block's width is the least that holds ``PERCENTILE`` of its values; larger
ones are exceptions. Spark's committer makes the files appear whole or not at
all, so a lost executor costs a repeated task and nothing else; the folder can
be in any store that Spark writes.

Documents without text count as empty and have the end id alone. Rows with a
null doc_id come first; repeated rows are all written, and very long texts whole (a
segment may be longer than ``SEGMENT_IDS``). An empty table gives files without rows.
Other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .bpe import shared_bpe
from .shared import Cut, named, ship, slices, table

BLOCK = 256
PERCENTILE = 0.9
SEGMENT_IDS = 1 << 16
END_ID = 2
#: Words that a worker remembers the ids of.
WORDS = 300_000

SEGMENTS = "shard int, segment int, doc_ids array<bigint>, doc_lengths array<bigint>, n_ids bigint, data binary"


def pack_ids(ids: np.ndarray) -> bytes:
    """One segment's ids as blocks, with the index of their starts."""
    n = len(ids)
    count = -(-n // BLOCK)
    padded = np.zeros(count * BLOCK, np.uint32)
    padded[:n] = ids
    if n % BLOCK:
        padded[n:] = ids[-1]
    grid = padded.reshape(count, BLOCK)
    least = grid.min(axis=1, initial=0 if not count else None) if count else np.zeros(0, np.uint32)
    rest = grid - least[:, None]
    mark = np.partition(rest, int(PERCENTILE * BLOCK) - 1, axis=1)[:, int(PERCENTILE * BLOCK) - 1] if count else least
    widths = np.array([int(x).bit_length() for x in mark], np.uint8)
    over = (rest.astype(np.uint64) >> widths[:, None].astype(np.uint64)) > 0
    over.reshape(-1)[n:] = False
    packed: list[bytes] = [b""] * count
    for width in np.unique(widths[widths > 0]):
        rows = np.flatnonzero(widths == width)
        kind, size = (">u2", 16) if width <= 16 else (">u4", 32)
        whole = (rest[rows] & np.uint32((1 << int(width)) - 1)).astype(kind)
        bits = np.unpackbits(whole.view(np.uint8).reshape(len(rows), BLOCK, size // 8), axis=2)[:, :, size - width :]
        for row, line in zip(rows, np.packbits(bits.reshape(len(rows), -1), axis=1)):
            packed[row] = line.tobytes()
    blocks = []
    for k in range(count):
        at = np.flatnonzero(over[k])
        blocks.append(
            b"".join(
                (
                    int(least[k]).to_bytes(4, "little"),
                    bytes([widths[k]]),
                    len(at).to_bytes(2, "little"),
                    packed[k],
                    at.astype("<u2").tobytes(),
                    grid[k, at].astype("<u4").tobytes(),
                )
            )
        )
    head = 8 + 4 * count
    starts = head + np.cumsum([0, *map(len, blocks)])[:-1] if count else np.zeros(0)
    return b"".join((n.to_bytes(4, "little"), count.to_bytes(4, "little"), starts.astype("<u4").tobytes(), *blocks))


def unpack_block(data: bytes, k: int) -> np.ndarray:
    """Block k alone, by the index of starts (the last block's padding included)."""
    start = int.from_bytes(data[8 + 4 * k : 12 + 4 * k], "little")
    least, width = int.from_bytes(data[start : start + 4], "little"), data[start + 4]
    n = int.from_bytes(data[start + 5 : start + 7], "little")
    at = start + 7
    size = BLOCK * width // 8
    if width:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at)).reshape(BLOCK, width)
        kind, most = (">u2", 16) if width <= 16 else (">u4", 32)
        whole = np.zeros((BLOCK, most), np.uint8)
        whole[:, most - width :] = bits
        values = np.packbits(whole, axis=1).view(kind)[:, 0].astype(np.uint32) + np.uint32(least)
    else:
        values = np.full(BLOCK, least, np.uint32)
    if n:
        at += size
        values[np.frombuffer(data, "<u2", n, at)] = np.frombuffer(data, "<u4", n, at + 2 * n)
    return values


def unpack_ids(data: bytes) -> np.ndarray:
    """All ids of a segment; blocks of one width are unpacked together."""
    n, count = int.from_bytes(data[:4], "little"), int.from_bytes(data[4:8], "little")
    if not count:
        return np.zeros(0, np.uint32)
    # Three bytes more, so that the last values of the last block can be read as four.
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    starts = np.frombuffer(data, "<u4", count, 8).astype(np.int64)
    least = raw[starts[:, None] + np.arange(4)].copy().view("<u4")
    widths = raw[starts + 4]
    outliers = raw[starts[:, None] + np.arange(5, 7)].copy().view("<u2")[:, 0].astype(np.int64)
    values = np.repeat(least.astype(np.uint32), BLOCK, axis=1)
    for width in np.unique(widths[widths > 0]).tolist():
        rows = np.flatnonzero(widths == width)
        if width <= 25:
            # A value lies in the four bytes from its first one on.
            bit = np.arange(BLOCK) * width
            at = starts[rows, None] + 7 + (bit >> 3)
            whole = raw[at].astype(np.uint32)
            for k in range(1, 4):
                whole = whole << np.uint32(8) | raw[at + k]
            values[rows] += whole >> (32 - width - (bit & 7)).astype(np.uint32) & np.uint32((1 << width) - 1)
            continue
        kind, most = ">u4", 32
        packed = raw[starts[rows, None] + 7 + np.arange(BLOCK * width // 8)]
        whole = np.zeros((len(rows), BLOCK, most), np.uint8)
        whole[:, :, most - width :] = np.unpackbits(packed, axis=1).reshape(len(rows), BLOCK, width)
        values[rows] += np.packbits(whole, axis=2).reshape(len(rows), -1).view(kind).astype(np.uint32)
    for k in np.flatnonzero(outliers).tolist():
        at, m = int(starts[k]) + 7 + BLOCK * int(widths[k]) // 8, int(outliers[k])
        values[k, np.frombuffer(data, "<u2", m, at)] = np.frombuffer(data, "<u4", m, at + 2 * m)
    return values.reshape(-1)[:n]


def read_range(data: bytes, start: int, end: int) -> np.ndarray:
    """Ids start to end of a segment, from their blocks alone."""
    first, last = start // BLOCK, -(-end // BLOCK)
    if start >= end:
        return np.zeros(0, np.uint32)
    return np.concatenate([unpack_block(data, k) for k in range(first, last)])[start - first * BLOCK : end - first * BLOCK]


def segments_of(docs: Iterable[tuple[int | None, bytes]]) -> Iterator[tuple[list, list, bytes]]:
    """Group (doc_id, packed ids) into segments of whole documents."""
    keys: list[int | None] = []
    parts: list[bytes] = []
    size = 0
    for key, ids in docs:
        keys.append(key)
        parts.append(ids)
        size += len(ids) // 4
        if size >= SEGMENT_IDS:
            yield keys, [len(p) // 4 for p in parts], b"".join(parts)
            keys, parts, size = [], [], 0
    if keys:
        yield keys, [len(p) // 4 for p in parts], b"".join(parts)


def write_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = END_ID) -> Cut:
    """Encode the texts in ascending doc_id order and write the segments.

    One shuffle deals the texts out by ranges of (doc_id, hash), so that neither
    many rows of one id nor a hot source make a large task.
    """
    spark = docs.sparkSession
    ship(spark)
    end = int(end_id).to_bytes(4, "little")
    rows = docs.select(named(doc_id).cast("long").alias("doc_id"), F.xxhash64(named(text)).alias("h"), named(text).alias("text"))
    dealt = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    arrow = pa.schema(
        [("shard", pa.int32()), ("segment", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("data", pa.binary())]
    )

    def run(batches):
        shard = TaskContext.get().partitionId()
        bpe = shared_bpe(path, True, WORDS)
        docs = ((i, bpe.packed(t) + end) for b in slices(batches) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        for k, (keys, lengths, ids) in enumerate(segments_of(docs)):
            n = len(ids) // 4
            yield pa.RecordBatch.from_pylist(
                [dict(shard=shard, segment=k, doc_ids=keys, doc_lengths=lengths, n_ids=n, data=pack_ids(np.frombuffer(ids, "<u4")))], schema=arrow
            )

    return Cut(dealt.mapInArrow(run, StructType.fromDDL(SEGMENTS)), "token-ids")


def segment_starts(files: DataFrame) -> DataFrame:
    """shard, segment and the number of ids before it, over all shards.

    The totals of shards (one row a task of the writer) are summed in one place;
    segments only within their shard.
    """
    from pyspark.sql import Window

    sizes = files.select("shard", "segment", "n_ids")
    within = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    inside = sizes.select("shard", "segment", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("inside"))
    return inside.join(shards, "shard").select("shard", "segment", (F.col("shard_start") + F.col("inside")).alias("start"))


def read_tokens(spark: SparkSession, files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    ship(spark)
    arrow = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("doc_id", pa.int64()), ("inside", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        for b in slices(batches, 16):
            for shard, segment, keys, lengths, data in zip(*(b.column(i).to_pylist() for i in range(5))):
                raw = unpack_ids(data).astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                starts = ends - lengths
                sums = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist())]
                n = len(keys)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * n, pa.int32()), pa.array([segment] * n, pa.int32()), pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())],
                    schema=arrow,
                )

    out = files.select("shard", "segment", "doc_ids", "doc_lengths", "data").mapInArrow(
        run, "shard int, segment int, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint"
    )
    starts = segment_starts(files)
    return out.join(starts, ["shard", "segment"]).select("doc_id", (F.col("start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(spark, write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")).df)
