"""Token ids in binary files: patched frame-of-reference blocks.

A segment is one blob: a header, an index of block starts, then blocks of 1,024 ids. A block holds
its minimum, the differences to it packed at the width that a given share of them needs, and a
list of exceptions: places and the bits that did not fit. Spark writes segments (with the ids and
lengths of their documents) as rows of Parquet files, so a lost task leaves nothing behind."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.common import in_slices
from postmill.llm.tokens import codec, texts_of

BLOCK = 1024
#: A segment is closed at the end of the document that fills it.
SEGMENT_IDS = 1 << 20
#: Share of a block's ids that fit its width.
PERCENTILE = 90
_HEAD = struct.Struct("<4sQI")  # mark, ids, blocks
_BLOCK = struct.Struct("<IBH")  # minimum, width, exceptions
_MARK = b"PFR1"
_AT_ONCE = 64  # blocks that are worked on at a time


def _bits(values: np.ndarray) -> np.ndarray:
    return np.frexp(values.astype(np.float64))[1]  # 0 for 0, else the bit length


def _packed(low: np.ndarray, width: int) -> np.ndarray:
    """Rows of values, each row packed at `width` bits, highest bit first.

    Eight values fill `width` bytes: each of the eight is shifted to its place in these, for all
    groups of eight at a time."""
    out = np.zeros((len(low), low.shape[1] // 8, width), np.uint8)
    groups = low.reshape(len(low), -1, 8).astype(np.uint64)
    for k in range(8):
        first, last = k * width // 8, (k * width + width - 1) // 8
        moved = groups[:, :, k] << np.uint64((last + 1) * 8 - (k + 1) * width)
        for byte in range(last, first - 1, -1):
            out[:, :, byte] |= moved.astype(np.uint8)
            moved >>= np.uint64(8)
    return out.reshape(len(low), -1)


def _unpacked(rows: np.ndarray, width: int, n: int) -> np.ndarray:
    """Rows of n values: each is cut out of the few bytes that hold its bits."""
    at = np.arange(n) * width
    size = (width + 14) // 8  # bytes that a value can reach into
    first = at // 8
    padded = np.pad(rows, ((0, 0), (0, size)))
    word = np.zeros((len(rows), n), np.uint64)
    for k in range(size):
        word = word << np.uint64(8) | padded[:, first + k]
    word >>= (8 * size - width - at % 8).astype(np.uint64)
    return (word & np.uint64((1 << width) - 1)).astype(np.uint32)


def pack(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """Ids (unsigned, 32 bits) as a blob; of an empty array too."""
    count = -(-len(ids) // BLOCK)
    filled = np.zeros(count * BLOCK, np.uint32)
    filled[: len(ids)] = ids
    if count:
        filled[len(ids):] = ids[-1]  # padding that needs no bits of its own
    blocks = filled.reshape(count, BLOCK)
    least = blocks.min(axis=1) if count else np.zeros(0, np.uint32)
    over = blocks - least[:, None]
    bits = _bits(over)
    place = max(0, -(-int(BLOCK * percentile) // 100) - 1)
    widths = np.partition(bits, place, axis=1)[:, place] if count else np.zeros(0, int)
    out: list[bytes] = [b""] * count
    for width in np.unique(widths):
        which = np.flatnonzero(widths == width)
        for at in range(0, len(which), _AT_ONCE):
            some = which[at : at + _AT_ONCE]
            low = over[some] & np.uint32((1 << int(width)) - 1)
            rows = _packed(low, int(width)) if width else np.zeros((len(some), 0), np.uint8)
            odd = bits[some] > width
            for k, b in enumerate(some):
                places = np.flatnonzero(odd[k])
                high = over[b][places] >> np.uint32(width)
                out[b] = b"".join((
                    _BLOCK.pack(int(least[b]), int(width), len(places)), rows[k].tobytes(),
                    places.astype("<u2").tobytes(), high.astype("<u4").tobytes(),
                ))
    lengths = np.fromiter(map(len, out), np.int64, count)
    starts = _HEAD.size + 8 * count + np.cumsum(lengths) - lengths
    return b"".join((_HEAD.pack(_MARK, len(ids), count), starts.astype("<u8").tobytes(), *out))


def unpack(blob: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids at places first to last (not included); only the blocks that hold them are read."""
    mark, total, count = _HEAD.unpack_from(blob)
    if mark != _MARK:
        raise ValueError("not a block of packed ids")
    last = total if last is None else min(last, total)
    if first >= last:
        return np.zeros(0, np.uint32)
    starts = np.frombuffer(blob, "<u8", count, _HEAD.size).astype(np.int64)
    from_, to = first // BLOCK, -(-last // BLOCK)
    starts = starts[from_:to]
    heads = [_BLOCK.unpack_from(blob, s) for s in starts]
    least, widths, odd = (np.array(x, np.int64) for x in zip(*heads, strict=True))
    whole = np.frombuffer(blob, np.uint8)
    values = np.zeros((len(starts), BLOCK), np.uint32)
    for width in np.unique(widths):
        if not width:
            continue
        which = np.flatnonzero(widths == width)
        reach = np.arange(BLOCK * int(width) // 8) + _BLOCK.size
        for at in range(0, len(which), _AT_ONCE):
            some = which[at : at + _AT_ONCE]
            values[some] = _unpacked(whole[starts[some][:, None] + reach], int(width), BLOCK)
    for k in np.flatnonzero(odd):
        at = int(starts[k]) + _BLOCK.size + BLOCK * int(widths[k]) // 8
        places = np.frombuffer(blob, "<u2", odd[k], at)
        high = np.frombuffer(blob, "<u4", odd[k], at + 2 * int(odd[k]))
        values[k, places] |= high << np.uint32(widths[k])
    values += least.astype(np.uint32)[:, None]
    return values.reshape(-1)[first - from_ * BLOCK : last - from_ * BLOCK]


SEGMENT = "shard int, segment int, doc_ids array<bigint>, lengths array<bigint>, blob binary"


def write(
    docs: DataFrame, folder: str, path: str, end_id: int, pattern: str | None = None,
) -> None:
    """Encode `text` of every row (null: empty), end each with `end_id`, and write segments.

    Order: ascending doc_id, null first, rows of one doc_id by a hash of the text; repeated rows are all
    kept. The texts are dealt out by ranges of that order, so shard k precedes shard k + 1, and rows of
    one doc_id (or none), even equal ones, go to as many tasks as their share asks for. Other columns
    are not read. An empty table gives a folder without segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, segment = TaskContext.get().partitionId(), codec(path, pattern), 0
        ids, lengths, keys, count = [], [], [], 0
        ending = np.array([end_id], np.uint32)

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "segment": pa.array([segment], pa.int32()),
                "doc_ids": pa.array([keys], pa.list_(pa.int64())),
                "lengths": pa.array([lengths], pa.list_(pa.int64())),
                "blob": pa.array([pack(np.concatenate(ids))], pa.binary()),
            })

        for piece in in_slices(batches):
            encoded = held.encode(texts_of(piece.column("text")))
            for key, i in zip(piece.column("doc_id").to_pylist(), encoded, strict=True):
                ids += [i, ending]
                lengths.append(len(i) + 1)
                keys.append(key)
                count += len(i) + 1
                if count >= SEGMENT_IDS:
                    yield made()
                    ids, lengths, keys, count, segment = [], [], [], 0, segment + 1
        if ids:
            yield made()

    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("h"),
        F.monotonically_increasing_id().alias("n"),  # tells equal rows apart, whichever is which
    )
    order = ["doc_id", "h", "n"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    ordered.mapInArrow(run, SEGMENT).write.option("compression", "none").parquet(folder)


def read(segments: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, ids (array<bigint>)."""
    return _documents(segments, True)


def index(segments: DataFrame) -> DataFrame:
    """As `read`, but without the ids: they are unpacked and summed where they lie."""
    return _documents(segments, False)


def _documents(segments: DataFrame, with_ids: bool) -> DataFrame:
    schema = "shard int, segment int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint"
    schema += ", ids array<bigint>" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for p in in_slices(batches, 1) for r in p.to_pylist()):
            ids = unpack(row["blob"])
            ends = np.cumsum(np.array(row["lengths"], np.int64))
            starts = ends - np.array(row["lengths"], np.int64)
            raw = memoryview(ids.astype("<u4").tobytes())
            n = len(ends)
            out = {
                "shard": pa.array([row["shard"]] * n, pa.int32()),
                "segment": pa.array([row["segment"]] * n, pa.int32()),
                "doc_id": pa.array(row["doc_ids"], pa.int64()),
                "at": pa.array(starts, pa.int64()),
                "n_tokens": pa.array(ends - starts, pa.int64()),
                "ids_crc32": pa.array(
                    [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts, ends, strict=True)],
                    pa.int64(),
                ),
            }
            if with_ids:
                out["ids"] = pa.array(
                    [ids[s:e] for s, e in zip(starts, ends, strict=True)], pa.list_(pa.int64())
                )
            yield pa.RecordBatch.from_pydict(out)

    sizes = segments.select(
        "shard", "segment", F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n")
    )
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("n"))  # as many rows as tasks wrote
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "shard", "segment", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("within")
    ).join(
        shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "shard"
    )
    docs = segments.mapInArrow(run, schema).join(offsets, ["shard", "segment"])
    return docs.select(
        "doc_id", (F.col("before") + F.col("within") + F.col("at")).alias("start"),
        "n_tokens", "ids_crc32", *(["ids"] if with_ids else []),
    )
