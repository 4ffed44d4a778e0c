"""Packing token ids into windows by the sum of squares.

Documents are placed as they come. A document of a window or more is cut: its full windows stand alone,
what is left over is placed whole. Of the windows that are open only the number at each fill level is
looked at: a document goes to the level (or a new window) that makes the sum of the squares of these
numbers smallest. Where many windows wait at one level, that draws documents to it; so no level piles up
and, for most distributions of lengths, only few windows are open at any time.

Each task packs the documents it reads, without a shuffle. What is open at its end (or beyond
`most_open` windows) is closed without padding: windows that are filled to a power of two as they are,
the others' documents one after another, cut into full windows and the powers of two of the remainder."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import in_slices
from postmill.llm.tokens import codec, texts_of

WINDOW = 2048
#: Open windows of a task; beyond this they are closed as at its end, which drops and pads nothing.
MOST_OPEN = 8192
#: Windows of one task get numbers from (task << TASK_BITS) on.
TASK_BITS = 40


@dataclass
class Piece:
    """Ids of one document, from the `start`-th of its `total` on."""

    doc: int | None
    start: int
    total: int
    ids: np.ndarray

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return (Piece(self.doc, self.start, self.total, self.ids[:at]),
                Piece(self.doc, self.start + at, self.total, self.ids[at:]))


@dataclass
class Packer:
    """Windows of `size` ids; `closed` takes those that are done."""

    size: int = WINDOW
    most_open: int = MOST_OPEN
    closed: list[list[Piece]] = field(default_factory=list)

    def __post_init__(self):
        self.levels = np.zeros(self.size + 1, np.int64)  # windows open at each fill
        self.open: dict[int, list[list[Piece]]] = {}
        self.n_open = 0

    def level(self, length: int) -> int:
        """The fill of the window that a document of `length` < size goes to; 0 is a new one.

        From level h to h + length the sum of squares grows by 2 (n[h + length] - n[h]) + 2; a full
        window, and one not begun, are not counted. Of equal levels the fullest is taken."""
        n, last = self.levels, self.size - length
        grows = 2 * (n[length : self.size + 1] - n[: last + 1]) + 2  # from each level 0 to last
        grows[last] = 1 - 2 * n[last]  # fills the window
        grows[0] = 2 * n[length] + 1
        grows[1:][n[1 : last + 1] == 0] = np.iinfo(np.int64).max
        return int(last - np.argmin(grows[::-1]))

    def add(self, piece: Piece) -> None:
        while len(piece.ids) >= self.size:
            full, piece = piece.cut(self.size)
            self.closed.append([full])
        length = len(piece.ids)
        if not length:
            return
        at = self.level(length)
        if at:
            window = self.open[at].pop()
            self.levels[at] -= 1
            self.n_open -= 1
        else:
            window = []
        window.append(piece)
        if at + length == self.size:
            self.closed.append(window)
        else:
            self.open.setdefault(at + length, []).append(window)
            self.levels[at + length] += 1
            self.n_open += 1
            if self.n_open > self.most_open:
                self.finish()

    def finish(self) -> None:
        """Close all windows, without padding."""
        rest: list[Piece] = []
        for fill in sorted(self.open, reverse=True):
            for window in self.open[fill]:
                if fill & (fill - 1) == 0:
                    self.closed.append(window)
                else:
                    rest += window
        self.open, self.n_open = {}, 0
        self.levels[:] = 0
        left = sum(len(p.ids) for p in rest)
        rest.reverse()
        while rest:
            # a full window, or the largest power of two that what is left can fill
            room = self.size if left >= self.size else 1 << (left.bit_length() - 1)
            left -= room
            window: list[Piece] = []
            while room:
                piece = rest.pop()
                if len(piece.ids) > room:
                    piece, later = piece.cut(room)
                    rest.append(later)
                window.append(piece)
                room -= len(piece.ids)
            self.closed.append(window)


def packed(
    docs: DataFrame, path: str, end_id: int, size: int = WINDOW, pattern: str | None = None,
    most_open: int = MOST_OPEN,
) -> DataFrame:
    """doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset: a row for each piece.

    Every row's `text` is encoded (null and empty: no ids) and ended with `end_id`; each id lies in just
    one piece. `start` counts the document's ids before the piece, `offset` the window's; a window's
    pieces follow each other without a gap from 0 and hold at most `size` ids. Windows that are not
    full hold a power of two, if `size` is one. Rows with equal or null doc_id are documents of their
    own. Which documents share a window depends on how the table is dealt to tasks. An empty table
    gives no rows; other columns are not read."""
    schema = ("doc_id bigint, start bigint, length bigint, ids array<int>, ids_crc32 bigint, doc_tokens bigint, "
              "sequence_id bigint, offset bigint")
    if size < 1:
        raise ValueError("a window holds one id at least")

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, packer = codec(path, pattern), Packer(size, most_open)
        number = TaskContext.get().partitionId() << TASK_BITS
        ending = np.array([end_id], "<u4")
        for piece in in_slices(batches):
            encoded = held.encode(texts_of(piece.column("text")))
            for doc, ids in zip(piece.column("doc_id").to_pylist(), encoded, strict=True):
                packer.add(Piece(doc, 0, len(ids) + 1, np.concatenate((ids, ending))))
            if packer.closed:
                yield _rows(packer.closed, number)
                number += len(packer.closed)
                packer.closed.clear()
        packer.finish()
        if packer.closed:
            yield _rows(packer.closed, number)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(job, schema)


def _rows(windows: list[list[Piece]], first: int) -> pa.RecordBatch:
    pieces = [p for w in windows for p in w]
    lengths = np.fromiter((len(p.ids) for p in pieces), np.int64, len(pieces))
    of = np.repeat(np.arange(len(windows)), [len(w) for w in windows])
    before = np.cumsum(lengths) - lengths
    heads = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    ends = np.append(0, np.cumsum(lengths)).astype(np.int32)
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array([p.doc for p in pieces], pa.int64()),
        "start": pa.array([p.start for p in pieces], pa.int64()), "length": pa.array(lengths),
        "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([p.ids for p in pieces]).view("<i4"))),
        "ids_crc32": pa.array([zlib.crc32(p.ids.tobytes()) for p in pieces], pa.int64()),
        "doc_tokens": pa.array([p.total for p in pieces], pa.int64()),
        "sequence_id": pa.array(first + of), "offset": pa.array(before - before[heads][of]),
    })
