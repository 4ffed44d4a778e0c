"""Approximate nearest neighbours with an inverted multi-index.

Vectors, scaled to length one, are quantised as two halves with a codebook each: a pair of
centroids is a cell. A query visits cells by the sum of its halves' distances to the centroids,
nearest first, from a heap, until it has seen a given share of the index; what lies in them is
reranked by the exact cosine of the original vectors."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.common import in_slices, settle

CENTROIDS = 64
#: Vectors that the codebooks are fitted on.
SAMPLE_ROWS = 20_000
#: Share of the index a query sees at least, and the vectors it sees at least.
SHARE = 0.5
LEAST_SEEN = 2000
#: Vectors or queries of one block of the exact comparison.
BLOCK = 512
#: Blocks of either side that meet in one group.
LANE_BLOCKS = 8


def _valid(table: DataFrame) -> DataFrame:
    """id, v: one row for each vec_id (its smallest vector, should it have several), of those that
    can be compared: not null, of finite components, not all zero, of the usual dimension."""
    v = F.col("v")
    usable = table.select(
        F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").cast("array<double>").alias("v")
    ).filter(
        F.col("id").isNotNull() & v.isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0)
    )
    size = usable.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return usable.filter(F.size("v") == (size.d if size else 0)).groupBy("id").agg(F.min("v").alias("v"))


def _kmeans(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(7)
    rows = np.unique(rows, axis=0)
    centres = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)]
    for _ in range(rounds):
        nearest = _apart(rows, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, rows)
        counts = np.bincount(nearest, minlength=len(centres))
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def _apart(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances."""
    return (rows**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1)[None] - 2 * rows @ centres.T


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1)[:, None]
    return rows / np.sqrt((rows**2).sum(axis=1))[:, None]


class Codebooks:
    """Centroids of both halves; `centroids` of each at most, whatever the size of the index."""

    def __init__(self, sample: np.ndarray, centroids: int):
        rows, half = _unit(sample), sample.shape[1] // 2
        self.half = half
        self.books = tuple(_kmeans(x, centroids) if x.shape[1] else np.zeros((1, 0)) for x in (rows[:, :half], rows[:, half:]))

    def distances(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = _unit(rows)
        return _apart(rows[:, : self.half], self.books[0]), _apart(rows[:, self.half :], self.books[1])


def visited(first: np.ndarray, second: np.ndarray, counts: np.ndarray, enough: int) -> list[tuple[int, int]]:
    """Cells (i, j) by first[i] + second[j], ascending, until they hold `enough` vectors.

    The heap holds the next cell of each row of the sorted table that has been reached."""
    rows, columns = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    a, b = first[rows].tolist(), second[columns].tolist()
    held = counts[np.ix_(rows, columns)].tolist()
    heap, out, seen = [(a[0] + b[0], 0, 0)], [], 0
    while heap and seen < enough:
        _, i, j = heapq.heappop(heap)
        if held[i][j]:
            out.append((i, j))
            seen += held[i][j]
        if j + 1 < len(b):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
    return [(int(rows[i]), int(columns[j])) for i, j in out]


def nearest(
    table: DataFrame, queries: DataFrame, k: int = 5, centroids: int = CENTROIDS,
    share: float = SHARE, least_seen: int = LEAST_SEEN,
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of `queries`, the `k` nearest of `table` found.

    Both have vec_id and embedding. Nearness is the cosine in double precision; ties go to the
    smaller vec_id; a row is no neighbour of its own id. Vectors that are null or zero, hold null,
    NaN or infinity, or are of another dimension than most, take no part on either side. If an id
    has several vectors, the smallest stands for it. Fewer candidates than k give fewer rows; empty
    tables none. Of equal vectors only the k + 1 smallest ids can ever be among the k nearest, so no
    more are indexed; which leaves nothing out."""
    spark = table.sparkSession
    least = Window.partitionBy("v").orderBy("id")
    index = settle(
        _valid(table).withColumn("r", F.row_number().over(least)).filter(F.col("r") <= k + 1).drop("r")
    )
    sample = index.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("v").toArrow().column(0)
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not len(sample):
        return spark.createDataFrame([], schema)
    books = Codebooks(_matrix(sample.combine_chunks()), centroids)
    held = spark.sparkContext.broadcast(books)
    size = len(books.books[0]), len(books.books[1])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in in_slices(batches, 4096):
            a, b = held.value.distances(_matrix(piece.column("v")))
            yield pa.RecordBatch.from_pydict({
                "i": pa.array(a.argmin(axis=1), pa.int32()), "j": pa.array(b.argmin(axis=1), pa.int32()),
                "id": piece.column("id"), "v": piece.column("v"),
            })

    coded = settle(index.mapInArrow(cells, "i int, j int, id bigint, v array<double>"))
    counts = np.zeros(size, np.int64)  # one number a cell: bounded by the codebooks
    for r in coded.groupBy("i", "j").count().collect():
        counts[r.i, r.j] = r["count"]
    enough = max(least_seen, int(np.ceil(share * counts.sum())))
    counted = spark.sparkContext.broadcast(counts)

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of each query: for each first centroid whose cells it visits, which second ones, as bits
        for piece in in_slices(batches, 128):
            a, b = held.value.distances(_matrix(piece.column("v")))
            rows, firsts, masks = [], [], []
            for q in range(piece.num_rows):
                bits = np.zeros((size[0], size[1]), np.uint8)
                for i, j in visited(a[q], b[q], counted.value, enough):
                    bits[i, j] = 1
                for i in np.flatnonzero(bits.any(axis=1)):
                    rows.append(q)
                    firsts.append(i)
                    masks.append(np.packbits(bits[i]).tobytes())
            yield pa.RecordBatch.from_pydict({
                "i": pa.array(firsts, pa.int32()), "cells": pa.array(masks, pa.binary()),
                "query_id": piece.column("id").take(pa.array(rows, pa.int64())),
                "q": piece.column("v").take(pa.array(rows, pa.int64())),
            })

    # every block holds about BLOCK rows: a row's block is drawn by its id, from as many as the
    # rows under its first centroid need. LANE_BLOCKS blocks are a lane. Both sides are dealt to lanes,
    # and each is copied to all lanes of the other: a task's share is two lanes, however many
    # queries ask for one centroid
    per_i = counts.sum(axis=1)
    blocks = np.maximum(1, -(-per_i // BLOCK))
    lanes = np.maximum(1, -(-blocks // LANE_BLOCKS))
    at = lambda values: F.element_at(F.array(*[F.lit(int(x)) for x in values]), F.col("i") + 1)
    xs = coded.withColumn("block", F.pmod(F.xxhash64("id"), at(blocks))).groupBy("i", "block").agg(
        F.collect_list(F.struct("id", "j", "v")).alias("xs")
    ).withColumn("lane", F.pmod("block", at(lanes)))
    n_queries = queries.count()
    q_blocks = max(1, -(-n_queries // BLOCK))
    q_lanes = -(-q_blocks // LANE_BLOCKS)
    to_all = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1))
    xs = xs.withColumn("q_lane", to_all(F.lit(q_lanes)))
    asked = _valid(queries).mapInArrow(probes, "i int, cells binary, query_id bigint, q array<double>")
    qs = settle(asked).groupBy("i", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).alias("q_block")).agg(
        F.collect_list(F.struct("query_id", "cells", "q")).alias("qs")
    ).withColumn("q_lane", F.pmod("q_block", F.lit(q_lanes)).cast("bigint")).withColumn("lane", to_all(at(lanes)))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in in_slices(batches, 1):
            x, q = piece.column("xs").flatten(), piece.column("qs").flatten()
            xv, qv = _matrix(x.field("v")), _matrix(q.field("q"))
            xid, qid = (c.to_numpy(zero_copy_only=False) for c in (x.field("id"), q.field("query_id")))
            packed = np.frombuffer(b"".join(q.field("cells").to_pylist()), np.uint8).reshape(len(qid), -1)
            seen = np.unpackbits(packed, axis=1)[:, x.field("j").to_numpy(zero_copy_only=False)] > 0
            seen &= qid[:, None] != xid[None]
            score = np.where(seen, cosines(qv, xv), -np.inf)
            kth = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else np.full(len(qid), -np.inf)
            row, column = np.nonzero(seen & (score >= kth[:, None]))  # all that tie with the k-th
            yield pa.RecordBatch.from_pydict({
                "query_id": pa.array(qid[row]), "vec_id": pa.array(xid[column]),
                "score": pa.array(score[row, column]),
            })

    pairs = settle(xs).join(settle(qs), ["i", "lane", "q_lane"]).select("xs", "qs")
    found = pairs.mapInArrow(compared, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of every row of a with every row of b, in double precision. Rows are scaled by powers of two
    first, which changes no digit but keeps large and small components in range."""
    a, b = (x / 2.0 ** np.frexp(np.abs(x).max(axis=1))[1][:, None] for x in (a, b))
    return (a @ b.T) / (np.sqrt((a**2).sum(axis=1))[:, None] * np.sqrt((b**2).sum(axis=1))[None])
