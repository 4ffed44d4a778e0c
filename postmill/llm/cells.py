"""Clusters around centroids, with a vector-approximation file in front of the vectors.

Of each vector the file has one cell of few bits a dimension. For given centroids, tables by dimension
and cell bound what the dimension adds to a distance, so looking up the cells gives an interval of the
distance to each centroid. A centroid whose interval lies beyond another's end cannot be the nearest.
Among those that are left, intervals of the *difference* to the one that looks nearest decide more:
the vector's own square, which is most of an interval's width, is the same on both sides. Full
vectors are fetched, by a join on their row's key, only where more than one centroid is left, or where
a vector has left its cluster, whose sums it is taken out of. So a round reads narrow rows, moves few
vectors, and changes sums by what moved; only building the file and the last distances read all vectors."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import free, in_slices, settle

#: Components are multiplied by this and rounded down, so that all arithmetic is exact.
SCALE = 1024
#: Bits of a cell.
BITS = 6
#: Vectors that cell bounds are drawn from; the outer bounds are those of all vectors.
SAMPLE_ROWS = 20_000
#: Components beyond this, after scaling, have squared distances that no long holds.
LARGEST = 1 << 27
ROWS = 4096
_STATE = "key bigint, cells binary, cluster int, n bigint, sums array<bigint>"


def kept(table: DataFrame, components: int, scale: int = SCALE) -> DataFrame:
    """key, vec_id, v (array<int>): the vectors that take part, in whole numbers. The key is the row's own."""
    x = F.col("embedding")
    usable = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) * scale <= LARGEST))
    rows = table.filter(x.isNotNull() & (F.size(x) == components) & usable)
    return rows.select(
        F.monotonically_increasing_id().alias("key"), F.col("vec_id").cast("bigint").alias("vec_id"),
        F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("int")).alias("v"),
    )


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


class Cells:
    """Bounds of the cells of every dimension, and what they say about distances."""

    def __init__(self, sample: np.ndarray, least: list[int], most: list[int], bits: int):
        self.bits, self.width = bits, sample.shape[1]
        shares = np.linspace(0, 1, (1 << bits) + 1)
        edges = np.quantile(sample, shares, axis=0, method="lower").astype(np.int64).T
        edges[:, 0], edges[:, -1] = least, np.array(most, np.int64) + 1
        self.edges = np.maximum.accumulate(edges, axis=1)
        self.low, self.high = self.edges[:, :-1], self.edges[:, 1:] - 1  # of each cell, both included

    def pack(self, rows: np.ndarray) -> list[bytes]:
        at = np.stack([np.searchsorted(e[:-1], rows[:, d], side="right") - 1 for d, e in enumerate(self.edges)], axis=1)
        bits = np.unpackbits(at.astype(np.uint8)[:, :, None], axis=2)[:, :, 8 - self.bits :]
        return [r.tobytes() for r in np.packbits(bits.reshape(len(rows), -1), axis=1)]

    def unpack(self, packed: list[bytes]) -> np.ndarray:
        raw = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1)
        bits = np.unpackbits(raw, axis=1)[:, : self.width * self.bits].reshape(len(packed), self.width, self.bits)
        return np.packbits(bits, axis=2)[:, :, 0].astype(np.int64) >> (8 - self.bits)

    def possible(self, cells: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        """Of each vector and centroid: may it be the nearest (or as near as that), by the cells alone?"""
        by, left = np.arange(self.width), self.low[None] - centroids[:, :, None]
        right = self.high[None] - centroids[:, :, None]
        far = np.maximum(left**2, right**2)
        near = np.where((left <= 0) & (right >= 0), 0, np.minimum(left**2, right**2))
        least = np.stack([t[by, cells].sum(axis=1) for t in near], axis=1)
        most = np.stack([t[by, cells].sum(axis=1) for t in far], axis=1)
        open_ = least <= most.min(axis=1)[:, None]
        lead = (least + most).argmin(axis=1)
        squares = (centroids**2).sum(axis=1)
        undecided = open_.sum(axis=1) > 1
        for b in np.unique(lead[undecided]):
            mine = np.flatnonzero(undecided & (lead == b))
            for k in range(len(centroids)):
                if k == b:
                    continue
                # the least of |v - c_k|^2 - |v - c_b|^2, which is linear in v
                slope = 2 * (centroids[b] - centroids[k])[:, None]
                table = np.minimum(slope * self.low, slope * self.high)
                open_[mine, k] &= table[by, cells[mine]].sum(axis=1) + squares[k] - squares[b] <= 0
        return open_


def _nearest(rows: np.ndarray, centroids: np.ndarray, allowed: np.ndarray | None = None) -> np.ndarray:
    """The number of the nearest centroid, exactly; of equally near ones the smallest."""
    apart = np.stack([((rows - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    if allowed is not None:
        apart = np.where(allowed, apart, np.iinfo(np.int64).max)
    return apart.argmin(axis=1)


def _batch(keys, cells, cluster: np.ndarray, was: np.ndarray, rows: np.ndarray, k: int) -> pa.RecordBatch:
    """Rows of the file with their clusters; then, without a key, what each cluster gains or loses."""
    n, sums = np.zeros(k, np.int64), np.zeros((k, rows.shape[1]), np.int64)
    moved = cluster != was
    for who, sign in ((cluster, 1), (was, -1)):
        use = moved & (who >= 0)
        np.add.at(n, who[use], sign)
        np.add.at(sums, who[use], sign * rows[use])
    some = np.flatnonzero(n.astype(bool) | sums.any(axis=1))
    empty, size = [None] * len(some), len(cluster)
    return pa.RecordBatch.from_pydict({
        "key": pa.array([*keys, *empty], pa.int64()), "cells": pa.array([*cells, *empty], pa.binary()),
        "cluster": pa.array(np.append(cluster, some), pa.int32()),
        "n": pa.array([None] * size + n[some].tolist(), pa.int64()),
        "sums": pa.array([None] * size + sums[some].tolist(), pa.list_(pa.int64())),
    })


def clusters(
    table: DataFrame, k: int = 8, rounds: int = 10, components: int = 64, seed: str = "3:", bits: int = BITS,
) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256: a row for each
    vector that takes part.

    Those have just `components` components, none null or not finite, each turned into
    floor(SCALE * x). Centroids start as the k vectors whose `seed` followed by the vec_id has the
    smallest SHA-256; `rounds` times each vector goes to the nearest one (ties: the smaller number)
    and each centroid with vectors becomes their mean, rounded down; then vectors are assigned once
    more. All sums and distances are whole numbers.

    Repeated rows take part each; of one vec_id the smaller vector starts first, null ids start last.
    Fewer than k vectors give fewer centroids, an empty table no rows. Vectors with a scaled component
    beyond LARGEST in size, whose distances no long holds, take no part. Other columns are not read."""
    spark = table.sparkSession
    vectors = settle(kept(table, components))
    first = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    starts = vectors.orderBy(first.asc_nulls_last(), "vec_id", "v").limit(k).select("v").collect()
    schema = ("vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, "
              "centroid_sha256 string")
    if not starts:
        return spark.createDataFrame([], schema)
    centroids = np.array([r.v for r in starts], np.int64)
    grid, k = _grid(vectors, components, bits), len(starts)
    state = settle(_built(vectors, grid, centroids))
    sums, counts = [[0] * components for _ in range(k)], [0] * k
    for last in [False] * (rounds - 1) + [True] if rounds else []:
        _moved(state, sums, counts)
        centroids = np.array([
            [s // counts[j] for s in sums[j]] if counts[j] else centroids[j].tolist() for j in range(k)
        ], np.int64)
        looked = settle(_looked(state.filter("key is not null"), grid, centroids))
        fetched = settle(_fetched(looked, vectors, centroids))
        free(state)
        same = looked.filter("sure = cluster").select("key", "cells", "cluster", F.lit(None).cast("bigint").alias("n"),
                                                      F.lit(None).cast("array<bigint>").alias("sums"))
        state = same.unionByName(fetched)
    return _result(state, vectors, centroids)


def _grid(vectors: DataFrame, components: int, bits: int) -> Cells:
    at = [F.col("v")[d] for d in range(components)]
    ends = vectors.agg(*map(F.min, at), *map(F.max, at)).first()
    sample = vectors.orderBy(F.xxhash64("key")).limit(SAMPLE_ROWS).select("v").toArrow().column(0)
    return Cells(_matrix(sample.combine_chunks(), components), list(ends[:components]), list(ends[components:]), bits)


def _built(vectors: DataFrame, grid: Cells, centroids: np.ndarray) -> DataFrame:
    """The file, with each vector at its first centroid: all vectors are at hand, so nothing is looked up."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in in_slices(batches, ROWS):
            rows = _matrix(piece.column("v"), grid.width)
            cluster = _nearest(rows, centroids)
            yield _batch(piece.column("key").to_pylist(), grid.pack(rows), cluster, np.full(len(rows), -1), rows, len(centroids))

    return vectors.select("key", "v").mapInArrow(job, _STATE)


def _moved(state: DataFrame, sums: list[list[int]], counts: list[int]) -> None:
    """Add what clusters gained and lost: a row for each of them comes to the driver."""
    per = [F.sum(F.col("sums")[d]) for d in range(len(sums[0]))]
    for r in state.filter("key is null").groupBy("cluster").agg(F.sum("n"), *per).collect():
        counts[r[0]] += r[1]
        sums[r[0]] = [a + b for a, b in zip(sums[r[0]], r[2:], strict=True)]


def _looked(state: DataFrame, grid: Cells, centroids: np.ndarray) -> DataFrame:
    """key, cells, cluster, sure (null if several centroids may be nearest), open (these, else null)."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in in_slices(batches, ROWS):
            may = grid.possible(grid.unpack(piece.column("cells").to_pylist()), centroids)
            one = may.sum(axis=1) == 1
            open_ = [None if o else np.flatnonzero(m).tolist() for o, m in zip(one.tolist(), may, strict=True)]
            yield pa.RecordBatch.from_pydict({
                "key": piece.column("key"), "cells": piece.column("cells"), "cluster": piece.column("cluster"),
                "sure": pa.array(may.argmax(axis=1), pa.int32(), mask=~one),
                "open": pa.array(open_, pa.list_(pa.int32())),
            })

    schema = "key bigint, cells binary, cluster int, sure int, open array<int>"
    return state.select("key", "cells", "cluster").mapInArrow(job, schema)


def _fetched(looked: DataFrame, vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Rows of the file whose vector was needed, with the cluster it is in now, and what that moved."""
    width = centroids.shape[1]

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in in_slices(batches, ROWS):
            rows = _matrix(piece.column("v"), width)
            may = np.zeros((len(rows), len(centroids)), bool)
            for i, (sure, open_) in enumerate(zip(piece.column("sure").to_pylist(), piece.column("open").to_pylist(), strict=True)):
                may[i, [sure] if open_ is None else open_] = True
            was = piece.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64)
            yield _batch(
                piece.column("key").to_pylist(), piece.column("cells").to_pylist(),
                _nearest(rows, centroids, may), was, rows, len(centroids),
            )

    needed = looked.filter("sure is null or sure <> cluster")
    return needed.join(vectors.select("key", "v"), "key").mapInArrow(job, _STATE)


def _result(state: DataFrame, vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    width = centroids.shape[1]

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in in_slices(batches, ROWS):
            cluster = piece.column("cluster").to_numpy(zero_copy_only=False)
            apart = ((_matrix(piece.column("v"), width) - centroids[cluster]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_pydict({
                "vec_id": piece.column("vec_id"), "cluster": piece.column("cluster"), "distance": pa.array(apart),
            })

    held = state.filter("key is not null").select("key", "cluster").join(vectors, "key")
    placed = settle(held.select("vec_id", "cluster", "v").mapInArrow(job, "vec_id bigint, cluster int, distance bigint"))
    inertia = {r.cluster: int(r.s) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    shown = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def of(values: list) -> Column:  # a value for each centroid
        return F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)

    return placed.select(
        "vec_id", "cluster", "distance",
        of([inertia.get(j, 0) for j in range(len(centroids))]).cast("bigint").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("bigint").alias("inertia"), of(shown).alias("centroid_sha256"),
    )
