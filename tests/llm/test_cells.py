"""Clusters with a vector-approximation file against plain rounds over whole vectors, and SQL."""

from __future__ import annotations

import math
import random
from hashlib import sha256

import numpy as np
import pytest

from postmill.llm import cells, queries
from postmill.session import settled_within
from tests import oracle
from tests.llm import cases

SCHEMA = "vec_id bigint, embedding array<float>, key bigint, v string"


def plain(rows, k, rounds, components):
    """vec_id, cluster, distance, ...: the same rules over all vectors, in Python's whole numbers."""
    use = [(i, [math.floor(1024 * np.float32(x).astype(float)) for x in e]) for i, e in rows
           if e is not None and len(e) == components and all(x is not None and math.isfinite(x) for x in e)
           and max(abs(x) for x in e) * 1024 <= cells.LARGEST]
    order = sorted(use, key=lambda r: (r[0] is None, sha256(f"3:{r[0]}".encode()).hexdigest(), r[0] or 0, r[1]))
    centroids = [v for _, v in order[:k]]
    apart = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min(range(len(centroids)), key=lambda j: (apart(v, centroids[j]), j))
    for _ in range(rounds):
        groups = {}
        for _, v in use:
            groups.setdefault(near(v), []).append(v)
        for j, group in groups.items():
            centroids[j] = [sum(x) // len(group) for x in zip(*group, strict=True)]
    placed = [(i, j, apart(v, centroids[j])) for i, v in use for j in [near(v)]]
    inertia = {}
    for _, j, d in placed:
        inertia[j] = inertia.get(j, 0) + d
    return [
        (i, j, d, inertia[j], sum(inertia.values()), sha256(",".join(map(str, centroids[j])).encode()).hexdigest())
        for i, j, d in placed
    ]


def made(spark, rows, k, rounds, components, bits=cells.BITS):
    table = spark.createDataFrame([(i, e, 1, "own") for i, e in rows], SCHEMA)
    with settled_within(spark):
        return sorted(map(tuple, cells.clusters(table, k, rounds, components, bits=bits).collect()), key=repr)


def test_agrees_with_sql(spark):
    got = oracle.spark_rows(queries.op12_centroid_clusters(spark, cases.SF))
    assert got == oracle.sql_rows(oracle.tables(cases.SF), queries.ORACLES["op12_centroid_clusters"])


@pytest.mark.parametrize("bits", [2, 6])
def test_awkward_vectors(spark, bits):
    r = random.Random(bits)
    rows = [(i, [r.gauss(0, 0.2), r.gauss(0, 3), 0.5]) for i in range(60)]
    rows += [(100 + i, [float(i % 2), -1.0, 0.0]) for i in range(9)]  # ties and copies
    rows += [(5, [0.25, 0.25, 0.25]), (5, [0.125, 0.0, 0.0]), (5, [0.125, 0.0, 0.0]), (None, [0.1, 0.2, 0.3]), (None, None)]
    rows += [(201, None), (202, []), (203, [1.0, 2.0]), (204, [1.0, None, 0.0]), (205, [float("nan"), 0.0, 0.0]),
             (206, [float("inf"), 0.0, 0.0]), (207, [0.0, 0.0, 0.0]), (208, [131072.0, -131072.0, 0.0]), (209, [3e38, 0.0, 0.0])]
    r.shuffle(rows)
    assert made(spark, rows, 4, 3, 3, bits) == sorted(plain(rows, 4, 3, 3), key=repr)


def test_few_vectors_and_none(spark):
    rows = [(1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [-0.5, 0.25])]
    assert made(spark, rows, 8, 2, 2) == sorted(plain(rows, 8, 2, 2), key=repr)  # two equal centroids: one stays empty
    assert made(spark, rows, 8, 0, 2) == sorted(plain(rows, 8, 0, 2), key=repr)
    assert made(spark, [(1, None)], 8, 2, 2) == [] == made(spark, [], 8, 2, 2)


@pytest.mark.parametrize("bits", [1, 3, 6, 8])
def test_cells_never_exclude_the_nearest_centroid(bits):
    rng = np.random.default_rng(bits)
    rows = rng.normal(0, 120, (400, 16)).astype(np.int64)
    rows[:50] = rows[0]
    grid = cells.Cells(rows[::3], rows.min(axis=0).tolist(), rows.max(axis=0).tolist(), bits)
    at = grid.unpack(grid.pack(rows))
    by = np.arange(16)
    assert ((grid.low[by, at] <= rows) & (rows <= grid.high[by, at])).all()
    for spread in (120, 30):
        centroids = rng.normal(0, spread, (8, 16)).astype(np.int64)
        centroids[7] = centroids[3]
        apart = ((rows[:, None] - centroids[None]) ** 2).sum(axis=2)
        may = grid.possible(at, centroids)
        assert may[apart == apart.min(axis=1)[:, None]].all()  # ties included
    if bits >= 6:
        assert may.sum(axis=1).mean() < 4


def test_only_needed_vectors_are_fetched(spark):
    """Of 64 components at 6 bits, most rows are settled by their cells, once clusters hold still."""
    rng = np.random.default_rng(1)
    middle = rng.normal(0, 0.3, (5, 64))
    rows = [(i, (middle[i % 5] + rng.normal(0, 0.05, 64)).tolist()) for i in range(1000)]
    vectors = cells.settle(cells.kept(spark.createDataFrame([(i, e, 1, "own") for i, e in rows], SCHEMA), 64))
    centroids = np.floor(middle * 1024).astype(np.int64)
    grid = cells._grid(vectors, 64, cells.BITS)
    state = cells.settle(cells._built(vectors, grid, centroids))
    looked = cells._looked(state.filter("key is not null"), grid, centroids)
    assert looked.count() == 1000 and cells._fetched(looked, vectors, centroids).count() < 50
