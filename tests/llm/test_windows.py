"""Packing: every id in one piece, windows without gaps, padding and open windows; the level rule by brute force."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as public
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from postmill.llm import queries, windows
from tests.llm import cases

PATH = public.path("byte_bpe_50k.json")


def plain_level(levels, length, size):
    """Try each level: the least sum of squares of the windows then open, the fullest of equal ones."""
    best = None
    for h in range(size - length + 1):
        if h and not levels[h]:
            continue
        after = Counter(levels)
        if h:
            after[h] -= 1
        if h + length < size:
            after[h + length] += 1
        total = sum(n * n for n in after.values())
        if best is None or total <= best[0]:
            best = (total, h)
    return best[1]


@pytest.mark.parametrize("size", [1, 2, 16, 37])
def test_levels_by_brute_force(size):
    r = random.Random(size)
    packer, levels = windows.Packer(size), Counter()
    for k in range(1500):
        length = r.choice([r.randrange(1, size + 1), max(1, size // 3), 1])
        if length < size:
            h = plain_level(levels, length, size)
            assert packer.level(length) == h
            if h:
                levels[h] -= 1
            if h + length < size:
                levels[h + length] += 1
        packer.add(windows.Piece(k, 0, length, np.zeros(length, np.uint32)))
        assert {h: n for h, n in enumerate(packer.levels.tolist()) if n} == {h: n for h, n in levels.items() if n}
        assert packer.n_open == sum(levels.values())


@pytest.mark.parametrize("most_open", [3, 8192])
def test_finish_pads_nothing_and_loses_nothing(most_open):
    r = random.Random(most_open)
    packer, total = windows.Packer(64, most_open), 0
    for k in range(700):
        n = r.choice([1, 40, 45, r.randrange(1, 300)])
        packer.add(windows.Piece(k, 0, n, np.arange(n, dtype=np.uint32)))
        assert packer.n_open <= most_open
        total += n
    packer.finish()
    fills = [sum(len(p.ids) for p in w) for w in packer.closed]
    assert sum(fills) == total and all(f & (f - 1) == 0 and f <= 64 for f in fills)
    seen = defaultdict(list)
    for p in (p for w in packer.closed for p in w):
        seen[p.doc] += p.ids.tolist()
        assert p.ids[0] == p.start and len(p.ids)
    assert all(sorted(ids) == list(range(len(ids))) for ids in seen.values())


def check(pieces, expected, size):
    """pieces: dicts of the query; expected: ids of every row, with the end id, and its doc_id."""
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append(p)
    for mine in sequences.values():
        at = 0
        for p in sorted(mine, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= size and (at & (at - 1) == 0)
    parts = Counter((p["doc_id"], p["doc_tokens"], p["start"], p["length"], p["ids_crc32"]) for p in pieces)
    starts = defaultdict(set)
    for p in pieces:
        starts[p["doc_id"], p["doc_tokens"]] |= {p["start"], p["start"] + p["length"]}
    assert sum(p["length"] for p in pieces) == sum(len(ids) for _, ids in expected)
    whole = Counter((i, tuple(ids)) for i, ids in expected)
    if len({i for i, _ in expected}) == len(expected):  # with ids of their own, pieces are known to be theirs
        for (i, ids), _ in whole.items():
            cuts = sorted(starts[i, len(ids)])
            assert cuts[0] == 0 and cuts[-1] == len(ids)
            for s, e in zip(cuts, cuts[1:], strict=False):
                crc = zlib.crc32(np.array(ids[s:e], "<u4").tobytes())
                assert parts[i, len(ids), s, e - s, crc] == 1


def test_whole_table(spark):
    docs = queries.load(spark, cases.SF, "documents")
    pieces = cases.rows(queries.op13_window_packing(spark, cases.SF))
    plain = Tokenizer.from_file(PATH)
    expected = [(r.doc_id, [*plain.encode(r.text or "", add_special_tokens=False).ids, 1]) for r in docs.collect()]
    check(pieces, expected, 2048)


def test_awkward_rows(spark):
    data = cases.awkward()
    docs = cases.clashing(spark, cases.documents(spark, data), ["start", "ids", "length", "offset"])
    plain = Tokenizer.from_file(PATH)
    ids = lambda t: [*plain.encode(t or "", add_special_tokens=False).ids, 1]
    for size in (8, 2048):
        pieces = cases.rows(windows.packed(docs, PATH, 1, size))
        check(pieces, [(i, ids(t)) for i, t, *_ in data], size)
        assert all(zlib.crc32(np.array(p["ids"], "<u4").tobytes()) == p["ids_crc32"] for p in pieces)
        assert Counter(x for p in pieces for x in p["ids"]) == Counter(x for _, t, *_ in data for x in ids(t))
    own = docs.filter("doc_id not in (3, 5)").select(F.col("doc_id"), "text")
    check(cases.rows(windows.packed(own, PATH, 1, 32)), [(i, ids(t)) for i, t, *_ in data if i not in (None, 3, 5)], 32)
    assert windows.packed(docs.limit(0), PATH, 1).collect() == []


def test_few_windows_stay_open():
    """Of the lengths of the test texts, windows fewer than a tenth of the documents are open at any time."""
    r = random.Random(1)
    packer = windows.Packer()
    for k in range(20_000):
        n = min(2047, max(1, int(r.lognormvariate(6, 1))))
        packer.add(windows.Piece(k, 0, n, np.zeros(n, np.uint32)))
        packer.closed.clear()
    assert packer.n_open < 2_000
