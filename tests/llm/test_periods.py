"""Periodic runs against a plain search of every period, and the planted query on whole small tables."""

from __future__ import annotations

import random
import zlib
from hashlib import sha256

import numpy as np
import pytest

from postmill.llm import periods, queries
from tests.llm import cases


def plain_runs(w, least_words=6, least_exponent=4):
    """By each period in turn: stretches on which words that far apart are equal."""
    found, n = [], len(w)
    for q in range(1, n // least_exponent + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i + q - start
            if length >= max(least_words, least_exponent * q) and not any(
                w[start : i + q - r] == w[start + r : i + q] for r in range(1, q)
            ):
                found.append((start, length, q))
    return sorted(found)


def plain_row(doc_id, text):
    w = text.encode().split() if text else []
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    again = {i for s, e, q in found for i in range(s + q, s + e)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return {
        "doc_id": doc_id, "n_runs": len(found), "start": best and best[0], "length": best and best[1],
        "period": best and best[2], "exponent_milli": best and 1000 * best[1] // best[2],
        "runs_sha256": sha256("".join(f"{s},{e},{q}\n" for s, e, q in found).encode()).hexdigest(),
        "collapsed_sha256": sha256(b" ".join(x for i, x in enumerate(w) if i not in again)).hexdigest(),
    }


@pytest.mark.parametrize("least_words, least_exponent", [(6, 4), (2, 2), (4, 3)])
def test_random_words_of_few_kinds(least_words, least_exponent):
    r = random.Random(least_words)
    for _ in range(600):
        docs = []
        for _ in range(r.randrange(1, 4)):
            w = [r.randrange(r.choice([1, 2, 3])) for _ in range(r.randrange(40))]
            if w and r.random() < 0.5:
                a = r.randrange(len(w))
                p = r.randrange(1, len(w) - a + 1)
                w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
            docs.append(w)
        ids, doc = np.array(sum(docs, []), np.int64), np.repeat(np.arange(len(docs)), list(map(len, docs)))
        got = periods.runs_of(ids, doc, least_words, least_exponent).tolist()
        first = np.cumsum([0, *map(len, docs)])
        assert [(d, s - first[d], e, q) for d, s, e, q in got] == [
            (d, *run) for d, w in enumerate(docs) for run in plain_runs(w, least_words, least_exponent)
        ]


def test_long_texts_of_one_word_and_of_two():
    for kinds in (1, 2):
        ids = np.arange(200_000) % kinds
        assert periods.runs_of(ids, np.zeros(len(ids), np.int64)).tolist() == [[0, 0, 200_000, kinds]]


def test_ordered_sets_hold_any_order():
    r = random.Random(4)
    values = r.sample(range(100_000), 5000)
    held = periods.Positions(values[0])
    for k, x in enumerate(values[1:], 1):
        if k % 50 == 0:
            below, above = [v for v in values[:k] if v < x], [v for v in values[:k] if v > x]
            assert held.around(x) == (max(below, default=None), min(above, default=None))
        held.add(x)
    assert [x for b in held.blocks for x in b] == sorted(values) and held.size == 5000
    assert held.lows == [b[0] for b in held.blocks] and max(map(len, held.blocks)) <= periods.BLOCK


def test_whole_table(spark):
    docs = queries.load(spark, cases.SF, "documents")
    got = {x["doc_id"]: x for x in cases.rows(queries.op11_periodic_runs(spark, cases.SF))}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert got == {i: plain_row(i, t) for i, t in texts.items()}
    assert any(x["n_runs"] for x in got.values())


def test_awkward_rows(spark, monkeypatch):
    data = [(i, t) for i, t, *_ in cases.awkward() if len(t or "") < 3000]
    # ids whose text is changed by the query, among them an empty and a null one
    tens = [i for i in range(1000, 1400) if zlib.crc32(str(i).encode()) % 10 == 0][:12]
    data += list(zip(tens, [None, "", "one", "a b", *(t for _, t in data if t and len(t) > 50)], strict=False))
    docs = cases.documents(spark, [(i, t, "en", "s", 0) for i, t in data])
    docs = cases.clashing(spark, docs, ["g", "w", "n", "a", "p", "runs", "start", "period"])
    monkeypatch.setattr(queries, "load", lambda *_: docs)
    made = cases.spark_rows(queries.op11_periodic_runs(spark, ""))
    names = sorted(plain_row(1, ""))
    assert made == sorted((tuple(plain_row(i, t)[n] for n in names) for i, t in data), key=repr)
    assert queries.with_planted_runs(docs.limit(0)).count() == 0
    assert periods.collapsed(docs.limit(0)).collect() == [] == periods.runs(docs.limit(0)).collect()


def test_runs_are_rows(spark):
    docs = cases.documents(spark, [(1, "x " + "a b " * 4 + "a a a a a a", "en", "s", 0), (None, None, "en", "s", 0)])
    assert sorted(map(tuple, periods.runs(docs).collect())) == [(1, 1, 9, 2), (1, 9, 6, 1)]
    assert cases.rows(periods.collapsed(docs).select("doc_id", "collapsed").filter("doc_id = 1")) == [
        {"doc_id": 1, "collapsed": "x a b"}  # the last a of the first run begins the second
    ]
