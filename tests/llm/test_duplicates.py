"""SimHash groups and repeated passages against plain versions."""

from __future__ import annotations

import random
import re
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from postmill.llm import graph, simhash, substrings
from postmill.llm.queries import ORACLES, QUERIES
from tests.llm import cases

WORD = r"[^\x20\x09-\x0D]+"


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(WORD, low)
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_groups_of_awkward_rows(spark):
    data = cases.awkward()
    docs = cases.clashing(spark, cases.documents(spark), ["fp", "component_id", "root"])
    found = Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in cases.rows(simhash.near_duplicates(docs)))
    fps = [plain_fingerprint(t) for _, t, *_ in data]
    groups = plain_groups(fps)
    least = {g: min((d[0] for d, h in zip(data, groups, strict=True) if h == g and d[0] is not None), default=None) for g in groups}
    assert found == Counter((d[0], f, least[g]) for d, f, g in zip(data, fps, groups, strict=True))
    kept = simhash.first_of_groups(docs)
    assert kept.columns == docs.columns
    fp_of = lambda t: groups[fps.index(plain_fingerprint(t))]
    assert {(r["doc_id"], fp_of(r["text"])) for r in cases.rows(kept)} == {(i, g) for g, i in least.items()}
    empty = cases.documents(spark, [])
    assert simhash.near_duplicates(empty).collect() == [] and simhash.first_of_groups(empty).collect() == []


def test_the_pipeline_keeps_one_of_each_group(spark):
    """Its stage on a whole small table, with a chain of near copies and odd columns, by brute force."""
    data = [tuple(r) for r in spark.read.parquet(f"{cases.SF}/documents.parquet").select(
        "doc_id", "text", "lang", "source", "n_chars").collect()]
    long = [f"w{i}" for i in range(400)]
    for k in range(6):
        data.append((10_000 + k, " ".join([f"n{k}", *long[:-1]]), "en", "s", 0))
    docs = cases.clashing(spark, cases.documents(spark, data), ["th", "h", "__th", "first", "fp", "id"])
    kept = corpus_pipeline.one_of_each(spark, docs, cases.SF)
    groups = plain_groups([plain_fingerprint(d[1]) for d in data])
    least = {g: min(d[0] for d, h in zip(data, groups, strict=True) if h == g) for g in groups}
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["th"], r["__th"]) for r in cases.rows(kept)) == sorted((i, "own", "own") for i in least.values())


def test_whole_table_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    fps = [plain_fingerprint(r.text) for r in docs]
    groups = plain_groups(fps)
    least = {}
    for r, g in zip(docs, groups, strict=True):
        least[g] = min(least.get(g, r.doc_id), r.doc_id)
    made = QUERIES["op9_simhash_trie"](spark, "/root/testdata/sf0.01").collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in made} == {
        (r.doc_id, f"{f:016x}", least[g]) for r, f, g in zip(docs, fps, groups, strict=True)
    }


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(0, (1 << 64) - 1), max_size=60), st.integers(0, 5), st.integers(0, 2**30))
def test_trie_finds_all_pairs(values, budget, seed):
    r = random.Random(seed)
    near = {v ^ sum(1 << r.randrange(64) for _ in range(r.randrange(4))) & ((1 << 64) - 1) for v in values}
    every = np.array(sorted(values | near), np.uint64)
    groups = np.array([r.randrange(3) for _ in every], np.int64)
    order = np.lexsort((every, groups))
    every, groups = every[order], groups[order]
    found = {frozenset(p) for i, j in simhash.trie_links(every, groups, budget) for p in zip(i.tolist(), j.tolist(), strict=True)}
    assert found == {
        frozenset((i, j)) for i in range(len(every)) for j in range(i)
        if groups[i] == groups[j] and (int(every[i]) ^ int(every[j])).bit_count() <= budget
    }


def test_large_nodes_are_split_and_lose_no_link(spark):
    r = random.Random(8)
    base = r.getrandbits(64)
    values = {base ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(150)}
    values |= {r.getrandbits(64) for _ in range(40)}
    values = sorted(values)
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp bigint")
    links = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.links(frame, 2, node_rows=8).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in links)
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in links:
        root[find(a)] = find(b)
    groups = plain_groups(values)
    assert len({find(v) for v in values}) == len(set(groups))


@pytest.mark.parametrize("links", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)] + [(70, 71)]])
def test_components(spark, links):
    made = dict(map(tuple, graph.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()))
    root = {}
    for a, b in links:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in links:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert made == {n: x for n, x in root.items() if a_links(links, n)}


def a_links(links, node):
    return any(node in pair and pair[0] != pair[1] for pair in links)


# --- passages --------------------------------------------------------------------------------------

def plain_removal(data, window):
    """By rows, the removed places; rows equal in doc_id and text are one document."""
    seen = {}
    place = lambda d, s: (d[0] is None, d[0] or 0, s)
    for d in set((i, t) for i, t, *_ in data):
        w = re.findall(WORD, d[1] or "")
        for s in range(len(w) - window + 1):
            seen.setdefault(tuple(w[s : s + window]), []).append((place(d, s), d))
    out = []
    for i, t, *_ in data:
        w, gone = re.findall(WORD, t or ""), set()
        for s in range(len(w) - window + 1):
            if min(seen[tuple(w[s : s + window])])[0] < place((i, t), s):
                gone |= set(range(s, s + window))
        out.append((i, len(w), len(gone), sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return Counter(out)


def digests(df):
    return Counter(map(tuple, df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()))


def test_removal_of_awkward_rows(spark):
    data = [d for d in cases.awkward() if d[0] is not None or d[1] is None]
    docs = cases.clashing(spark, cases.documents(spark, data), ["spans", "seeds", "th", "key"])
    assert digests(substrings.removal_digests(docs)) == plain_removal(data, 20)
    whole = cases.documents(spark)
    cut = substrings.without_repeats(whole)
    assert cut.columns == whole.columns
    by = {(r["doc_id"], r["n_words"], r["kept_sha256"]) for r in cases.rows(substrings.removal_digests(whole))}
    for r in cases.rows(cut):
        digest = sha256(" ".join(re.findall(WORD, r["text"] or "")).encode()).hexdigest()
        assert any((r["doc_id"], digest) == (i, d) for i, _, d in by)
        assert r["text"] is None or r["n_chars"] == len(r["text"])
    empty = cases.documents(spark, [])
    assert substrings.removal_digests(empty).collect() == [] and substrings.without_repeats(empty).collect() == []


@pytest.mark.parametrize("seed, letters, window, anchor", [(1, "ab", 6, 3), (2, "abc", 5, 2), (3, "abcdefgh", 4, 4), (4, "a", 5, 2)])
def test_removal_of_random_texts(spark, seed, letters, window, anchor):
    r = random.Random(seed)
    data = [(k, " ".join(r.choice(letters) for _ in range(r.randrange(60))), "en", "s", 0) for k in range(40)]
    made = substrings.removal_digests(cases.documents(spark, data), window, anchor)
    assert digests(made) == plain_removal(data, window)


def test_removal_agrees_with_sql(spark):
    table = [r.asDict() for r in spark.read.parquet(f"{cases.SF}/documents.parquet").select("doc_id", "text").collect()]
    assert cases.spark_rows(QUERIES["op8_seed_and_extend"](spark, cases.SF)) == cases.sql_rows(
        ORACLES["op8_seed_and_extend"], documents=table
    )


def test_spans_of_repeated_rows_are_listed_once(spark):
    passage = " ".join(f"w{k}" for k in range(30))
    data = [(1, passage, "en", "s", 0)] + [(2, f"x {passage}", "en", "s", 0), (None, passage, "en", "s", 0)] * 20
    made = cases.rows(substrings.repeats(cases.documents(spark, data)))
    assert len(made) == 2
    for r in made:
        assert len(r["spans"]) == len(set(map(tuple, r["spans"])))
