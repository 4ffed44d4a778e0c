"""Repetition, quality and licences against plain versions."""

from __future__ import annotations

import random
import re
import math
import time
import zlib

import zstandard
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from postmill.llm import licences, quality, repetition
from postmill.llm.queries import ORACLES, QUERIES
from tests.llm import cases

WORD = r"[^\x20\x09-\x0D]+"


def plain_repetition(text, shortest):
    w = re.findall(WORD, text or "")
    reach = [0] * len(w)
    for i in range(len(w)):
        for j in range(len(w)):
            n = 0
            while i != j and max(i, j) + n < len(w) and w[i + n] == w[j + n]:
                n += 1
            reach[i] = max(reach[i], n)
    covered = {k for i, n in enumerate(reach) if n >= shortest for k in range(i, i + n)}
    return len(w), len(covered), max([n for n in reach if n >= shortest], default=0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from("a b c aa".split()), max_size=40).map(" ".join)), max_size=6))
def test_spans_are_those_of_all_pairs(texts):
    made = repetition._measured(texts, 3)
    found = list(zip(made["n_words"], made["n_repeat_words"], made["longest_repeat"], strict=True))
    assert found == [plain_repetition(t, 3) for t in texts]


def test_rules_agree_with_sql_on_awkward_rows(spark):
    data = {i: (i, t, *x) for i, t, *x in cases.awkward() if i is not None}  # SQL needs distinct ids
    docs = cases.clashing(spark, cases.documents(spark, list(data.values())), ["kept", "n_words"])
    made = repetition.judged(docs).drop("longest_repeat")
    table = [dict(doc_id=r[0], text=r[1]) for r in data.values()]
    assert cases.spark_rows(made) == cases.sql_rows(ORACLES["op2_suffix_repetition"], documents=table)
    again = cases.rows(repetition.judged(cases.documents(spark)))
    assert len(again) == len(cases.awkward())
    assert all(not r["kept"] and r["base_failed"] for r in again if r["n_words"] < 20)
    assert repetition.judged(cases.documents(spark, [])).collect() == []


def test_a_long_repeat_is_rejected_though_it_covers_little(spark):
    r = random.Random(2)
    fresh = lambda n: [f"w{r.random()}" for _ in range(n)]
    repeat = fresh(70)
    text = " ".join(repeat + fresh(1000) + repeat)
    (row,) = cases.rows(repetition.judged(cases.documents(spark, [(1, text, "en", "s", 0)])))
    assert (row["longest_repeat"], row["base_failed"], row["kept"]) == (70, False, False)


# --- quality ---------------------------------------------------------------------------------------

def test_held_out_accuracy_and_awkward_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scorer = quality.fit(docs, labels)
    known = labels.filter("crc32(cast(doc_id as string)) % 4 = 2")
    both = quality.scores(docs.join(known, "doc_id", "left_semi"), scorer).join(known, "doc_id").collect()
    assert all(r.held_out and 0 <= r.score <= 1 for r in both)
    for label in (0, 1):
        of = [r for r in both if r.quality == label]
        assert sum(r.predicted == label for r in of) >= 0.93 * len(of)
    rows = cases.rows(quality.scores(cases.clashing(spark, cases.documents(spark), ["score", "quality"]), scorer))
    assert len(rows) == len(cases.awkward())
    for r in rows:
        held = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2
        assert r["held_out"] == held and r["predicted"] == (r["score"] >= 0.7)
    kept = quality.accepted(cases.documents(spark), scorer, 0.5)
    assert kept.columns == cases.documents(spark).columns
    assert kept.count() == sum(r["score"] >= 0.5 for r in rows)
    assert quality.scores(cases.documents(spark, []), scorer).collect() == []


def test_scores_by_the_plain_library_and_a_plain_fit(spark):
    """Sizes by zstandard itself under the scorer's dictionaries; the curve where its gradient is nought."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scorer = quality.fit(docs, labels, rows=60)
    plain = [zstandard.ZstdCompressor(level=quality.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False,
                                      dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
             for d in (scorer.good, scorer.bad)]

    def difference(text):
        good, bad = (len(c.compress(text.encode())) for c in plain)
        return (bad - good) / (len(text.encode()) + quality.STEADY_BYTES)

    logistic = lambda x: 1 / (1 + math.exp(-(scorer.offset + scorer.slope * x)))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in quality.scores(docs, scorer).collect():
        assert abs(r.score - logistic(difference(texts[r.doc_id]))) < 1e-9
    # the sample once more, by hand
    known = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    order = spark.createDataFrame([(i,) for i in known], "doc_id bigint").selectExpr("doc_id", "xxhash64(doc_id) h").collect()
    ids = [r.doc_id for r in sorted(order, key=lambda r: (r.h, r.doc_id))]
    used = {q: [i for i in ids if known[i] == q][:60] for q in (0, 1)}
    kept = {q: [texts[i] for i in used[q] if i in texts and 0 < len(texts[i]) <= quality.SAMPLE_CHARS] for q in used}
    longer = [i for q in used for i in used[q] if len(texts.get(i, "")) > quality.SAMPLE_CHARS]
    assert all(t[:200].encode() in scorer.good for t in kept[1][::2][:20]) or longer
    if not longer:
        share = sum(known.values()) / len(known)
        rest = [(q, difference(t)) for q in (0, 1) for t in kept[q][1::2]]
        good = sum(q for q, _ in rest) / len(rest)
        weight = {1: share / good, 0: (1 - share) / (1 - good)}
        slope = [sum(weight[q] * (q - logistic(x)) * f for (q, x) in rest for f in [f(x)]) for f in (lambda x: 1, lambda x: x)]
        assert max(map(abs, slope)) < 0.05


def test_long_labelled_texts_are_learned_from(spark):
    """A table of long texts only: a piece of each is in the sample, so scores part the labels."""
    r = random.Random(2)
    kinds = {1: [f"clear{i}" for i in range(300)], 0: [f"noisy{i}" for i in range(300)]}
    data = [(i, " ".join(r.choice(kinds[i % 2]) for _ in range(4000)), "en", "s", 0) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id bigint, quality int, toxic int")
    scorer = quality.fit(cases.documents(spark, data), labels)
    assert scorer.good and scorer.score(data[1][1]) > 0.7 > 0.3 > scorer.score(data[2][1])
    assert len(scorer.good) <= quality.DICTIONARY_BYTES


def test_labels_that_must_not_be_learned_from_are_not(spark):
    docs = cases.documents(spark, [(i, f"good {i} " * 9, "en", "s", 0) for i in range(40)])
    schema = "doc_id bigint, quality int, toxic int"
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert quality.fit(docs, spark.createDataFrame([(i, i % 2, 0) for i in held], schema)) == quality.Scorer()
    odd = [(None, 1, 0), (1, None, 0), (3, 7, 0), (4, 0, 0), (4, 1, 0)]
    assert quality.fit(docs, spark.createDataFrame(odd, schema)).prior == 0.5
    ones = spark.createDataFrame([(i, 1, 0) for i in range(40)], schema)
    assert quality.fit(docs, ones).score("anything") == 1.0


# --- licences --------------------------------------------------------------------------------------

def plain_base(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = []
    for phrase, label in licences.BASE.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    return len(w), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def check_base(rows, data):
    found = Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows)
    assert found == Counter((i, *plain_base(t)) for i, t, *_ in data)


def test_base_places_of_whole_texts(spark):
    phrases = [*licences.BASE, "gnu general", "license", "cc by cc by", "mit\nLICENSE apache-license"]
    r = random.Random(4)
    data = [(k, " ".join(r.choice([*phrases, "x", "é", "_"]) for _ in range(r.randrange(30))), "en", "s", 0) for k in range(200)]
    check_base(cases.rows(licences.scanned(cases.documents(spark, data))), data)
    awkward = cases.clashing(spark, cases.documents(spark), ["labels", "score"])
    rows = cases.rows(licences.scanned(awkward))
    check_base(rows, cases.awkward())
    for r in rows:
        assert 0 <= r["score"] <= 1
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
    assert licences.scanned(cases.documents(spark, [])).collect() == []


@pytest.mark.parametrize("text, choices", [
    ("MIT", [{"mit"}]),
    ("MIT OR Apache-2.0", [{"mit"}, {"apache-2.0"}]),
    ("MIT AND (Apache-2.0 OR BSD-3-Clause)", [{"mit", "apache-2.0"}, {"mit", "bsd-3-clause"}]),
    ("A or B and C", [{"a"}, {"b", "c"}]),
    ("GPL-2.0-only WITH Classpath-exception-2.0 OR MIT", [{"gpl-2.0-only with classpath-exception-2.0"}, {"mit"}]),
    ("A OR A AND B", [{"a"}]),
])
def test_expressions(text, choices):
    assert {*map(frozenset, choices)} == set(licences.choices(licences.in_postfix(text)))


@pytest.mark.parametrize("text", ["", "AND MIT", "MIT OR", "(MIT", "OR", "()", "WITH x"])
def test_ill_formed_expressions_add_nothing(text):
    assert licences.in_postfix(text) is None
    assert licences.scan(f"// SPDX-License-Identifier: {text}\n")["labels"] == ""


def test_tags_and_notices():
    found = licences.scan("/* spdx-license-identifier: (MIT OR Apache-2.0) */ Licensed under the Apache License, Version 2.0")
    assert found["labels"] == "apache,apache-2.0,mit" and found["base_labels"] == "apache"
    assert licences.scan("x" * 10)["score"] == 0.0 and found["score"] > 0.9
    deep = "SPDX-License-Identifier: " + " AND ".join(f"(a{i} OR b{i})" for i in range(60))
    assert len(licences.scan(deep)["labels"].split(",")) == 120


@pytest.mark.parametrize("text, labels", [
    ("MIT OR (MIT AND Apache-2.0)", "apache-2.0,mit"),
    ("(GPL-2.0 OR MIT) AND MIT", "gpl-2.0,mit"),
    ("GPL-2.0 WITH Classpath AND " + " AND ".join(["MIT"] * 40), "gpl-2.0 with classpath,mit"),
    (" AND ".join(["MIT"] * 40) + " OR", ""),
    (" OR ".join(f"a{i:05}" for i in range(20_000)), ",".join(f"a{i:05}" for i in range(20_000))),
])
def test_labels_are_the_licences_named_at_any_length(text, labels):
    assert licences.scan(f"SPDX-License-Identifier: {text}\n")["labels"] == labels


def test_whole_table(spark):
    data = [tuple(r) for r in spark.read.parquet(f"{cases.SF}/documents.parquet").select("doc_id", "text").collect()]
    check_base(cases.rows(QUERIES["op10_licence_scan"](spark, cases.SF)), data)


def test_a_long_text_of_phrases_is_scanned_in_one_pass():
    text = "mit license " * 300_000
    start = time.perf_counter()
    row = licences.scan(text)
    assert (row["n_words"], row["n_base"], row["first_word"], row["last_word"]) == (600_000, 300_000, 0, 599_998)
    assert time.perf_counter() - start < 20  # some seconds; by counting from the start it would be an hour
