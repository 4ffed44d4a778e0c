"""Packs, replies, digest, rules and preferences."""

from __future__ import annotations

import json
import random

import pandas as pd
from pyspark.sql import functions as F

from postmill import fixed
from postmill.operators import prefs as P
from postmill.operators import reports
from postmill.operators import scoring as S

POST = "seq bigint, url string, title string, company string, location_text string, job_description string"


def posts(spark, *rows):
    return spark.createDataFrame([(i, f"u{i}", *r) for i, r in enumerate(rows)], POST)


def many(spark, n, **cells):
    row = (cells.get("title", "t"), cells.get("company", "c"), cells.get("place", "l"), cells.get("text", "d"))
    return posts(spark, *[row] * n)


def test_closed_roles(spark):
    df = posts(spark, ("t", "c", "The ROLE IS CLOSED", "d"), ("t", "c", "x", "Applications are closed."),
               ("t", "c", None, None))
    closed, waiting = S.split_closed(df)
    assert sorted(r.url for r in closed.collect()) == ["u0", "u1"]
    assert [r.url for r in waiting.collect()] == ["u2"]


def test_packs_and_texts(spark):
    packed = S.pack(many(spark, 23, text="x" * 7000))
    sizes = {r.batch: r["count"] for r in packed.groupBy("batch").count().collect()}
    assert sizes == {0: 10, 1: 10, 2: 3}
    assert packed.agg(F.max(F.length("job_description"))).collect()[0][0] == 7000
    cut = S.pack(many(spark, 3, text="x" * 70), chars=60)
    assert cut.agg(F.max(F.length("job_description"))).collect()[0][0] == 60
    text = S.render_batches(S.pack(posts(spark, ("T", "", None, "D"), ("", "C", "L", "")))).collect()[0]
    assert text.batch_text == (
        "Job 1:\nURL: u0\nTitle: T\nCompany: (none)\nLocation: (none)\nJob Description:\nD"
        "\n\n---\n\nJob 2:\nURL: u1\nTitle: (none)\nCompany: C\nLocation: L\nJob Description: (empty)")


def item(**changes):
    base = {"url": "u0", "bucket": "monitor", "why": ["a"], "what_to_do_next": "n"} | changes
    return {k: v for k, v in base.items() if v is not ...}


def test_replies(spark):
    good = json.dumps({"true_matches": [item(why=[])], "rejects": [item(bucket="odd", extra=1)], "notes": "n"})
    cases = [
        (good, True, 2), (f"```json\n{good}\n```", True, 2), (f"Sure! {good} Bye.", True, 2),
        (good.replace('"n"', '"n\n"'), True, 2), ("{}", True, 0),
        (json.dumps({"monitor": [item(why="text")]}), False, 0),
        (json.dumps({"monitor": [item(why=[1])]}), False, 0),
        (json.dumps({"monitor": [item(why=["a", None])]}), False, 0),
        (json.dumps({"monitor": [item(url=...)]}), False, 0),
        (json.dumps({"monitor": [item(bucket=None)]}), False, 0),
        (json.dumps({"monitor": [item(), 3]}), False, 0),
        (json.dumps({"monitor": None}), False, 0), (json.dumps({"monitor": {}}), False, 0),
        (json.dumps({"notes": [1]}), False, 0), (json.dumps({"notes": ["a", "b"]}), True, 0),
        ("[]", False, 0), ("no json", False, 0), ("", False, 0), (None, False, 0),
    ]
    df = spark.createDataFrame([(i, 0, c[0]) for i, c in enumerate(cases)], "batch bigint, try int, text string")
    rows = S.parse_replies(df).orderBy("batch").collect()
    assert [(r.valid, len(r["items"])) for r in rows] == [c[1:] for c in cases]
    assert rows[0].notes == ["n"] and rows[14].notes == ["a", "b"] and rows[7].notes == []
    first = rows[0]["items"][1]
    assert (first.list, first.pos, first.bucket) == (2, 0, "odd")


def test_score_asks_twice_at_most_and_once_if_valid(spark):
    calls = spark.sparkContext.accumulator(0)

    def answer(pack: pd.DataFrame, attempt: int) -> str:
        calls.add(1)
        if pack["batch"].iloc[0] == 0 or (pack["batch"].iloc[0] == 1 and attempt == 1):
            assert list(pack["place"]) == sorted(pack["place"])
            return json.dumps({"monitor": [item(url=u) for u in pack["url"]]})
        return "sorry"

    packed = S.pack(many(spark, 25))
    parsed = S.score(packed, answer)
    rows = {r.batch: (r["try"], r.valid, len(r["items"])) for r in parsed.collect()}
    parsed.collect()
    assert rows == {0: (0, True, 10), 1: (1, True, 10), 2: (1, False, 0)}
    assert calls.value == 5  # three packs, two of them again; never for reading the result
    closed, _ = S.split_closed(posts(spark, ("t", "c", "role is closed", "d")))
    scored = S.assemble(closed, packed, parsed).orderBy("ord").collect()
    assert len(scored) == 26
    assert [r.what_to_do_next for r in scored[20:]] == ["Skip"] + ["Review manually"] * 5
    assert scored[21].why == [fixed.FAILED_REASON]
    assert S.digest_notes(parsed).collect()[0].note == fixed.FAILED_NOTE


def test_rules_precedence(spark):
    rules = [S.Rule("good", "true_match", any_of=["green"]),
             S.Rule("big", "reject", any_of=["enterprise"], overridable=True),
             S.Rule("infra", "reject", all_of=["infra", "sre"])]
    prefs = spark.createDataFrame(
        [("reject", "Amazon"), ("exception", "Netflix"), ("note", "Netflix")], "kind string, value string")
    df = posts(
        spark, ("green", "c", "role is closed", ""), ("green", "c", "", "PATTERN x"), ("green", "aws", "", ""),
        ("green", "c", "", "enterprise"), ("green", "Netflix", "", "enterprise"),
        ("green", "Netflix", "", "infra sre"), ("x", "c", "", "infra"))
    rows = S.bucket_by_rules(df, rules, prefs, ["pattern x"]).orderBy("seq").collect()
    assert [(r.bucket, r.why[0]) for r in rows] == [
        ("reject", fixed.CLOSED_REASON), ("reject", "pattern: pattern x"), ("reject", "entity: reject"),
        ("reject", "rule: big"), ("true_match", "rule: good"), ("reject", "rule: infra"),
        ("monitor", "no rule fired")]


def test_patterns_as_a_table(spark):
    """Against plain containment: parts of words, short ones, several blanks, other cases, blank ones, repeats."""
    r = random.Random(8)
    words = ["".join(r.choice("abcdé+") for _ in range(r.choice([1, 2, 3, 5, 9]))) for _ in range(60)]
    texts = [r.choice([" ", "  ", "\n"]).join(r.choices(words, k=r.randrange(0, 30))) for _ in range(150)]
    texts += ["", None, "the hot text " * 5, "Senior Staff\tEngineer (m/f)"] + ["same words here"] * 40
    cut = lambda t: t[(a := r.randrange(len(t))) : a + r.randrange(1, 25)]
    patterns = [cut(r.choice([t for t in texts if t])).upper() for _ in range(120)] + ["", "  ", "a", "É", "zz", "hot text THE", "f) ", None]
    patterns += patterns[:5]
    r.shuffle(patterns)
    rows = spark.createDataFrame([(i, (t or "").lower()) for i, t in enumerate(texts)], "seq bigint, words string")
    table = spark.createDataFrame(list(enumerate(patterns)), "seq bigint, pattern string")
    first = lambda t: next((p for p in patterns if p and p.strip() and p.lower() in (t or "").lower()), None)
    got = {x.seq: x.pattern for x in S.first_patterns(rows, table).collect()}
    assert got == {i: first(t) for i, t in enumerate(texts) if first(t) is not None} and len(got) > 100
    df = rows.select("seq", F.lit("t").alias("title"), F.lit("c").alias("company"), F.lit("").alias("location_text"), F.col("words").alias("job_description"))
    kept = [p for p in patterns if p and p.strip() and not p.startswith((" ", "\n"))]
    one = S.bucket_by_rules(df, [], None, spark.createDataFrame(list(enumerate(kept)), "seq bigint, pattern string"))
    assert sorted(one.select("seq", "bucket", "why").collect()) == sorted(S.bucket_by_rules(df, [], None, kept).select("seq", "bucket", "why").collect())


def test_pieces_of_words_are_met_as_they_are_cut(spark, monkeypatch):
    """They are several times the words: none is written or kept, few patterns are met without a shuffle of them."""
    rows = spark.createDataFrame([(i, f"word{i} some other ab text{i % 7} x") for i in range(300)], "seq bigint, words string")
    table = spark.createDataFrame([(0, "d29 so"), (1, "xt3"), (2, " ab "), (3, "b"), (4, "absent")], "seq bigint, pattern string")
    settled, seen = S.settle, []

    def noted(df):
        seen.append(df.columns)
        return settled(df)

    monkeypatch.setattr(S, "settle", noted)
    got = {r.seq: r.pattern for r in S.first_patterns(rows, table).collect()}
    assert not [names for names in seen if {"token", "gram"} <= set(names)]
    assert got == {i: "d29 so" if i == 29 else "xt3" if i % 7 == 3 else " ab " for i in range(300)}


def test_many_patterns_make_no_longer_plan(spark):
    words = [f"word{i}" for i in range(5000)]
    r = random.Random(2)
    many = [f"{r.choice(words)} {r.choice(words)} engineer" for _ in range(100_000)]
    texts = [" ".join(r.choices(words, k=40)) + f" {r.choice(many)} more" for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "seq bigint, words string")
    plans = []
    for some in (many[:10], many):
        table = spark.createDataFrame(pd.DataFrame({"seq": range(len(some)), "pattern": some}))
        found = S.first_patterns(rows, table)
        plans.append(len(found._jdf.queryExecution().optimizedPlan().toString()))
    assert plans[1] < 1.1 * plans[0]
    got = {x.seq: x.pattern for x in found.collect()}
    place = {p: i for i, p in reversed(list(enumerate(many)))}
    ends = {t.rsplit(" ", 4)[1:4] and " ".join(t.split()[-4:-1]) for t in texts}
    for i, t in enumerate(texts):  # the planted one, or an earlier one that is there too
        planted = " ".join(t.split()[-4:-1])
        assert got[i] in t and place[got[i]] <= place[planted] and planted in ends


def test_digest_lists(spark):
    scored = spark.createDataFrame(
        [(i, f"u{i}", "reject" if i % 3 else "monitor", ["w"]) for i in range(9)],
        "seq bigint, url string, bucket string, why array<string>")
    lists = reports.bucket_digest(scored).orderBy("bucket", "place").collect()
    assert [(r.bucket, r.place, r.url) for r in lists[:4]] == [
        ("monitor", 1, "u0"), ("monitor", 2, "u3"), ("monitor", 3, "u6"), ("reject", 1, "u1")]


def feedback(spark, *rows):
    return spark.createDataFrame(
        [("me", i, e, a) for i, (e, a) in enumerate(rows)],
        "owner string, seq bigint, entity string, action string")


def test_preferences(spark):
    events = feedback(spark, ("A", "reject"), (" A ", "reject"), ("A", "exception"), ("  ", "reject"),
                      ("AWS", "exception"), ("amazon", "reject"), ("microsoft", "reject"), ("MSFT", "reject"))
    rows = P.preference_verdicts(events).orderBy("seq").collect()
    assert [r.verdict for r in rows] == [
        "added", "no-op", "contradiction", "error", "added", "contradiction", "added", "added"]
    assert rows[2].message.startswith("Contradiction: A is in reject list.")
    assert rows[3].message == fixed.EMPTY_ENTITY_ERROR
    want = {("A", "reject"), ("Amazon", "exception"), ("microsoft", "reject"), ("Microsoft", "reject")}
    for parts in (1, 4, 17):
        state = P.fold_preferences(events.repartition(parts, "action"))
        assert {(r.value, r.kind) for r in state.collect()} == want
    merged = P.merge_preferences(P.fold_preferences(events), feedback(spark, ("A", "exception"), ("B", "reject")))
    assert {(r.value, r.kind) for r in merged.collect()} == want | {("B", "reject")}


def test_preference_block(spark):
    rows = [("me", "reject", f"c{i:02d}", i) for i in range(20)]
    rows += [("me", "note", f"n{i}", -i) for i in range(12)] + [("you", "exception", "Z", 1), ("none", "other", "x", 1)]
    blocks = {r.owner: r.block for r in P.preference_block(
        spark.createDataFrame(rows, "owner string, kind string, value string, seq bigint")).collect()}
    assert blocks["me"] == (
        "Learned from your feedback:\nReject these companies: " + ", ".join(f"c{i:02d}" for i in range(15))
        + "\n" + "\n".join(f"- n{i}" for i in range(11, 1, -1)) + "\n\n")
    assert blocks["you"] == "Learned from your feedback:\nExceptions (override category rules): Z\n\n"
    assert "none" not in blocks


def test_notes_and_feedback_replies(spark):
    notes = spark.createDataFrame(
        [("me", " b ", 0), ("me", "a", 1), ("me", "b", 2), ("me", " ", 3)], "owner string, value string, seq bigint")
    assert [r.value for r in P.fold_notes(notes).orderBy("seq").collect()] == ["b", "a"]
    replies = ['{"entity": " A ", "action": "Reject"}', '```json\n{"entity":"B","action":"exception"}\n```',
               'Sure: {"entity":"B","action":"reject"}', '{"entity":"","action":"reject"}',
               '{"entity":"A","action":"maybe"}', "[]", "", None, '{"entity":7,"action":"reject"}']
    df = spark.createDataFrame([("me", i, 0, r) for i, r in enumerate(replies)],
                               "owner string, seq bigint, try int, reply string")
    got = P.parse_feedback_replies(df).orderBy("seq").collect()
    assert [(r.entity, r.action) for r in got] == [("A", "reject"), ("B", "exception")] + [(None, None)] * 7
    tries = spark.createDataFrame([("me", 0, 0, "x"), ("me", 0, 1, replies[0]), ("me", 1, 2, replies[0])],
                                  df.schema)
    status = {r.seq: (r.entity, r.status) for r in P.feedback_status(tries, tries=2).collect()}
    assert status == {0: ("A", "parsed")}  # a third try does not count if two are asked for
    assert P.feedback_status(tries).filter("status = 'parsed'").count() == 2
