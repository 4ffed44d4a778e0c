"""Edge rows of tables, patches, the store, islands, upserts and write-backs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from postmill import fixed
from postmill.functions.text import eastern_text, lenient_int
from postmill.operators import upsert as U
from postmill.operators.dedup import dedup_first, key_index
from postmill.operators.sequence import contiguous_ranges, dense_index
from postmill.sources import files, tables as T
from postmill.operators.lifecycle import check_invariants
from postmill.sources import changes

NOW = "now"


def table(spark, columns, *rows):
    """Rows as dicts; seq counts from 0, missing columns are ''."""
    data = [(i, *[r.get(c, "") for c in columns]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "seq bigint, " + ", ".join(f"{c} string" for c in columns))


def mail(spark, *rows):
    return table(spark, fixed.MAIL_COLUMNS, *rows)


def test_header_and_grid(spark):
    assert T.header_names(["Job URL", "", "a-b", "a b", None]) == [
        "job_url", "__col_1", "a_b", "a_b__1", "__col_4"]
    grid = spark.createDataFrame([(0, ["u", "x"]), (1, ["u", None, "c", "d", "e", "surplus"])],
                                 "seq bigint, cells array<string>")
    rows = T.from_grid(grid, ["Job URL", "", "a-b", "a b", "e"]).orderBy("seq").collect()
    assert tuple(rows[0]) == (0, "u", "x", "", "", "")
    assert tuple(rows[1]) == (1, "u", "", "c", "d", "e")


def test_bind_and_append_errors(spark):
    df = spark.createDataFrame([(0, "a", "b")], "seq bigint, `Job-URL` string, job_url string")
    assert T.bind(df, ["job url"]).collect()[0][1] == "a"
    with pytest.raises(ValueError):
        T.bind(df, ["missing"])
    with pytest.raises(ValueError):
        T.append(spark.range(1).withColumnRenamed("id", "seq"), df)
    assert T.read_companies(df).count() == 0


def test_sparse_patch(spark):
    t = mail(spark, {"company": "a", "location": "l"}, {"company": "b"})
    patches = spark.createDataFrame(
        [(0, 1, {"company": "x", "role_title": "r"}), (0, 2, {"company": ""}), (0, 0, {"company": "z"}),
         (1, 1, {"location": None})], "seq bigint, patch_seq int, changes map<string,string>")
    rows = T.apply_patches(t, patches).orderBy("seq").collect()
    assert (rows[0].company, rows[0].role_title, rows[0].location) == ("", "r", "l")
    assert (rows[1].company, rows[1].location) == ("b", "")
    once = T.apply_patches(t, patches)
    assert sorted(T.apply_patches(once, patches).collect()) == sorted(once.collect())


def test_islands(spark):
    df = spark.createDataFrame([(v,) for v in [1, 2, 3, 5, 5, 9, -4]], "v int")
    assert [tuple(r) for r in contiguous_ranges(df, "v").collect()] == [(9, 9), (5, 5), (2, 3)]


def test_dense_index_of_sparse_keys(spark):
    keys = [-9, -1, 0, 1, 2, 7, 8, 9, 64, 65, 1000, 5000, 5001, 1 << 40]
    df = spark.createDataFrame([(k, k % 2) for k in keys], "k bigint, g bigint")
    got = dense_index(df, "k").orderBy("k").collect()
    assert [r.idx for r in got] == list(range(1, len(keys) + 1))
    per = dense_index(df, "k", within=["g"]).orderBy("g", "k").collect()
    for g in (0, 1):
        assert [r.idx for r in per if r.g == g] == list(range(1, sum(k % 2 == g for k in keys) + 1))


def test_dedup_keeps_the_first_under_any_partitioning(spark):
    rows = [(k % 5, 100 - k, f"p{k}") for k in range(50)]
    for parts in (1, 4, 17):
        df = spark.createDataFrame(rows, "k int, s int, p string").repartition(parts, "p")
        assert sorted(r.p for r in dedup_first(df, ["k"], ["s"]).collect()) == [
            "p45", "p46", "p47", "p48", "p49"]


def test_key_index(spark):
    t = mail(spark, {"job_url": "a"}, {"job_url": " a/ "}, {"job_url": "b//"}, {"job_url": " "})
    assert {tuple(r) for r in key_index(t).collect()} == {("a", 1), ("a/", 1), ("b//", 2), ("b", 2)}


def board_rows(spark, *urls):
    return spark.createDataFrame(
        [(u, "slug", i) for i, u in enumerate(urls)], "url string, company_slug string, seq bigint")


def test_insert_if_absent(spark):
    t = table(spark, fixed.BOARD_COLUMNS, {"job_url": "a/"}, {"job_url": "b//"})
    rows = board_rows(spark, "a", "b/", "b", "c", " c ", "", "c/", None)
    out = U.insert_new(t, rows, "board", NOW)
    assert [r.job_url for r in out.orderBy("seq").collect()] == ["a/", "b//", "b/", "c"]
    again = U.insert_new(out, rows, "board", NOW)
    assert sorted(again.collect()) == sorted(out.collect())
    new = out.filter("job_url = 'c'").collect()[0]
    assert (new.source, new.company, new.fetch_status, new.fetch_attempts, new.first_seen) == (
        "greenhouse", "slug", "pending", "0", NOW)


def test_insert_described(spark):
    rows = spark.createDataFrame([("u", "A", "R", "L", "d" * 600, 0)],
        "url string, company string, role_title string, location string, job_description string, seq bigint")
    r = U.insert_new(table(spark, fixed.BOARD_COLUMNS), rows, "described", NOW).collect()[0]
    assert (r.seq, r.fetch_status, r.fetch_attempts, r.last_fetch_at, len(r.job_summary)) == (
        0, "fetched", "1", NOW, 500)


def test_touch(spark):
    t = mail(spark, {"job_url": "a", "last_seen_at": "x", "company": "keep"}, {"job_url": "b"})
    arrivals = spark.createDataFrame([("a/", 0), ("n", 1), ("n", 2), (" ", 3)], "url string, seq bigint")
    out = U.upsert_touch(t, arrivals, "gmail", NOW)
    rows = {r.job_url: r for r in out.collect()}
    assert (rows["a"].last_seen_at, rows["a"].company, rows["b"].last_seen_at) == (NOW, "keep", "")
    assert (rows["n"].fetch_status, rows["n"].date_received, rows["n"].last_seen_at) == (
        "pending", NOW, NOW)
    assert sorted(U.upsert_touch(out, arrivals, "gmail", NOW).collect()) == sorted(out.collect())
    assert tuple(U.upsert_report(t, arrivals).collect()[0]) == (1, 1, 2, 3)


def test_one_row_for_all_forms_of_an_address(spark):
    at = "https://www.linkedin.com{}/jobs/view/7{}"
    forms = [at.format("/comm", "/"), at.format("", ""), at.format("", "/"), at.format("/comm", "")]
    urls_ = ["n/", "n", "n//", *forms, "m"]
    t = mail(spark, {"job_url": "a/"})
    arrivals = spark.createDataFrame([(u, i) for i, u in enumerate(urls_)], "url string, seq bigint")
    for out in (U.upsert_touch(t, arrivals, "gmail", NOW), U.insert_new(t, arrivals.withColumn("company", F.lit("c")), "companies", NOW)):
        assert [r.job_url for r in out.orderBy("seq").collect()] == ["a/", "n/", forms[0], "m"]
        counts = {r.rule: r.n for r in check_invariants(out).collect()}
        assert counts["duplicate_form"] == counts["duplicate_key"] == 0
    assert tuple(U.upsert_report(t, arrivals).collect()[0]) == (0, 3, 1, 4)
    known = spark.createDataFrame([("a", 0), ("a/", 1), ("b", 2), ("b/", 3)], "url string, seq bigint")
    assert tuple(U.upsert_report(t, known).collect()[0]) == (2, 1, 1, 2)


def test_snapshot_counts_the_previous_run_only(spark):
    runs = [("2024-01-01", "u"), ("2024-01-02", "v")]
    history = spark.createDataFrame(runs, "d string, url string").select(
        F.col("d").cast("date").alias("run_date"), "url")
    now = spark.createDataFrame([("u",), ("v",)], "url string")
    fresh = U.snapshot_delta(now, files.latest_snapshot(history, before="2024-01-03"))
    assert [r.url for r in fresh.collect()] == ["u"]
    assert U.advance_snapshot(history, now, "2024-01-02").count() == 3
    assert U.advance_snapshot(history, now.limit(0), "2024-01-02").count() == 2


def test_score_writeback(spark):
    t = mail(spark, {"job_url": "https://l/comm/jobs/view/1"}, {"job_url": "b/", "agent_bucket": "old"},
             {"job_url": "c", "agent_bucket": "old"})
    scored = spark.createDataFrame(
        [(0, "https://l/jobs/view/1", "monitor", ["x", "y"]), (1, "b", "true_match", ["x"]),
         (2, "b/", "reject", ["z"]), (3, "nowhere", "reject", ["z"])],
        "seq bigint, url string, bucket string, why array<string>")
    rows = U.write_scores(t, scored).orderBy("seq").collect()
    assert [(r.agent_bucket, r.agent_reasoning) for r in rows] == [
        ("monitor", "• x\n• y"), ("reject", "• z"), ("old", "")]
    assert U.score_patches(t, scored).count() == 2


def test_only_changes_are_written(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "seq BIGINT, job_url STRING, a STRING"
    nothing = changes.current(spark, path, schema)
    assert nothing.count() == 0
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    changes.put(changes.changed(nothing, rows((0, "u", "x"), (1, "v", "y"), (2, "w", ""))), path, "run", 0)
    before = changes.current(spark, path, schema)
    after = rows((0, "u", "x"), (1, "v", "z"), (2, "w", None), (7, "n", "y"))
    made = changes.changed(before, after)
    assert sorted(map(tuple, made.select("seq", "version", "gone").collect())) == [(1, 2, False), (7, 1, False)]
    changes.put(made, path, "run", 1)
    changes.put(made, path, "run", 1)  # once more: the same folder
    before = changes.current(spark, path, schema)
    assert sorted(map(tuple, before.collect())) == [(0, "u", "x", 1), (1, "v", "z", 2), (2, "w", "", 1), (7, "n", "y", 1)]
    changes.put(changes.changed(before, before.filter("seq <> 1").drop("version")), path, "run", 2)
    assert sorted(r.seq for r in changes.current(spark, path, schema).collect()) == [0, 2, 7]
    assert sorted((r.seq, r.version, r.gone) for r in changes.current(spark, path, schema, tombstones=True).collect()) == [
        (0, 1, False), (1, 3, True), (2, 1, False), (7, 1, False)]
    assert sorted(r.seq for r in changes.current(spark, path, schema, without=("run", 2)).collect()) == [0, 1, 2, 7]
    heads = changes.heads(changes.written(spark, path, schema), "job_url")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<seq:bigint,job_url:string,version:bigint,gone:boolean>" in heads  # no wide column


def test_files(spark, tmp_path):
    (tmp_path / "s.txt").write_text("# c\n\n https://a.io \nhttps://b.io\n")
    assert files.read_seed_urls(spark, str(tmp_path / "s.txt"), "b.io").collect() == [("https://b.io",)]
    missing = str(tmp_path / "none")
    assert files.read_seed_urls(spark, missing).count() == 0
    assert files.read_snapshots(spark, missing).count() == 0
    assert files.read_preferences(spark, missing).count() == 0
    snap = str(tmp_path / "snap")
    urls = spark.createDataFrame([("u",), ("u",)], "url string")
    files.write_snapshot(urls, snap, "2024-01-01")
    files.write_snapshot(urls, snap, "2024-01-01")
    assert [str(r.run_date) + r.url for r in files.read_snapshots(spark, snap).collect()] == ["2024-01-01u"]
    raw = spark.createDataFrame([(" hello ",)], "raw string")
    files.append_feedback(raw, str(tmp_path / "log"))
    files.append_feedback(raw, str(tmp_path / "log"))
    assert [r.raw for r in spark.read.parquet(str(tmp_path / "log")).collect()] == ["hello"] * 2


def test_eastern_text_and_lenient_int(spark):
    df = spark.sql("select timestamp_ntz'2026-02-05 18:09:55' a, timestamp_ntz'2026-07-01 03:00:00' b")
    assert tuple(df.select(eastern_text("a"), eastern_text("b")).collect()[0]) == (
        "2026-02-05 13:09:55 EST", "2026-06-30 23:00:00 EDT")
    ints = spark.createDataFrame([(" 2 ",), ("x",), ("",), (None,), ("1.5",)], "s string")
    assert [r[0] for r in ints.select(lenient_int("s")).collect()] == [2, 0, 0, 0, 0]


def test_delete_rows_and_union(spark):
    t = mail(spark, {"job_url": "a"}, {"job_url": "b"})
    left = T.delete_rows(t, spark.createDataFrame([(0,), (0,), (9,)], "seq bigint"))
    assert [r.job_url for r in left.collect()] == ["b"]
    both = U.union_sources(t.select("seq", "job_url"), t.select("seq"))
    assert sorted((r.source_rank, r.seq) for r in both.collect()) == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_settled_tables_go_with_their_scope(spark):
    from postmill.session import settle, settled_within

    before = settle(spark.range(3))
    with settled_within(spark):
        inside = settle(spark.range(5))
        assert inside.count() == 5
    assert before.count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(*inside.inputFiles()).count()
