"""Streams equal their batch twins, over several batches and under replay."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from postmill import fixed
from postmill.operators.lifecycle import fold_attempts
from postmill.operators.prefs import fold_preferences
from postmill.operators.reports import status_counts
from postmill.sources import changes
from postmill.streaming import folds, merges, sinks

ATTEMPTS = "url string, seq bigint, outcome string, error_type string"
FEEDBACK = "owner string, seq bigint, entity string, action string"
TABLE = "seq BIGINT, " + ", ".join(f"{c} STRING" for c in fixed.MAIL_COLUMNS)


def attempt_rows():
    pick = random.Random(7)
    outcomes = ["ok", "timeout", "http_error", "parse_empty"]
    hot = [("hot", i, "timeout", "") for i in range(200)]
    rest = [(f"u{pick.randrange(40)}", 200 + i, pick.choice(outcomes), "E") for i in range(150)]
    return hot + rest


def batches(spark, tmp_path, rows, schema, n=4):
    """Rows in seq order, cut into n files: one file a batch."""
    size = len(rows) // n + 1
    for i in range(n):
        part = rows[i * size : (i + 1) * size]
        random.Random(i).shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_attempts(spark, tmp_path):
    rows = attempt_rows()
    stream = batches(spark, tmp_path, rows, ATTEMPTS)
    out, counts = str(tmp_path / "out"), str(tmp_path / "counts")
    sinks.append_into(folds.attempt_states(stream), out, str(tmp_path / "c1"), "update").awaitTermination()
    sinks.status_changes_into(folds.attempt_states(stream), counts, str(tmp_path / "c2")).awaitTermination()
    last = spark.read.parquet(out).groupBy("url").agg(
        F.max_by(F.struct("fetch_attempts", "fetch_status", "fetch_error"), "b").alias("s")).select("url", "s.*")
    twin = fold_attempts(spark.createDataFrame(rows, ATTEMPTS))
    assert sorted(last.collect()) == sorted(twin.collect())
    assert sorted(sinks.running_status_counts(spark, counts).collect()) == sorted(status_counts(twin).collect())


def test_preferences(spark, tmp_path):
    pick = random.Random(3)
    rows = [("me", i, f"e{pick.randrange(20)}", pick.choice(["reject", "exception"])) for i in range(120)]
    stream = batches(spark, tmp_path, rows, FEEDBACK)
    out = str(tmp_path / "out")
    sinks.append_into(folds.preference_states(stream), out, str(tmp_path / "c")).awaitTermination()
    twin = fold_preferences(spark.createDataFrame(rows, FEEDBACK))
    assert sorted(spark.read.parquet(out).drop("b").collect()) == sorted(twin.collect())


def bytes_of(folder):
    return sum(f.stat().st_size for f in folder.rglob("*.parquet"))


def table(spark, tmp_path, **more):
    return changes.current(spark, str(tmp_path / "t"), TABLE, **more)


@pytest.mark.parametrize("fail_once", [False, True])
def test_upserts(spark, tmp_path, fail_once):
    rows = [(f"u{i % 30}" + "/" * (i % 2), i) for i in range(90)]
    stream = batches(spark, tmp_path, rows, "url string, seq bigint", n=3)
    path = str(tmp_path / "t")
    if fail_once:  # writes, then dies before the stream's own checkpoint is written
        def dying(batch, batch_id):
            writer = sinks.stream_of(batch)
            old = changes.written(spark, path, TABLE, without=(writer, batch_id))
            changes.put(merges.touches(old, batch, fixed.MAIL_COLUMNS, "gmail", "now"), path, writer, batch_id)
            if batch_id == 1:
                raise RuntimeError("lost")

        query = stream.writeStream.foreachBatch(dying).option(
            "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        with pytest.raises(Exception):
            query.awaitTermination()
        half = sorted(table(spark, tmp_path).collect())
        assert len(half) == 30
    sinks.touch_into(stream, path, fixed.MAIL_COLUMNS, "gmail", "now", str(tmp_path / "c")).awaitTermination()
    made = table(spark, tmp_path).collect()
    assert sorted(r.seq for r in made) == list(range(30))
    assert {r.job_url.rstrip("/") for r in made} == {f"u{i}" for i in range(30)}
    # a version for each batch that has the address: a replayed batch does not see what it wrote before
    assert {r.job_url.rstrip("/"): r.version for r in made} == {
        f"u{u}": len({i // 31 for i in range(90) if i % 30 == u}) for u in range(30)}
    assert len(list((tmp_path / "t").glob("q=*/b=*"))) == 3


def test_what_a_batch_writes_grows_with_the_batch(spark, tmp_path):
    path = str(tmp_path / "t")
    base = spark.range(20_000).select(F.col("id").alias("seq"), *[
        F.sha2(F.concat(F.lit(c), F.col("id").cast("string")), 256).alias(c) for c in fixed.MAIL_COLUMNS])
    changes.put(changes.changed(changes.current(spark, path, TABLE), base), path, "base", 0)
    first = base.filter("seq < 5").select(F.col("job_url").alias("url"), "seq").collect()
    rows = [tuple(r) for r in first] + [("new", 7)]
    stream = batches(spark, tmp_path, rows, "url string, seq bigint", n=1)
    sinks.touch_into(stream, path, fixed.MAIL_COLUMNS, "gmail", "later", str(tmp_path / "c")).awaitTermination()
    (batch,) = [p for p in (tmp_path / "t").glob("q=*/b=*") if "q=base" not in str(p)]
    assert bytes_of(batch) < bytes_of(tmp_path / "t" / "q=base") / 100
    made = table(spark, tmp_path)
    assert made.count() == 20_001
    assert sorted(r.seq for r in made.filter("last_seen_at = 'later'").collect()) == [0, 1, 2, 3, 4, 20_000]


def test_two_streams_into_one_table(spark, tmp_path):
    """Each has a batch 0; so has a stream that starts again without its checkpoint."""
    for k, rows in enumerate([[("a", 0), ("b", 1 << 40)], [("c", 2)], [("c", 2), ("d", 3)]]):
        (tmp_path / f"s{k}").mkdir()
        stream = batches(spark, tmp_path / f"s{k}", rows, "url string, seq bigint", n=1)
        sinks.touch_into(stream, str(tmp_path / "t"), fixed.MAIL_COLUMNS, "gmail", "now", str(tmp_path / f"c{k}")).awaitTermination()
    assert sorted((r.job_url, r.seq) for r in table(spark, tmp_path).collect()) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]


def test_deleted_rows_are_not_brought_back_by_a_late_stream(spark, tmp_path):
    path = str(tmp_path / "t")
    stored = spark.createDataFrame([(0, "a/"), (1, "b"), (2, "c")], "seq bigint, job_url string")
    full = stored.select("seq", *[F.col(c) if c == "job_url" else F.lit("").alias(c) for c in fixed.MAIL_COLUMNS])
    changes.put(changes.changed(changes.current(spark, path, TABLE), full), path, "base", 0)
    changes.put(merges.deletions(changes.written(spark, path, TABLE), fixed.MAIL_COLUMNS, "job_url <> 'b'"), path, "prune", 0)
    stream = batches(spark, tmp_path, [("a", 1), ("b/", 2), ("c", 3), ("d", 4)], "url string, seq bigint", n=1)
    sinks.touch_into(stream, path, fixed.MAIL_COLUMNS, "gmail", "now", str(tmp_path / "c1")).awaitTermination()
    sinks.insert_into(stream.withColumn("company", F.lit("x")), path, fixed.MAIL_COLUMNS, "companies", "now",
                      str(tmp_path / "c2")).awaitTermination()
    assert sorted((r.job_url, r.seq, r.last_seen_at) for r in table(spark, tmp_path).collect()) == [
        ("b", 1, "now"), ("d", 3, "now")]
    every = table(spark, tmp_path, tombstones=True)
    assert sorted((r.job_url, r.gone) for r in every.collect()) == [("a/", True), ("b", False), ("c", True), ("d", False)]
    changes.folded(spark, path, TABLE, str(tmp_path / "t2"))
    assert sorted(changes.current(spark, str(tmp_path / "t2"), TABLE, tombstones=True).collect()) == sorted(every.collect())


def test_first_seen(spark, tmp_path):
    """Whole earliest rows, though they come late, in other batches, and twice at one time; null is a key."""
    day = lambda d, h=0: f"2024-01-{d:02d} {h:02d}:00:00"
    rows = [("a", 5, day(2), "later"), ("b", 1, day(2), "b"), (None, 2, day(2), "null"),
            ("a", 4, day(1, 23), "first"), ("a", 9, day(1, 23), "same time"), ("b", 7, day(2, 1), "again"),
            ("c", 8, day(6), "c"), (None, 3, day(6), "null again"),
            ("b", 0, day(1), "b first"), ("c", 6, day(5, 12), "c first"), ("d", 11, day(9), "open"), ("a", 12, None, "no time"),
            ("b", -1, day(1), "too late"), ("f", 1, day(3), "too late"), ("e", 13, day(9), "open"), ("c", 14, day(9), "again")]
    stream = batches(spark, tmp_path, rows, "url string, n bigint, at string, note string", n=5).withColumn("ts", F.col("at").cast("timestamp_ntz"))
    out = str(tmp_path / "out")
    seen = folds.earliest(stream, ["url"], "ts", "n", "2 days")
    sinks.append_into(seen, out, str(tmp_path / "c")).awaitTermination()
    got = {(r.url, r.n, r.at, r.note) for r in spark.read.parquet(out).collect()}
    assert got == {("a", 4, day(1, 23), "first"), ("b", 0, day(1), "b first"), (None, 2, day(2), "null"), ("c", 6, day(5, 12), "c first")}
    assert spark.read.parquet(out).count() == 4 and spark.read.parquet(out).columns == seen.columns


def test_first_seen_by_numbers_some_of_which_are_null(spark, tmp_path):
    """Beside a null a whole number stays one: as a float it was another key, and its row was lost."""
    rows = [(None if i % 10 == 0 else i % 40, i, f"2024-01-{1 + i // 50:02d} 00:00:{i % 50:02d}") for i in range(200)]
    rows.append((999, 999, "2024-02-01 00:00:00"))
    stream = batches(spark, tmp_path, rows, "k bigint, n bigint, at string", n=1).withColumn("ts", F.col("at").cast("timestamp"))
    seen = folds.earliest(stream, ["k"], "ts", "n", "1 hour")
    sinks.append_into(seen, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    first = {}
    for k, n, _ in rows[:-1]:
        first.setdefault(k, n)
    got = [(r.k, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(got) == len(first) and dict(got) == first


class _Held:
    """Stands for the state and the timers of one key; counts what is asked of them."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


def test_a_key_takes_and_gives_rows():
    """No frame is made for a key, which was most of the time of a stream of many keys."""
    row = lambda at, ord_: Row(key0="k", ts=None, at_us=at, ord=ord_, body=f"{at} {ord_}")
    earliest = folds._Earliest(None)
    earliest.state = earliest.handle = held = _Held()
    assert list(earliest.handleInputRows(("k",), iter([row(9000, 1), row(7000, 5), row(7000, 3)]), None)) == []
    assert held.value == (7000, 3, "7000 3", False) and held.timers == {7} and held.calls == 3
    list(earliest.handleInputRows(("k",), iter([row(7000, 4), row(7000, None)]), None))
    assert held.value[1] == 3 and held.calls == 4
    list(earliest.handleInputRows(("k",), iter([row(5000, None)]), None))
    assert held.value == (5000, None, "5000 None", False) and held.timers == {5}
    assert list(earliest.handleExpiredTimer(("k",), None, None)) == [Row(body="5000 None")]
    assert held.value == (5000, None, None, True)


def state_rows(query):
    return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


def test_attempts_go_on_from_a_batch_fold(spark, tmp_path):
    rows = attempt_rows()
    before = fold_attempts(spark.createDataFrame(rows[:190] + [(None, -1, "ok", "")], ATTEMPTS))
    stream = batches(spark, tmp_path, rows[190:] + [(None, 900, "timeout", "")], ATTEMPTS, n=3)
    out = str(tmp_path / "out")
    sinks.append_into(folds.attempt_states(stream, before), out, str(tmp_path / "c"), "update").awaitTermination()
    later = {r.url: tuple(r.s) for r in spark.read.parquet(out).groupBy("url").agg(
        F.max_by(F.struct("fetch_attempts", "fetch_status", "fetch_error"), "b").alias("s")).collect()}
    done = {r.url: tuple(r)[1:] for r in before.collect()} | later
    twin = fold_attempts(spark.createDataFrame(rows + [(None, -1, "ok", ""), (None, 900, "timeout", "")], ATTEMPTS))
    assert done == {r.url: tuple(r)[1:] for r in twin.collect()}
    assert done[None] == (1, "fetched", "")


def test_finished_keys_are_forgotten(spark, tmp_path):
    at = lambda h: f"2024-01-0{1 + h // 24} {h % 24:02d}:00:00"
    rows = [(f"u{i}", i, "ok", "", at(0)) for i in range(8)] + [
        ("open", 8, "timeout", "", at(1)), ("hot", 9, "ok", "", at(12)), ("x", 10, "ok", "", at(40)), ("y", 11, "timeout", "", at(60)),
        ("untimed", 12, "ok", "", None)]
    schema = ATTEMPTS + ", at string"
    stream = batches(spark, tmp_path, rows, schema, n=6).withColumn("ts", F.col("at").cast("timestamp"))
    out = str(tmp_path / "out")
    query = sinks.append_into(folds.attempt_states(stream, keep="6 hours", lateness="1 hour"), out, str(tmp_path / "c"), "update")
    query.awaitTermination()
    held = state_rows(query)
    # watermark 59:00: all finished urls are gone; the two open ones stay, whatever their age, and the one without a time
    assert max(held) >= 8 and held[-1] == 3
    assert spark.read.parquet(out).count() == 13


def test_preferences_go_on_and_are_forgotten(spark, tmp_path):
    stored = spark.createDataFrame([("me", "e1", "reject")], "owner string, value string, kind string")
    rows = [("me", 1, "e1", "exception", "2024-01-01 00:00:00"), ("me", 2, "e2", "reject", "2024-01-01 01:00:00"),
            (None, 3, "e2", "exception", "2024-01-01 02:00:00"), ("me", 4, "e9", "reject", "2024-01-05 00:00:00")]
    stream = batches(spark, tmp_path, rows, FEEDBACK + ", at string", n=2).withColumn("ts", F.col("at").cast("timestamp"))
    out = str(tmp_path / "out")
    query = sinks.append_into(folds.preference_states(stream, stored, keep="1 day"), out, str(tmp_path / "c"))
    query.awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(out).select("owner", "kind", "value", "seq").collect()} == {
        ("me", "reject", "e2", 2), (None, "exception", "e2", 3), ("me", "reject", "e9", 4)}
    assert state_rows(query)[-1] == 1


def test_changes_of_two_queries_do_not_meet(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"s{k}").mkdir()
        stream = batches(spark, tmp_path / f"s{k}", [(f"u{k}", 0, "ok", "")], ATTEMPTS, n=1)
        states = folds.attempt_states(stream)
        sinks.append_into(states, str(tmp_path / "out"), str(tmp_path / f"c{k}"), "update").awaitTermination()
    assert sorted(r.url for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["u0", "u1"]
