"""Histories as ranges of runs equal full sets, also where a run is done again or finds nothing."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from postmill.operators import history as H
from postmill.operators import upsert as U
from postmill.session import settle
from postmill.sources.files import latest_snapshot


def day(k):
    return f"2024-03-{k:02d}"


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "d string, url string").select(F.col("d").cast("date").alias("run_date"), "url")


def expanded(ranges, runs):
    """(run, url) of all runs that a range covers."""
    return sorted((r, x.url) for x in ranges.collect() for r in runs if str(x.first_run) <= r <= str(x.last_run))


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_one_after_the_other(spark, seed):
    r = random.Random(seed)
    ranges, history = spark.createDataFrame([], H.SCHEMA), rows(spark, []).limit(0)
    runs = []
    for k in (1, 2, 5, 5, 6, 9):  # dates have gaps; one run is done again with another set, one finds nothing
        found = [] if k == 6 else [f"u{i}" for i in range(12) if r.random() < 0.6]
        current = spark.createDataFrame([(u,) for u in found + found[:2]], "url string")
        fresh = U.snapshot_delta(current, latest_snapshot(history, before=day(k)))
        again = U.snapshot_delta(current, H.last_set(ranges, before=day(k)))
        assert sorted(fresh.collect()) == sorted(again.collect())
        history = settle(U.advance_snapshot(history, current, day(k)))
        ranges = settle(H.advance_ranges(ranges, current, day(k)))
        if found and day(k) not in runs:
            runs.append(day(k))
        full = sorted((str(x.run_date), x.url) for x in history.collect())
        assert expanded(ranges, runs) == full
        assert ranges.groupBy("url", "last_run").count().filter("count > 1").count() == 0
        assert sorted(latest_snapshot(history).collect()) == sorted(H.last_set(ranges).collect())
        for run in runs:
            assert sorted(x.url for x in H.at_run(ranges, run).collect()) == sorted(u for d, u in full if d == run)
    # prev_run is kept for the latest run only
    ends = lambda df: sorted(map(tuple, df.select("url", "first_run", "last_run").collect()))
    assert ends(H.as_ranges(history)) == ends(ranges)


def test_a_url_that_stays_is_one_row(spark):
    history = rows(spark, [(day(k), u) for k in range(1, 29) for u in ("a", "b")] + [(day(3), "c"), (day(9), "c"), (day(9), "c")])
    got = sorted((x.url, str(x.first_run), str(x.last_run), x.prev_run and str(x.prev_run)) for x in H.as_ranges(history).collect())
    assert got == [("a", day(1), day(28), day(27)), ("b", day(1), day(28), day(27)), ("c", day(3), day(3), None), ("c", day(9), day(9), None)]
