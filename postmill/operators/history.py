"""What was seen in which run, as ranges of runs instead of a full set for each.

A row (url, first_run, last_run, prev_run) says that the url was in every run from the first to the last;
prev_run is the run before the last (null where first and last are one), kept for ranges that reach the
latest run. So a url that stays is one
row however many runs there are. A run touches only ranges that end in the run before (or in the same
one, if it is done again); dealt to folders by last_run, older ones are never read or written again.
Runs are dates in ascending order; only the latest can be done again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCHEMA = "url STRING, first_run DATE, last_run DATE, prev_run DATE"


def _day(value: Column | str) -> Column:
    return (F.lit(value) if isinstance(value, str) else value).cast("date")


def as_ranges(history: DataFrame) -> DataFrame:
    """Ranges of a history of full sets (run_date, url)."""
    runs = history.select("run_date").distinct()
    # as many rows as runs
    runs = runs.select("run_date", F.row_number().over(W.orderBy("run_date")).alias("n"))
    seen = history.select("run_date", "url").distinct().join(F.broadcast(runs), "run_date")
    by_url = W.partitionBy("url").orderBy("n")
    islands = seen.withColumn("island", F.col("n") - F.row_number().over(by_url)).withColumn(
        "before", F.lag(F.struct("run_date", "n")).over(by_url))
    islands = islands.withColumn("prev", F.when(F.col("before.n") == F.col("n") - 1, F.col("before.run_date")))
    return islands.groupBy("url", "island").agg(
        F.min("run_date").alias("first_run"), F.max("run_date").alias("last_run"), F.max_by("prev", "n").alias("prev_run"),
    ).select("url", "first_run", "last_run", "prev_run")


def at_run(ranges: DataFrame, run_date: str) -> DataFrame:
    """The urls of one run."""
    day = _day(run_date)
    return ranges.filter((F.col("first_run") <= day) & (F.col("last_run") >= day)).select("url")


def _last_before(ranges: DataFrame, before: str | None) -> tuple[DataFrame, Column]:
    """ranges with `run`, the last run of each (before a date, if one is named), and the last of all."""
    if before is None:
        run = F.col("last_run")
    else:  # the latest run may be of that date: then the one before it counts
        run = F.when(F.col("last_run") < _day(before), F.col("last_run")).when(
            F.col("prev_run") < _day(before), F.col("prev_run"))
    with_run = ranges.withColumn("run", run)
    return with_run, with_run.agg(F.max("run")).scalar()


def last_set(ranges: DataFrame, before: str | None = None) -> DataFrame:
    """The urls of the last run (before a date, which may be that of the latest run, if one is named)."""
    with_run, last = _last_before(ranges, before)
    return with_run.filter(F.col("run") == last).select("url")


def advance_ranges(ranges: DataFrame, current: DataFrame, run_date: str) -> DataFrame:
    """Ranges after the run of `run_date` found `current` (url); unchanged if it found nothing. Done again,
    the run's set is replaced. Only ranges that end in this run or the one before change."""
    day = _day(run_date)
    found = current.select("url").distinct()
    any_found = F.coalesce(found.limit(1).agg(F.count(F.lit(1))).scalar() > 0, F.lit(False))
    # as it was before this run
    undone = ranges.filter(~((F.col("first_run") == day) & any_found)).withColumns({
        "last_run": F.when((F.col("last_run") == day) & any_found, F.col("prev_run")).otherwise(F.col("last_run")),
        "prev_run": F.when((F.col("last_run") == day) & any_found, F.lit(None).cast("date")).otherwise(F.col("prev_run")),
    })
    last = undone.filter(F.col("last_run") < day).agg(F.max("last_run")).scalar()
    marked = found.withColumn("now", F.lit(True))
    held = undone.withColumn("open", F.coalesce(F.col("last_run") == last, F.lit(False)))
    both = held.filter("open").join(marked, "url", "full")
    going_on = both.select(
        "url", F.coalesce("first_run", day).alias("first_run"),
        F.when(F.col("now"), day).otherwise(F.col("last_run")).alias("last_run"),
        F.when(F.col("now"), F.col("last_run")).otherwise(F.col("prev_run")).alias("prev_run"),
    )
    return held.filter("not open").drop("open").unionByName(going_on)
