"""What a batch of arrivals changes in a table of `sources.changes`: only the rows that it touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.text import strip, text
from postmill.operators.dedup import dedup_first, known_keys, one_form
from postmill.operators.sequence import dense_index
from postmill.operators.upsert import new_rows, pending_row
from postmill.session import settle
from postmill.sources.changes import heads, rows_at
from postmill.sources.tables import align


def _numbered(fresh: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """New rows in their `seq` order, numbered on from the table's last number without gaps."""
    ordered = settle(fresh.withColumn("at", F.struct("seq", "job_url")))
    counted = dense_index(ordered.drop("seq"), "at", "n")
    last = F.coalesce(rows.agg(F.max("seq")).scalar(), F.lit(-1).cast("bigint"))
    placed = counted.select((F.col("n") + last).alias("seq"), *[c for c in columns if c in counted.columns])
    return align(placed, columns).withColumns({"version": F.lit(1).cast("bigint"), "gone": F.lit(False)})


def touches(rows: DataFrame, arrivals: DataFrame, columns: list[str], source: str, now: str) -> DataFrame:
    """Arrivals (url, seq) upserted: rows that they name, under any form of the address, with another
    `last_seen_at`; a pending row for each other address. A deleted row that is named stays deleted.

    rows: `changes.written`. Of the table only seq and the address are compared; whole rows are read
    where they are touched."""
    head = settle(heads(rows, "job_url"))
    found = dedup_first(
        arrivals.select(strip(text("url")).alias("url"), "seq").filter("url <> ''"), ["url"], ["seq"]
    )
    # the last living row of an address is touched; a tombstone only counts where no row lives
    alive = F.max(F.when(~F.col("gone"), F.col("row_seq"))).alias("row_seq")
    known = known_keys(head, also=["gone"]).groupBy("key").agg(alive).withColumnRenamed("key", "url")
    matched = settle(found.join(known.withColumn("known", F.lit(True)), "url", "left"))
    hit = head.join(matched.filter("row_seq is not null").select(F.col("row_seq").alias("seq")).distinct(), "seq", "left_semi")
    touched = rows_at(rows, settle(hit)).withColumn("last_seen_at", F.lit(now)).select(
        "seq", *columns, (F.col("version") + 1).alias("version"), F.lit(False).alias("gone")
    )
    fresh = one_form(matched.filter("known is null"), ["seq"]).select("seq", *pending_row(source, now))
    return touched.unionByName(_numbered(fresh, rows, columns))


def inserts(rows: DataFrame, arrivals: DataFrame, columns: list[str], preset: str, now: str) -> DataFrame:
    """Arrivals inserted if absent: those of no stored or deleted row under any form of the address."""
    head = settle(heads(rows, "job_url"))
    return _numbered(new_rows(head, arrivals, preset, now), rows, columns)


def deletions(rows: DataFrame, columns: list[str], where: Column | str) -> DataFrame:
    """Living rows that meet a condition on their columns, as tombstones: they are not inserted again."""
    whole = rows_at(rows, heads(rows).filter(~F.col("gone"))).filter(where)
    return whole.select("seq", *columns, (F.col("version") + 1).alias("version"), F.lit(True).alias("gone"))
