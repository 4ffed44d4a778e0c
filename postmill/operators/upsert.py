"""Deltas, inserts, touches and write-backs against a keyed table.

Joins here carry the wide table once and keep the other side narrow. Inputs are
reduced to one row per key before they are joined, so a hot key never reaches a join."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from postmill import fixed
from postmill.functions.text import strip, text
from postmill.functions.urls import key_form
from postmill.operators.dedup import dedup_first, key_index, known_keys, one_form
from postmill.operators.links import match_variants
from postmill.session import settle
from postmill.sources.tables import append, text_columns


def snapshot_delta(current: DataFrame, previous: DataFrame, key: str = "url") -> DataFrame:
    """Current rows whose key the previous run did not have."""
    return current.join(previous.select(key), key, "left_anti").select(*current.columns)


def advance_snapshot(history: DataFrame, current: DataFrame, run_date: str) -> DataFrame:
    """History with the run's set replaced by the current one; unchanged if nothing was found."""
    run = F.lit(run_date).cast("date")
    found = current.select("url").distinct()
    any_found = F.coalesce(
        found.limit(1).agg(F.count(F.lit(1)).alias("n")).scalar() > 0, F.lit(False)
    )
    kept = history.filter(~((F.col("run_date") == run) & any_found))
    return kept.unionByName(found.select(run.alias("run_date"), "url"))


def _presets(now: Column) -> dict[str, dict[str, Column]]:
    pending = {"fetch_status": F.lit("pending"), "fetch_attempts": F.lit("0"), "first_seen": now}
    return {
        "board": pending | {
            "source": F.lit(fixed.SOURCE_BOARD), "company": F.col("company_slug"),
        },
        "companies": pending | {
            "source": F.lit(fixed.SOURCE_COMPANY), "company": F.col("company"),
        },
        "described": {
            "source": F.lit(fixed.SOURCE_DESCRIBED),
            "first_seen": now,
            "company": F.col("company"),
            "role_title": F.col("role_title"),
            "location": F.col("location"),
            "fetch_status": F.lit("fetched"),
            "fetch_attempts": F.lit("1"),
            "last_fetch_at": now,
            "job_description": F.col("job_description"),
            "job_summary": F.left("job_description", F.lit(fixed.SUMMARY_CHARS)),
        },
    }


def new_rows(table: DataFrame, rows: DataFrame, preset: str, now: str) -> DataFrame:
    """Arrivals (url, seq, preset fields) the table does not know, as table rows; of those that are forms
    of one address the first."""
    arrivals = dedup_first(
        rows.withColumn("url", strip(text("url"))).filter("url <> ''"), ["url"], ["seq"]
    )
    keys = known_keys(table).select(F.col("key").alias("url"))
    fresh = one_form(arrivals.join(keys, "url", "left_anti"), ["seq"])
    values = _presets(F.lit(now))[preset] | {"job_url": F.col("url")}
    return fresh.select("seq", *[text(v).alias(c) for c, v in values.items()])


def insert_new(table: DataFrame, rows: DataFrame, preset: str, now: str) -> DataFrame:
    """Insert-if-absent. Presence is tested against every form of the stored keys."""
    return append(table, new_rows(table, rows, preset, now))


def matched(table: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Distinct non-blank arrivals (url, seq) with `row_seq` of the row they name, or null."""
    found = dedup_first(
        arrivals.select(strip(text("url")).alias("url"), "seq").filter("url <> ''"),
        ["url"], ["seq"],
    )
    return found.join(key_index(table).withColumnRenamed("key", "url"), "url", "left")


def upsert_touch(table: DataFrame, arrivals: DataFrame, source: str, now: str) -> DataFrame:
    """Known url -> only `last_seen_at` moves; unknown -> a full pending row, one for all its forms."""
    return touch(table, matched(table, arrivals), source, now)


def pending_row(source: str, now: str) -> list[Column]:
    """The cells of an address (`url`) that is new."""
    return [
        F.col("url").alias("job_url"),
        F.lit(source).alias("source"),
        F.lit(now).alias("date_received"),
        F.lit("pending").alias("fetch_status"),
        F.lit("0").alias("fetch_attempts"),
        F.lit(now).alias("last_seen_at"),
    ]


def touch(table: DataFrame, found: DataFrame, source: str, now: str) -> DataFrame:
    """`upsert_touch` with arrivals that are matched already: `found` is read twice."""
    touched = found.filter("row_seq is not null").select("row_seq").distinct()
    seen = table.join(touched, F.col("seq") == F.col("row_seq"), "left").withColumn(
        "last_seen_at",
        F.when(F.col("row_seq").isNotNull(), F.lit(now)).otherwise(F.col("last_seen_at")),
    )
    fresh = one_form(found.filter("row_seq is null"), ["seq"]).select("seq", *pending_row(source, now))
    return append(seen.select(*table.columns), fresh)


def upsert_report(table: DataFrame, arrivals: DataFrame) -> DataFrame:
    """One row: existing (addresses), new, rows_before, rows_after for the arrivals."""
    # a known address counts by itself, all forms of a new one together
    found = matched(table, arrivals)
    known = F.col("row_seq").isNotNull()
    named = F.when(known, F.col("url")).otherwise(key_form("url"))
    sides = found.groupBy(known.alias("known"), named.alias("named")).agg(F.count(F.lit(1))).select(
        F.col("known").cast("bigint").alias("existing"),
        (~F.col("known")).cast("bigint").alias("new"),
        F.lit(0).cast("bigint").alias("rows_before"),
    ).unionByName(
        table.select(
            F.lit(0).cast("bigint").alias("existing"),
            F.lit(0).cast("bigint").alias("new"),
            F.lit(1).cast("bigint").alias("rows_before"),
        )
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return sides.agg(total("existing"), total("new"), total("rows_before")).withColumn(
        "rows_after", F.col("rows_before") + F.col("new")
    )


@dataclass(frozen=True)
class Touched:
    """A table after an upsert, and what became of the arrivals once it has been written."""

    table: DataFrame
    found: DataFrame
    seen: Observation

    def report(self) -> dict[str, int]:
        """existing, new, rows_before, rows_after: rows are counted as the table is written, so it is not
        read once more; blocks until then. Arrivals are counted on their own narrow table."""
        known = F.col("row_seq").isNotNull()
        counts = self.found.groupBy(known.alias("k"), F.when(known, F.col("url")).otherwise(key_form("url"))).agg(
            F.count(F.lit(1))).groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()
        by = {r.k: r.n for r in counts}
        after, new = self.seen.get["rows_after"], by.get(False, 0)
        return {"existing": by.get(True, 0), "new": new, "rows_before": after - new, "rows_after": after}


def touch_observed(table: DataFrame, arrivals: DataFrame, source: str, now: str) -> Touched:
    """`upsert_touch` with the report of `upsert_report`, counted in passing."""
    found, seen = settle(matched(table, arrivals)), Observation()
    after = touch(table, found, source, now).observe(seen, F.count(F.lit(1)).alias("rows_after"))
    return Touched(after, found, seen)


def render_reasons(why: Column | str) -> Column:
    return F.array_join(
        F.transform(why, lambda r: F.concat(F.lit(fixed.REASON_BULLET), r)), "\n"
    )


def score_patches(table: DataFrame, scored: DataFrame, order: str = "seq") -> DataFrame:
    """row_seq, agent_bucket, agent_reasoning for scored (url, bucket, why, order) rows.

    A url is matched through its forms, best form first; unmatched ones are dropped.
    Where several scores reach one row, the last in list order counts."""
    latest = (
        scored.select(
            strip(text("url")).alias("url"),
            F.struct("bucket", render_reasons("why").alias("reasons")).alias("score"),
            F.col(order).alias("ord"),
        )
        .groupBy("url")
        .agg(F.max_by("score", "ord").alias("score"), F.max("ord").alias("ord"))
    )
    narrow = match_variants(latest.select("url", "ord")).join(
        key_index(table).withColumnRenamed("key", "variant"), "variant"
    )
    hits = narrow.groupBy("url").agg(F.min_by("row_seq", "prio").alias("row_seq"))
    return (
        hits.join(latest, "url")
        .groupBy("row_seq")
        .agg(F.max_by("score", "ord").alias("s"))
        .select(
            "row_seq",
            F.col("s.bucket").alias("agent_bucket"),
            F.col("s.reasons").alias("agent_reasoning"),
        )
    )


def write_scores(table: DataFrame, scored: DataFrame, order: str = "seq") -> DataFrame:
    """The table with bucket and reasoning set on every row a score reaches."""
    return apply_scores(table, score_patches(table, scored, order))


def apply_scores(table: DataFrame, patches: DataFrame) -> DataFrame:
    """The table with the cells of `score_patches`: one join by seq."""
    columns = ["agent_bucket", "agent_reasoning"]
    patches = patches.select("row_seq", *[text(c).alias(f"__{c}") for c in columns])
    joined = table.join(patches, F.col("seq") == F.col("row_seq"), "left")
    return joined.select(
        "seq",
        *[
            F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c)
            for c in text_columns(table)
        ],
    )


def union_sources(*frames: DataFrame) -> DataFrame:
    """Several lists end to end: adds `source_rank`; order is (source_rank, seq)."""
    ranked = [df.withColumn("source_rank", F.lit(i)) for i, df in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
