"""Stages shared by the runs. A run is one function from a table version and the
inputs of the run to the next version. What a stage finds out (which arrivals are new, what
was fetched, how rows are scored) is settled as narrow cells, so later stages do not repeat it;
the table itself stays a plan of joins by seq on these, and is written once, by whoever takes it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.operators.lifecycle import apply_cells, outcome_cells, scoreable
from postmill.operators.prefs import preference_block
from postmill.operators.scoring import (
    Rule, ScoreFn, assemble, bucket_by_rules, digest_notes, pack, score, split_closed, with_prompts,
)
from postmill.operators.sequence import dense_index
from postmill.operators.upsert import apply_scores, matched, new_rows, score_patches, touch
from postmill.session import settle
from postmill.sources.tables import append


@dataclass
class Scorer:
    """How postings are bucketed: a user's function on packs of ten, or rules.

    The function gets a pack with `batch_text` (all its postings as text, in the first row) and
    `preferences` (what `owner` has taught, as text), and the attempt, 0 or 1."""

    fn: ScoreFn | None = None
    rules: list[Rule] | None = None
    prefs: DataFrame | None = None
    patterns: list[str] | DataFrame | None = None
    owner: str = "me"

    def preferences(self) -> str:
        """One owner's block: a single row, whose lists are capped."""
        if self.prefs is None or "owner" not in self.prefs.columns:
            return ""
        row = preference_block(self.prefs.filter(F.col("owner") == self.owner)).first()
        return row.block if row else ""


def fetch_stage(
    table: DataFrame, attempts: DataFrame, now: str, cap: int | None, run: int | None = None
) -> DataFrame:
    return apply_cells(table, settle(outcome_cells(table, attempts, now, cap, run)), now)


def _numbered(rows: DataFrame, key: str) -> DataFrame:
    """Rows with `seq` 0, 1, 2… in the order of what it was. Arrivals are numbered with gaps as
    large as the pages they come from, and a table that took these over would run out of numbers."""
    placed = settle(rows.withColumn("__at", F.struct("seq", key)))
    return dense_index(placed.drop("seq"), "__at", "seq").withColumn("seq", F.col("seq") - 1).drop("__at")


def insert_stage(table: DataFrame, rows: DataFrame, preset: str, now: str) -> DataFrame:
    return append(table, settle(_numbered(new_rows(table, rows, preset, now), "job_url")))


def touch_stage(table: DataFrame, arrivals: DataFrame, source: str, now: str) -> DataFrame:
    return touch(table, settle(_numbered(matched(table, arrivals), "url")), source, now)


def score_stage(
    table: DataFrame, scorer: Scorer
) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(table with scores, scored rows: ord, url, bucket, why, what_to_do_next; the function's
    notes: batch, pos, note, None without a function)."""
    notes = None
    closed, waiting = split_closed(settle(scoreable(table)))
    if scorer.fn:
        packed = settle(with_prompts(pack(waiting), scorer.preferences()))
        parsed = settle(score(packed, scorer.fn))
        scored = assemble(closed, packed, parsed)
        notes = digest_notes(parsed)
    else:
        ruled = bucket_by_rules(
            waiting, scorer.rules or [], scorer.prefs, scorer.patterns
        ).select(
            F.struct(
                F.lit(1).alias("list"), F.lit(1).alias("part"),
                F.lit(0).cast("bigint").alias("batch"), F.col("seq").alias("pos"),
            ).alias("ord"),
            "url", "bucket", "why", F.lit("").alias("what_to_do_next"),
        )
        none = closed.sparkSession.createDataFrame([], "batch BIGINT, valid BOOLEAN, "
            "items ARRAY<STRUCT<list: INT, pos: INT, url: STRING, bucket: STRING, "
            "why: ARRAY<STRING>, what_to_do_next: STRING>>")
        automatic = assemble(closed, none.select("batch", F.lit("").alias("url"), F.lit(0).alias("place")), none)
        scored = automatic.unionByName(ruled)
    scored = settle(scored)
    return apply_scores(table, settle(score_patches(table, scored, "ord"))), scored, notes
