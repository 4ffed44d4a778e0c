"""The runs, end to end: mail alerts, boards and aggregators, company lists, upkeep."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill import fixed
from postmill.functions import urls
from postmill.operators import companies as co
from postmill.operators.dedup import dedup_first
from postmill.operators.extract import api_postings, mail_postings, page_apply_links
from postmill.operators.lifecycle import prune, reset_fetched
from postmill.operators.links import anchors, arrival, board_slugs, resolve_links
from postmill.operators.prefs import feedback_status, merge_preferences, stored_verdicts
from postmill.operators.upsert import advance_snapshot, snapshot_delta
from postmill.plans.stages import Scorer, fetch_stage, insert_stage, score_stage, touch_stage
from postmill.session import settle
from postmill.sources.files import append_feedback, latest_snapshot, write_preferences


@dataclass
class Run:
    table: DataFrame
    scored: DataFrame | None = None
    snapshots: DataFrame | None = None
    companies: DataFrame | None = None
    notes: DataFrame | None = None


def mail_run(
    table: DataFrame,
    messages: DataFrame,
    attempts: DataFrame,
    now: str,
    scorer: Scorer,
    cap: int | None = None,
    max_messages: int | None = None,
    run: int | None = None,
) -> Run:
    """messages: (seq, id, payload). `cap` fetches and `max_messages` messages at most, if given;
    `run` picks the outcomes of one run out of a log of several (see `fetch_outcomes`). Only the links go on; the stub text is not stored."""
    if max_messages is not None:
        messages = messages.orderBy("seq").limit(max_messages)
    links = mail_postings(messages, ["seq"]).select(
        "url", arrival("seq", "pos").alias("seq")
    )
    table = touch_stage(table, links, fixed.SOURCE_MAIL, now)
    table = fetch_stage(table, attempts, now, cap, run)
    table, scored, notes = score_stage(table, scorer)
    return Run(table, scored, notes=notes)


def board_links(pages: DataFrame) -> DataFrame:
    """pages (seq, url, html) -> (url, company_slug, seq): board postings, first mention each."""
    links = anchors(pages.select("seq", F.col("url").alias("base"), "html"), ["seq", "base"])
    found = board_slugs(resolve_links(links.filter(
        (F.col("href") != "") & ~F.col("href").startswith("#")
    ), "base"))
    return dedup_first(
        found.select(
            urls.board_form("full").alias("url"),
            F.col("slug").alias("company_slug"),
            arrival("seq", "pos").alias("seq"),
        ),
        ["url"], ["seq"],
    )


def described_postings(bodies: DataFrame, rendered: DataFrame) -> DataFrame:
    """Postings that arrive with their text: (url, company, role_title, location,
    job_description, seq). A page whose captured bodies hold none is read as rendered.

    bodies: (seq, page, url, body, doc); rendered: (seq, url, html) with url = page."""
    columns = ["url", "company", "role_title", "location", "job_description", "seq"]
    listed = settle(api_postings(bodies).select(
        "page", F.col("job_url").alias("url"), "company", "role_title", "location",
        "job_description", arrival("seq", "pos").alias("seq"),
    ))
    bare = rendered.join(
        listed.select(F.col("page").alias("url")), "url", "left_anti"
    )
    read = page_apply_links(bare, ["seq", "url"]).select(
        F.col("job_url").alias("url"),
        F.lit("").alias("company"), F.lit("").alias("role_title"), F.lit("").alias("location"),
        "job_description", arrival("seq", "pos").alias("seq"),
    )
    return dedup_first(listed.select(columns).unionByName(read), ["url"], ["seq"])


def board_run(
    table: DataFrame,
    pages: DataFrame,
    bodies: DataFrame,
    rendered: DataFrame,
    snapshots: DataFrame,
    attempts: DataFrame,
    now: str,
    run_date: str,
    scorer: Scorer,
    cap: int | None = None,
    run: int | None = None,
    before: str | None = None,
) -> Run:
    """Described postings go in before board links, so they win a shared address. Links are new
    that the set saved last does not have, be it of the same day, or the last set before the date
    `before`. The snapshot moves after the insert: a crash repeats the delta, and the insert is idempotent."""
    found = settle(board_links(pages))
    table = insert_stage(table, described_postings(bodies, rendered), "described", now)
    fresh = snapshot_delta(found, latest_snapshot(snapshots, before))
    table = insert_stage(table, fresh, "board", now)
    snapshots = advance_snapshot(snapshots, found, run_date)
    table = fetch_stage(table, attempts, now, cap, run)
    table, scored, notes = score_stage(table, scorer)
    return Run(table, scored, snapshots=snapshots, notes=notes)


def company_run(
    table: DataFrame,
    companies: DataFrame,
    pages: DataFrame,
    attempts: DataFrame,
    now: str,
    scorer: Scorer,
    cap: int | None = None,
    run: int | None = None,
) -> Run:
    """companies: (seq, company, company_url, career_site_url, last_error)."""
    found = settle(co.discover_companies(companies, pages))
    companies = co.write_errors(companies, co.company_errors(found))
    links = co.company_postings(found).select(
        "url", "company", arrival("company_seq", "pos").alias("seq")
    )
    table = insert_stage(table, links, "companies", now)
    table = fetch_stage(table, attempts, now, cap, run)
    table, scored, notes = score_stage(table, scorer)
    return Run(prune(table), scored, companies=companies, notes=notes)


def rescore_run(table: DataFrame, scorer: Scorer, pruned: bool = False) -> Run:
    table, scored, notes = score_stage(table, scorer)
    return Run(prune(table) if pruned else table, scored, notes=notes)


def refetch_run(
    table: DataFrame, attempts: DataFrame, now: str, cap: int | None = None, run: int | None = None
) -> Run:
    """Fetched rows start again; give the outcomes since then, or their `run`."""
    return Run(fetch_stage(reset_fetched(table), attempts, now, cap, run))


@dataclass
class Feedback:
    """prefs: the preferences after the run; unread: lines that could not be read; verdicts: what
    became of each line that could, judged after what was stored (contradictions and errors too)."""

    prefs: DataFrame
    unread: DataFrame
    verdicts: DataFrame


def feedback_run(
    prefs: DataFrame, replies: DataFrame, raw: DataFrame | None = None, log: str | None = None,
    save: str | None = None, tries: int | None = None,
) -> Feedback:
    """Raw lines (owner, seq, raw) are added to the folder `log` before anything parses them; the
    preferences are saved to the folder `save`, if it is named."""
    if raw is not None and log is not None:
        append_feedback(raw, log)
    lines = settle(feedback_status(replies, tries))
    events = lines.filter("status = 'parsed'").select("owner", "seq", "entity", "action")
    merged = settle(merge_preferences(prefs, events))
    if save is not None:
        write_preferences(merged, save)
    return Feedback(merged, lines.filter("status <> 'parsed'"), stored_verdicts(prefs, events))
