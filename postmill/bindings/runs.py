from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from postmill import fixed
from postmill.bindings.base import (
    HOST, LANG, NOW, PAGE_WORDS, SITE, event_table, filled, lang_of, load, query, relink,
    site_of, sql_any,
)
from postmill.bindings.lifecycle import attempt_log
from postmill.bindings.pages import listed_bodies, messages
from postmill.bindings.prefs import feedback_replies
from postmill.functions import urls
from postmill.operators import companies as C
from postmill.operators.links import hrefs
from postmill.operators.scoring import Rule
from postmill.plans import runs as R
from postmill.plans.stages import Scorer
from postmill.operators.extract import mail_html
from postmill.session import settle, shared_dir
from postmill.sources.files import (
    PREFERENCE_SCHEMA, message_headers, read_feedback, read_messages, read_preferences,
    read_snapshots, write_snapshot,
)


def empty(spark, columns):
    return spark.createDataFrame([], "seq BIGINT, " + ", ".join(f"{c} STRING" for c in columns))


# --- companies: by language a company is served by a different level ---------------------

def companies(spark, sf):
    pages = load(spark, sf, "pages")
    url = F.col("url")
    home = F.concat(site_of(), F.lit("/home/"), F.col("page_id").cast("string"))
    return pages.select(
        F.col("page_id").alias("seq"),
        urls.host("url").alias("company"),
        F.when((lang_of() == "de") & url.contains("?"), "").otherwise(home).alias("company_url"),
        url.alias("career_site_url"),
        F.lit("before").alias("last_error"),
    )


def company_pages(spark, sf):
    pages = load(spark, sf, "pages")
    pid, site, url = F.col("page_id").cast("string"), site_of(), F.col("url")
    de = lang_of() == "de"
    full = relink("/job/$1")
    link = lambda to, text: F.concat(F.lit(f'<a href="/{to}/'), pid, F.lit(f'">{text}</a>'))
    at = lambda to: F.concat(site, F.lit(f"/{to}/"), pid)
    rows = [
        (lang_of() == "en", url, "static", full),
        (lang_of() == "fr", url, "static", link("roles", "See open roles")),
        (lang_of() == "fr", at("roles"), "static", full),
        (lang_of() == "es", url, "static", F.lit("<p>none</p>")),
        (lang_of() == "es", url, "clicked", full),
        (de & ~url.contains(".html"), at("home"), "static",
         F.when(url.contains("#"), F.lit("<p>none</p>")).otherwise(link("careers", "x"))),
        (de, at("careers"), "static", F.lit("<p>none</p>")),
        (de & ~url.endswith("/"), at("careers"), "rendered", full),
    ]
    arrays = F.array(*[
        F.struct(test.alias("test"), address.alias("url"), F.lit(render).alias("render"), html.alias("html"))
        for test, address, render, html in rows
    ])
    return pages.select(F.explode(arrays).alias("r")).filter("r.test").select(
        "r.url", "r.render", "r.html"
    )


_STATE = f"""{PAGE_WORDS},
l AS (SELECT page_id, {SITE} || '/job/' || word AS url, min(pos) AS pos FROM w
  WHERE NOT {sql_any(f"lower({SITE} || '/job/' || word)", fixed.EXCLUDED_LINK_PARTS)} GROUP BY 1, 2),
c AS (SELECT page_id AS seq, {HOST} AS company, {SITE} || '/home/' || page_id AS home, url, {LANG} AS lang,
  EXISTS (SELECT 1 FROM l WHERE l.page_id = pages.page_id) AS any_link FROM pages),
s AS (SELECT seq, company, CASE WHEN NOT any_link AND lang <> 'de' THEN NULL
    WHEN lang = 'en' THEN 1 WHEN lang = 'fr' THEN 2 WHEN lang = 'es' THEN 3
    WHEN contains(url, '?') OR contains(url, '#') OR contains(url, '.html') OR url LIKE '%/' OR NOT any_link
      THEN NULL ELSE 8 END AS level,
  CASE WHEN lang <> 'de' AND any_link THEN NULL
    WHEN contains(url, '?') AND lang = 'de' THEN 'Career URL failed and no company URL to fall back to'
    WHEN lang <> 'de' OR contains(url, '.html') THEN 'Fallback failed: no page ' || home
    WHEN contains(url, '#') THEN 'Career URL failed; no careers link found on company page'
    WHEN url LIKE '%/' OR NOT any_link THEN 'Found careers page but no job links extracted' END AS error FROM c)"""


@query(f"WITH {_STATE} SELECT seq, company, level, error FROM s")
def company_cascade(spark, sf):
    found = C.discover_companies(companies(spark, sf), company_pages(spark, sf))
    return found.select("seq", "company", "level", "error")


@query(f"""WITH {_STATE} SELECT s.seq AS company_seq, s.company, s.level, l.url,
  row_number() OVER (PARTITION BY s.seq ORDER BY l.pos) - 1 AS pos
FROM s JOIN l ON l.page_id = s.seq WHERE s.level IS NOT NULL""", ints="pos")
def company_links(spark, sf):
    return C.company_postings(
        C.discover_companies(companies(spark, sf), company_pages(spark, sf))
    )


@query(f"WITH {_STATE} SELECT seq, company, coalesce(error, 'before') AS last_error FROM s")
def company_errors(spark, sf):
    listed = companies(spark, sf)
    found = C.discover_companies(listed, company_pages(spark, sf))
    return C.write_errors(listed, C.company_errors(found)).select("seq", "company", "last_error")


@query(f"""WITH {_STATE}, f AS (SELECT l.url, arg_min(s.company, s.seq * 16777216 + l.pos) AS company
  FROM s JOIN l ON l.page_id = s.seq WHERE s.level IS NOT NULL GROUP BY l.url)
SELECT url AS job_url, company, 'companies' AS source, 'pending' AS fetch_status, '' AS agent_bucket FROM f""")
def company_intake(spark, sf):
    """A company run with nothing fetched yet."""
    run = R.company_run(
        empty(spark, fixed.BOARD_COLUMNS), companies(spark, sf), company_pages(spark, sf),
        attempt_log(spark, sf).select(
            "url", F.col("seq").alias("run"), "outcome", "error_type", F.lit("").alias("html")),
        NOW, Scorer(rules=[]), cap=None,
    )
    return run.table.select("job_url", "company", "source", "fetch_status", "agent_bucket")


# --- mail: every page is a message; fetched unless its word begins with a capital ---------

@query(f"""WITH {PAGE_WORDS}, u AS (SELECT DISTINCT word, regexp_matches(word, '^[A-Z]') AS late FROM w)
SELECT 'https://www.linkedin.com/jobs/view/' || word AS job_url, '1' AS fetch_attempts,
  CASE WHEN late THEN 'timeout' ELSE 'fetched' END AS fetch_status,
  CASE WHEN late THEN '' ELSE word END AS role_title, CASE WHEN late THEN '' ELSE 'Acme' END AS company,
  CASE WHEN late THEN '' WHEN contains(word, 'th') THEN 'reject' ELSE 'monitor' END AS agent_bucket FROM u""")
def mail_intake(spark, sf):
    return _mail(spark, sf, None)


_MESSAGES = 5


@query(f"""WITH {PAGE_WORDS}, u AS (SELECT DISTINCT word, regexp_matches(word, '^[A-Z]') AS late FROM w
  WHERE page_id IN (SELECT page_id FROM pages ORDER BY page_id LIMIT {_MESSAGES}))
SELECT 'https://www.linkedin.com/jobs/view/' || word AS job_url, '1' AS fetch_attempts,
  CASE WHEN late THEN 'timeout' ELSE 'fetched' END AS fetch_status,
  CASE WHEN late THEN '' ELSE word END AS role_title, CASE WHEN late THEN '' ELSE 'Acme' END AS company,
  CASE WHEN late THEN '' WHEN contains(word, 'th') THEN 'reject' ELSE 'monitor' END AS agent_bucket FROM u""")
def mail_capped(spark, sf):
    """A run that takes the first messages of the list only: the source's own cap."""
    return _mail(spark, sf, _MESSAGES)


def _mail(spark, sf, most):
    words = hrefs(load(spark, sf, "pages"), ["page_id"]).select(
        F.ltrim("href", F.lit("/")).alias("word")
    ).distinct()
    word = F.col("word")
    attempts = words.select(
        F.concat(F.lit("https://www.linkedin.com/comm/jobs/view/"), word).alias("url"),
        F.lit(1).alias("run"),
        F.when(word.rlike("^[A-Z]"), "timeout").otherwise("ok").alias("outcome"),
        F.lit("").alias("error_type"),
        F.concat(F.lit("<title>Acme hiring "), word, F.lit(" in Paris | LinkedIn</title><main>"),
                 word, F.lit("</main>")).alias("html"),
    )
    mail = messages(spark, sf).withColumnRenamed("page_id", "seq")
    run = R.mail_run(
        empty(spark, fixed.MAIL_COLUMNS), mail, attempts, NOW,
        Scorer(rules=[Rule("th", "reject", any_of=["th"])]), cap=None, max_messages=most,
    )
    return run.table.select(
        "job_url", "fetch_attempts", "fetch_status", "role_title", "company", "agent_bucket"
    )


# --- boards: page links to a board, and described postings from captures -------------------

@query(f"""WITH {PAGE_WORDS},
b AS (SELECT DISTINCT 'https://boards.greenhouse.io/' || word || '/jobs/' || page_id AS url, lower(word) AS slug
  FROM w WHERE regexp_matches(word, '^[a-zA-Z0-9_-]+$'))
SELECT 'https://x.example.com/' || doc_id AS job_url, 'swooped' AS source, source AS company,
  'fetched' AS fetch_status, CASE WHEN contains(lower(text), 'ndsh') THEN 'reject' ELSE 'monitor' END AS agent_bucket
FROM documents
UNION ALL SELECT url, 'greenhouse', slug, 'pending', '' FROM b WHERE NOT contains(slug, 'th')""")
def board_intake(spark, sf):
    """Board links with `th` were in the last snapshot, so they are not fresh."""
    pages = load(spark, sf, "pages")
    to = F.concat(F.lit('<a href="https://boards.greenhouse.io/$1/jobs/'),
                  F.col("page_id").cast("string"), F.lit('?gh=1"'))
    seeds = pages.select(
        F.col("page_id").alias("seq"), "url",
        F.regexp_replace(F.col("html"), F.lit('<a href="/([^"]*)"'), to).alias("html"),
    )
    known = settle(R.board_links(seeds).filter(F.col("company_slug").contains("th")))
    snapshots = known.select(F.lit("2026-02-01").cast("date").alias("run_date"), "url")
    attempts = attempt_log(spark, sf).select(
        "url", F.col("seq").alias("run"), "outcome", "error_type", F.lit("").alias("html"))
    run = R.board_run(
        empty(spark, fixed.BOARD_COLUMNS), seeds, listed_bodies(spark, sf),
        pages.select(F.col("page_id").alias("seq"), "url", "html"), snapshots, attempts, NOW,
        "2026-02-05", Scorer(rules=[Rule("ndsh", "reject", any_of=["ndsh"])]), cap=None,
    )
    return run.table.select("job_url", "source", "company", "fetch_status", "agent_bucket")


@query("""SELECT event_id AS seq, CASE event_type WHEN 'purchase' THEN 'timeout' WHEN 'view' THEN 'pending'
    WHEN 'click' THEN 'failed' WHEN 'signup' THEN 'timeout' ELSE '' END AS fetch_status,
  CASE event_type WHEN 'purchase' THEN '1' ELSE CAST(CAST(floor(value) AS BIGINT) % 5 AS VARCHAR) END AS fetch_attempts
FROM events""")
def refetch(spark, sf):
    """Fetched rows are reset and run into a timeout; nothing else has an outcome."""
    table = event_table(spark, sf)
    attempts = table.filter("source = 'purchase'").select(
        F.col("job_url").alias("url"), F.lit(1).alias("run"), F.lit("timeout").alias("outcome"),
        F.lit("").alias("error_type"), F.lit("").alias("html"),
    )
    run = R.refetch_run(table, attempts, NOW, cap=None)
    return run.table.select("seq", "fetch_status", "fetch_attempts")


@query("""SELECT doc_id AS seq, CASE WHEN contains(lower(text), 'einer') THEN 'true_match' ELSE 'monitor' END AS agent_bucket
FROM documents WHERE NOT contains(lower(text), 'ndsh')""")
def rescore(spark, sf):
    """All documents scored again; rejected rows are pruned."""
    rules = [Rule("a", "reject", any_of=["ndsh"]), Rule("b", "true_match", all_of=["einer"])]
    table = filled(load(spark, sf, "documents").select(
        F.col("doc_id").alias("seq"),
        F.concat(F.lit("https://d.example.com/"), F.col("doc_id").cast("string")).alias("job_url"),
        F.lit("fetched").alias("fetch_status"), F.col("text").alias("job_description"),
        F.lit("stale").alias("agent_bucket"),
    ), fixed.BOARD_COLUMNS)
    run = R.rescore_run(table, Scorer(rules=rules), pruned=True)
    return run.table.select("seq", "agent_bucket")


_SPOKEN = """e AS (SELECT 'u' || user_id AS value, event_id,
    CASE WHEN event_type = 'click' THEN 'exception' ELSE 'reject' END AS kind
  FROM events WHERE event_type IN ('view', 'click', 'signup')),
f AS (SELECT *, first_value(kind) OVER w AS first_kind, min(event_id) OVER w AS first_id FROM e
  WINDOW w AS (PARTITION BY value ORDER BY event_id))"""


def _feedback(spark, sf) -> tuple[R.Feedback, str]:
    """A feedback run over all events; what was said is logged, what follows is saved."""
    place = f"{shared_dir(spark)}/feedback/{uuid.uuid4().hex}"
    replies = feedback_replies(spark, sf)
    raw = load(spark, sf, "events").select(
        F.lit("me").alias("owner"), F.col("event_id").alias("seq"),
        F.concat(F.lit("  "), "event_type", F.lit("\t")).alias("raw"),
    )
    stored = spark.createDataFrame([], PREFERENCE_SCHEMA)
    return R.feedback_run(stored, replies, raw, f"{place}/raw", f"{place}/prefs"), place


@query(f"WITH {_SPOKEN} SELECT DISTINCT value, first_kind AS kind FROM f")
def feedback_intake(spark, sf):
    return _feedback(spark, sf)[0].prefs.select("value", "kind")


@query(f"""WITH {_SPOKEN} SELECT event_id AS seq, value AS entity, kind AS action,
  CASE WHEN event_id = first_id THEN 'added' WHEN kind = first_kind THEN 'no-op' ELSE 'contradiction' END AS verdict
FROM f""")
def feedback_verdicts(spark, sf):
    return _feedback(spark, sf)[0].verdicts.select("seq", "entity", "action", "verdict")


@query("SELECT event_id AS seq, event_type AS raw, 'me' AS owner FROM events")
def raw_feedback(spark, sf):
    """The raw lines, as the log holds them."""
    return read_feedback(spark, f"{_feedback(spark, sf)[1]}/raw").select("seq", "raw", "owner")


@query(f"WITH {_SPOKEN} SELECT DISTINCT 'me' AS owner, first_kind AS kind, value, first_id AS seq FROM f")
def preference_roundtrip(spark, sf):
    """The preferences, as they were saved."""
    return read_preferences(spark, f"{_feedback(spark, sf)[1]}/prefs")


@query("""SELECT DISTINCT CAST('2024-01-01' AS DATE) + CAST(event_id % 3 AS INTEGER) AS run_date,
  'https://x/' || user_id AS url FROM events""")
def snapshot_roundtrip(spark, sf):
    """All events as the snapshots of three runs, one of which is saved twice."""
    place = f"{shared_dir(spark)}/snapshots/{uuid.uuid4().hex}"
    seen = load(spark, sf, "events").select(
        (F.col("event_id") % 3).alias("run"), F.concat(F.lit("https://x/"), F.col("user_id").cast("string")).alias("url"))
    for run in (0, 1, 2, 1):
        write_snapshot(seen.filter(F.col("run") == run), place, f"2024-01-0{run + 1}")
    return read_snapshots(spark, place).select("run_date", "url")


@query(f"""SELECT 'm' || page_id AS id, 'Subject ' || {LANG} AS subject, html AS body FROM pages""")
def message_scan(spark, sf):
    """Messages written as JSON lines and read again: their subject, and the html decoded."""
    place = f"{shared_dir(spark)}/messages/{uuid.uuid4().hex}"
    pages = load(spark, sf, "pages")
    header = F.struct(F.lit("Subject").alias("name"), F.concat(F.lit("Subject "), lang_of()).alias("value"))
    data = F.translate(F.base64(F.encode("html", "utf-8")), "+/\r\n", "-_")
    pages.select(
        F.concat(F.lit("m"), F.col("page_id").cast("string")).alias("id"),
        F.struct(
            F.lit("text/html").alias("mimeType"), F.array(header).alias("headers"),
            F.struct(data.alias("data")).alias("body"),
        ).alias("payload"),
    ).write.json(place)
    read = message_headers(mail_html(read_messages(spark, place)))
    return read.select("id", F.element_at("headers", "subject").alias("subject"), F.col("html").alias("body"))
