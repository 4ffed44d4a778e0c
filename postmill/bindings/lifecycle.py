from __future__ import annotations

from pyspark.sql import functions as F

from postmill import fixed
from postmill.bindings.base import (
    ARTICLE, EVENT_TABLE, LANG, NOW, SHOWN_TITLE, by_type, event_table, filled, lang_of, load, query,
)
from postmill.operators import lifecycle as LC
from postmill.operators.reports import status_counts as count_states
from postmill.operators.scoring import split_closed
from postmill.session import settle

_ELIGIBLE = f"""{EVENT_TABLE},
e AS (SELECT * FROM ev WHERE fetch_status IN ('', 'pending', 'failed', 'timeout')
  AND CAST(fetch_attempts AS INTEGER) < 3)"""


@query(f"WITH {_ELIGIBLE} SELECT seq, job_url, fetch_status FROM e")
def eligible_rows(spark, sf):
    return LC.eligible(event_table(spark, sf), cap=None).select("seq", "job_url", "fetch_status")


@query(f"WITH {_ELIGIBLE} SELECT seq, job_url, fetch_status FROM e ORDER BY seq LIMIT 25")
def eligible_topn(spark, sf):
    """The capped selection of one run."""
    return LC.eligible(event_table(spark, sf), cap=25).select("seq", "job_url", "fetch_status")


@query(f"""WITH {EVENT_TABLE} SELECT seq, source, job_url AS url, role_title AS title, company,
  location AS location_text, job_description FROM ev WHERE fetch_status = 'fetched'""")
def scoreable_rows(spark, sf):
    return LC.scoreable(event_table(spark, sf))


@query(f"""WITH {EVENT_TABLE} SELECT CASE WHEN fetch_status = '' THEN '(empty)' ELSE fetch_status END
  AS fetch_status, count(*) AS n FROM ev GROUP BY 1""")
def status_counts(spark, sf):
    return count_states(event_table(spark, sf))


def attempt_log(spark, sf):
    return load(spark, sf, "events").select(
        F.concat(F.lit("https://jobs.lever.co/u/"), F.col("user_id").cast("string")).alias("url"),
        F.col("event_id").alias("seq"),
        by_type(view="ok", purchase="ok", signup="timeout", click="parse_empty",
                error="http_error").alias("outcome"),
        by_type(error=F.concat(F.lit("E"), (F.col("event_id") % 7).cast("string")))
        .alias("error_type"),
    )


FOLDED = """o AS (SELECT 'https://jobs.lever.co/u/' || user_id AS url, event_id AS seq,
    CASE WHEN event_type IN ('view', 'purchase') THEN 'ok' WHEN event_type = 'signup' THEN 'timeout'
      WHEN event_type = 'click' THEN 'parse_empty' ELSE 'http_error:E' || event_id % 7 END AS outcome
  FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq) AS n FROM o),
u AS (SELECT *, min(CASE WHEN outcome = 'ok' THEN n END) OVER (PARTITION BY url) AS first_ok FROM r),
f AS (SELECT url, max(n) AS fetch_attempts, arg_max(outcome, n) AS outcome FROM u
  WHERE n <= least(3, coalesce(first_ok, 3)) GROUP BY url),
s AS (SELECT url, CAST(fetch_attempts AS INTEGER) AS fetch_attempts,
  CASE outcome WHEN 'ok' THEN 'fetched' WHEN 'timeout' THEN 'timeout' ELSE 'failed' END AS fetch_status,
  CASE outcome WHEN 'ok' THEN '' ELSE outcome END AS fetch_error FROM f)"""


@query(f"WITH {FOLDED} SELECT url, fetch_attempts, fetch_status, fetch_error FROM s")
def attempt_fold(spark, sf):
    return LC.fold_attempts(attempt_log(spark, sf))


@query(f"WITH {FOLDED} SELECT url AS job_url, fetch_status, CAST(fetch_attempts AS VARCHAR) AS fetch_attempts, fetch_error FROM s")
def fetch_runs(spark, sf):
    """Three runs, each given the whole log of all runs: what `attempt_fold` makes of it at once."""
    log = attempt_log(spark, sf)
    empty = F.col("outcome") == "parse_empty"
    attempts = log.select(
        "url", F.col("seq").alias("run"), "error_type",
        F.when(empty, "ok").otherwise(F.col("outcome")).alias("outcome"),
        F.when(empty, "<p></p>").otherwise("<title>Role</title>").alias("html"),
    )
    table = filled(log.groupBy("url").agg(F.min("seq").alias("seq")).select(
        "seq", F.col("url").alias("job_url"), F.lit("pending").alias("fetch_status")
    ), fixed.MAIL_COLUMNS)
    for run in range(3):
        table = settle(LC.apply_outcomes(table, attempts, f"run {run}"))
    return table.select("job_url", "fetch_status", "fetch_attempts", "fetch_error")


_FETCH = f"""p AS (SELECT page_id AS seq, url AS job_url, {LANG} AS lang, {SHOWN_TITLE} AS title,
    {ARTICLE} AS about FROM pages),
d AS (SELECT *, CASE lang WHEN 'fr' THEN 'timeout' WHEN 'de' THEN 'http_error'
    WHEN 'es' THEN 'empty' ELSE 'ok' END AS o FROM p)"""


@query(f"""WITH {_FETCH}
SELECT seq, job_url, CASE WHEN o = 'timeout' THEN 'timeout' WHEN o = 'ok' THEN 'fetched' ELSE 'failed' END
  AS fetch_status, '2' AS fetch_attempts, '{NOW}' AS last_fetch_at,
  CASE o WHEN 'timeout' THEN 'timeout' WHEN 'http_error' THEN 'http_error:ConnectError'
    WHEN 'empty' THEN 'parse_empty' ELSE '' END AS fetch_error,
  CASE WHEN o = 'ok' THEN title ELSE 'old' END AS role_title,
  CASE WHEN o = 'ok' THEN '' ELSE 'old' END AS company,
  CASE WHEN o = 'ok' THEN about ELSE 'old' END AS job_description,
  CASE WHEN o = 'ok' THEN left(about, 500) ELSE 'old' END AS job_summary
FROM d""")
def fetch_outcomes(spark, sf):
    """One run over all pages: by language a page is fetched, times out, fails or is empty."""
    pages = load(spark, sf, "pages")
    old = F.lit("old")
    table = filled(
        pages.select(
            F.col("page_id").alias("seq"), F.col("url").alias("job_url"),
            F.lit("failed").alias("fetch_status"), F.lit("1").alias("fetch_attempts"),
            old.alias("role_title"), old.alias("company"), old.alias("job_description"),
            old.alias("job_summary"),
        ),
        fixed.MAIL_COLUMNS,
    )
    lang = lang_of()
    attempts = pages.select(
        "url", F.lit(1).alias("run"),
        F.when(lang == "fr", "timeout").when(lang == "de", "http_error").otherwise("ok")
        .alias("outcome"),
        F.when(lang == "de", "ConnectError").alias("error_type"),
        F.when(lang == "es", "<p></p>").otherwise(F.col("html")).alias("html"),
    )
    return LC.apply_outcomes(table, attempts, NOW, run=1).select(
        "seq", "job_url", "fetch_status", "fetch_attempts", "last_fetch_at", "fetch_error",
        "role_title", "company", "job_description", "job_summary",
    )


@query(f"""WITH {EVENT_TABLE} SELECT seq, CASE fetch_status WHEN 'fetched' THEN 'pending' ELSE fetch_status END
  AS fetch_status, CASE fetch_status WHEN 'fetched' THEN '0' ELSE fetch_attempts END AS fetch_attempts,
  role_title, agent_bucket FROM ev""")
def reset_fetched(spark, sf):
    return LC.reset_fetched(event_table(spark, sf)).select(
        "seq", "fetch_status", "fetch_attempts", "role_title", "agent_bucket"
    )


@query(f"""WITH {EVENT_TABLE}, h AS (SELECT *, contains(job_url, '/comm/jobs/view/') AS hit FROM ev)
SELECT seq, replace(job_url, '/comm/jobs/view/', '/jobs/view/') AS job_url,
  CASE WHEN hit THEN 'pending' ELSE fetch_status END AS fetch_status,
  CASE WHEN hit THEN '0' ELSE fetch_attempts END AS fetch_attempts,
  CASE WHEN hit THEN '' ELSE fetch_error END AS fetch_error,
  CASE WHEN hit THEN '' ELSE company END AS company,
  CASE WHEN hit THEN '' ELSE location END AS location,
  CASE WHEN hit THEN '' ELSE agent_bucket END AS agent_bucket, source FROM h""")
def repair_urls(spark, sf):
    return LC.repair_urls(event_table(spark, sf)).select(
        "seq", "job_url", "fetch_status", "fetch_attempts", "fetch_error", "company", "location",
        "agent_bucket", "source",
    )


@query(f"WITH {EVENT_TABLE} SELECT seq, job_url, agent_bucket FROM ev WHERE lower(trim(agent_bucket)) <> 'reject'")
def pruned_rows(spark, sf):
    return LC.prune(event_table(spark, sf)).select("seq", "job_url", "agent_bucket")


@query(f"""WITH {EVENT_TABLE}, i AS (SELECT *, trim(agent_bucket) <> '' AS scored FROM ev)
SELECT 'state_undefined' AS rule, true AS must_be_zero, count(*) AS n FROM i WHERE fetch_status = ''
UNION ALL SELECT 'attempts_out_of_range', true, count(*) FROM i WHERE fetch_attempts = '4'
UNION ALL SELECT 'duplicate_key', true, count(*) - count(DISTINCT company || CASE source WHEN 'signup' THEN '/' ELSE '' END) FROM i
UNION ALL SELECT 'duplicate_form', true, count(DISTINCT company || CASE source WHEN 'signup' THEN '/' ELSE '' END) - count(DISTINCT company) FROM i
UNION ALL SELECT 'fetched_unscored', false, count(*) FROM i WHERE fetch_status = 'fetched' AND NOT scored
UNION ALL SELECT 'scored_not_fetched', false, count(*) FROM i WHERE fetch_status <> 'fetched' AND scored
UNION ALL SELECT 'fetched_empty', false, count(*) FROM i WHERE fetch_status = 'fetched' AND role_title = ''""")
def invariants(spark, sf):
    """Keyed by company here, with and without a slash, so that there are repeated keys and forms to count."""
    slash = F.when(F.col("source") == "signup", "/").otherwise("")
    return LC.check_invariants(event_table(spark, sf).withColumn("job_url", F.concat("company", slash)))


_PHRASES = ["the the", "edea", "einer d"]


@query("""SELECT doc_id AS seq, source AS url, contains(lower(text), 'the the') OR contains(lower(text), 'edea')
  OR contains(lower(text), 'einer d') AS closed FROM documents""")
def closed_split(spark, sf):
    docs = load(spark, sf, "documents").select(
        F.col("doc_id").alias("seq"), F.col("source").alias("url"),
        F.col("text").alias("job_description"), F.col("lang").alias("location_text"),
    )
    closed, waiting = split_closed(docs, _PHRASES)
    return closed.select("seq", "url", F.lit(True).alias("closed")).unionByName(
        waiting.select("seq", "url", F.lit(False).alias("closed"))
    )
