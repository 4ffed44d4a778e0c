from __future__ import annotations

from pyspark.sql import functions as F

from postmill import fixed
from postmill.bindings.base import (
    EVENT_TABLE, NOW, PAGE_FORM, PAGE_WORDS, SITE, by_type, event_table, filled, load, query,
    site_of,
)
from postmill.functions import urls
from postmill.operators import history as H
from postmill.operators import upsert as U
from postmill.operators.dedup import key_index as build_index
from postmill.operators.links import arrival, hrefs, resolve_links
from postmill.session import settle


@query("""WITH k AS (SELECT 'https://h.example.com/' || user_id || CASE WHEN event_type = 'click' THEN '/'
    WHEN event_type = 'view' THEN '//' ELSE '' END AS k, event_id AS seq FROM events),
v AS (SELECT k AS key, seq FROM k UNION ALL
  SELECT CASE WHEN k LIKE '%/' THEN rtrim(k, '/') ELSE k || '/' END, seq FROM k)
SELECT key, max(seq) AS row_seq FROM v GROUP BY key""")
def key_index(spark, sf):
    table = load(spark, sf, "events").select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit(" https://h.example.com/"), F.col("user_id").cast("string"),
                 by_type(click="/", view="//")).alias("job_url"),
    )
    return build_index(table)


@query("""WITH h AS (SELECT DISTINCT CAST(ts AS DATE) AS run_date, user_id FROM events)
SELECT CAST(run_date AS VARCHAR) || '/' || user_id AS url FROM h
WHERE NOT EXISTS (SELECT 1 FROM h p WHERE p.user_id = h.user_id AND p.run_date = h.run_date - 1)""")
def daily_delta(spark, sf):
    """Users of a day that the day before did not have, for every day at once."""
    seen = load(spark, sf, "events").select(F.to_date("ts").alias("d"), "user_id").distinct()
    key = lambda day: F.concat(day.cast("string"), F.lit("/"), F.col("user_id").cast("string"))
    current = seen.select(key(F.col("d")).alias("url"))
    previous = seen.select(key(F.date_add("d", 1)).alias("url"))
    return U.snapshot_delta(current, previous)


@query("""WITH h AS (SELECT DISTINCT CAST(ts AS DATE) AS run_date, 'u/' || user_id AS url FROM events)
SELECT run_date, url FROM h WHERE run_date <> DATE '2024-01-30' UNION ALL
SELECT DISTINCT DATE '2024-01-30', 'c/' || c_custkey FROM customer""")
def snapshot_advance(spark, sf):
    history = load(spark, sf, "events").select(
        F.to_date("ts").alias("run_date"),
        F.concat(F.lit("u/"), F.col("user_id").cast("string")).alias("url"),
    ).distinct()
    current = load(spark, sf, "customer").select(
        F.concat(F.lit("c/"), F.col("c_custkey").cast("string")).alias("url")
    )
    return U.advance_snapshot(history, current, "2024-01-30")


def page_table(spark, sf, columns):
    return filled(
        load(spark, sf, "pages").select(
            F.col("page_id").alias("seq"), urls.page_form("url").alias("job_url"),
            F.lit("old").alias("last_seen_at"), F.lit("seed").alias("source"),
        ),
        columns,
    )


def arrivals(spark, sf):
    """Known addresses with the other slash, then every link on the pages."""
    pages = load(spark, sf, "pages")
    known = pages.select(
        F.concat(urls.page_form("url"), F.lit("/")).alias("url"), F.col("page_id").alias("seq"),
        F.lit("k").alias("company"),
    )
    links = resolve_links(hrefs(pages, ["page_id", "url"])).select(
        F.col("full").alias("url"), arrival("page_id", "pos").alias("seq"),
        F.lit("n").alias("company"),
    ).withColumn("seq", F.col("seq") + (1 << 40))
    return known.unionByName(links)


_ARRIVALS = f"""{PAGE_WORDS},
t AS (SELECT page_id AS seq, {PAGE_FORM} AS job_url FROM pages),
a AS (SELECT {SITE} || '/' || word AS url, min(page_id * 16777216 + pos) + 1099511627776 AS seq
      FROM w GROUP BY 1),
n AS (SELECT url, seq + 1 + (SELECT max(seq) FROM t) AS seq FROM a
  WHERE url NOT IN (SELECT job_url FROM t) AND url NOT IN (SELECT job_url || '/' FROM t))"""


def _insert_sql(company, source):
    return f"""WITH {_ARRIVALS}
SELECT seq, 'seed' AS source, '' AS first_seen, '' AS company, job_url, '' AS fetch_status,
  '' AS fetch_attempts FROM t
UNION ALL SELECT seq, '{source}', '{NOW}', '{company}', url, 'pending', '0' FROM n"""


_SHOWN = ["seq", "source", "first_seen", "company", "job_url", "fetch_status", "fetch_attempts"]


@query(_insert_sql("n", "companies"))
def insert_companies(spark, sf):
    table = page_table(spark, sf, fixed.BOARD_COLUMNS)
    return U.insert_new(table, arrivals(spark, sf), "companies", NOW).select(_SHOWN)


@query(_insert_sql("n", "greenhouse"))
def insert_boards(spark, sf):
    rows = arrivals(spark, sf).withColumnRenamed("company", "company_slug")
    table = page_table(spark, sf, fixed.BOARD_COLUMNS)
    return U.insert_new(table, rows, "board", NOW).select(_SHOWN)


@query(f"""WITH t AS (SELECT doc_id AS seq, 'https://jobs.example.com/' || md5(text) || '/' AS job_url
  FROM documents JOIN labels USING (doc_id)),
a AS (SELECT 'https://jobs.example.com/' || md5(text) AS url, min(doc_id) AS doc_id FROM documents
  GROUP BY 1)
SELECT seq, job_url, '' AS source, '' AS company, '' AS fetch_status, '' AS fetch_attempts,
  '' AS last_fetch_at, '' AS text_digest, 0 AS summary_chars FROM t
UNION ALL
SELECT a.doc_id + 1 + (SELECT max(seq) FROM t), url, 'swooped', source, 'fetched', '1', '{NOW}',
  md5(text), least(length(text), 500)
FROM a JOIN documents USING (doc_id) WHERE url || '/' NOT IN (SELECT job_url FROM t)""", ints="summary_chars")
def insert_described(spark, sf):
    """Postings that arrive with their text; copies of a text share an address."""
    docs = load(spark, sf, "documents")
    url = F.concat(F.lit("https://jobs.example.com/"), F.md5("text"))
    labelled = docs.join(load(spark, sf, "labels").select("doc_id"), "doc_id")
    table = filled(
        labelled.select(
            F.col("doc_id").alias("seq"), F.concat(url, F.lit("/")).alias("job_url")
        ),
        fixed.BOARD_COLUMNS,
    )
    rows = docs.select(
        F.col("doc_id").alias("seq"), url.alias("url"), F.col("source").alias("company"),
        F.col("lang").alias("role_title"), F.lit("").alias("location"),
        F.col("text").alias("job_description"),
    )
    text = F.col("job_description")
    return U.insert_new(table, rows, "described", NOW).select(
        "seq", "job_url", "source", "company", "fetch_status", "fetch_attempts", "last_fetch_at",
        F.when(text == "", "").otherwise(F.md5(text)).alias("text_digest"),
        F.length("job_summary").alias("summary_chars"),
    )


@query(f"""WITH {_ARRIVALS}
SELECT seq, job_url, 'seed' AS source, CASE WHEN seq = max(seq) OVER (PARTITION BY job_url)
    THEN '{NOW}' ELSE 'old' END AS last_seen_at, '' AS date_received, '' AS fetch_status FROM t
UNION ALL SELECT seq, url, 'gmail', '{NOW}', '{NOW}', 'pending' FROM n""")
def upsert_touch(spark, sf):
    table = page_table(spark, sf, fixed.MAIL_COLUMNS)
    return U.upsert_touch(table, arrivals(spark, sf), fixed.SOURCE_MAIL, NOW).select(
        "seq", "job_url", "source", "last_seen_at", "date_received", "fetch_status"
    )


@query(f"""WITH {_ARRIVALS}
SELECT (SELECT count(DISTINCT job_url) FROM t) AS existing, (SELECT count(*) FROM n) AS "new",
  (SELECT count(*) FROM t) AS rows_before, (SELECT count(*) FROM t) + (SELECT count(*) FROM n) AS rows_after""")
def upsert_report(spark, sf):
    return U.upsert_report(page_table(spark, sf, fixed.MAIL_COLUMNS), arrivals(spark, sf))


@query(f"""WITH {_ARRIVALS}
SELECT (SELECT count(DISTINCT job_url) FROM t) AS existing, (SELECT count(*) FROM n) AS "new",
  (SELECT count(*) FROM t) AS rows_before, (SELECT count(*) FROM t) + (SELECT count(*) FROM n) AS rows_after""")
def observed_upsert(spark, sf):
    """The same report, counted while the table is written."""
    done = U.touch_observed(page_table(spark, sf, fixed.MAIL_COLUMNS), arrivals(spark, sf), fixed.SOURCE_MAIL, NOW)
    settle(done.table)
    return spark.createDataFrame([done.report()], "existing bigint, new bigint, rows_before bigint, rows_after bigint")


@query(f"""WITH {EVENT_TABLE},
s AS (SELECT user_id AS target, event_id, event_type AS bucket FROM events),
last AS (SELECT target, max(event_id) AS event_id, arg_max(bucket, event_id) AS bucket FROM s GROUP BY 1)
SELECT seq, job_url, coalesce(last.bucket, agent_bucket) AS agent_bucket,
  coalesce('• ' || last.bucket || chr(10) || '• e' || last.event_id, '') AS agent_reasoning
FROM ev LEFT JOIN last ON last.target = ev.seq""")
def score_writeback(spark, sf):
    """Every event scores the row numbered like its user, under one of its address forms."""
    address = F.concat(
        F.lit("https://www.linkedin.com"), by_type(view="/comm", error="/comm"),
        F.lit("/jobs/view/"), F.col("user_id").cast("string"),
    )
    scored = load(spark, sf, "events").select(
        F.concat(address, by_type(signup="/")).alias("url"),
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("bucket"),
        F.array("event_type", F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("why"),
    )
    return U.write_scores(event_table(spark, sf), scored).select(
        "seq", "job_url", "agent_bucket", "agent_reasoning"
    )


@query("""SELECT 0 AS source_rank, c_custkey AS seq, c_name AS company FROM customer UNION ALL
SELECT 1, s_suppkey, s_name FROM supplier UNION ALL SELECT 2, p_partkey, NULL FROM part""")
def union_sources(spark, sf):
    pick = lambda t, k, *c: load(spark, sf, t).select(F.col(k).alias("seq"), *c)
    return U.union_sources(
        pick("customer", "c_custkey", F.col("c_name").alias("company")),
        pick("supplier", "s_suppkey", F.col("s_name").alias("company")),
        pick("part", "p_partkey"),
    )


@query(f"""WITH f AS (SELECT 'https://www.linkedin.com' || CASE WHEN event_type = 'signup' THEN '/comm' ELSE '' END
    || '/jobs/view/' || user_id || CASE WHEN event_type = 'click' THEN '/' ELSE '' END AS url, event_id, user_id FROM events)
SELECT arg_min(url, event_id) AS job_url, min(event_id) AS seq, 'pending' AS fetch_status FROM f GROUP BY user_id""")
def insert_forms(spark, sf):
    """Arrivals under several forms of one address: one row each, under the form that came first."""
    url = F.concat(
        F.lit("https://www.linkedin.com"), by_type(signup="/comm"), F.lit("/jobs/view/"),
        F.col("user_id").cast("string"), by_type(click="/"),
    )
    rows = load(spark, sf, "events").select(F.col("event_id").alias("seq"), url.alias("url"), F.lit("c").alias("company"))
    table = filled(event_table(spark, sf).limit(0), fixed.BOARD_COLUMNS)
    return U.insert_new(table, rows, "companies", NOW).select("job_url", "seq", "fetch_status")


_SEEN = """h AS (SELECT DISTINCT CAST(ts AS DATE) AS run_date, 'u/' || user_id AS url FROM events),
r AS (SELECT *, dense_rank() OVER (ORDER BY run_date) AS n FROM h)"""


def _history(spark, sf):
    return load(spark, sf, "events").select(
        F.to_date("ts").alias("run_date"), F.concat(F.lit("u/"), F.col("user_id").cast("string")).alias("url")
    ).distinct()


@query(f"""WITH {_SEEN}, i AS (SELECT *, n - row_number() OVER (PARTITION BY url ORDER BY n) AS island FROM r)
SELECT url, min(run_date) AS first_run, max(run_date) AS last_run FROM i GROUP BY url, island""")
def history_ranges(spark, sf):
    """What was seen in which run, as ranges of runs."""
    return H.as_ranges(_history(spark, sf)).select("url", "first_run", "last_run")


@query(f"""WITH {_SEEN}, m AS (SELECT max(n) AS n FROM r)
SELECT url FROM r WHERE n = (SELECT n FROM m) AND url NOT IN (SELECT url FROM r WHERE n = (SELECT n FROM m) - 1)""")
def range_delta(spark, sf):
    """The last run's urls that the run before did not have: the history in ranges, run after run."""
    history = _history(spark, sf)
    last = history.agg(F.max("run_date").cast("string")).first()[0] or "2024-01-01"
    current = history.filter(F.col("run_date") == F.lit(last).cast("date"))
    before = H.as_ranges(history.filter(F.col("run_date") < F.lit(last).cast("date")))
    after = settle(H.advance_ranges(before, current, last))
    # done again after it was saved, the delta is the same
    return U.snapshot_delta(H.at_run(after, last), H.last_set(after, before=last))
