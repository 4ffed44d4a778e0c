from __future__ import annotations

from pyspark.sql import functions as F

from postmill import fixed
from postmill.bindings.base import (
    EVENT_TABLE, HOST, PAGE_WORDS, SITE, TITLE, by_type, event_table, load, query, site_of,
)
from postmill.functions import urls
from postmill.functions.text import eastern_text
from postmill.operators.dedup import dedup_first
from postmill.operators.sequence import contiguous_ranges
from postmill.sources import files, tables as T

_GRID = ["Job URL", "", "Order-Status", "order status", "Total Price"]


@query("""SELECT o_orderkey AS seq, 'https://o.example.com/' || o_orderkey AS job_url,
  CASE WHEN o_orderstatus <> 'P' THEN 'x' ELSE '' END AS __col_1,
  CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus ELSE '' END AS order_status,
  CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE '' END AS order_status__1,
  CASE WHEN o_orderstatus = 'F' THEN 'y' ELSE '' END AS total_price FROM orders""")
def grid_scan(spark, sf):
    """Ragged rows: one cell for status P, three for O, six for F."""
    status = F.col("o_orderstatus")
    wide = [
        F.concat(F.lit("https://o.example.com/"), F.col("o_orderkey").cast("string")),
        F.lit("x"), status, F.col("o_orderpriority"), F.lit("y"), F.lit("surplus"),
    ]
    cells = F.when(status == "F", F.array(*wide)).when(
        status == "O", F.array(*wide[:3])
    ).otherwise(F.array(*wide[:1]))
    grid = load(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), cells.alias("cells"))
    return T.from_grid(grid, _GRID)


@query("""SELECT o_orderkey AS seq, o_orderpriority AS "Order Priority", '' AS missing,
  CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus AS "O_OrderStatus" FROM orders""")
def bound_columns(spark, sf):
    """Columns found by normalised name, then aligned to a target layout."""
    orders = load(spark, sf, "orders").withColumnRenamed("o_orderkey", "seq")
    bound = T.bind(
        orders.withColumnRenamed("o_orderpriority", "Order-Priority"),
        ["order priority", "O_OrderStatus", "o_custkey"],
    ).withColumnRenamed("order priority", "order_priority")
    return T.align(bound, ["Order Priority", "missing", "o_custkey", "O_OrderStatus"])


@query(f"""WITH {EVENT_TABLE}
SELECT seq, job_url, source, company FROM ev UNION ALL
SELECT (SELECT max(seq) FROM ev) + 1 + doc_id, 'https://d.example.com/' || doc_id, source, ''
FROM documents""")
def appended_rows(spark, sf):
    rows = load(spark, sf, "documents").select(
        F.col("doc_id").alias("seq"),
        F.concat(F.lit("https://d.example.com/"), F.col("doc_id").cast("string")).alias("job_url"),
        "source",
    )
    return T.append(event_table(spark, sf), rows).select("seq", "job_url", "source", "company")


_PATCHED = ["company", "location", "role_title", "fetch_status"]


@query(f"""WITH {EVENT_TABLE},
p AS (SELECT user_id, event_id, unnest(['company', 'location', 'role_title', 'fetch_status']) AS c,
    unnest([CASE event_type WHEN 'view' THEN 'v' || event_id WHEN 'purchase' THEN ''
              WHEN 'signup' THEN 's' || event_id END,
            CASE WHEN event_type = 'purchase' THEN 'p' || event_id END,
            CASE WHEN event_type = 'click' THEN '' END,
            CASE WHEN event_type = 'signup' THEN 'pending' END]) AS v FROM events),
m AS (SELECT user_id, c, arg_max(v, event_id) AS v FROM p WHERE v IS NOT NULL GROUP BY 1, 2)
SELECT seq, source, """ + ", ".join(
    f"coalesce((SELECT v FROM m WHERE m.user_id = ev.seq AND m.c = '{c}'), {c}) AS {c}"
    for c in _PATCHED
) + " FROM ev")
def sparse_patch(spark, sf):
    """Every event patches the row numbered like its user: many patches to few rows."""
    eid = F.col("event_id").cast("string")
    none = F.create_map().cast("map<string,string>")
    kind = F.col("event_type")
    changes = (
        F.when(kind == "view", F.create_map(F.lit("company"), F.concat(F.lit("v"), eid)))
        .when(kind == "purchase", F.create_map(
            F.lit("company"), F.lit(""), F.lit("location"), F.concat(F.lit("p"), eid)))
        .when(kind == "click", F.create_map(F.lit("role_title"), F.lit(None).cast("string")))
        .when(kind == "signup", F.create_map(
            F.lit("company"), F.concat(F.lit("s"), eid), F.lit("fetch_status"), F.lit("pending")))
        .otherwise(none)
    )
    patches = load(spark, sf, "events").select(
        F.col("user_id").alias("seq"), F.col("event_id").alias("patch_seq"),
        changes.alias("changes"),
    )
    return T.apply_patches(event_table(spark, sf), patches).select("seq", "source", *_PATCHED)


@query(f"""WITH {EVENT_TABLE}
SELECT seq, job_url FROM ev WHERE seq NOT IN (SELECT user_id FROM events)""")
def deleted_rows(spark, sf):
    keys = load(spark, sf, "events").select(F.col("user_id").alias("seq"))
    return T.delete_rows(event_table(spark, sf), keys).select("seq", "job_url")


@query("""WITH v AS (SELECT DISTINCT o_orderkey + CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1000000000000
    ELSE 2000000000000 END AS v FROM orders),
g AS (SELECT v, v - row_number() OVER (ORDER BY v) AS run FROM v WHERE v >= 2)
SELECT min(v) AS range_start, max(v) AS range_end FROM g GROUP BY run""")
def order_islands(spark, sf):
    """Runs of order keys of one status, over all orders: each status has a range of its own."""
    status = F.col("o_orderstatus")
    apart = F.when(status == "F", 0).when(status == "O", 1_000_000_000_000).otherwise(2_000_000_000_000)
    orders = load(spark, sf, "orders").select((F.col("o_orderkey") + apart).alias("v"))
    return contiguous_ranges(orders, "v")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, trim(line) AS value FROM l
WHERE trim(line) <> '' AND trim(line) NOT LIKE '#%' AND contains(trim(line), 'an')""")
def seed_lines(spark, sf):
    lines = load(spark, sf, "documents").select(
        "doc_id", F.explode(F.split("text", "\n")).alias("value")
    )
    return files.seed_lines(lines, "an")


@query("""WITH h AS (SELECT DISTINCT CAST(ts AS DATE) AS run_date, 'u/' || user_id AS url FROM events)
SELECT url FROM h WHERE run_date = (SELECT max(run_date) FROM h)""")
def latest_snapshot(spark, sf):
    return files.latest_snapshot(_history(spark, sf))


def _history(spark, sf):
    return load(spark, sf, "events").select(
        F.to_date("ts").alias("run_date"),
        F.concat(F.lit("u/"), F.col("user_id").cast("string")).alias("url"),
    ).distinct()


@query(f"""SELECT page_id, {TITLE} AS subject, {HOST} AS sender, 3 AS n FROM pages""")
def message_headers(spark, sf):
    """Repeated names, mixed case: the last one counts."""
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    title = F.trim(F.regexp_extract("html", "<title>(.*?)</title>", 1))
    mail = load(spark, sf, "pages").select(
        "page_id",
        F.struct(
            F.array(
                pair("Subject", F.lit("old")), pair("From", urls.host("url")),
                pair("SUBJECT", title), pair("X", F.lit("1")),
            ).alias("headers")
        ).alias("payload"),
    )
    h = F.col("headers")
    return files.message_headers(mail).select(
        "page_id", h["subject"].alias("subject"), h["from"].alias("sender"),
        F.size(h).alias("n"),
    )


@query("""SELECT event_id FROM events WHERE event_type IN ('view', 'click')""")
def api_captures(spark, sf):
    """Only graphql answers of the API host with a filled JSON object are kept."""
    api = "https://api.swooped.co/"
    captures = load(spark, sf, "events").select(
        "event_id",
        by_type(view=api + "graphql", click=api + "GraphQL?x", error=api + "rest",
                purchase="https://example.com/graphql", signup=api + "graphql").alias("url"),
        by_type(view='{"a":1}', click='{"data":{}}', error='{"a":1}', purchase='{"a":1}',
                signup="[1]").alias("body"),
    )
    return files.api_bodies(captures).select("event_id")


@query(f"""SELECT page_id AS seq, {HOST} AS company,
  CASE WHEN url LIKE 'https:%' THEN {SITE} ELSE '' END AS company_url,
  CASE WHEN contains(url, '?') THEN url ELSE '' END AS career_site_url
FROM pages WHERE url LIKE 'https:%' OR contains(url, '?')""")
def company_list(spark, sf):
    pages = load(spark, sf, "pages").select(
        F.col("page_id").alias("seq"),
        F.concat(F.lit(" "), urls.host("url")).alias("Company"),
        F.when(F.col("url").startswith("https:"), site_of("url")).alias("company url"),
        F.when(F.col("url").contains("?"), F.col("url")).otherwise("\t").alias("Career-Site-URL"),
    )
    return T.read_companies(pages)


@query("""SELECT min(doc_id) AS doc_id, md5(text) AS digest FROM documents GROUP BY md5(text)""")
def first_docs(spark, sf):
    docs = load(spark, sf, "documents").select(F.md5("text").alias("digest"), "doc_id")
    return dedup_first(docs, ["digest"], ["doc_id"])


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn
  FROM events) SELECT user_id, event_type, event_id, value FROM r WHERE rn = 1""")
def first_events(spark, sf):
    """First-wins with payload."""
    events = load(spark, sf, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return dedup_first(events, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("""SELECT event_id, strftime(ts - INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S') || ' EST' AS seen_at FROM events""")
def event_times(spark, sf):
    """When events were seen, as tables store it; all are in winter."""
    return load(spark, sf, "events").select("event_id", eastern_text("ts").alias("seen_at"))
