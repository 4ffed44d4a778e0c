from __future__ import annotations

from pyspark.sql import functions as F

from postmill import fixed
from postmill.bindings.base import (
    EVENT_TABLE, HOST, PAGE_FORM, PAGE_WORDS, SITE, event_table, load, query, relink,
    site_of, sql_any, sql_rules,
)
from postmill.functions import urls
from postmill.operators import links as L
from postmill.operators.reports import apply_link_report, discovery_report, link_report

KEYS = ["page_id", "url"]


@query(f"""WITH {PAGE_WORDS},
l AS (SELECT {HOST} AS source, rtrim({SITE} || '/' || word, '/') AS link,
        min(page_id * 16777216 + pos) AS seq FROM w GROUP BY 1, 2),
r AS (SELECT source, row_number() OVER (PARTITION BY link ORDER BY seq) AS rn FROM l)
SELECT source, count(*) AS "found", count(*) FILTER (rn = 1) AS "new" FROM r GROUP BY source""")
def page_links(spark, sf):
    """Links found on each site, and first seen there."""
    found = L.canonical_page_links(L.resolve_links(L.hrefs(load(spark, sf, "pages"), KEYS)))
    return discovery_report(
        found.select(
            urls.host("url").alias("source"),
            F.col("link").alias("url"),
            L.arrival("page_id", "pos").alias("seq"),
        )
    )


@query(f"""WITH {PAGE_WORDS}
SELECT page_id, pos, '/' || word AS href, {SITE} || '/' || word AS "full" FROM w""", ints="pos")
def page_hrefs(spark, sf):
    return L.resolve_links(L.hrefs(load(spark, sf, "pages"), KEYS)).select(
        "page_id", "pos", "href", "full"
    )


@query("""WITH a AS (
  SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href,
    unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS text,
    generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">', 1), 1) - 1 AS pos
  FROM pages) SELECT page_id, pos, href, trim(text) AS text FROM a""", ints="pos")
def anchor_texts(spark, sf):
    return L.anchors(load(spark, sf, "pages"), ["page_id"])


@query(f"""SELECT page_id, {PAGE_FORM} AS page_link,
  rtrim(regexp_replace(url, '[?#].*$', ''), '/') AS board_link FROM pages""")
def canonical_urls(spark, sf):
    pages = load(spark, sf, "pages").select("page_id", F.col("url").alias("full"))
    by_page = L.canonical_page_links(pages).withColumnRenamed("link", "page_link")
    by_board = L.canonical_board_links(pages).withColumnRenamed("link", "board_link")
    return by_page.join(by_board, "page_id").select("page_id", "page_link", "board_link")


@query("""WITH f AS (SELECT page_id, unnest([url, regexp_replace(url, '^https?:', ''),
    regexp_replace(url, '^https?://', ''), replace(url, 'http', 'HTTP'), '  ']) AS raw,
    unnest([0, 1, 2, 3, 4]) AS form FROM pages)
SELECT page_id, form, CASE WHEN trim(raw) = '' THEN '' WHEN lower(raw) LIKE 'http%://%' THEN raw
  WHEN raw LIKE '//%' THEN 'https:' || raw ELSE 'https://' || raw END AS raw FROM f""")
def with_protocol(spark, sf):
    forms = F.array(
        F.col("url"), F.regexp_replace("url", "^https?:", ""),
        F.regexp_replace("url", "^https?://", ""),
        F.replace("url", F.lit("http"), F.lit("HTTP")), F.lit("  "),
    )
    raw = load(spark, sf, "pages").select("page_id", F.posexplode(forms).alias("form", "raw"))
    return L.ensure_protocol(raw, "raw")


@query(f"""WITH p AS (SELECT page_id, url, {SITE} AS site,
    regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path,
    CASE WHEN contains(url, '?') THEN regexp_extract(url, '(\\?[^#]*)', 1) ELSE '' END AS q FROM pages),
d AS (SELECT *, regexp_replace(path, '[^/]*$', '') AS dir FROM p)
SELECT page_id, unnest(['/x', '//cdn.example.com/x', 'a/b', '../x', './x?y=1', '?q=1', '#f',
    'mailto:a@example.com', '', '/a/../b']) AS href,
  unnest([site || '/x', split_part(url, ':', 1) || '://cdn.example.com/x', site || dir || 'a/b',
    site || regexp_replace(dir, '[^/]+/$', '') || 'x', site || dir || 'x?y=1',
    site || path || '?q=1', site || path || q || '#f', 'mailto:a@example.com', url,
    site || '/b']) AS "full"
FROM d""")
def resolved_links(spark, sf):
    forms = ["/x", "//cdn.example.com/x", "a/b", "../x", "./x?y=1", "?q=1", "#f",
             "mailto:a@example.com", "", "/a/../b"]
    pages = load(spark, sf, "pages").select(
        "page_id", "url", F.explode(F.array(*map(F.lit, forms))).alias("href")
    )
    return L.resolve_links(pages).select("page_id", "href", "full")


_FORMS = ["/", "/careers/job-", "/blog/jobs/1", "/jobs/", "/openings/", "/about/position/"]


@query(f"""WITH {PAGE_WORDS},
l AS (SELECT page_id, pos, unnest({_FORMS}) AS form, {SITE} AS site, word FROM w),
u AS (SELECT page_id, pos, form, site || form || word AS link FROM l)
SELECT page_id, pos, form, link, length(link) >= 10
  AND NOT {sql_any('lower(link)', fixed.EXCLUDED_LINK_PARTS)}
  AND {sql_rules('link', fixed.POSTING_LINK_PATTERNS)} AS is_posting FROM u""", ints="pos")
def posting_links(spark, sf):
    words = L.hrefs(load(spark, sf, "pages"), KEYS)
    forms = words.withColumn("form", F.explode(F.array(*map(F.lit, _FORMS))))
    link = F.concat(site_of("url"), F.col("form"), F.ltrim("href", F.lit("/")))
    return L.classify_links(
        forms.select("page_id", "pos", "form", link.alias("link"))
    )


@query(f"""SELECT page_id, 'https://boards.greenhouse.io/' || upper(split_part({HOST}, '.', 1))
    || '/jobs/' || page_id AS link,
  lower(split_part({HOST}, '.', 1)) AS slug, CAST(page_id AS VARCHAR) AS posting_no
FROM pages WHERE regexp_matches({HOST}, '^[a-zA-Z0-9_-]+\\.')""")
def board_slugs(spark, sf):
    slug = F.upper(F.split_part(urls.host("url"), F.lit("."), F.lit(1)))
    full = F.concat(
        F.lit("https://boards.greenhouse.io/"), slug, F.lit("/jobs/"),
        F.col("page_id").cast("string"), F.lit("/?gh=1#a"),
    )
    pages = load(spark, sf, "pages").select("page_id", full.alias("full"))
    return L.canonical_board_links(L.board_slugs(pages)).select(
        "page_id", "link", "slug", "posting_no"
    )


_HOSTED = ["https://boards.greenhouse.io/", "https://Acme-1.greenhouse.io/", "https://jobs.lever.co/",
           "https://apply.workable.com/", "https://jobs.ashbyhq.com/", "https://example.com/"]


@query(f"""WITH {PAGE_WORDS}, l AS (SELECT page_id, pos, word, unnest({_HOSTED}) AS host FROM w)
SELECT page_id, pos, host || word AS apply_url FROM l WHERE host <> 'https://example.com/'""", ints="pos")
def hosted_links(spark, sf):
    words = L.hrefs(load(spark, sf, "pages"), ["page_id"])
    full = F.concat(F.lit("https://r.example.com/?to="), F.col("host"), F.ltrim("href", F.lit("/")),
                    F.lit("' x"))
    hosts = words.withColumn("host", F.explode(F.array(*map(F.lit, _HOSTED))))
    return L.hosted_links(hosts.select("page_id", "pos", full.alias("full"))).select(
        "page_id", "pos", "apply_url"
    )


@query(f"""WITH {EVENT_TABLE},
c AS (SELECT seq, p, v FROM (SELECT seq, job_url,
    CASE WHEN job_url LIKE '%/' THEN rtrim(job_url, '/') ELSE job_url || '/' END AS twin,
    CASE WHEN contains(job_url, '/comm/jobs/view/') THEN replace(job_url, '/comm/jobs/view/', '/jobs/view/')
      ELSE replace(job_url, '/jobs/view/', '/comm/jobs/view/') END AS other,
    contains(job_url, '/comm/jobs/view/') AS tracked FROM ev),
  LATERAL (VALUES (0, job_url), (1, twin), (2, other), (3, CASE WHEN tracked THEN rtrim(other, '/') END)) x(p, v)
  WHERE v IS NOT NULL),
f AS (SELECT seq, v, min(p) AS p FROM c GROUP BY seq, v)
SELECT seq, row_number() OVER (PARTITION BY seq ORDER BY p) - 1 AS prio, v AS variant FROM f""", ints="prio")
def url_variants(spark, sf):
    return L.match_variants(event_table(spark, sf), "job_url").select("seq", "prio", "variant")


_ALERT = "https://www.linkedin.com/comm/jobs/view/$1?trk=a&amp;r=2"


@query(f"""WITH {PAGE_WORDS},
f AS (SELECT page_id, 'https://www.linkedin.com/jobs/view/' || word AS url, min(pos) AS pos
      FROM w GROUP BY 1, 2)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS pos, url FROM f""", ints="pos")
def alert_links(spark, sf):
    mail = load(spark, sf, "pages").withColumn("html", relink(_ALERT))
    return L.alert_links(mail, ["page_id"])


@query(f"""WITH {PAGE_WORDS}
SELECT page_id, pos, 'https://www.linkedin.com/jobs/view/' || word AS url FROM w""", ints="pos")
def alert_urls(spark, sf):
    words = L.hrefs(load(spark, sf, "pages"), ["page_id"])
    raw = F.concat(
        F.lit("https://www.linkedin.com/comm/jobs/view"), F.col("href"), F.lit("?a=1&amp;b=2")
    )
    other = F.concat(F.lit("https://example.com/jobs/view"), F.col("href"))
    both = words.select("page_id", "pos", F.explode(F.array(raw, other)).alias("href"))
    return L.canonical_alert_urls(both).select("page_id", "pos", "url")


_MARKED = '<a href="/(the[^"]*|[A-Z][^"]*)">'


@query(f"""WITH {PAGE_WORDS},
m AS (SELECT page_id, {SITE} || '/jobs/' || min_by(word, pos) AS link FROM w
  WHERE regexp_matches(word, '^(the|[A-Z])') GROUP BY page_id, url)
SELECT p.page_id, m.link AS open_roles_url, m.link AS careers_url
FROM pages p LEFT JOIN m USING (page_id)""")
def listing_links(spark, sf):
    """First link to open roles and first careers link of each page."""
    pages = load(spark, sf, "pages").withColumn(
        "html", F.regexp_replace("html", _MARKED, '<a href="/jobs/$1">See jobs ')
    )
    lists = L.resolve_lists(L.anchor_lists(pages, KEYS))
    return L.careers_link(L.open_roles_link(lists)).select(
        "page_id", "open_roles_url", "careers_url"
    )


@query(f"""WITH {PAGE_WORDS}
SELECT page_id, count(*) AS links, count(*) FILTER (NOT {sql_any(f"lower({SITE} || '/job/' || word)", fixed.EXCLUDED_LINK_PARTS)})
  AS postings FROM w GROUP BY page_id""")
def page_link_report(spark, sf):
    pages = load(spark, sf, "pages").withColumn("html", relink("/job/$1"))
    return link_report(pages, KEYS).select("page_id", "links", "postings")


@query(f"""WITH {PAGE_WORDS}
SELECT page_id, count(*) AS links, count(*) FILTER (contains(lower(word), 'ie')) AS apply_texts,
  count(*) FILTER (contains(lower(word), 'ie') OR contains(lower(word), 'lever')) AS apply_links
FROM w GROUP BY page_id""")
def page_apply_report(spark, sf):
    """Anchor texts say `apply` wherever their word has `ie`."""
    html = F.regexp_replace("html", '>([^<>]*[iI][eE][^<>]*)</a>', ">Apply now</a>")
    pages = load(spark, sf, "pages").withColumn("html", html)
    return apply_link_report(pages, KEYS).select("page_id", "links", "apply_texts", "apply_links")
