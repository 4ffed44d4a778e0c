from __future__ import annotations

from pyspark.sql import functions as F

from postmill.bindings.base import (
    ARTICLE, HOST, LANG, PAGE_WORDS, SITE, SHOWN_TITLE, TITLE, lang_of, load, query, relink,
)
from postmill.functions import urls
from postmill.operators import extract as X
from postmill.operators.reports import page_report as report_pages
from postmill.sources import files

KEYS = ["page_id", "url"]
_H1 = "trim(regexp_extract(html, '<h1>(.*?)</h1>', 1))"


@query(f"""WITH f AS (SELECT page_id, {HOST} AS h, {TITLE} AS t, {LANG} AS lang FROM pages),
t AS (SELECT page_id, unnest(['in', 'role', 'plain']) AS form,
  unnest([h || ' hiring ' || t || ' in ' || lang || ' | LinkedIn', h || ' hiring ' || replace(t, ' in', ' an') ,
          t || ' | LinkedIn']) AS title, h, t, lang FROM f)
SELECT page_id, form, CASE WHEN form = 'plain' THEN '' ELSE h END AS company,
  CASE form WHEN 'in' THEN t WHEN 'role' THEN replace(t, ' in', ' an') ELSE title END AS role_title,
  CASE WHEN form = 'in' THEN lang ELSE '' END AS location FROM t""")
def title_split(spark, sf):
    title = F.trim(F.regexp_extract("html", "<title>(.*?)</title>", 1))
    lead = F.concat(urls.host("url"), F.lit(" hiring "))
    forms = {
        "in": F.concat(lead, title, F.lit(" in "), lang_of(), F.lit(" | LinkedIn")),
        "role": F.concat(lead, F.replace(title, F.lit(" in"), F.lit(" an"))),
        "plain": F.concat(title, F.lit(" | LinkedIn")),
    }
    rows = load(spark, sf, "pages").select(
        "page_id",
        F.explode(F.array(*[F.struct(F.lit(k).alias("form"), v.alias("title"))
                            for k, v in forms.items()])).alias("t"),
    )
    return X.split_titles(rows.select("page_id", "t.*")).drop("title")


@query(f"""SELECT page_id, CASE WHEN {LANG} IN ('en', 'fr') AND {_H1} <> '' THEN {_H1} ELSE {LANG} END
  AS role_title FROM pages""")
def generic_titles(spark, sf):
    lang = lang_of()
    rows = load(spark, sf, "pages").select(
        "page_id",
        F.when(lang == "en", " Careers").when(lang == "fr", "Join our TEAM!").otherwise(lang)
        .alias("role_title"),
        F.trim(F.regexp_extract("html", "<h1>(.*?)</h1>", 1)).alias("h1"),
    )
    return X.fix_generic_titles(rows).drop("h1")


@query(f"""SELECT page_id, {SHOWN_TITLE} AS role_title, '' AS company, '' AS location,
  {ARTICLE} AS description, CAST(NULL AS VARCHAR) AS parse_error FROM pages""")
def page_fields(spark, sf):
    return X.parse_pages(load(spark, sf, "pages"), ["page_id"])


@query(f"""WITH p AS (SELECT page_id, {ARTICLE} AS about, {SHOWN_TITLE} AS t,
  contains(html, '</body>') AS ended FROM pages)
SELECT page_id, CASE WHEN length(about) < 100 AND ended THEN t ELSE about END AS description FROM p""")
def page_descriptions(spark, sf):
    """A container marked as description stands in where the main text is short."""
    title = F.trim(F.regexp_extract("html", "<title>(.*?)</title>", 1))
    pages = load(spark, sf, "pages").withColumn(
        "html",
        F.replace("html", F.lit("</body>"), F.concat(
            F.lit('<div class="x Job-Description">'), title, F.lit("</div></body>"))),
    )
    return X.descriptions(pages, ["page_id"])


@query(f"""SELECT doc_id, trim(regexp_replace(text, '[\\s]+', ' ', 'g')) AS text FROM documents""")
def plain_documents(spark, sf):
    return X.to_text(load(spark, sf, "documents").select("doc_id", "text"), "text")


@query(f"SELECT page_id, {ARTICLE} AS html FROM pages")
def article_text(spark, sf):
    articles = load(spark, sf, "pages").select(
        "page_id", F.regexp_extract("html", "(?s)<article>(.*?)</article>", 1).alias("html")
    )
    return X.to_text(articles, "html")


@query("""SELECT doc_id, 'Doc ' || doc_id AS role_title, source AS company,
  CASE WHEN lang = 'en' THEN lang ELSE '' END AS location,
  trim(regexp_replace(text, '\\s+', ' ', 'g')) AS description FROM documents""")
def jsonld_postings(spark, sf):
    """Every document as a page with a structured posting behind a broken script."""
    place = F.when(
        F.col("lang") == "en",
        F.to_json(F.struct(F.struct(F.col("lang").alias("addressLocality")).alias("address"))),
    ).otherwise(F.lit('["x"]'))
    posting = F.concat(
        F.lit('[{"@type":"Thing"},{"@type":"JobPosting","title":'),
        F.concat(F.lit('"Doc '), F.col("doc_id").cast("string"), F.lit('"')),
        F.lit(',"hiringOrganization":'), F.to_json(F.struct(F.col("source").alias("name"))),
        F.lit(',"jobLocation":'), place,
        F.lit(',"description":'), F.regexp_extract(F.to_json(F.struct("text")), r'(?s)^\{"text":(.*)\}$', 1),
        F.lit("}]"),
    )
    script = '<script type="application/ld+json">'
    pages = load(spark, sf, "documents").select(
        "doc_id",
        F.concat(
            F.lit(f"<html><head>{script}{{broken</script>{script}"), posting,
            F.lit("</script></head><body>x</body></html>"),
        ).alias("html"),
    )
    return X.jsonld_postings(pages, ["doc_id"])


@query(f"""WITH {PAGE_WORDS},
f AS (SELECT page_id, {TITLE} AS subject, {HOST} AS sender,
    'https://www.linkedin.com/jobs/view/' || word AS url, min(pos) AS pos FROM w GROUP BY 1, 2, 3, 4)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS pos, 'gmail' AS source, url,
  'Subject: ' || subject || chr(10) || 'From: ' || sender || chr(10) || 'URL: ' || url AS job_description,
  subject AS email_subject FROM f""", ints="pos")
def mail_postings(spark, sf):
    """Pages sent as mail: html in the second part, or one level deeper, by language."""
    return X.mail_postings(messages(spark, sf), ["page_id"]).select(
        "page_id", "pos", "source", "url", "job_description",
        F.col("metadata")["email_subject"].alias("email_subject"),
    )


def messages(spark, sf):
    html = relink("https://www.linkedin.com/comm/jobs/view/$1?trk=a&amp;r=2")
    data = F.translate(F.base64(F.encode(html, "utf-8")), "+/\r\n", "-_")
    body = lambda d: F.struct(d.alias("data"))
    inner = "array<struct<mimeType:string,body:struct<data:string>>>"
    none = F.lit(None).cast(inner)
    part = lambda m, d, p: F.struct(F.lit(m).alias("mimeType"), body(d).alias("body"), p.alias("parts"))
    leaf = F.array(F.struct(F.lit("text/html").alias("mimeType"), body(data).alias("body"))).cast(inner)
    flat = F.array(
        part("text/html", F.lit(None).cast("string"), none), part("text/html", data, none))
    deep = F.array(part("multipart/alternative", F.lit(None).cast("string"), leaf))
    header = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    title = F.trim(F.regexp_extract("html", "<title>(.*?)</title>", 1))
    return load(spark, sf, "pages").select(
        "page_id",
        F.struct(
            F.lit("multipart/mixed").alias("mimeType"),
            F.array(header("SUBJECT", title), header("From", urls.host("url"))).alias("headers"),
            body(F.lit(None).cast("string")).alias("body"),
            F.when(lang_of() == "en", flat).otherwise(deep).alias("parts"),
        ).alias("payload"),
    )


def listed_bodies(spark, sf):
    """One captured body per document: two postings with one address, one of the aggregator's own."""
    doc = F.col("doc_id").cast("string")
    obj = lambda url, company, about: F.struct(
        url.alias("applyUrl"), F.lit("").alias("url"), F.concat(F.lit(" T"), doc).alias("title"),
        F.struct(company.alias("name")).alias("company"), F.col("lang").alias("location"),
        about.alias("jobDescription"),
    )
    url = F.concat(F.lit("https://x.example.com/"), doc)
    list_ = F.array(
        obj(F.concat(F.lit("https://swooped.co/"), doc), F.col("source"), F.col("text")),
        obj(url, F.col("source"), F.col("text")),
        obj(url, F.lit("second"), F.lit("second")),
    )
    body = F.when(
        F.col("lang") == "en", F.to_json(F.struct(F.struct(list_.alias("jobPostings")).alias("data")))
    ).otherwise(F.to_json(F.struct(F.array().alias("jobPostings"), list_.alias("jobs"))))
    captures = load(spark, sf, "documents").select(
        F.col("doc_id").alias("seq"), F.col("source").alias("page"),
        F.lit("https://api.swooped.co/graphql").alias("url"), body.alias("body"),
    )
    return files.api_bodies(captures)


@query("""SELECT doc_id AS seq, 1 AS pos, 'https://x.example.com/' || doc_id AS job_url, source AS company,
  'T' || doc_id AS role_title, lang AS location, text AS job_description FROM documents""")
def api_postings(spark, sf):
    return X.api_postings(listed_bodies(spark, sf)).drop("page")


@query("""SELECT doc_id AS seq, unnest([0, 1]) AS pos,
  unnest(['https://p.example.com/' || doc_id, 'https://c.example.com/' || doc_id]) AS job_url,
  unnest([source, '']) AS company, unnest(['Parent', 'Child']) AS role_title,
  unnest([lang, '']) AS location, unnest([text, '']) AS job_description FROM documents""")
def nested_postings(spark, sf):
    """Bodies without a list: objects with an address at any depth, parents first."""
    doc = F.col("doc_id").cast("string")
    child = F.struct(
        F.lit("Child").alias("name"),
        F.concat(F.lit("https://c.example.com/"), doc).alias("application_url"),
    )
    parent = F.struct(
        F.lit("ftp://no").alias("apply_url"), F.struct(F.col("source").alias("title")).alias("employer"),
        F.lit("Parent").alias("title"), F.array(F.array(child, child)).alias("a_first"),
        F.concat(F.lit("https://p.example.com/"), doc).alias("external_url"),
        F.col("lang").alias("location_text"), F.col("text").alias("body"),
    )
    captures = load(spark, sf, "documents").select(
        F.col("doc_id").alias("seq"), F.col("source").alias("page"),
        F.lit("https://api.swooped.co/graphql").alias("url"),
        F.to_json(F.struct(F.struct(parent.alias("node")).alias("data"))).alias("body"),
    )
    return X.api_postings(files.api_bodies(captures)).drop("page")


@query(f"""WITH {PAGE_WORDS},
f AS (SELECT page_id, 'https://jobs.lever.co/acme/' || word AS job_url, min(pos) AS pos FROM w GROUP BY 1, 2)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS pos, job_url,
  '' AS job_description FROM f""", ints="pos")
def hosted_page_links(spark, sf):
    pages = load(spark, sf, "pages").withColumn("html", relink("https://jobs.lever.co/acme/$1"))
    return X.page_apply_links(pages, KEYS).drop("url")


@query(f"""WITH {PAGE_WORDS},
f AS (SELECT page_id, {SITE} || '/' || word AS job_url, word, min(pos) AS pos FROM w GROUP BY 1, 2, 3)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS pos, job_url,
  'Apply ' || word AS job_description FROM f""", ints="pos")
def apply_page_links(spark, sf):
    """Pages without hosted links: links that speak of applying, with the text around them."""
    html = F.regexp_replace("html", '<a href="/([^"]*)">', '<a href="/$1">Apply ')
    return X.page_apply_links(load(spark, sf, "pages").withColumn("html", html), KEYS).drop("url")


@query(f"""WITH {PAGE_WORDS}
SELECT page_id, {SITE} || '/' || word AS job_url, min(pos) AS pos FROM w GROUP BY 1, 2""", ints="pos")
def apply_buttons(spark, sf):
    html = F.regexp_replace("html", '<a href="/([^"]*)">', '<a href="/$1">Apply ')
    pages = load(spark, sf, "pages").withColumn("html", html)
    return X.apply_buttons(pages, KEYS).drop("url")


@query(f"""SELECT page_id, length(html) AS html_chars, contains(html, '<main>') AS has_main,
  contains(html, '<article>') AS has_article, contains(html, '<body') AS has_body,
  contains(html, 'ld+json') AS has_structured, contains(html, 'JobPosting') AS names_posting,
  length({SHOWN_TITLE}) AS role_title_chars, 0 AS company_chars, 0 AS location_chars,
  length({ARTICLE}) AS description_chars FROM pages""", ints="html_chars role_title_chars description_chars")
def page_report(spark, sf):
    return report_pages(load(spark, sf, "pages"), ["page_id"])
