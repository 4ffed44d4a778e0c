"""Edge rows of the extraction operators."""

from __future__ import annotations

import base64
import json

from pyspark.sql import functions as F

from postmill.operators import extract as X
from postmill.sources import files


def pages(spark, *htmls):
    rows = [(i, "https://h.io/", h) for i, h in enumerate(htmls)]
    return spark.createDataFrame(rows, "id int, url string, html string")


def b64(text):
    raw = text if isinstance(text, bytes) else text.encode()
    return base64.urlsafe_b64encode(raw).decode()


def part(mime, data=None, parts=None):
    return {"mimeType": mime, "body": {"data": data}, "parts": parts}


def test_mail_body_choice(spark, tmp_path):
    link = '<a href="https://www.linkedin.com/jobs/view/1">ü</a>'
    leaf = {"mimeType": "text/html", "body": {"data": b64("deep" + link)}}
    payloads = {
        "top": {"mimeType": "text/html", "body": {"data": b64("top" + link)}},
        "skip": {"mimeType": "multipart/mixed", "body": {}, "parts": [
            part("text/html"), part("text/html", b64("second" + link))]},
        "deep": {"mimeType": "multipart/mixed", "body": {}, "parts": [
            part("text/plain", b64("plain")), part("multipart/x", None, [leaf])]},
        "none": {"mimeType": "text/plain", "body": {"data": b64("x")}},
        "bad": {"mimeType": "text/html", "body": {"data": b64(b"a\xffb")}},
    }
    headers = [{"name": "Subject", "value": "first"}, {"name": "FROM", "value": "me"},
               {"name": "subject", "value": "last"}]
    with open(tmp_path / "m.json", "w") as f:
        for name, payload in payloads.items():
            f.write(json.dumps({"id": name, "payload": payload | {"headers": headers}}) + "\n")
    messages = files.read_messages(spark, str(tmp_path))
    html = {r.id: r.html for r in X.mail_html(messages).collect()}
    assert set(html) == {"top", "skip", "deep", "bad"}
    assert html["skip"].startswith("second") and html["deep"].startswith("deep")
    assert html["bad"] == "ab" and "ü" in html["top"]
    got = X.mail_postings(messages).filter("id = 'top'").collect()[0]
    assert got.job_description == (
        "Subject: last\nFrom: me\nURL: https://www.linkedin.com/jobs/view/1")
    assert got.metadata == {"email_subject": "last", "email_sender": "me"}


def test_titles(spark):
    titles = ["Acme hiring PM in Product in Paris | LinkedIn", "Acme hiring PM", "Plain | LinkedIn",
              " Acme  hiring  X | linkedin ", "hiring none"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "id int, title string")
    got = X.split_titles(df).orderBy("id").select("company", "role_title", "location").collect()
    assert [tuple(r) for r in got] == [
        ("Acme", "PM in Product", "Paris"), ("Acme", "PM", ""), ("", "Plain | LinkedIn", ""),
        ("Acme", "X", ""), ("", "hiring none", "")]


def parsed(spark, *htmls):
    return X.parse_pages(pages(spark, *htmls), ["id"]).orderBy("id").collect()


def ld(*scripts, body="<body>text</body>"):
    tags = "".join(f'<script type="application/ld+json">{s}</script>' for s in scripts)
    return f"<html><head><title>T</title>{tags}</head>{body}</html>"


def test_structured_postings(spark):
    job = {"@type": "JobPosting", "title": " Engineer ", "description": "<p>a</p><p>b</p>",
           "hiringOrganization": {"name": "Acme"},
           "jobLocation": {"address": {"addressLocality": "Paris"}}}
    rows = parsed(
        spark,
        ld("{broken", json.dumps([{"@type": "Thing"}, job])),
        ld(json.dumps(job | {"jobLocation": [1], "hiringOrganization": "x"})),
        ld(json.dumps(job | {"hiringOrganization": {"name": None}})),
        ld(json.dumps(job | {"title": "", "description": None})),
        ld(json.dumps(job | {"title": 5})),
    )
    assert tuple(rows[0]) == (0, "Engineer", "Acme", "Paris", "a b", None)
    assert tuple(rows[1]) == (1, "Engineer", "", "", "a b", None)
    assert rows[2].parse_error == "AttributeError" and rows[4].parse_error == "AttributeError"
    assert rows[3].role_title == "T" and rows[3].description == "text"
    only = X.jsonld_postings(pages(spark, ld(json.dumps(job)), "<p>x</p>"), ["id"]).collect()
    assert [r.id for r in only] == [0]


def test_descriptions(spark):
    long = "word " * 30
    rows = parsed(
        spark,
        "<main>" + "m" * 20 + '</main><div class="x Description">' + "d" * 30 + "</div>",
        f"<body><article>{long}</article><main>{long} main</main></body>",
        f'<body><p>body</p><div role="main">{long}role</div></body>',
        '<body>b<div id="job-description"></div></body>',
        f'<body><main>s</main><div class="description">t</div><i data-testid="the-job">{long}</i></body>',
        "<body>a &lt;b&gt; c<script>no</script><style>no</style><!-- no --><template>no</template></body>",
        "", "<p>no body</p>",
    )
    got = [r.description for r in rows]
    assert got[0] == "d" * 30
    assert got[1] == (long + " main").replace("  ", " ").strip()
    assert got[2].endswith("role")
    assert got[3] == "b"
    assert got[4] == long.strip()
    assert got[5] == "a c"  # shown text that looks like a tag is read as one
    assert got[6] == "" and got[7] == ""


def test_generic_titles_and_headings(spark):
    rows = parsed(
        spark, "<title>Careers</title><h1>Soft<b>ware</b> dev</h1>", "<title> CAREERS </title><h1></h1>",
        "<title>Other</title><h1>x</h1>",
    )
    assert [r.role_title for r in rows] == ["Softwaredev", "CAREERS", "Other"]


def test_to_text(spark):
    df = spark.createDataFrame(
        [(0, "a < b"), (1, "<p>a</p><p>b</p>"), (2, " x  \n y\x1f "), (3, None)], "id int, t string")
    assert [r.t for r in X.to_text(df, "t").orderBy("id").collect()] == ["a < b", "a b", "x y", ""]


def bodies(spark, *docs):
    rows = [(i, "p", "https://api.swooped.co/GraphQL", json.dumps(d) if not isinstance(d, str) else d)
            for i, d in enumerate(docs)]
    return files.api_bodies(
        spark.createDataFrame(rows, "seq bigint, page string, url string, body string"))


def test_listed_postings(spark):
    job = {"url": "", "applyUrl": " https://x/1 ", "jobTitle": " T ", "company": {"name": " A "},
           "location": "", "location_text": "L", "jobDescription": "d" * 7000}
    got = X.api_postings(bodies(
        spark,
        {"data": {"jobPostings": [
            job, {"url": "https://swooped.co/1"}, {"url": "https://x/1", "title": "again"}, 7,
            {"apply_url": "https://x/2", "company": "B ", "description": None}]}},
        {"jobs": []},
        {"jobPostings": [], "x": {"job_url": "https://y/1"}},
        {"data": {"jobPostings": None, "jobs": [{"url": "https://z/1"}]}},
        [], {}, "not json",
    )).orderBy("seq", "pos").collect()
    assert [(r.seq, r.job_url, r.company, r.role_title, r.location, len(r.job_description)) for r in got] == [
        (0, "https://x/1", "A", "T", "L", 7000), (0, "https://x/2", "B", "", "", 0),
        (2, "https://y/1", "", "", "", 0), (3, "https://z/1", "", "", "", 0)]


def test_walked_postings(spark):
    doc = {"z": {"external_url": "https://p", "name": "P", "employer": {"title": "E"},
                 "a": [{"url": "https://c1"}, [{"url": "https://c2"}]]},
           "b": {"url": "https://c1", "title": "late"}, "c": {"apply_url": "ftp://x", "url": "https://swooped.co"}}
    got = X.api_postings(bodies(spark, doc)).orderBy("pos").collect()
    assert [(r.job_url, r.role_title, r.company) for r in got] == [
        ("https://p", "P", "E"), ("https://c1", "", ""), ("https://c2", "", "")]


def test_rendered_pages(spark):
    about = "about " * 30
    rows = X.page_apply_links(pages(
        spark,
        f'<div>{about}<a href="https://jobs.lever.co/a/1?x">Go</a></div>'
        '<li><a href="https://jobs.lever.co/a/2">short</a></li><a href="/apply">Apply</a>'
        '<a href="https://jobs.lever.co/a/1?x">again</a>',
        '<li>near <a href="/in">Apply now</a></li><a href="https://swooped.co/apply">Apply</a>'
        '<a href="#x">For Employers</a>',
    ), ["id", "url"]).orderBy("id", "pos").collect()
    assert [(r.id, r.job_url, r.job_description[:8]) for r in rows] == [
        (0, "https://jobs.lever.co/a/1?x", "about ab"), (0, "https://jobs.lever.co/a/2", ""),
        (1, "https://h.io/in", "near App"), (1, "https://h.io/#x", "")]


def test_apply_buttons(spark):
    rows = X.apply_buttons(pages(
        spark, '<a href="/x">Apply on Employer Site</a><a href="/x">apply</a><a href="#f">apply</a>'
        '<a href="https://swooped.co/a">apply</a><a href="https://swooped.co/job-postings/1">apply</a>'
        '<a href="https://o.io/?r=swooped.co/job-postings">apply</a>'), ["id", "url"])
    assert {r.job_url for r in rows.collect()} == {
        "https://h.io/x", "https://o.io/?r=swooped.co/job-postings"}


def test_broken_pages_lose_only_themselves(spark):
    deep = "[" * 100_000
    texts = ["<![foo[x]]><a href='/x'>apply</a>", '<a href="http://[x">apply</a><a href="/ok">apply</a>', '<a href="/y">apply</a>']
    got = X.page_apply_links(pages(spark, *texts), ["id", "url"]).orderBy("id", "pos").collect()
    assert [(r.id, r.job_url) for r in got if r.id > 0] == [
        (1, "http://[x"), (1, "https://h.io/ok"), (2, "https://h.io/y")]
    outlines = {r.id: r.parse_error for r in X.page_outlines(pages(spark, *texts), ["id"]).collect()}
    assert outlines[0] == "AssertionError" and outlines[2] is None
    captures = bodies(spark, deep, {"a": {"url": "https://ok"}})
    assert [r.job_url for r in X.api_postings(captures).collect()] == ["https://ok"]
    broken = spark.createDataFrame([(0, "<![foo[x]]>"), (1, "<b>x</b>")], "id int, t string")
    assert [r.t for r in X.to_text(broken, "t").orderBy("id").collect()][1] == "x"


def test_unclosed_tags_take_linear_time():
    import time

    from postmill.functions.dom import Outline

    start = time.perf_counter()
    assert len(Outline("<li>" * 50_000 + "x" + "</b>" * 50_000).elements) == 50_000
    assert time.perf_counter() - start < 3


def test_closed_phrases_late_in_a_text_are_found(spark):
    from postmill.operators.scoring import split_closed

    page = "<title>T</title><main>" + "word " * 2000 + "This role is closed.</main>"
    read = X.parse_pages(pages(spark, page), ["id"])
    closed, _ = split_closed(read.selectExpr("id as seq", "'u' as url", "description as job_description", "location as location_text"))
    assert closed.count() == 1


def test_mail_that_does_not_decode_is_told(spark):
    rows = [("good", ("text/html", [], ("PGI-eDwvYj4=",), [])), ("bad", ("text/html", [], ("@@@",), [])),
            ("none", ("text/plain", [], ("eA==",), []))]
    messages = spark.createDataFrame(rows, files.MESSAGE_SCHEMA)
    assert [tuple(r) for r in X.mail_errors(messages).collect()] == [("bad", "not base64")]
    assert [r.id for r in X.mail_html(messages).collect()] == ["good"]
