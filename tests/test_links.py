"""Edge rows of the link operators."""

from __future__ import annotations

from urllib.parse import urljoin

import pytest

from pyspark.sql import functions as F

from postmill.functions import urls
from postmill.operators import links as L


def one(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def strings(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "u string")


def test_resolve_agrees_with_the_standard_library(spark):
    bases = ["https://h.io/a/b/c?x=1#f", "https://h.io", "https://h.io/a/", "http://h.io/p?q=2"]
    hrefs = [
        "/x", "x", "../x", "../../../x", "./x", "?q=1", "#z", "//o.com/y", "HTTPS://o.com/Y?a",
        "mailto:a@b", "/a/../b", "/a/./b/", "x/..", "..", ".", "", "a//b", "//o.com",
        "x?y=../z", "/x;p=1", "x/./y/", "javascript:void(0)", "/a\tb", "tel:1",
    ]
    df = spark.createDataFrame([(b, h) for b in bases for h in hrefs], "b string, h string")
    for b, h, got in df.select("b", "h", urls.resolve("b", "h")).collect():
        assert got == urljoin(b, h), (b, h)


def test_canonical_forms(spark):
    df = strings(spark, "https://boards.greenhouse.io/Acme/jobs/12/?gh=1#a")
    assert one(df, urls.board_form("u")) == ["https://boards.greenhouse.io/Acme/jobs/12"]
    slugs = L.board_slugs(df, "u").select("slug", "posting_no").collect()
    assert [tuple(r) for r in slugs] == [("acme", "12")]
    pages = strings(spark, "https://h.io/x/?a=1#f", "mailto:a@b", "HTTP://h.io//", "https://h.io/x;p/")
    assert one(pages, urls.page_form("u")) == [
        "https://h.io/x/?a=1", None, "http://h.io", "https://h.io/x;p"]


def test_alert_urls(spark):
    df = strings(
        spark, "https://linkedin.com/comm/jobs/view/7?x=1&amp;y=2", "https://h.io/jobs/view/7",
        "https://linkedin.com&#47;jobs/view/8",
    )
    assert L.canonical_alert_urls(df, "u").select("url").collect() == [
        ("https://linkedin.com/jobs/view/7",), ("https://linkedin.com/jobs/view/8",)]


def test_ensure_protocol(spark):
    df = strings(spark, "h.io", "//h.io", "HTTP://h.io", "  ", " h.io ")
    assert one(df, urls.ensure_protocol("u")) == [
        "https://h.io", "https://h.io", "HTTP://h.io", "", "https://h.io"]


def test_posting_links(spark):
    df = strings(
        spark, "https://jobs.lever.co/a/b", "https://h.io/blog/job/1", "h.io/job/", "https://h.io/x",
        "https://jobs.gem.com/co/" + "a" * 20, "https://h.io/JOBS/12", None,
    )
    assert one(df, urls.is_posting_link("u")) == [True, False, False, False, True, True, False]


def test_match_variants(spark):
    df = strings(
        spark, "u//", "u", "https://l/comm/jobs/view/1/", "https://l/jobs/view/1", "")
    assert one(df, urls.match_list("u")) == [
        ["u//", "u"], ["u", "u/"],
        ["https://l/comm/jobs/view/1/", "https://l/comm/jobs/view/1", "https://l/jobs/view/1/",
         "https://l/jobs/view/1"],
        ["https://l/jobs/view/1", "https://l/jobs/view/1/", "https://l/comm/jobs/view/1"],
        [],
    ]


PAGE = """<html><!-- <a href="/no">no</a> --><script>var a='<a href="/no2">';</script>
<body><A HREF='/one?a=1&amp;b=2'> One <b>bold</b></A><a name=x>none</a><a href=/two>Two
<div>Long block <a href="#frag">f</a><a href="javascript:x()">View open roles</a>
<a href="three/">See OPEN roles</a></div><a href="/careers/">We</a></body></html>"""


def test_anchors_and_hrefs(spark):
    pages = spark.createDataFrame([(1, "https://h.io/d/", PAGE)], "id int, url string, html string")
    exact = L.anchors(pages, ["id"], context=True).orderBy("pos").collect()
    assert [r.href for r in exact] == [
        "/one?a=1&b=2", "/two", "#frag", "javascript:x()", "three/", "/careers/"]
    assert exact[0].text == "Onebold" and exact[4].text == "See OPEN roles"
    assert exact[0].context is None
    assert exact[4].context == "Long block f View open roles See OPEN roles"
    quick = L.hrefs(pages, ["id"]).orderBy("pos").collect()
    assert [r.href for r in quick] == [r.href for r in exact]


def test_anchor_lists_grow_with_the_page(spark):
    """Unclosed anchors, and very many links in one block: a row holds the page's text once."""
    def size(html, context=False):
        page = spark.createDataFrame([(1, html)], "id int, html string")
        row = L.anchor_lists(page, ["id"], context).collect()[0]
        return len(str(row.anchors)) + len(row.glued) + len(row.spaced)

    unclosed = lambda n: "".join(f'<a href="/{i}">some words here {i} ' for i in range(n))
    block = lambda n: "<div>" + "".join(f'<a href="/{i}">some words here {i}</a> ' for i in range(n)) + "</div>"
    for make, context in ((unclosed, False), (unclosed, True), (block, True)):
        assert size(make(8000), context) < 9 * size(make(1000), context)
    page = spark.createDataFrame([(1, unclosed(300)), (2, block(50)), (3, "<div>é <a href=x>日本 <b>ü</b></a> ä</div>")], "id int, html string")
    got = {(r.id, r.pos): (r.text, r.context) for r in L.anchors(page, ["id"], context=True).collect()}
    words = [f"some words here {i}" for i in range(300)]
    assert all(got[1, i] == ("".join(words[i:]), None) for i in (0, 7, 299))
    assert all(got[2, i] == (words[i], " ".join(words[:50])) for i in (0, 49))
    assert got[3, 0] == ("日本ü", "é 日本 ü ä")


def test_what_anchors_speak_of(spark):
    texts = ["Open Roles", "open <b>roles</b>", "Apply", "re-apply", "CAREERS", "career", "Job", "x jobs x", "", "ap", "ply"]
    html = "<p>apply</p>" + "".join(f'<a href="/{i}">{t}</a>' for i, t in enumerate(texts)) + "<p>careers</p>"
    (row,) = L.anchor_lists(spark.createDataFrame([(1, html)], "id int, html string"), ["id"]).collect()
    for a, shown in zip(row.anchors, texts, strict=True):
        plain = shown.replace(" <b>", "").replace("</b>", "").lower()
        assert set(a.says) == {k for k, (part, whole) in L.SPEAKS_OF.items() if any(p in plain for p in part) or plain in whole}


def test_listing_links(spark):
    pages = spark.createDataFrame(
        [(1, "https://h.io/d/", PAGE), (2, "https://h.io", "<p>none</p>")],
        "id int, url string, html string")
    lists = L.resolve_lists(L.anchor_lists(pages, ["id", "url"]))
    rows = L.careers_link(L.open_roles_link(lists)).orderBy("id").collect()
    # the second anchor is never closed, so all text after it is its own
    assert (rows[0].open_roles_url, rows[1].open_roles_url) == ("https://h.io/two", None)
    assert rows[0].careers_url == "https://h.io/two"
    assert rows[1].careers_url is None


def test_alert_links_keep_the_first_mention(spark):
    html = ("<a HREF='https://www.linkedin.com/comm/jobs/view/2?a=1'>x</a>"
            '<a href="https://www.linkedin.com/jobs/view/1">x</a><a href="https://x.io">x</a>'
            '<a href="https://www.linkedin.com/jobs/view/2?b=2">x</a>')
    mail = spark.createDataFrame([(1, html), (2, "")], "id int, html string")
    got = L.alert_links(mail, ["id"]).orderBy("pos").collect()
    assert [tuple(r) for r in got] == [
        (1, 0, "https://www.linkedin.com/jobs/view/2"), (1, 1, "https://www.linkedin.com/jobs/view/1")]


def test_arrivals_that_cannot_be_ordered_are_an_error(spark):
    rows = spark.createDataFrame([(5, 1), ((1 << 39) - 1, 2)], "page bigint, pos int")
    got = [r.a for r in rows.select(L.arrival("page", "pos").alias("a")).orderBy("page").collect()]
    assert got == [(5 << 24) + 1, (((1 << 39) - 1) << 24) + 2]
    for page, pos in (((1 << 40) + 5, 0), (0, 1 << 24)):
        with pytest.raises(Exception, match="too large"):
            spark.createDataFrame([(page, pos)], "page bigint, pos int").select(L.arrival("page", "pos")).collect()
