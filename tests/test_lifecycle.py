"""The fetch lifecycle, companies, and their runs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from postmill import fixed
from postmill.operators import companies as C
from postmill.operators import lifecycle as LC
from postmill.operators.scoring import Rule
from postmill.plans import runs as R
from postmill.plans.stages import Scorer
from postmill.session import settle
from postmill.sources.files import api_bodies
from tests.test_tables import NOW, mail, table

ATTEMPT = "url string, run int, outcome string, error_type string, html string"


def test_eligible(spark):
    rows = [("", ""), ("  ", "0"), ("pending", "x"), ("failed", "3"), ("timeout", " 2 "), ("fetched", "1"),
            ("pending ", "0")]
    t = mail(spark, *[{"job_url": f"u{i}", "fetch_status": s, "fetch_attempts": a}
                      for i, (s, a) in enumerate(rows)], {"job_url": " ", "fetch_status": "pending"})
    assert [r.seq for r in LC.eligible(t, None).orderBy("seq").collect()] == [0, 2, 4, 6]
    assert [r.seq for r in LC.eligible(t, 2).collect()] == [0, 2]


def outcomes(spark, *rows):
    return spark.createDataFrame([(*r, None)[:5] if len(r) == 4 else r for r in rows], ATTEMPT)


def test_apply_outcomes(spark):
    start = {"fetch_status": "pending", "fetch_attempts": "0", "company": "old", "role_title": "old",
             "fetch_error": "e"}
    names = ["ok", "timeout", "http", "parse", "empty", "untried"]
    t = mail(spark, *[start | {"job_url": f"https://l/comm/jobs/view/{n}"} for n in names])
    url = lambda n: f"https://l/jobs/view/{n}"
    page = "<title>Role</title><body>" + "text " * 200 + "</body>"
    log = outcomes(
        spark, (url("ok"), 1, "ok", "", page), (url("ok"), 2, "timeout", "", None),
        (url("timeout"), 1, "timeout", "", None), (url("http"), 1, "http_error", "ConnectError", None),
        (url("parse"), 1, "parse_error", "AttributeError", None), (url("empty"), 1, "ok", "", "<p></p>"))
    rows = {r.job_url.rsplit("/", 1)[1]: r for r in LC.apply_outcomes(t, log, NOW).collect()}
    state = lambda n: (rows[n].fetch_status, rows[n].fetch_attempts, rows[n].fetch_error, rows[n].company)
    assert state("ok") == ("fetched", "1", "", "")
    assert (rows["ok"].role_title, len(rows["ok"].job_summary), rows["ok"].last_fetch_at) == ("Role", 500, NOW)
    assert state("timeout") == ("timeout", "1", "timeout", "old")
    assert state("http") == ("failed", "1", "http_error:ConnectError", "old")
    assert state("parse") == ("failed", "1", "parse_error:AttributeError", "old")
    assert state("empty") == ("failed", "1", "parse_empty", "old")
    assert state("untried") == ("pending", "0", "e", "old")


def test_fold_equals_repeated_runs(spark):
    histories = {
        "a": ["timeout", "http_error", "ok", "ok"], "b": ["http_error"] * 4, "c": ["ok", "timeout"],
        "d": ["timeout"], "e": ["http_error", "timeout"],
    }
    page = "<title>T</title>"
    t = mail(spark, *[{"job_url": k, "fetch_status": "pending", "fetch_attempts": "0"} for k in histories])
    whole = spark.createDataFrame(
        [(k, i, o, "E", page) for k, h in histories.items() for i, o in enumerate(h)], ATTEMPT)
    by_run = t
    for run in range(4):
        t = settle(LC.apply_outcomes(t, whole, f"now {run}"))
        by_run = LC.apply_outcomes(by_run, whole, f"now {run}", run=run)
        # a run that is applied again changes nothing
        by_run = settle(LC.apply_outcomes(by_run, whole, f"now {run}", run=run))
    assert sorted(t.drop("last_fetch_at").collect()) == sorted(by_run.drop("last_fetch_at").collect())
    stepped = {r.job_url: (int(r.fetch_attempts), r.fetch_status, r.fetch_error) for r in t.collect()}
    log = [(k, i, o, "E") for k, h in histories.items() for i, o in enumerate(h)]
    folded = LC.fold_attempts(spark.createDataFrame(log, "url string, seq int, outcome string, error_type string"))
    assert {r.url: (r.fetch_attempts, r.fetch_status, r.fetch_error) for r in folded.collect()} == stepped
    assert stepped["a"] == (3, "fetched", "") and stepped["b"] == (3, "failed", "http_error:E")


def test_only_pages_of_the_outcomes_taken_are_parsed(spark, monkeypatch):
    """Of a long log a run parses one page a row at most, and none of rows that are done."""
    page = "<title>T</title>"
    log = spark.createDataFrame([(f"u{i % 20}", i // 20, "ok", "", page) for i in range(2000)], ATTEMPT)
    t = mail(spark, *[{"job_url": f"u{i}", "fetch_status": "pending" if i < 15 else "fetched", "fetch_attempts": "1"} for i in range(20)])
    read = []

    def counted(pages, *args, parse=LC.parse_pages, **named):
        read.append(sorted((r.url, r.run) for r in pages.collect()))
        return parse(pages, *args, **named)

    monkeypatch.setattr(LC, "parse_pages", counted)
    done = LC.apply_outcomes(t, log, NOW)
    assert read == [sorted((f"u{i}", 1) for i in range(15))]
    assert done.filter("role_title = 'T'").count() == 15


def test_a_board_run_parses_no_page_of_others(spark, monkeypatch):
    """The log holds outcomes of other tables too: only those of this table's rows are parsed."""
    link = "https://boards.greenhouse.io/a/jobs/1"
    seeds = spark.createDataFrame([(1, "https://s.io", f'<a href="{link}">x</a>')], "seq bigint, url string, html string")
    bodies = api_bodies(spark.createDataFrame([], "seq bigint, page string, url string, body string"))
    none = spark.createDataFrame([], "run_date date, url string")
    log = spark.createDataFrame(
        [(f"https://o.io/{i}", 1, "ok", "", "<title>O</title>") for i in range(300)] + [(link, 1, "ok", "", "<title>R</title>")], ATTEMPT)
    read = []

    def counted(pages, *args, parse=LC.parse_pages, **named):
        read.append([r.url for r in pages.collect()])
        return parse(pages, *args, **named)

    monkeypatch.setattr(LC, "parse_pages", counted)
    t = spark.createDataFrame([], "seq BIGINT, " + ", ".join(f"{c} STRING" for c in fixed.BOARD_COLUMNS))
    run = R.board_run(t, seeds, bodies, seeds.limit(0), none, log, NOW, "2026-02-05", Scorer(rules=[]))
    assert [(r.job_url, r.fetch_status, r.role_title) for r in run.table.collect()] == [(link, "fetched", "R")]
    assert read == [[link]]


def test_every_outcome_is_applied_unless_a_cap_is_asked_for(spark):
    t = mail(spark, *[{"job_url": f"u{i}", "fetch_status": "pending", "fetch_attempts": "0"} for i in range(60)])
    log = spark.createDataFrame([(f"u{i}", 1, "timeout", "", None) for i in range(30, 60)], ATTEMPT)
    assert LC.apply_outcomes(t, log, NOW).filter("fetch_status = 'timeout'").count() == 30
    capped = LC.apply_outcomes(t, log, NOW, cap=25).filter("fetch_status = 'timeout'")
    assert sorted(r.seq for r in capped.collect()) == list(range(30, 55))


def test_the_first_outcome_of_a_run_counts(spark):
    t = mail(spark, {"job_url": "u", "fetch_status": "pending", "fetch_attempts": "0"})
    log = spark.createDataFrame(
        [("u", 1, 2, "ok", "", "<title>b</title>"), ("u", 1, 1, "http_error", "E", None), ("u", 2, 3, "ok", "", "<title>c</title>")],
        "url string, run int, ts int, outcome string, error_type string, html string")
    once = LC.apply_outcomes(t, log, "a")
    assert [(r.fetch_status, r.fetch_error) for r in once.collect()] == [("failed", "http_error:E")]
    twice = LC.apply_outcomes(once, log, "b").collect()
    assert [(r.fetch_status, r.fetch_attempts, r.role_title) for r in twice] == [("fetched", "2", "c")]


def test_repeated_pages_do_not_multiply_companies(spark):
    listed = spark.createDataFrame([(0, "A", "", "https://h.io/l", "")], "seq bigint, company string, company_url string, career_site_url string, last_error string")
    pages = spark.createDataFrame([("https://h.io/l", "static", "<p>none</p>")] * 3, "url string, render string, html string")
    found = settle(C.discover_companies(listed, pages))
    assert found.count() == 1 and C.write_errors(listed, C.company_errors(found)).count() == 1


def test_reset_repair_prune_invariants(spark):
    t = mail(
        spark,
        {"job_url": "https://l/comm/jobs/view/1", "fetch_status": "failed", "fetch_attempts": "3",
         "company": "c", "agent_bucket": "monitor", "source": "s"},
        {"job_url": "u", "fetch_status": "fetched", "fetch_attempts": "2", "agent_bucket": " REJECT "},
        {"job_url": "u ", "fetch_status": "bad", "fetch_attempts": "9"}, {"job_url": "u/", "fetch_status": "pending"})
    repaired = LC.repair_urls(t).orderBy("seq").collect()[0]
    assert (repaired.job_url, repaired.fetch_status, repaired.fetch_attempts, repaired.company,
            repaired.agent_bucket, repaired.source) == ("https://l/jobs/view/1", "pending", "0", "", "", "s")
    reset = LC.reset_fetched(t).orderBy("seq").collect()[1]
    assert (reset.fetch_status, reset.fetch_attempts, reset.agent_bucket) == ("pending", "0", " REJECT ")
    assert [r.seq for r in LC.prune(t).orderBy("seq").collect()] == [0, 2, 3]
    assert LC.prune(t.drop("agent_bucket")).count() == 4
    counts = {r.rule: r.n for r in LC.check_invariants(t).collect()}
    assert counts == {"state_undefined": 1, "attempts_out_of_range": 2, "duplicate_key": 1, "duplicate_form": 1,
                      "fetched_unscored": 0, "scored_not_fetched": 1, "fetched_empty": 1}


JOB = '<a href="/jobs/12{}">x</a>'


def company_inputs(spark):
    rows = [
        ("L1", "", "h.io/l1"), ("L2", "", "https://h.io/l2"), ("L3", "", "https://h.io/l3"),
        ("L4", "", "https://h.io/l4"), ("", "https://h.io/home", "https://h.io/gone"),
        ("E1", " ", "https://h.io/gone"), ("E2", "https://h.io/bare", ""),
        ("E3", "https://h.io/home3", "https://h.io/none"), ("E4", "https://h.io/gone", "")]
    companies = spark.createDataFrame(
        [(i, *r, "old") for i, r in enumerate(rows)],
        "seq bigint, company string, company_url string, career_site_url string, last_error string")
    opens = '<a href="/{}">View open roles</a>'
    pages = [
        ("https://h.io/l1", "static", JOB.format(1) + JOB.format(1) + JOB.format(2)),
        ("https://h.io/l2", "static", opens.format("l2b")), ("https://h.io/l2b", "static", JOB.format(3)),
        ("https://h.io/l3", "static", "<p>"), ("https://h.io/l3", "clicked", JOB.format(4)),
        # the open-roles page names another one: that is the page to render
        ("https://h.io/l4", "static", opens.format("l4b")),
        ("https://h.io/l4b", "static", opens.format("l4c")), ("https://h.io/l4c", "rendered", JOB.format(5)),
        ("https://h.io/home", "static", '<a href="/careers">x</a>'),
        ("https://h.io/careers", "static", JOB.format(6)),
        ("https://h.io/bare", "static", "<p>nothing</p>"),
        ("https://h.io/none", "static", "<p>"), ("https://h.io/home3", "static", '<a href="/none">Jobs</a>'),
    ]
    return companies, spark.createDataFrame(pages, "url string, render string, html string")


def test_company_cascade(spark):
    companies, pages = company_inputs(spark)
    found = C.discover_companies(companies, pages).orderBy("seq").collect()
    job = lambda *n: [f"https://h.io/jobs/12{i}" for i in n]
    assert [(r.level, r.links) for r in found[:5]] == [
        (1, job(1, 2)), (2, job(3)), (3, job(4)), (4, job(5)), (5, job(6))]
    assert found[4].company == "Unknown"
    assert [r.error for r in found[5:]] == [
        fixed.ERROR_NO_COMPANY_URL, fixed.ERROR_NO_CAREERS_LINK, fixed.ERROR_NO_POSTINGS,
        "Fallback failed: no page https://h.io/gone"]
    errors = C.company_errors(C.discover_companies(companies, pages))
    written = C.write_errors(companies, errors).orderBy("seq").collect()
    assert [r.last_error == "old" for r in written] == [True] * 5 + [False] * 4


def plain_cascade(company, pages):
    """A company's links and level, one page after the other."""
    def listing(start):
        """(reached, links, level)"""
        if (own := pages.get((start, "static"))) is None:
            return False, None, None
        if own["links"]:
            return True, own["links"], 1
        last = own
        if own["open"] and (opened := pages.get((own["open"], "static"))) is not None:
            if opened["links"]:
                return True, opened["links"], 2
            last = opened
        for level, at, render in ((3, start, "clicked"), (4, last["open"] or start, "rendered")):
            if (page := pages.get((at, render))) is not None and page["links"]:
                return True, page["links"], level
        return True, None, None

    if company["career"]:
        _, links, level = listing(company["career"])
        if level:
            return links, level, None
    if not company["site"]:
        return None, None, fixed.ERROR_NO_COMPANY_URL
    if (home := pages.get((company["site"], "static"))) is None:
        return None, None, f"Fallback failed: no page {company['site']}"
    if not home["careers"]:
        return None, None, fixed.ERROR_NO_CAREERS_LINK
    reached, links, level = listing(home["careers"])
    if level:
        return links, level + 4, None
    return None, None, fixed.ERROR_NO_POSTINGS if reached else f"Fallback failed: no page {home['careers']}"


@pytest.mark.parametrize("seed", [1, 2])
def test_company_cascade_on_random_sites(spark, seed):
    """All levels, by the plain cascade; many companies share pages, and one page is wanted by a third."""
    r = random.Random(seed)
    at = lambda k: f"https://h.io/p{k}"
    pages, rows = {}, []
    for k in range(60):
        for render in ("static", "clicked", "rendered"):
            if r.random() < (0.9 if render == "static" else 0.4):
                has = lambda p, x: x if r.random() < p else None
                page = {"links": [f"https://h.io/jobs/12{k}{render}"] if r.random() < 0.12 else [],
                        "open": has(0.6, at(r.randrange(60))), "careers": has(0.7, at(r.randrange(60)))}
                pages[at(k), render] = page
                html = "".join([f'<a href="{page["careers"]}">Our Careers</a>' if page["careers"] else "",
                                *(f'<a href="{x}">x</a>' for x in page["links"]),
                                f'<a href="{page["open"]}">View open roles</a>' if page["open"] else ""])
                # postings and open roles speak of careers too: the first of all counts
                page["careers"] = page["careers"] or next(iter(page["links"]), None) or page["open"]
                rows.append((at(k), render, html))
    listed = [{"seq": i, "career": r.choice(["", at(r.randrange(60))]), "site": r.choice(["", at(3), at(r.randrange(60))])} for i in range(240)]
    companies = spark.createDataFrame([(c["seq"], "c", c["site"], c["career"], "") for c in listed],
        "seq bigint, company string, company_url string, career_site_url string, last_error string")
    found = {x.seq: (x.links, x.level, x.error) for x in C.discover_companies(
        companies, spark.createDataFrame(rows, "url string, render string, html string")).collect()}
    assert found == {c["seq"]: plain_cascade(c, pages) for c in listed}
    assert len({level for _, level, _ in found.values()}) >= 6


def test_company_run_is_idempotent(spark):
    companies, pages = company_inputs(spark)
    log = spark.createDataFrame(
        [(f"https://h.io/jobs/12{i}", 1, "ok", "", f"<title>R{i}</title><body>infra {i}</body>")
         for i in (1, 2, 3)], ATTEMPT)
    scorer = Scorer(rules=[Rule("two", "reject", any_of=["infra 2"])])
    run = R.company_run(table(spark, fixed.BOARD_COLUMNS), companies, pages, log, NOW, scorer)
    rows = {r.job_url[-1]: (r.fetch_status, r.role_title, r.agent_bucket) for r in run.table.collect()}
    assert rows == {"1": ("fetched", "R1", "monitor"), "3": ("fetched", "R3", "monitor"),
                    "4": ("pending", "", ""), "5": ("pending", "", ""), "6": ("pending", "", "")}
    strict = LC.check_invariants(run.table).filter("must_be_zero and n > 0")
    assert strict.count() == 0
    # a pruned posting leaves no trace: found again, it is inserted again
    again = R.company_run(run.table, companies, pages, log.limit(0), NOW, scorer)
    assert sorted(r.job_url[-1] for r in again.table.collect()) == list("123456")


def test_a_second_run_of_a_day_sees_only_what_is_new_since_the_first(spark):
    link = lambda *n: "".join(f'<a href="https://boards.greenhouse.io/acme/jobs/{i}">x</a>' for i in n)
    pages = lambda *n: spark.createDataFrame([(0, "https://h.io", link(*n))], "seq bigint, url string, html string")
    bodies = spark.createDataFrame([], "seq bigint, page string, url string, body string, doc string").withColumn(
        "doc", F.try_parse_json("doc"))
    rendered = spark.createDataFrame([], "seq bigint, url string, html string")
    history = spark.createDataFrame([("2026-02-01", "https://boards.greenhouse.io/acme/jobs/1")], "d string, url string").select(
        F.col("d").cast("date").alias("run_date"), "url")
    empty, log, day = table(spark, fixed.BOARD_COLUMNS), spark.createDataFrame([], ATTEMPT), "2026-02-05"
    run = lambda h, *n, **k: R.board_run(empty, pages(*n), bodies, rendered, h, log, NOW, day, Scorer(rules=[]), **k)
    numbers = lambda r: sorted(int(x.job_url.rsplit("/", 1)[1]) for x in r.table.collect())
    first = run(history, 1, 2)
    assert numbers(first) == [2]
    saved = settle(first.snapshots)
    second = run(saved, 1, 2, 3)
    assert numbers(second) == [3]
    assert numbers(run(saved, 1, 2, 3, before=day)) == [2, 3]  # as of the day's beginning
    assert second.snapshots.filter(F.col("run_date") == day).count() == 3


def test_repeated_runs_do_not_use_numbers_up(spark):
    from postmill.plans.stages import insert_stage

    t = table(spark, fixed.BOARD_COLUMNS)
    for run in range(3):
        arrivals = spark.createDataFrame(
            [(f"https://x/{run}/{i}", "slug", (1 << 50) + i * (1 << 30)) for i in range(4)],
            "url string, company_slug string, seq bigint")
        t = settle(insert_stage(t, arrivals, "board", NOW))
    assert [r.job_url for r in t.orderBy("seq").collect()] == [f"https://x/{k}/{i}" for k in range(3) for i in range(4)]
    assert t.agg(F.max("seq")).collect()[0][0] == 11
