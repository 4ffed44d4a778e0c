"""Postings of a company: its listing page, then ever weaker sources, looked up in rounds.

`pages` holds what was fetched: (url, render, html) with render one of static,
clicked, rendered. A page that is not there is a fetch that failed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill import fixed
from postmill.functions import urls
from postmill.functions.text import non_empty, strip, text
from postmill.operators.dedup import dedup_first
from postmill.operators.links import (
    anchor_lists, careers_anchor, open_roles_anchor, posting_list, resolve_lists,
)
from postmill.session import settle


def page_digests(pages: DataFrame) -> DataFrame:
    """url, render, links (canonical postings), open (the open-roles anchor), careers_url.

    One row for each url and render, of the least hash of html if there are several (pages that several
    runs kept, say): equal pages would multiply the companies that lead to them. Html is read once
    here, and every link resolved once."""
    hashed = pages.select("url", "render", "html", F.xxhash64("html").alias("html_hash"))
    lists = resolve_lists(anchor_lists(hashed, ["url", "render", "html_hash"]))
    lists = lists.select("*", open_roles_anchor("anchors").alias("to_roles"))
    return dedup_first(lists.select(
        "url",
        "render",
        posting_list("anchors").alias("links"),
        F.when(F.col("to_roles").isNotNull(), F.struct("to_roles.href", "to_roles.full")).alias("open"),
        careers_anchor("anchors")["full"].alias("careers_url"),
        "html_hash",
    ), ["url", "render"], ["html_hash"]).drop("html_hash")


_PAGE = "STRUCT<links: ARRAY<STRING>, open: STRUCT<href: STRING, full: STRING>, careers_url: STRING>"


def _looked_up(state: DataFrame, digests: DataFrame, wants: dict[str, tuple[str, Column]]) -> DataFrame:
    """Adds, for each name in `wants` (render, url), the page that a company wants, null where there is none.

    All wants of a round are rows of one table, joined once with the digests: a company that wants no
    page has no row, so there is no null key. One aggregate puts the pages beside their company."""
    listed = F.filter(
        F.array(*[F.struct(F.lit(n).alias("name"), F.lit(r).alias("render"), u.alias("url")) for n, (r, u) in wants.items()]),
        lambda w: w["url"].isNotNull(),
    )
    pages = digests.select("url", "render", F.struct("links", "open", "careers_url").alias("page"))
    found = state.select("seq", F.inline(listed)).join(pages, ["url", "render"])
    both = state.select("seq", F.struct(*state.columns).alias("row"), F.lit(None).cast("string").alias("name")).unionByName(
        found.select("seq", "name", "page"), allowMissingColumns=True
    )
    of = lambda n: F.any_value(F.when(F.col("name") == n, F.col("page")), True).alias(n)
    return settle(both.groupBy("seq").agg(F.any_value("row", True).alias("row"), *map(of, wants)).select("row.*", *wants))


def _filled(page: Column) -> Column:
    return F.coalesce(F.size(page["links"]) > 0, F.lit(False))


@dataclass(frozen=True)
class _Listing:
    """A listing page (address in column `start`) and the columns of the pages that it may lead to."""

    start: str
    name: str

    def page(self, which: str) -> Column:
        return F.col(f"{self.name}_{which}")

    def first(self) -> dict[str, tuple[str, Column]]:
        """Itself, also after a click and as rendered."""
        s = F.col(self.start)
        return {f"{self.name}_{k}": (r, s) for k, r in (("own", "static"), ("click", "clicked"), ("render", "rendered"))}

    def waiting(self) -> Column:
        """Read, but without postings of its own."""
        return self.page("own").isNotNull() & ~_filled(self.page("own"))

    def second(self) -> dict[str, tuple[str, Column]]:
        """Its open-roles page, also as rendered."""
        to = F.when(self.waiting(), self.page("own")["open"]["full"])
        return {f"{self.name}_open": ("static", to), f"{self.name}_open_render": ("rendered", to)}

    def further(self) -> Column:
        """The page that the open-roles page names: still taken relative to the listing page."""
        named = urls.resolve(self.start, f"{self.name}_open.open.href")
        return F.when(self.waiting() & ~_filled(self.page("open")) & ~_filled(self.page("click")), named)

    def third(self) -> dict[str, tuple[str, Column]]:
        """Of what `further` gave, which is in column `<name>_to` by then."""
        return {f"{self.name}_further": ("rendered", self.page("to"))}

    def outcome(self) -> Column:
        """STRUCT<reached, links, level>: level 1 its own links, 2 those of its open-roles page, 3 of the page
        after a click, 4 of the page to render: what the last page read names, else the listing page."""
        own, opened, clicked = (self.page(k) for k in ("own", "open", "click"))
        rendered = (
            F.when(opened.isNotNull() & self.page("to").isNotNull(), self.page("further"))
            .when(opened.isNull() & own["open"]["full"].isNotNull(), self.page("open_render"))
            .otherwise(self.page("render"))
        )
        level = F.when(own.isNull(), F.lit(None).cast("int"))
        links = F.when(own.isNull(), F.lit(None).cast("array<string>"))
        for k, page in enumerate((own, opened, clicked, rendered), 1):
            level, links = level.when(_filled(page), k), links.when(_filled(page), page["links"])
        return F.struct(own.isNotNull().alias("reached"), links.alias("links"), level.alias("level"))


def discover_companies(companies: DataFrame, pages: DataFrame) -> DataFrame:
    """seq, company, links, level, error: one row per company (a seq is one).

    Levels 1-4 from the listing page, 5-8 through the careers link of the company page. Html is
    parsed once, to narrow digests. Then pages are looked up in rounds: a round asks at once for all
    pages that are known by then and may count, whatever their level, with one join; the least level
    is chosen at the end. Three rounds serve all but careers pages whose open-roles page names a further
    one; a fourth is made if there are such. Checkpoint the result too where both postings and errors
    are used."""
    digests = settle(page_digests(pages))
    rows = companies.select(
        "seq",
        F.coalesce(non_empty(strip(text("company"))), F.lit("Unknown")).alias("company"),
        non_empty(urls.ensure_protocol("career_site_url")).alias("start"),
        non_empty(urls.ensure_protocol("company_url")).alias("site"),
    )
    a, b = _Listing("start", "a"), _Listing("careers", "b")
    rows = _looked_up(rows, digests, a.first() | {"home": ("static", F.col("site"))})
    # sure of a posting: its own, or those after a click at least
    sure = F.col("a_own").isNotNull() & (_filled(F.col("a_own")) | _filled(F.col("a_click")))
    rows = rows.withColumn("careers", F.when(~sure, F.col("home.careers_url")))
    rows = _looked_up(rows, digests, a.second() | b.first())
    rows = _looked_up(rows.withColumn("a_to", a.further()), digests, a.third() | b.second())
    rows = rows.withColumn("b_to", b.further())
    if rows.filter("b_to is not null").isEmpty():
        rows = rows.withColumn("b_further", F.lit(None).cast(_PAGE))
    else:
        rows = _looked_up(rows, digests, b.third())
    rows = rows.select("seq", "company", "site", "home", "careers", a.outcome().alias("a"), b.outcome().alias("b"))
    failed = F.col("a.level").isNull()
    error = (
        F.when(~failed | F.col("b.level").isNotNull(), F.lit(None).cast("string"))
        .when(F.col("site").isNull(), F.lit(fixed.ERROR_NO_COMPANY_URL))
        .when(F.col("home").isNull(), F.concat(F.lit(fixed.ERROR_FALLBACK), F.lit("no page "), "site"))
        .when(F.col("careers").isNull(), F.lit(fixed.ERROR_NO_CAREERS_LINK))
        .when(~F.col("b.reached"), F.concat(F.lit(fixed.ERROR_FALLBACK), F.lit("no page "), "careers"))
        .otherwise(F.lit(fixed.ERROR_NO_POSTINGS))
    )
    return rows.select(
        "seq",
        "company",
        F.coalesce("a.links", "b.links").alias("links"),
        F.coalesce(F.col("a.level"), F.col("b.level") + 4).alias("level"),
        error.alias("error"),
    )


def company_postings(found: DataFrame) -> DataFrame:
    """company_seq, company, pos, url, level."""
    return found.select(
        F.col("seq").alias("company_seq"), "company", "level",
        F.posexplode("links").alias("pos", "url"),
    )


def company_errors(found: DataFrame) -> DataFrame:
    return found.filter("error is not null").select("seq", "error")


def write_errors(companies: DataFrame, errors: DataFrame) -> DataFrame:
    """Sets `last_error` of failed companies; a success does not clear an old error."""
    failed = errors.groupBy(F.col("seq").alias("__seq")).agg(F.min("error").alias("__error"))
    return (
        companies.join(failed, F.col("seq") == F.col("__seq"), "left")
        .withColumn("last_error", F.coalesce("__error", "last_error"))
        .select(*companies.columns)
    )
