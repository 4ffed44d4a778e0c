"""Counts and lists about tables, links and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill import fixed
from postmill.functions import urls
from postmill.functions.text import has_any, non_empty, strip, text
from postmill.operators.dedup import dedup_first
from postmill.operators.extract import parse_pages
from postmill.operators.links import anchors, classify_links, resolve_links
from postmill.operators.upsert import render_reasons
from postmill.operators.sequence import dense_index


def status_counts(table: DataFrame) -> DataFrame:
    """fetch_status, n; a blank status is `(empty)`."""
    status = strip(F.coalesce(non_empty(text("fetch_status")), F.lit("(empty)")))
    return table.groupBy(status.alias("fetch_status")).agg(F.count(F.lit(1)).alias("n"))


def bucket_counts(scored: DataFrame) -> DataFrame:
    return scored.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def bucket_digest(scored: DataFrame) -> DataFrame:
    """The list of each bucket as rows: bucket, place, url, reasons.

    There are three buckets and any number of postings, so a list is numbered rows,
    not one array; places come from the dense index, which no bucket can overload."""
    return dense_index(
        scored.select("bucket", "seq", "url", render_reasons("why").alias("reasons")),
        "seq", "place", within=["bucket"],
    ).select("bucket", "place", "url", "reasons")


def discovery_report(links: DataFrame) -> DataFrame:
    """Per source: links found, and links no earlier source had. links: (source, url, seq)."""
    found = links.groupBy("source", "url").agg(F.min("seq").alias("seq"))
    fresh = dedup_first(found, ["url"], ["seq"])
    # counting `seq` keeps it in both branches, so that they share one shuffle of the links
    return (
        found.select("source", F.col("seq").isNotNull().cast("int").alias("f"), F.lit(0).alias("n"))
        .unionByName(fresh.select("source", F.lit(0).alias("f"), F.lit(1).alias("n")))
        .groupBy("source")
        .agg(F.sum("f").alias("found"), F.sum("n").alias("new"))
    )


def link_report(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Per page: followable web links, and how many of them look like postings."""
    links = resolve_links(anchors(pages, keys))
    kept = links.filter(
        (F.col("href") != "")
        & ~F.col("href").startswith("#")
        & ~F.col("href").contains("javascript")
        & F.col("full").startswith("http")
    )
    return classify_links(kept, "full").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("links"), F.count_if("is_posting").alias("postings")
    )


def page_report(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Per page: size, which structure it has, and the lengths of its parsed fields."""
    html = F.col("html")
    flags = pages.select(
        *keys,
        F.length(html).alias("html_chars"),
        (html.contains("<main>") | html.contains("<Main>")).alias("has_main"),
        (html.contains("<article>") | html.contains("<Article>")).alias("has_article"),
        html.contains("<body").alias("has_body"),
        html.contains("application/ld+json").alias("has_structured"),
        html.contains("JobPosting").alias("names_posting"),
    )
    fields = parse_pages(pages, keys).select(
        *keys,
        *[
            F.length(c).alias(f"{c}_chars")
            for c in ("role_title", "company", "location", "description")
        ],
    )
    return flags.join(fields, keys)


def apply_link_report(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Per page: links, and those that speak of applying or leave for a known host."""
    links = resolve_links(anchors(pages, keys))
    says = F.col("text").rlike(fixed.APPLY_REPORT_PATTERN)
    leaves = has_any(F.lower("full"), fixed.APPLY_REPORT_HOSTS)
    return links.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("links"),
        F.count_if(says).alias("apply_texts"),
        F.count_if(says | leaves).alias("apply_links"),
    )
