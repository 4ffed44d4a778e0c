"""Registration, and tables derived from the given ones (in Spark, and again in SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill import fixed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NOW = "2026-02-05 13:09:55 EST"


def query(sql: str | None = None, ints: str = ""):
    """Register a query under its name; `ints` are the SQL columns that are 32 bits wide."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql and ints:
            casts = ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in ints.split())
            ORACLES[fn.__name__] = f"SELECT * REPLACE ({casts}) FROM ({sql}) AS q"
        elif sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def by_type(**values) -> Column:
    """Case over event_type; missing ones are ''."""
    expr = None
    for kind, value in values.items():
        value = value if isinstance(value, Column) else F.lit(value)
        test = F.col("event_type") == kind
        expr = F.when(test, value) if expr is None else expr.when(test, value)
    return expr.otherwise(F.lit(""))


def filled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Table layout: seq plus all columns, missing ones ''."""
    return df.select(
        "seq",
        *[F.col(c) if c in df.columns else F.lit("").alias(c) for c in columns],
    )


# --- a tracking table with one row per event ------------------------------------------

def event_table(spark: SparkSession, sf: str) -> DataFrame:
    third = F.floor("value").cast("bigint") % 3
    events = load(spark, sf, "events").select(
        F.col("event_id").alias("seq"),
        F.concat(
            F.lit("https://www.linkedin.com"), by_type(signup="/comm"),
            F.lit("/jobs/view/"), F.col("event_id").cast("string"), by_type(click="/"),
        ).alias("job_url"),
        F.col("event_type").alias("source"),
        by_type(view="pending", purchase="fetched", click="failed", signup="timeout")
        .alias("fetch_status"),
        (F.floor("value").cast("bigint") % 5).cast("string").alias("fetch_attempts"),
        F.lit("old").alias("fetch_error"),
        F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("company"),
        by_type(purchase="Engineer").alias("role_title"),
        F.lit("here").alias("location"),
        F.when(third == 0, " Reject").when(third == 1, "monitor").otherwise("")
        .alias("agent_bucket"),
    )
    return filled(events, fixed.MAIL_COLUMNS)


EVENT_TABLE = """ev AS (
  SELECT event_id AS seq,
    'https://www.linkedin.com' || CASE WHEN event_type='signup' THEN '/comm' ELSE '' END
      || '/jobs/view/' || event_id || CASE WHEN event_type='click' THEN '/' ELSE '' END AS job_url,
    event_type AS source, '' AS date_received,
    CASE event_type WHEN 'view' THEN 'pending' WHEN 'purchase' THEN 'fetched'
      WHEN 'click' THEN 'failed' WHEN 'signup' THEN 'timeout' ELSE '' END AS fetch_status,
    CAST(CAST(floor(value) AS BIGINT) % 5 AS VARCHAR) AS fetch_attempts,
    'old' AS fetch_error, '' AS last_fetch_at, '' AS last_seen_at,
    'c' || user_id AS company,
    CASE WHEN event_type='purchase' THEN 'Engineer' ELSE '' END AS role_title,
    'here' AS location, '' AS apply_url, '' AS job_description, '' AS job_summary,
    CASE CAST(floor(value) AS BIGINT) % 3 WHEN 0 THEN ' Reject' WHEN 1 THEN 'monitor' ELSE '' END
      AS agent_bucket,
    '' AS agent_reasoning
  FROM events)"""

# --- page parts in SQL --------------------------------------------------------------------

SITE = "regexp_extract(url, '^https?://[^/?#]+')"
HOST = "regexp_extract(url, '^https?://([^/?#]+)', 1)"
TITLE = "trim(regexp_extract(html, '<title>(.*?)</title>', 1))"
PAGE_FORM = "rtrim(regexp_replace(url, '#.*$', ''), '/')"
LANG = "regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1)"


def _decoded(text: str) -> str:
    for entity, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("amp", "&")):
        text = f"regexp_replace({text}, '&{entity};?', '{char}', 'g')"
    return text


ARTICLE = _decoded(
    "trim(regexp_replace(regexp_replace(regexp_extract(html, '<article>(.*?)</article>', 1, 's'),"
    " '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"
)
SHOWN_TITLE = _decoded(TITLE)
PAGE_WORDS = """w AS (
  SELECT page_id, url, html,
    unnest(regexp_extract_all(html, '<a href="/([^"]*)"', 1)) AS word,
    generate_subscripts(regexp_extract_all(html, '<a href="/([^"]*)"', 1), 1) - 1 AS pos
  FROM pages)"""


def lang_of(url: Column | str = "url") -> Column:
    return F.regexp_extract(url, "^https?://[^/]+/([a-z]+)/", 1)


def site_of(url: Column | str = "url") -> Column:
    return F.regexp_extract(url, "^https?://[^/?#]+", 0)


def relink(to: str) -> Column:
    """Page html with every `/word` link rewritten; `$1` is the word."""
    return F.regexp_replace("html", '<a href="/([^"]*)"', f'<a href="{to}"')


def sql_any(text: str, phrases: list[str]) -> str:
    quoted = (p.replace("'", "''") for p in phrases)
    return "(" + " OR ".join(f"contains({text}, '{p}')" for p in quoted) + ")"


def sql_rules(text: str, patterns: list[str]) -> str:
    return f"regexp_matches({text}, '(?i)" + "|".join(f"(?:{p})" for p in patterns) + "')"
