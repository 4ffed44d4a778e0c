"""Scans and sinks: seed lists, mail messages, capture bodies, snapshots, preferences."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill import fixed
from postmill.functions.text import strip, text

MESSAGE_SCHEMA = """
id STRING, payload STRUCT<
  mimeType: STRING,
  headers: ARRAY<STRUCT<name: STRING, value: STRING>>,
  body: STRUCT<data: STRING>,
  parts: ARRAY<STRUCT<
    mimeType: STRING, body: STRUCT<data: STRING>,
    parts: ARRAY<STRUCT<mimeType: STRING, body: STRUCT<data: STRING>>>>>>
"""
PREFERENCE_SCHEMA = "owner STRING, kind STRING, value STRING, seq BIGINT"
SNAPSHOT_SCHEMA = "run_date DATE, url STRING"


def _or_empty(spark: SparkSession, read, schema: str) -> DataFrame:
    """A path that is missing or holds nothing readable is an empty table."""
    try:
        return read()
    except AnalysisException:
        return spark.createDataFrame([], schema)


def seed_lines(lines: DataFrame, host: str | None = None) -> DataFrame:
    """Trimmed seed addresses from text lines; blank and `#` lines dropped."""
    url = strip("value")
    kept = lines.withColumn("value", url).filter(
        (F.col("value") != "") & ~F.col("value").startswith("#")
    )
    return kept.filter(F.col("value").contains(host)) if host else kept


def read_seed_urls(spark: SparkSession, path: str, host: str | None = None) -> DataFrame:
    lines = _or_empty(spark, lambda: spark.read.text(path), "value STRING")
    return seed_lines(lines, host)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    return _or_empty(
        spark, lambda: spark.read.schema(MESSAGE_SCHEMA).json(path), MESSAGE_SCHEMA
    )


def message_headers(messages: DataFrame) -> DataFrame:
    """Adds `headers MAP`: lower-cased name -> value; the last of a repeated name wins."""
    # later duplicates win: reverse, then keep the first of each name
    entries = F.reverse(
        F.transform(
            F.coalesce("payload.headers", F.array().cast("array<struct<name:string,value:string>>")),
            lambda h: F.struct(F.lower(h["name"]).alias("key"), h["value"].alias("value")),
        )
    )
    names = F.transform(F.col("__e"), lambda e: e["key"])
    firsts = F.filter(
        F.col("__e"), lambda e, i: F.array_position(names, e["key"]) == i + 1
    )
    return (
        messages.withColumn("__e", entries)
        .withColumn("headers", F.map_from_entries(firsts))
        .drop("__e")
    )


def api_bodies(captures: DataFrame) -> DataFrame:
    """Captured responses of the postings API whose body is a non-empty JSON object."""
    kept = captures.filter(
        F.col("url").contains(fixed.AGGREGATOR_API_HOST)
        & F.lower("url").contains("graphql")
    )
    # an explode keeps the parse to one evaluation; a filter on it would parse again
    filled = F.filter(
        F.array(F.try_parse_json("body")),
        lambda d: F.size(F.try_variant_get(d, "$", "map<string,variant>")) > 0,
    )
    return kept.select("*", F.explode(filled).alias("doc"))


def read_api_bodies(spark: SparkSession, path: str) -> DataFrame:
    schema = "seq BIGINT, page STRING, url STRING, body STRING"
    raw = _or_empty(spark, lambda: spark.read.schema(schema).json(path), schema)
    return api_bodies(raw)


# --- snapshots ---------------------------------------------------------------

def latest_snapshot(history: DataFrame, before=None) -> DataFrame:
    """Urls of the last run in the history (before a given date, if one is named)."""
    seen = history if before is None else history.filter(F.col("run_date") < F.lit(before).cast("date"))
    last = seen.agg(F.max("run_date").alias("d")).scalar()
    return seen.filter(F.col("run_date") == last).select("url")


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    return _or_empty(spark, lambda: spark.read.schema(SNAPSHOT_SCHEMA).parquet(path), SNAPSHOT_SCHEMA)


def write_snapshot(urls: DataFrame, path: str, run_date: str) -> None:
    """Replace the folder of one run; other runs stay as they are."""
    urls.select("url").distinct().write.mode("overwrite").parquet(
        f"{path.rstrip('/')}/run_date={run_date}"
    )


# --- preferences ---------------------------------------------------------------

def read_preferences(spark: SparkSession, path: str) -> DataFrame:
    return _or_empty(
        spark, lambda: spark.read.schema(PREFERENCE_SCHEMA).parquet(path), PREFERENCE_SCHEMA
    )


def write_preferences(prefs: DataFrame, path: str) -> None:
    """Replace what is stored. `prefs` must not read from `path` itself: settle it first."""
    prefs.select("owner", "kind", "value", "seq").write.mode("overwrite").parquet(path)


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    schema = "owner STRING, seq BIGINT, raw STRING"
    return _or_empty(spark, lambda: spark.read.schema(schema).parquet(path), schema)


def append_feedback(raw: DataFrame, path: str) -> None:
    """Log the trimmed raw lines before anything parses them."""
    raw.withColumn("raw", strip(text("raw"))).write.mode("append").parquet(path)
