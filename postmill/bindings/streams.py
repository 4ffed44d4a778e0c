from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from postmill import fixed
from postmill.bindings.base import EVENT_TABLE, NOW, event_table, load, query
from postmill.bindings.lifecycle import FOLDED, attempt_log
from postmill.bindings.prefs import _FEEDBACK, feedback
from postmill.functions.text import strip, text
from postmill.operators.lifecycle import fold_attempts, prune, reset_fetched
from postmill.operators.prefs import canonical_entities
from postmill.session import settle, shared_dir
from postmill.sources import changes
from postmill.streaming import folds, merges, sinks


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"


class _Streamed:
    """A session whose reads of `events` are streams, so that bindings serve both."""

    def __init__(self, spark):
        self.spark, self.read = spark, self

    def parquet(self, path):
        schema = self.spark.read.parquet(path).schema
        folder, name = path.rsplit("/", 1)
        source = self.spark.readStream.schema(schema).option("pathGlobFilter", name)
        return source.parquet(folder)


def _run(query):
    query.awaitTermination()


@query(f"WITH {FOLDED} SELECT url, fetch_attempts, fetch_status, fetch_error FROM s")
def stream_attempt_states(spark, sf):
    out = _folder(spark)
    states = folds.attempt_states(attempt_log(_Streamed(spark), sf))
    _run(sinks.append_into(states, f"{out}/t", f"{out}/c", "update"))
    last = spark.read.parquet(f"{out}/t").groupBy("url").agg(
        F.max_by(F.struct("fetch_attempts", "fetch_status", "fetch_error"), "b").alias("s")
    )
    return last.select("url", "s.*")


@query(f"WITH {FOLDED} SELECT fetch_status, count(*) AS n FROM s GROUP BY fetch_status")
def stream_status_counts(spark, sf):
    out = _folder(spark)
    states = folds.attempt_states(attempt_log(_Streamed(spark), sf))
    _run(sinks.status_changes_into(states, f"{out}/t", f"{out}/c"))
    return sinks.running_status_counts(spark, f"{out}/t")


@query(f"""WITH {_FEEDBACK} SELECT DISTINCT entity AS value, first_action AS kind, first_seq AS seq
FROM f WHERE entity <> ''""")
def stream_preferences(spark, sf):
    out = _folder(spark)
    events = canonical_entities(feedback(_Streamed(spark), sf)).filter("entity <> ''")
    _run(sinks.append_into(folds.preference_states(events), f"{out}/t", f"{out}/c"))
    return spark.read.parquet(f"{out}/t").select("value", "kind", "seq")


#: How far behind the latest row an event may come, in minutes.
_LATE = 60


@query(f"""SELECT event_id, ts, user_id, event_type, value, props FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events)
WHERE n = 1 AND epoch_ms(ts) <= (SELECT epoch_ms(max(ts)) FROM events) - {_LATE * 60_000}""")
def stream_first_seen(spark, sf):
    """The earliest event of each pair, whole; pairs first seen within the last hour are still open."""
    out = _folder(spark)
    events = load(_Streamed(spark), sf, "events")
    seen = folds.earliest(events, ["user_id", "event_type"], "ts", "event_id", f"{_LATE} minutes")
    _run(sinks.append_into(seen, f"{out}/t", f"{out}/c"))
    return spark.read.parquet(f"{out}/t").select("event_id", "ts", "user_id", "event_type", "value", "props")


@query(f"WITH {FOLDED} SELECT url, fetch_attempts, fetch_status, fetch_error FROM s")
def stream_resumed_states(spark, sf):
    """A batch fold over the first half of the log, and a stream that starts from it with the rest."""
    out = _folder(spark)
    half = load(spark, sf, "events").agg((F.max("event_id") / 2).cast("bigint").alias("h")).first().h or 0
    before = settle(fold_attempts(attempt_log(spark, sf).filter(F.col("seq") <= half)))
    rest = attempt_log(_Streamed(spark), sf).filter(F.col("seq") > half)
    _run(sinks.append_into(folds.attempt_states(rest, before), f"{out}/t", f"{out}/c", "update"))
    later = spark.read.schema(f"{STATES}, b BIGINT").parquet(f"{out}/t").groupBy("url").agg(
        F.max_by(F.struct("fetch_attempts", "fetch_status", "fetch_error"), "b").alias("s")
    ).select("url", "s.*")
    return before.join(later, "url", "left_anti").unionByName(later)


STATES = "url STRING, fetch_attempts INT, fetch_status STRING, fetch_error STRING"


@query(f"""SELECT 'https://jobs.lever.co/u/' || user_id AS job_url,
  row_number() OVER (ORDER BY min(event_id)) - 1 AS seq, 'gmail' AS source,
  'pending' AS fetch_status, '{NOW}' AS last_seen_at FROM events GROUP BY user_id""")
def stream_upserts(spark, sf):
    out = _folder(spark)
    arrivals = attempt_log(_Streamed(spark), sf).select("url", "seq")
    _run(sinks.touch_into(arrivals, f"{out}/t", fixed.MAIL_COLUMNS, fixed.SOURCE_MAIL, NOW, f"{out}/c"))
    table = changes.current(spark, f"{out}/t", sinks.table_schema(fixed.MAIL_COLUMNS))
    return table.select("job_url", "seq", "source", "fetch_status", "last_seen_at")


def _stored(spark, sf) -> tuple[str, str]:
    """The event table as a folder of rows and their changes: its path and schema."""
    path, schema = f"{_folder(spark)}/t", sinks.table_schema(fixed.MAIL_COLUMNS)
    nothing = changes.current(spark, path, schema)
    changes.put(changes.changed(nothing, event_table(spark, sf)), path, "base", 0)
    return path, schema


@query(f"""WITH {EVENT_TABLE} SELECT seq, job_url,
  CASE fetch_status WHEN 'fetched' THEN 'pending' ELSE fetch_status END AS fetch_status,
  CASE fetch_status WHEN 'fetched' THEN '0' ELSE fetch_attempts END AS fetch_attempts,
  CAST(CASE fetch_status WHEN 'fetched' THEN 2 ELSE 1 END AS BIGINT) AS version
FROM ev WHERE lower(trim(agent_bucket)) <> 'reject'""")
def changed_rows(spark, sf):
    """A run over a stored table: fetched rows reset, rejects pruned; only what changed is written."""
    path, schema = _stored(spark, sf)
    before = changes.current(spark, path, schema)
    after = reset_fetched(prune(before.drop("version")))
    changes.put(changes.changed(before, after), path, "reset", 0)
    done = changes.current(spark, path, schema)
    return done.select("seq", "job_url", "fetch_status", "fetch_attempts", "version")


@query(f"""WITH {EVENT_TABLE},
found AS (SELECT event_id AS seq, 'https://www.linkedin.com/jobs/view/' || event_id AS url FROM events
  UNION ALL SELECT event_id, 'https://www.linkedin.com/jobs/view/' || event_id || 'n' FROM events WHERE event_id % 3 = 0),
known AS (SELECT rtrim(job_url, '/') AS url FROM ev),
fresh AS (SELECT row_number() OVER (ORDER BY seq, url) + (SELECT max(seq) FROM ev) AS seq, url
  FROM found WHERE url NOT IN (SELECT url FROM known))
SELECT seq, job_url, fetch_status FROM ev WHERE lower(trim(agent_bucket)) <> 'reject'
UNION ALL SELECT seq, url, 'pending' FROM fresh""")
def pruned_stay_out(spark, sf):
    """Rejects are pruned, then all their addresses are found again, beside new ones: they stay out."""
    path, schema = _stored(spark, sf)
    columns = fixed.MAIL_COLUMNS
    rejected = F.lower(strip(text("agent_bucket"))) == "reject"
    gone = merges.deletions(changes.written(spark, path, schema), columns, rejected)
    changes.put(gone, path, "prune", 0)
    events = load(spark, sf, "events")
    url = F.concat(F.lit("https://www.linkedin.com/jobs/view/"), F.col("event_id").cast("string"))
    found = events.select(F.col("event_id").alias("seq"), url.alias("url")).unionByName(
        events.filter("event_id % 3 = 0").select(F.col("event_id").alias("seq"), F.concat(url, F.lit("n")).alias("url"))
    ).withColumn("company", F.lit(""))
    rows = changes.written(spark, path, schema, without=("found", 0))
    changes.put(merges.inserts(rows, found, columns, "companies", NOW), path, "found", 0)
    return changes.current(spark, path, schema).select("seq", "job_url", "fetch_status")
