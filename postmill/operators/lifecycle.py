"""The fetch lifecycle: who is fetched next, what an outcome does, resets, invariants.

States: pending, fetched, failed, timeout. Terminal: fetched, or three attempts used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postmill import fixed
from postmill.functions import urls
from postmill.functions.text import lenient_int, strip, text
from postmill.operators.dedup import dedup_first, maybe_among
from postmill.operators.extract import parse_pages
from postmill.session import settle
from postmill.sources.tables import text_columns


def is_eligible(max_attempts: int = fixed.MAX_ATTEMPTS) -> Column:
    # a blank status counts as pending; one of spaces only does not
    status = F.when(text("fetch_status") == "", F.lit("pending")).otherwise(
        strip(text("fetch_status"))
    )
    return (
        (strip(text("job_url")) != "")
        & status.isin(fixed.RETRYABLE)
        & (lenient_int("fetch_attempts") < max_attempts)
    )


def eligible(
    table: DataFrame, cap: int | None = None, max_attempts: int = fixed.MAX_ATTEMPTS
) -> DataFrame:
    """Rows to fetch next: all, or the first `cap` of them in table order."""
    rows = table.filter(is_eligible(max_attempts))
    return rows if cap is None else rows.orderBy("seq").limit(cap)


def scoreable(table: DataFrame) -> DataFrame:
    """Fetched rows as postings to score."""
    return table.filter("fetch_status = 'fetched'").select(
        "seq",
        "source",
        F.col("job_url").alias("url"),
        F.col("role_title").alias("title"),
        "company",
        F.col("location").alias("location_text"),
        "job_description",
    )


def fetch_outcomes(
    rows: DataFrame, attempts: DataFrame, run: int | None = None, cap: int | None = None,
    chars: int | None = None, max_attempts: int = fixed.MAX_ATTEMPTS,
) -> DataFrame:
    """The cells one run of fetches sets on each of `rows` (seq, job_url, fetch_attempts) that has
    an outcome; on the first `cap` of these, if that is given.

    attempts: (url, run, outcome ok|timeout|http_error|parse_error, error_type, html), and `ts` if
    there is one. Of a url and run the first outcome counts, by ts, then outcome and error_type.
    With `run`, that run's outcomes are taken. Without, the log may hold many runs: a row that has
    used n attempts takes the (n + 1)th run of its url, so the whole log can be given each time.

    Pages are parsed where they lie, and only the fields are moved: html is never shuffled. Which
    outcomes are taken is settled first, and only pages that may be theirs are parsed."""
    targets = rows.select(
        "seq", urls.drop_tracking(strip(text("job_url"))).alias("url"),
        (lenient_int("fetch_attempts") + 1).alias("turn"),
    )
    log = attempts.withColumn("url", urls.drop_tracking(strip(text("url"))))
    if run is not None:
        log = log.filter(F.col("run") == run)
    order = [*(["ts"] if "ts" in log.columns else []), "outcome", "error_type"]
    narrow = log.select("url", "run", *order)
    if run is None:  # only the first runs of a url can be taken: map tasks send on no more
        narrow = narrow.withColumn("turn", F.dense_rank().over(W.partitionBy("url").orderBy("run")))
        narrow = narrow.filter(F.col("turn") <= max_attempts)
    first = dedup_first(narrow, ["url", "run"], order)
    tried = targets.join(first, ["url", "turn"] if run is None else "url")
    if cap is not None:
        tried = tried.orderBy("seq").limit(cap)
    tried = settle(tried.select("seq", "url", "run", "outcome", "error_type"))
    pages = maybe_among(log.filter("outcome = 'ok'").select("url", "run", "html"), tried, ["url", "run"])
    read = parse_pages(pages, ["url", "run"], chars=chars)
    parsed = dedup_first(read, ["url", "run"], ["role_title", "description"])
    both = tried.join(parsed, ["url", "run"], "left")
    o = F.col("outcome")
    broken = F.when(o == "parse_error", F.col("error_type")).otherwise(F.col("parse_error"))
    empty = (F.col("role_title") == "") & (F.col("description") == "")
    status = (
        F.when(o == "timeout", F.lit("timeout"))
        .when((o != "ok") | broken.isNotNull() | empty, F.lit("failed"))
        .otherwise(F.lit("fetched"))
    )
    error = (
        F.when(o == "timeout", F.lit("timeout"))
        .when(o == "http_error", F.concat(F.lit("http_error:"), text("error_type")))
        .when(broken.isNotNull() | (o == "parse_error"), F.concat(F.lit("parse_error:"), text(broken)))
        .when(empty, F.lit("parse_empty"))
        .otherwise(F.lit(""))
    )
    return both.select(
        "seq", status.alias("fetch_status"), error.alias("fetch_error"),
        "role_title", "company", "location", F.col("description").alias("job_description"),
    )


def outcome_cells(
    table: DataFrame, attempts: DataFrame, now: str, cap: int | None = None,
    run: int | None = None, chars: int | None = None, summary_chars: int = fixed.SUMMARY_CHARS,
    max_attempts: int = fixed.MAX_ATTEMPTS,
) -> DataFrame:
    """`fetch_outcomes` of the rows of a table that are eligible, with the summary.

    With `run`, rows fetched at `now` are left: they have had it."""
    waiting = eligible(table, None, max_attempts)
    if run is not None:
        waiting = waiting.filter(text("last_fetch_at") != now)
    cells = fetch_outcomes(waiting, attempts, run, cap, chars, max_attempts)
    return cells.withColumn("job_summary", summary("job_description", summary_chars))


def summary(description: Column | str, chars: int = fixed.SUMMARY_CHARS) -> Column:
    """What the summary column holds: the description's first characters."""
    return F.left(description, F.lit(chars))


def apply_cells(table: DataFrame, cells: DataFrame, now: str) -> DataFrame:
    """The table after a run whose outcomes are `cells`: one join by seq.

    A success overwrites the parsed fields, also with ''; a failure leaves them."""
    content = ["role_title", "company", "location", "job_description", "job_summary"]
    cells = cells.select(F.col("seq").alias("__seq"), *[
        F.col(c).alias(f"__{c}") for c in cells.columns if c != "seq"
    ])
    hit = F.col("__seq").isNotNull()
    good = hit & (F.col("__fetch_status") == "fetched")
    values = {
        "fetch_attempts": (hit, (lenient_int("fetch_attempts") + 1).cast("string")),
        "last_fetch_at": (hit, F.lit(now)),
        "fetch_status": (hit, F.col("__fetch_status")),
        "fetch_error": (hit, F.col("__fetch_error")),
    } | {c: (good, text(f"__{c}")) for c in content}
    joined = table.join(cells, F.col("seq") == F.col("__seq"), "left")
    return joined.select(
        "seq",
        *[
            F.when(values[c][0], values[c][1]).otherwise(F.col(c)).alias(c)
            if c in values else F.col(c)
            for c in text_columns(table)
        ],
    )


def apply_outcomes(
    table: DataFrame, attempts: DataFrame, now: str, cap: int | None = None,
    run: int | None = None, chars: int | None = None, summary_chars: int = fixed.SUMMARY_CHARS,
    max_attempts: int = fixed.MAX_ATTEMPTS,
) -> DataFrame:
    """One run: every eligible row with an outcome uses up an attempt.

    Which outcome that is, see `fetch_outcomes`. Applied again, a run changes nothing: without
    `run` the attempts used say how far a row is in the log, with it `now` does."""
    cells = outcome_cells(table, attempts, now, cap, run, chars, summary_chars, max_attempts)
    return apply_cells(table, cells, now)


def fold_attempts(log: DataFrame, key: str = "url", order: str = "seq") -> DataFrame:
    """State after a whole attempts log: key, fetch_attempts, fetch_status, fetch_error.

    log: (key, order, outcome ok|timeout|http_error|parse_error|parse_empty, error_type).
    Attempts are used up to the first success or the third; the rest is ignored. Only
    the first three of a key matter, so map tasks send on no more than that."""
    turn = W.partitionBy(key).orderBy(order)
    used = (
        log.select(key, order, "outcome", text("error_type").alias("error_type"))
        .withColumn("n", F.row_number().over(turn))
        .filter(F.col("n") <= fixed.MAX_ATTEMPTS)
    )
    first_ok = F.min(F.when(F.col("outcome") == "ok", F.col("n")))
    state = used.groupBy(key).agg(
        F.least(F.coalesce(first_ok, F.max("n")), F.max("n")).alias("fetch_attempts"),
        first_ok.isNotNull().alias("done"),
        F.max_by("outcome", "n").alias("outcome"),
        F.max_by("error_type", "n").alias("error_type"),
    )
    o = F.col("outcome")
    return state.select(
        key,
        F.col("fetch_attempts").cast("int").alias("fetch_attempts"),
        F.when(F.col("done"), F.lit("fetched")).when(o == "timeout", F.lit("timeout"))
        .otherwise(F.lit("failed")).alias("fetch_status"),
        F.when(F.col("done"), F.lit(""))
        .when(o.isin("timeout", "parse_empty"), o)
        .otherwise(F.concat(o, F.lit(":"), "error_type")).alias("fetch_error"),
    )


def reset_fetched(table: DataFrame) -> DataFrame:
    """Fetched rows back to pending with no attempts used; content and score stay."""
    hit = (F.col("fetch_status") == "fetched") & (strip(text("job_url")) != "")
    return table.withColumns({
        "fetch_attempts": F.when(hit, F.lit("0")).otherwise(F.col("fetch_attempts")),
        "fetch_status": F.when(hit, F.lit("pending")).otherwise(F.col("fetch_status")),
    })


def repair_urls(table: DataFrame) -> DataFrame:
    """Rows stored under a tracking address: address repaired, everything fetched cleared."""
    url = strip(text("job_url"))
    hit = url.contains(fixed.ALERT_TRACKED_PATH)
    cleared = [
        "fetch_error", "last_fetch_at", "role_title", "company", "location",
        "job_description", "job_summary", "agent_bucket", "agent_reasoning",
    ]
    values = {
        "job_url": urls.drop_tracking(url),
        "fetch_status": F.lit("pending"),
        "fetch_attempts": F.lit("0"),
    } | {c: F.lit("") for c in cleared}
    return table.withColumns(
        {c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items() if c in table.columns}
    )


def prune(table: DataFrame) -> DataFrame:
    """The table without rejected rows; unchanged if it has no bucket column."""
    if "agent_bucket" not in table.columns:
        return table
    return table.filter(F.lower(strip(text("agent_bucket"))) != "reject")


def check_invariants(table: DataFrame) -> DataFrame:
    """rule, must_be_zero, n. duplicate_key counts rows beyond the first of an address, duplicate_form
    addresses beyond the first that are forms of one posting (`a`, `a/`). Rules on fetched and scored rows
    are for information only."""
    attempts = strip(text("fetch_attempts")).try_cast("bigint")
    status, bucket = text("fetch_status"), strip(text("agent_bucket"))
    rules = {
        "state_undefined": ~status.isin(fixed.STATES),
        "attempts_out_of_range": F.coalesce(
            (attempts < 0) | (attempts > fixed.MAX_ATTEMPTS), F.lit(True)
        ),
        "fetched_unscored": (status == "fetched") & (bucket == ""),
        "scored_not_fetched": (status != "fetched") & (bucket != ""),
        "fetched_empty": (status == "fetched")
        & (text("role_title") == "") & (text("job_description") == ""),
    }
    counts = table.agg(*[F.count_if(r).alias(name) for name, r in rules.items()])
    names = ", ".join(f"'{n}', {n}" for n in rules)
    row_rules = counts.selectExpr(f"stack({len(rules)}, {names}) as (rule, n)")
    keys = table.select(strip(text("job_url")).alias("k")).filter("k <> ''").groupBy("k").count()
    forms = keys.groupBy(urls.key_form("k")).agg(F.sum(F.col("count") - 1).alias("same"), (F.count(F.lit(1)) - 1).alias("alike"))
    none = F.lit(0).cast("bigint")
    repeats = forms.agg(F.coalesce(F.sum("same"), none).alias("same"), F.coalesce(F.sum("alike"), none).alias("alike")).selectExpr(
        "stack(2, 'duplicate_key', same, 'duplicate_form', alike) as (rule, n)"
    )
    strict = ["state_undefined", "attempts_out_of_range", "duplicate_key", "duplicate_form"]
    return row_rules.unionByName(repeats).select(
        "rule", F.col("rule").isin(strict).alias("must_be_zero"), "n"
    )
