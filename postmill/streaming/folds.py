"""Per-key state over streams: fetch lifecycle, preferences, and what was seen first.

Each is its batch twin (`fold_attempts`, `fold_preferences`, `dedup_first`) fed batch by batch, by
`transformWithState`: rows as rows, since most keys have few in a batch, and a frame for each key costs
more than all else that is done for it. A query can start from a batch table: its rows are the initial state, so
a new checkpoint goes on where a batch fold ended. State ends: with `keep`, a key that is finished is
forgotten by a timer once the watermark is that much later than its last row, and rows that late are not
let in again. Without `keep` a stream needs no time and remembers every key.

Before the shuffle most of what cannot matter is dropped (all but the first few rows of a key in an
Arrow batch), so a hot key reaches its one state task much reduced. State belongs in RocksDB, the only
store that these operators take (see `sinks.on_disk`)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from postmill import fixed

#: Column of the event time in milliseconds, and of whole rows as text.
_AT, _ROW = "at_ms", "body"


def _first_rows(df: DataFrame, keys: list[str], order: list[str], n: int, last: str | None = None) -> DataFrame:
    """Stateless cut before the shuffle: of each Arrow batch at most the first `n` rows of a key (null is
    one), and the one with the largest `last`.

    Nothing is held from one batch to the next, so memory is that of a batch; a hot key is cut
    from a batch's thousands of rows to n or n + 1."""

    def job(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ordered = batch.sort_values(order, kind="stable", ignore_index=True)
            groups = ordered.groupby(keys, sort=False, dropna=False)
            some = groups.cumcount() < n
            if last is not None and len(ordered):
                known = ordered[last].fillna(-1)  # rows without a time come before all others
                some |= ordered.index.isin(known.groupby([ordered[k] for k in keys], sort=False, dropna=False).idxmax())
            yield ordered[some]

    return df.mapInPandas(job, df.schema)


def _timed(stream: DataFrame, ts: str, lateness: str) -> DataFrame:
    """With a watermark on `ts`, and the time in milliseconds."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    return timed.withColumn(_AT, F.unix_millis(ts))


def _milliseconds(duration: str) -> int:
    return int(pd.Timedelta(duration) / pd.Timedelta(1, "ms"))


class _Forgetting(StatefulProcessor):
    """State of one row for each key, that may end `keep` milliseconds after the key's last row."""

    schema = ""

    def __init__(self, keep: int | None):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.schema)

    def forget_at(self, last: int | None) -> None:
        """One timer for the key, later than all those before."""
        if self.keep is None or last is None:
            return
        for timer in list(self.handle.listTimers()):
            if timer >= last + self.keep:
                return
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.keep)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def _by(*names: str):
    """Order of rows by columns, those without a value last."""
    return lambda row: tuple((row[n] is None, row[n] or 0) for n in names)


def _last(rows: list[Row]) -> int | None:
    return max((r[_AT] for r in rows if _AT in r and r[_AT] is not None), default=None)


class _Attempts(_Forgetting):
    schema = "used INT, status STRING, error STRING"

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        row = initialState
        self.state.update((row.fetch_attempts, row.fetch_status, row.fetch_error))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        used, status, error = self.state.get() or (0, None, None)
        before, batch = status, sorted(rows, key=_by("seq"))
        for a in batch:
            if status == "fetched" or used >= fixed.MAX_ATTEMPTS:
                break
            used += 1
            if a.outcome == "ok":
                status, error = "fetched", ""
            elif a.outcome == "timeout":
                status, error = "timeout", "timeout"
            else:
                bare = a.outcome == "parse_empty"
                status = "failed"
                error = a.outcome if bare else f"{a.outcome}:{a.error_type or ''}"
        self.state.update((used, status, error))
        if status == "fetched" or used >= fixed.MAX_ATTEMPTS:
            self.forget_at(_last(batch))
        yield Row(url=key[0], fetch_attempts=used, fetch_status=status, fetch_error=error, old_status=before)


def attempt_states(
    attempts: DataFrame, initial: DataFrame | None = None, keep: str | None = None, lateness: str = "1 hour"
) -> DataFrame:
    """Stream (url, seq, outcome, error_type) -> changed states, in update mode:
    url, fetch_attempts, fetch_status, fetch_error, old_status (null for a new url).

    Within a batch attempts are taken in seq order, across batches as they arrive. A null url is a key.
    initial: states to start from (url, fetch_attempts, fetch_status, fetch_error), as `fold_attempts`
    gives them, one for a url; read when the query first starts. keep: a finished url is forgotten that
    long after its last attempt; then attempts need `ts`, and ones older than the watermark
    (`lateness` behind the latest) are dropped."""
    columns = ["url", "seq", "outcome", "error_type"]
    narrow = attempts.select(*columns) if keep is None else _timed(
        attempts.select(*columns, "ts"), "ts", lateness
    )
    cut = _first_rows(narrow, ["url"], ["seq"], fixed.MAX_ATTEMPTS, None if keep is None else _AT)
    return cut.groupBy("url").transformWithState(
        _Attempts(keep and _milliseconds(keep)),
        "url STRING, fetch_attempts INT, fetch_status STRING, fetch_error STRING, old_status STRING",
        "update", "none" if keep is None else "eventTime",
        initialState=None if initial is None else initial.select(
            "url", "fetch_attempts", "fetch_status", "fetch_error").groupBy("url"),
    )


class _Preferences(_Forgetting):
    schema = "kind STRING"

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.state.update((initialState.kind,))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        batch = list(rows)
        known = self.state.exists()
        if not known:
            first = min(batch, key=_by("seq"))
            self.state.update((first.action,))
        self.forget_at(_last(batch))
        if not known:
            yield Row(owner=key[0], kind=first.action, value=key[1], seq=first.seq)


def preference_states(
    events: DataFrame, initial: DataFrame | None = None, keep: str | None = None, lateness: str = "1 hour"
) -> DataFrame:
    """Stream (owner, seq, entity, action) -> new standing preferences: owner, kind, value, seq.

    Entities must be canonical (`canonical_entities`) and not empty. initial: standing preferences to
    start from (owner, value, kind), as `fold_preferences` gives them. keep: an entity is forgotten that
    long after its last event, which needs `ts`; its next event then counts as a first one, so give what
    is stored as `initial` when a query starts anew."""
    columns = ["owner", "entity", "seq", "action"]
    narrow = events.select(*columns) if keep is None else _timed(events.select(*columns, "ts"), "ts", lateness)
    cut = _first_rows(narrow, ["owner", "entity"], ["seq"], 1, None if keep is None else _AT)
    return cut.groupBy("owner", "entity").transformWithState(
        _Preferences(keep and _milliseconds(keep)), "owner STRING, kind STRING, value STRING, seq BIGINT",
        "append", "none" if keep is None else "eventTime",
        initialState=None if initial is None else initial.select(
            "owner", F.col("value").alias("entity"), "kind").groupBy("owner", "entity"),
    )


class _Earliest(_Forgetting):
    """The earliest row so far (in microseconds, then by order) until it is sent; then a mark that it was."""

    schema = "at BIGINT, ord BIGINT, body STRING, sent BOOLEAN"

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first = min(rows, key=_by("at_us", "ord"))
        yield from ()  # rows are sent by the timer
        held = self.state.get()
        if held is not None:
            if held[3] or _by("at_us", "ord")({"at_us": held[0], "ord": held[1]}) <= _by("at_us", "ord")(first):
                return
            self.handle.deleteTimer(held[0] // 1000)
        self.state.update((first.at_us, first.ord, first.body, False))
        self.handle.registerTimer(first.at_us // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at, ord_, body, sent = self.state.get()
        if sent:
            self.state.clear()
            return
        self.state.update((at, ord_, None, True))
        if self.keep is not None:
            self.handle.registerTimer(at // 1000 + self.keep)
        yield Row(**{_ROW: body})


def earliest(
    stream: DataFrame, keys: list[str], ts: str, order: str, lateness: str, keep: str | None = None
) -> DataFrame:
    """The earliest row of each key, whole, in append mode: by `ts`, then by the whole number `order`.

    A row is sent once the watermark (`lateness` behind the latest row) has reached it, when no earlier
    one can be let in. Then only a mark stays, without the row; with `keep`, the mark goes that long
    after the row's time, and a later row of the key is a first one again. Keys may be null; rows
    without a time are left out."""
    stream = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    kinds = StructType([stream.schema[c] for c in stream.columns])
    options = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    packed = stream.filter(F.col(ts).isNotNull()).withWatermark(ts, lateness).select(
        *[F.col(k).alias(f"key{i}") for i, k in enumerate(keys)], ts,
        F.unix_micros(ts).alias("at_us"), F.col(order).cast("bigint").alias("ord"),
        F.to_json(F.struct(*stream.columns), options).alias(_ROW),
    )
    names = [f"key{i}" for i in range(len(keys))]
    cut = _first_rows(packed, names, ["at_us", "ord"], 1)
    sent = cut.groupBy(*names).transformWithState(
        _Earliest(keep and _milliseconds(keep)), f"`{_ROW}` STRING", "append", "eventTime"
    )
    return sent.select(F.from_json(_ROW, kinds, options).alias("r")).select("r.*")
