"""Streams into tables. Every sink is safe to replay: what a batch writes is named after it and its query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postmill.session import settle, settled_within
from postmill.sources import changes
from postmill.streaming import merges

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def on_disk(stream: DataFrame) -> DataFrame:
    """The stream, with its state in RocksDB unless the session names another store: state here
    has a row for each key, which the default store would keep in the executors' memory."""
    conf = stream.sparkSession.conf
    named = conf.get(_PROVIDER, "")
    if not named or named.endswith("HDFSBackedStateStoreProvider"):
        conf.set(_PROVIDER, ROCKS)
    return stream


def stream_of(batch: DataFrame) -> str:
    """The id of the query that a batch belongs to: it lives as long as the checkpoint."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or ""


def into_table(
    stream: DataFrame,
    path: str,
    merge: Callable[[DataFrame, DataFrame], DataFrame],
    schema: str,
    checkpoint: str,
) -> StreamingQuery:
    """Each batch: the rows that `merge(written rows, batch)` gives are written beside the others.

    What is written grows with the batch, not with the table. A batch that is replayed is merged with
    all rows but its own, and so writes the same rows to the same folder."""

    def one(batch: DataFrame, batch_id: int) -> None:
        writer = stream_of(batch)
        with settled_within(batch.sparkSession):
            rows = changes.written(batch.sparkSession, path, schema, without=(writer, batch_id))
            changes.put(merge(rows, settle(batch)), path, writer, batch_id)

    return (
        stream.writeStream.foreachBatch(one)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def touch_into(stream, path: str, columns: list[str], source: str, now: str, checkpoint: str) -> StreamingQuery:
    """Arrivals (url, seq) upserted: known ones touched, new ones pending, deleted ones left alone."""
    return into_table(
        stream, path, lambda rows, batch: merges.touches(rows, batch, columns, source, now),
        table_schema(columns), checkpoint,
    )


def insert_into(stream, path: str, columns: list[str], preset: str, now: str, checkpoint: str) -> StreamingQuery:
    """Arrivals inserted if absent."""
    return into_table(
        stream, path, lambda rows, batch: merges.inserts(rows, batch, columns, preset, now),
        table_schema(columns), checkpoint,
    )


def table_schema(columns: list[str]) -> str:
    return ", ".join(["seq BIGINT", *(f"{c} STRING" for c in columns)])


def append_into(
    stream: DataFrame, path: str, checkpoint: str, mode: str = "append"
) -> StreamingQuery:
    """The rows of a stream as Parquet files, by Spark's own file sink.

    That takes appended rows only. Changed ones (mode `update`) go to a folder for each query and
    batch, `q=…/b=…`, replaced as a whole if the batch is replayed."""
    out = on_disk(stream).writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    out = out.trigger(availableNow=True)
    if mode == "append":
        return out.format("parquet").option("path", path).start()

    def one(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/q={stream_of(batch)}/b={batch_id}")

    return out.foreachBatch(one).start()


def status_changes_into(states: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Per batch, how many urls entered and left each state: a few rows per batch."""

    def one(batch: DataFrame, batch_id: int) -> None:
        moves = batch.select(
            F.explode(F.array(
                F.struct(F.col("fetch_status").alias("fetch_status"), F.lit(1).alias("d")),
                F.struct(F.col("old_status").alias("fetch_status"), F.lit(-1).alias("d")),
            )).alias("m")
        ).select("m.*").filter("fetch_status is not null")
        moves.groupBy("fetch_status").agg(F.sum("d").alias("d")).write.mode(
            "overwrite"
        ).parquet(f"{path}/q={stream_of(batch)}/b={batch_id}")

    return (
        on_disk(states).writeStream.foreachBatch(one)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def running_status_counts(spark: SparkSession, path: str) -> DataFrame:
    """fetch_status, n: the sum of the changes so far."""
    return (
        spark.read.parquet(path).groupBy("fetch_status").agg(F.sum("d").alias("n")).filter("n > 0")
    )
