"""Order without a global window: dense index, chunks, islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postmill.session import settle


def dense_index(
    df: DataFrame, key: str, name: str = "idx", within: list[str] | None = None
) -> DataFrame:
    """Number rows 1, 2, 3… by a unique `key` (per `within` group, if given).

    Only the keys are sorted, by ranges: so sparse and hashed keys are dealt as evenly as dense
    ones, and a group that holds most rows is dealt over many ranges. A row's number is its place
    in its range plus the rows of the group in the ranges before; those counts are as many as there
    are ranges. The ranges are written, so that all of the plan sees the same ones. The other
    columns are moved once, to join the numbers."""
    group = within or []
    placed = settle(
        df.select(*group, key).repartitionByRange(key).withColumn("__range", F.spark_partition_id())
    )
    before = W.partitionBy(*group).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    counts = placed.groupBy(*group, "__range").agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select(
        *group, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")
    )
    in_range = W.partitionBy(*group, "__range").orderBy(key)
    numbers = placed.withColumn("__place", F.row_number().over(in_range)).join(
        offsets, [*group, "__range"]
    )
    numbers = numbers.select(key, (F.col("__place") + F.col("__before")).alias(name))
    return df.join(numbers, key).select(*df.columns, name)


def pack_no(idx: Column, size: int) -> Column:
    """Which chunk of `size` a 1-based dense index falls in (0, 1, 2…)."""
    return F.call_function("div", idx - 1, F.lit(size))


def contiguous_ranges(df: DataFrame, col: str, min_value: int = 2) -> DataFrame:
    """Runs of consecutive integers as inclusive (range_start, range_end), last run first.

    Along a run, value minus dense index is constant, so one partial-aggregated
    group-by finds the ends however long a run is."""
    values = df.select(F.col(col).cast("bigint").alias("v")).filter(
        F.col("v") >= min_value
    ).distinct()
    return (
        dense_index(values, "v")
        .groupBy((F.col("v") - F.col("idx")).alias("run"))
        .agg(F.min("v").alias("range_start"), F.max("v").alias("range_end"))
        .select("range_start", "range_end")
        .orderBy(F.desc("range_end"))
    )
