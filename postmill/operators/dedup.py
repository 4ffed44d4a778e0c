"""First-wins dedup and the last-wins key index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postmill.functions.text import strip, text
from postmill.functions.urls import key_form, slash_twin


def dedup_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep the earliest row of each key.

    With only key and one order column this is a hash `min`. Otherwise it is
    `row_number = 1`, which Spark plans with a group limit on the map side:
    every map task sends on at most one row per key, so a hot key costs nothing.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    if not rest and len(order) == 1:
        return df.groupBy(*keys).agg(F.min(order[0]).alias(order[0])).select(*df.columns)
    first = W.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("__rn", F.row_number().over(first)).filter("__rn = 1").drop("__rn")
    )


#: Bits of a map of keys, and of one of its pieces (as Spark's bitmap functions have them).
_MAP_BITS, _PIECE_BITS = 1 << 27, 1 << 15


def maybe_among(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys may be among those of `wanted`: all that are, and by chance a few others.

    Rows stay where they are, however wide. What is broadcast is a bit for the hash of each wanted
    key, 16 MB at most however many there are; beyond some tens of millions more rows pass in vain.
    Join what is left by the keys."""
    place = F.pmod(F.xxhash64(*keys), F.lit(_MAP_BITS))
    piece, bit = F.floor(place / _PIECE_BITS).cast("int"), (place % _PIECE_BITS).cast("int")
    marks = wanted.select(piece.alias("__piece"), bit.cast("bigint").alias("__bit")).groupBy("__piece").agg(
        F.bitmap_construct_agg("__bit").alias("__bits")
    )
    byte = F.conv(F.hex(F.substring("__bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = F.getbit(byte, bit % 8) == 1
    return rows.join(F.broadcast(marks), (piece == F.col("__piece")) & marked, "left_semi")


def one_form(rows: DataFrame, order: list[str], key: str = "url") -> DataFrame:
    """The earliest row of all whose keys are forms of one address (slashes, tracking path)."""
    formed = rows.withColumn("__form", key_form(key))
    return dedup_first(formed, ["__form"], [*order, key]).drop("__form")


def known_keys(table: DataFrame, key: str = "job_url", also: list[str] | None = None) -> DataFrame:
    """Every form (trimmed key and slash twin) under which a row can be found: key, row_seq, and the
    columns `also`."""
    k, also = strip(text(key)), also or []
    return (
        table.select(k.alias("k"), F.col("seq").alias("row_seq"), *also)
        .filter("k <> ''")
        .select(
            F.explode(F.array(F.col("k"), slash_twin("k"))).alias("key"), "row_seq", *also
        )
    )


def key_index(table: DataFrame, key: str = "job_url") -> DataFrame:
    """key -> row_seq; of several rows with one key form the latest row wins."""
    return known_keys(table, key).groupBy("key").agg(F.max("row_seq").alias("row_seq"))
