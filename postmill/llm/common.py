"""What the operators of this folder share: words, slices of a batch, tables written on the way."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.session import settle as write_and_read
from postmill.slices import SLICE_BYTES, by_slice, in_slices  # noqa: F401

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_freed(spark: SparkSession):
    """Jobs run inside drop their shuffle files as soon as they end: what they made is written."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def settle(df: DataFrame) -> DataFrame:
    """Write to a table in the shared folder and go on from there; its shuffles leave no files."""
    with _shuffles_freed(df.sparkSession):
        return write_and_read(df)


def free(*tables: DataFrame) -> None:
    """Delete settled tables that nothing will read again."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if "/settled/" in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def words(text: str | None) -> list[bytes]:
    """Runs of other characters than space and U+0009 to U+000D, in UTF-8; none for null.

    `bytes.split` parts at just these six, and no byte of a longer character is one of them."""
    return text.encode().split() if text else []


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bounded_ids(table: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` distinct keys, the same ones each time: those of the smallest hashes."""
    return table.select(key).dropna().distinct().orderBy(F.xxhash64(key), key).limit(most)


def free_name(name: str, taken: list[str]) -> str:
    """A column name that starts like this and is none of the table's."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name
