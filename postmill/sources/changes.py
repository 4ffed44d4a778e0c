"""Tables as rows and their later versions: what a run or a batch changes is written beside the rest.

A table is a folder of Parquet files that Spark's own writer makes. A row carries `version`, which
grows by one each time the row (its `seq`) changes, and `gone`, which is set where it was deleted;
that row then stays as a tombstone, so a key that was pruned is still known. What a writer changes
at once is one folder, `q=writer/b=batch`, dealt by a hash of `seq`. A batch that is replayed writes the
same folder again, and does not see what it wrote the first time: so it changes nothing.

The latest version of each row is an aggregate over narrow columns, combined before the shuffle;
wide columns are read only for the rows that are asked for. One writer at a time, as for any file.
Where a table format is at hand, its MERGE takes the place of `put`; the rest are functions of frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.sources.tables import text_columns

#: Folders that the rows of one batch are dealt to, by a hash of seq.
PARTS = 32
_META = "version BIGINT, gone BOOLEAN"
_PLACE = ["version", "q", "b"]


def _names(schema: str) -> list[str]:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).names


def written(
    spark: SparkSession, path: str, schema: str, without: tuple[str, int] | None = None
) -> DataFrame:
    """All versions of all rows: the columns of `schema`, version, gone, q, b. `without`: the writer and
    batch whose rows are left out. A folder that is not there yet has no rows."""
    full = f"{schema}, {_META}, part INT, q STRING, b BIGINT"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], full)
    rows = spark.read.schema(full).parquet(path)
    if without is not None:
        rows = rows.filter(~((F.col("q") == without[0]) & (F.col("b") == without[1])))
    return rows


def heads(rows: DataFrame, *columns: str) -> DataFrame:
    """seq, the named columns, version, gone, q, b of the latest version of each row of `written`."""
    rest = [c for c in columns if c not in ("seq", "version", "gone", "q", "b")]
    newest = F.max(F.struct(*_PLACE, "gone", *rest)).alias("head")
    return rows.groupBy("seq").agg(newest).select("seq", *[f"head.{c}" for c in (*rest, *_PLACE, "gone")])


def rows_at(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The whole rows of `written` that `found` (seq, version, q, b) names."""
    at = ["seq", *_PLACE]
    return rows.join(found.select(*at), at, "left_semi")


def current(
    spark: SparkSession, path: str, schema: str, without: tuple[str, int] | None = None,
    tombstones: bool = False,
) -> DataFrame:
    """The table as it is: columns of `schema` and version; with `tombstones` the deleted rows too, and gone."""
    rows = written(spark, path, schema, without)
    found = heads(rows)
    if not tombstones:
        found = found.filter(~F.col("gone"))
    kept = [*_names(schema), "version", *(["gone"] if tombstones else [])]
    return rows_at(rows, found).select(*kept)


def put(changed: DataFrame, path: str, writer: str, batch: int, parts: int = PARTS) -> None:
    """Write changed rows (with version and gone) as the folder of this writer and batch.

    Adaptive execution makes tasks of a fitting size: several for a part of a large base, and one for
    many parts of a small batch."""
    dealt = changed.withColumn("part", F.pmod(F.xxhash64("seq"), F.lit(parts)).cast("int")).hint("rebalance", "part")
    dealt.write.mode("overwrite").partitionBy("part").parquet(f"{path}/q={writer}/b={batch}")


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """What turns `before` (of `current`, with version) into `after`, as rows for `put`: those that are
    new or differ in a column, and those that are not in `after`, as gone.

    Only seq, version and two hashes of a row's columns are compared, so of `before` no wide column moves."""
    columns = text_columns(after)
    marks = lambda df: F.struct(*[F.xxhash64(F.lit(k), *[F.coalesce(F.col(c), F.lit("")) for c in columns]) for k in (0, 1)])
    old = before.select("seq", F.col("version").alias("old"), marks(before).alias("was"))
    both = after.withColumn("is", marks(after)).join(old, "seq", "left")
    differs = F.col("old").isNull() | (F.col("was") != F.col("is"))
    version = (F.coalesce("old", F.lit(0)) + 1).cast("bigint").alias("version")
    set_ = both.filter(differs).select("seq", *columns, version, F.lit(False).alias("gone"))
    lost = before.join(after.select("seq"), "seq", "left_anti")
    return set_.unionByName(lost.select("seq", *columns, (F.col("version") + 1).alias("version"), F.lit(True).alias("gone")))


def folded(spark: SparkSession, path: str, schema: str, into: str) -> None:
    """The latest version of each row, tombstones included, as the one base of a new folder. Readers of
    `path` are not touched; give them `into` when they start next, and drop `path` after that."""
    put(current(spark, path, schema, tombstones=True), into, "base", 0, parts=max(PARTS, spark.sparkContext.defaultParallelism))
