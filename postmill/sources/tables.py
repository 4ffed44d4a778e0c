"""Table shape: grids of text to records, alignment, appends, patches, deletes.

A table is `seq BIGINT` (arrival order, unique) plus text columns; the empty
string is the null. Row position is never a key."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.functions.text import strip, text


def column_key(name: str | None) -> str:
    """The form in which column names are compared: lower case, blanks and hyphens as `_`."""
    return re.sub("[ -]", "_", "" if name is None else name.strip().lower())


def header_names(header: list[str]) -> list[str]:
    """Column names for a header row: normalised, blanks numbered by place, repeats by count."""
    plain = [column_key(cell) or f"__col_{place}" for place, cell in enumerate(header)]
    before = [plain[:place].count(name) for place, name in enumerate(plain)]
    return [f"{name}__{n}" if n else name for name, n in zip(plain, before, strict=True)]


def from_grid(cells: DataFrame, header: list[str]) -> DataFrame:
    """(seq, cells ARRAY<STRING>) -> one text column per header cell.

    Short rows are filled with '', surplus cells dropped."""
    return cells.select(
        "seq",
        *[
            text(F.get("cells", F.lit(i))).alias(name)
            for i, name in enumerate(header_names(header))
        ],
    )


def bind(df: DataFrame, columns: list[str]) -> DataFrame:
    """Select columns by normalised name; the first that fits wins, none is an error."""
    found = {column_key(c): c for c in reversed(df.columns)}
    absent = sorted(c for c in columns if column_key(c) not in found)
    if absent:
        raise ValueError(f"no column for {', '.join(absent)} among: {', '.join(df.columns)}")
    keep = ["seq"] if "seq" in df.columns and "seq" not in columns else []
    return df.select(*keep, *[F.col(f"`{found[column_key(c)]}`").alias(c) for c in columns])


def align(df: DataFrame, columns: list[str]) -> DataFrame:
    """Target column order; a missing column or null is ''."""
    have = set(df.columns)

    def pick(c: str):
        alt = c.strip().lower().replace(" ", "_")
        exact = F.col(f"`{c}`").cast("string") if c in have else F.lit(None).cast("string")
        other = F.col(f"`{alt}`").cast("string") if alt in have and alt != c else F.lit("")
        return F.coalesce(exact, other, F.lit("")).alias(c)

    return df.select("seq", *[pick(c) for c in columns])


def text_columns(table: DataFrame) -> list[str]:
    return [c for c in table.columns if c != "seq"]


def next_seq(table: DataFrame):
    """First free `seq`, as a scalar subquery over the one narrow column."""
    return F.coalesce(
        table.agg(F.max("seq").alias("m")).scalar() + 1, F.lit(0).cast("bigint")
    )


def append(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows placed after the table in their own `seq` order (gaps in seq are harmless)."""
    columns = text_columns(table)
    if not columns:
        raise ValueError("a table without text columns takes no rows")
    fresh = align(rows, columns)
    return table.unionByName(
        fresh.withColumn("seq", F.col("seq").cast("bigint") + next_seq(table))
    )


def apply_patches(table: DataFrame, patches: DataFrame, key: str = "seq") -> DataFrame:
    """Sparse update. patches: (key, patch_seq, changes MAP<STRING,STRING>).

    Per row and column the latest patch wins; a null value clears the cell; cells
    no patch names keep their value. One aggregation (combined on the map side, so
    a row with very many patches is no hot spot) and one join."""
    columns = text_columns(table)

    def latest(c: str):
        named = F.map_contains_key("changes", c)
        value = F.when(named, text(F.col("changes")[c]))
        return F.max_by(value, F.when(named, F.col("patch_seq"))).alias(f"__{c}")

    merged = patches.groupBy(F.col(key).alias("__key")).agg(*[latest(c) for c in columns])
    return table.join(merged, F.col(key) == F.col("__key"), "left").select(
        "seq", *[F.coalesce(f"__{c}", c).alias(c) for c in columns]
    )


def delete_rows(table: DataFrame, keys: DataFrame, key: str = "seq") -> DataFrame:
    """The table without the rows named in `keys`."""
    return table.join(keys.select(key), key, "left_anti").select(*table.columns)


def read_companies(table: DataFrame) -> DataFrame:
    """Company list rows that name at least one address. A missing column gives no rows."""
    names = ["company", "company_url", "career_site_url"]
    try:
        bound = bind(table, names)
    except ValueError:
        return table.sparkSession.createDataFrame(
            [], "seq bigint, company string, company_url string, career_site_url string"
        )
    return bound.select("seq", *[strip(text(c)).alias(c) for c in names]).filter(
        "company_url <> '' or career_site_url <> ''"
    )
