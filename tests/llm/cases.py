"""Small tables with every awkward row: nulls, empty and long texts, ties, repeats, odd columns."""

from __future__ import annotations

import random

import duckdb
import pyarrow as pa

from tests.oracle import _norm

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def rows(df):
    names = df.columns
    return [dict(zip(names, r, strict=True)) for r in df.collect()]


def awkward(seed: int = 1) -> list[tuple]:
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéñ") for _ in range(r.randrange(1, 6)))
    passage = " ".join(word() for _ in range(45))
    long = " ".join(word() for _ in range(30_000))
    texts = [
        None, "", " \t\n", "one", "Two words", passage, passage, f"before {passage}\nafter",
        passage.upper(), long, "a " * 70, "a b " * 40, f"x {passage} y {passage}", "line\nline\n\nline",
        " wide space\u0085 here", "\x00\x01 \x1c\x1f \r\n\x0b\x0c end", "日本語 😀👍🏽 é",
        " ".join(word() for _ in range(25)), "MIT License, cc-by and the GNU General Public License",
    ]
    made = [(i, t) for i, t in enumerate(texts)]
    made += [(5, texts[5]), (5, texts[5]), (3, "another text of a known id"), (None, passage), (None, None)]
    r.shuffle(made)
    return [(i, t, "en", "src0", len(t or "")) for i, t in made]


def documents(spark, data=None):
    return spark.createDataFrame(awkward() if data is None else data, COLUMNS)


def clashing(spark, df, names):
    """The table with extra columns that are named like an operator's own."""
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit("own") for n in names if n not in df.columns})


def sql_rows(sql: str, **tables: list[dict]) -> list[tuple]:
    con = duckdb.connect()
    for name, table in tables.items():
        con.register(name, pa.Table.from_pylist(table) if isinstance(table, list) else table)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in found.fetchall()), key=repr)


def spark_rows(df) -> list[tuple]:
    names = sorted(df.columns)
    return sorted((tuple(_norm(v) for v in r) for r in df.select(*names).collect()), key=repr)
