"""Python workers hold a slice of what they read: pages, texts and bodies are wide."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postmill.operators import extract as X
from postmill.operators import links as L
from postmill.slices import each
from postmill.sources import files


def test_each_gives_what_the_whole_would():
    texts = ["a", None, "", "b"] * 50 + ["x" * 5_000_000, None]
    assert each(pa.array(texts, pa.string()), lambda t: t and t.upper(), pa.string()).to_pylist() == [t and t.upper() for t in texts]
    assert each(pa.array([], pa.string()), str, pa.string()).to_pylist() == []


@pytest.mark.parametrize("kind", ["outlines", "anchors", "bodies", "text"])
def test_no_batch_is_made_a_frame(spark, kind):
    """A frame holds all texts of a batch as Python strings, up to four bytes a character."""
    pages = spark.createDataFrame([(i, f"<title>é{i}</title><a href='/x'>y</a>" if i % 3 else None) for i in range(300)], "id bigint, html string")
    bodies = files.api_bodies(pages.select(
        F.col("id").alias("seq"), F.lit("p").alias("page"), F.lit("https://api.swooped.co/graphql").alias("url"),
        F.to_json(F.struct(F.struct(F.lit("https://a.io/1").alias("apply_url")).alias("data"))).alias("body")))
    made = {
        "outlines": lambda: X.page_outlines(pages, ["id"]), "anchors": lambda: L.anchors(pages, ["id"]),
        "bodies": lambda: X.api_postings(bodies), "text": lambda: X.to_text(pages, "html"),
    }[kind]()
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and ("MapInArrow" in plan or "ArrowEvalPython" in plan)
    if kind == "text":
        from pyspark.util import PythonEvalType

        assert X._plain.evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF
    assert made.count() == {"outlines": 300, "anchors": 200, "bodies": 300, "text": 300}[kind]


def test_a_page_is_made_plain_text_once(spark):
    """One Python worker for it, whether the text was structured or not."""
    pages = spark.createDataFrame([
        (1, '<script type="application/ld+json">{"@type": "JobPosting", "title": "T", "description": "<b>x</b> y"}</script>'),
        (2, "<main>" + "long enough " * 20 + "</main>")], "id bigint, html string")
    parsed = X.parse_pages(pages, ["id"])
    assert parsed._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython ") == 1
    assert {r.id: (r.role_title, r.description) for r in parsed.collect()} == {1: ("T", "x y"), 2: ("", ("long enough " * 20).strip())}
