"""What the plans must and must not hold."""

from __future__ import annotations

import re

import pytest

from postmill.bindings import QUERIES
from postmill.bindings.base import event_table, load
from postmill.operators import lifecycle as LC

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def lines(text: str, node: str) -> list[str]:
    return [line for line in text.splitlines() if re.search(rf"\b{node}\b", line)]


NARROW = ["attempt_fold", "first_events", "page_links", "api_postings"]


@pytest.mark.parametrize("name", NARROW)
def test_rows_are_cut_before_the_shuffle(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert re.search(r"WindowGroupLimit .* Partial", text) or "partial_" in text


@pytest.mark.parametrize(
    "name",
    ["page_links", "insert_boards", "upsert_touch", "score_writeback", "sparse_patch", "attempt_fold",
     "preference_verdicts", "preference_fold", "rule_buckets", "first_docs", "daily_delta", "key_index"],
)
def test_no_cross_join_and_no_single_partition_of_rows(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    # a single partition may only hold the one row of a final aggregate
    outside_subqueries = text.split("Subquery")[0]
    for line in lines(outside_subqueries, "SinglePartition"):
        assert "partial" in outside_subqueries, line


def test_html_is_never_shuffled(spark):
    for name in ("page_fields", "page_links", "listing_links", "mail_postings", "alert_links", "hosted_page_links"):
        for names in shuffled_columns(QUERIES[name](spark, SF)):
            assert not {"html", "glued", "spaced"} & set(names), name


def test_company_pages_are_joined_once_a_round(spark, monkeypatch):
    """Three rounds, each with one join of all wanted pages; none for the levels in turn."""
    from postmill.bindings.runs import companies, company_pages
    from postmill.operators import companies as C

    joins = []
    settled = C.settle

    def seen(df):
        joins.append(plan(df).count("Join ") - plan(df).count("BroadcastNestedLoopJoin "))
        return settled(df)

    monkeypatch.setattr(C, "settle", seen)
    C.discover_companies(companies(spark, SF), company_pages(spark, SF))
    assert joins[0] == 0 and len(joins) <= 5 and max(joins) == 1


def test_scans_read_only_what_is_used(spark):
    text = plan(LC.scoreable(event_table(spark, SF)).select("seq"))
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in text
    for scan in lines(plan(QUERIES["attempt_fold"](spark, SF)), "FileScan"):
        assert "props" not in scan and "value" not in scan


def test_the_capped_selection_is_a_top_k(spark):
    assert "TakeOrderedAndProject" in plan(LC.eligible(event_table(spark, SF), 25))


def test_rows_are_numbered_within_ranges(spark):
    """The window without a partition sums a row for each range, not rows of the table."""
    from postmill.operators.sequence import dense_index

    text = plan(dense_index(load(spark, SF, "documents").select("doc_id"), "doc_id"))
    rows = [w for w in lines(text, "Window") if "row_number" in w]
    assert rows and all("__range" in w for w in rows)


def test_an_exchange_of_fetch_outcomes_carries_no_html(spark):
    """What an exchange outputs, with broadcasts off, so that every join shows one."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        exchanges = shuffled_columns(QUERIES["fetch_outcomes"](spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert exchanges and all("html" not in names for names in exchanges)


def shuffled_columns(df) -> list[list[str]]:
    """The output columns of each shuffle of a plan."""
    found, waiting = [], [df._jdf.queryExecution().executedPlan()]
    while waiting:
        node = waiting.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            waiting.append(node.initialPlan())
            continue
        if node.nodeName() == "Exchange":
            out = node.output()
            found.append([out.apply(i).name() for i in range(out.size())])
        children = node.children()
        waiting += [children.apply(i) for i in range(children.size())]
    return found
