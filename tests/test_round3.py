"""Findings of round 3: queries against their SQL on made pages."""

import pytest

from __spark_entry__ import oracle_sql, queries
from oracle.check import connect, difference

from .conftest import SMALL


@pytest.fixture(scope="module")
def odd_pages(spark, tmp_path_factory):
    """The small tables with pages whose titles are cut inside a reference, or have more spaces than letters in a row."""
    folder = tmp_path_factory.mktemp("odd")
    for table in ("documents", "labels", "conversations", "embeddings", "events", "benchmark", "customer", "lineitem", "nation", "orders", "part", "region", "supplier"):
        (folder / f"{table}.parquet").symlink_to(f"{SMALL}/{table}.parquet")
    titles = ["cut &amp;&amp;&amp", "cut &am", "cut &amp;&lt", "&amp;lt; &copy; &nosuch; &ampx; & b", "L a L a L a \u00e9 \u00e9 \u00e9 \u00e9 \u00eaa", "One title"]
    rows = [(i, f"https://h/{i}", f"<html><head><title>{t}</title></head><body><h1>{t}</h1><p>text {i}</p></body></html>") for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(folder / "made"))
    next((folder / "made").glob("*.parquet")).rename(folder / "pages.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["s5_html_blocks", "c5_html_to_text", "w2_tracked_lines"])
def test_odd_pages(spark, odd_pages, name):
    got = queries()[name](spark, odd_pages).toArrow()
    assert difference(got, connect(odd_pages).execute(oracle_sql()[name]).to_arrow_table()) is None


def test_lines_without_windows(spark, views):
    """Rows become lines inside batches: no window over runs, and the same lines however the batches fall."""
    from corpusloom.operators import layout

    lines = layout.to_text_lines(views.runs, ordered=True)
    assert "Window" not in lines._jdf.queryExecution().executedPlan().toString()
    want = sorted(map(tuple, lines.collect()))
    default = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(tuple, lines.where("doc_id < 40").collect())) == [r for r in want if r[0] < 40]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", default)
    assert sorted(map(tuple, layout.to_text_lines(views.runs.repartition(5)).collect())) == want


def test_compounds_only_where_asked(spark):
    """Lines that no hyphen ends don't carry their document's compounds."""
    from corpusloom.operators import prose

    lines = spark.createDataFrame([(1, "a well-known word"), (1, "split well-"), (1, "well-­ "), (2, "none-"), (2, "plain")], "doc_id long, text string")
    got = {(r["doc_id"], r["text"]): r["seen"] for r in prose.with_compounds(lines).collect()}
    assert got == {(1, "a well-known word"): None, (1, "split well-"): ["well-known"], (1, "well-­ "): ["well-known"], (2, "none-"): [], (2, "plain"): None}


def test_first_hits_without_a_sort_of_all_hits(views):
    from corpusloom.operators import search

    assert "SortAggregate" not in search.hit_pages(search.find(views.runs, ["e"]))._jdf.queryExecution().executedPlan().toString()


def test_merged_rects_come_from_one_grouping(spark):
    from corpusloom.plans.registry import run_query

    plan = run_query("w17_merge_rects", spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "collect_list" in plan
