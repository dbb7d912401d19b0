"""Findings of round 3 on growth: steps read ordered rows batch by batch, however the batches fall."""

import pytest

from corpusloom.operators import prose


@pytest.fixture(params=[2, 10_000])
def batch(spark, request):
    default = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(request.param))
    yield request.param
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", default)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_eol_lines_without_windows(spark, batch):
    rows = [(1, 0, "a", False), (1, 1, "b", True), (1, 2, None, None), (1, 3, None, True), (1, 4, "c", True), (2, 0, "d", False), (2, 1, None, False),
            (3, 0, "e", True), (3, 1, "f", None), (None, 0, "g", True), (None, 1, "h", False)]
    items = spark.createDataFrame(rows, "doc long, n long, text string, eol boolean")
    want = [(None, 0, "g"), (None, 1, "h"), (1, 0, "ab"), (1, 1, None), (1, 2, "c"), (2, 0, "d"), (3, 0, "e"), (3, 1, "f")]
    for ordered, given in ((True, items.coalesce(1)), (False, items.orderBy("text"))):
        got = prose.eol_lines(given, ["doc"], ["n"], ordered=ordered)
        assert "Window" not in plan_of(got)
        assert sorted(map(tuple, got.collect()), key=lambda r: (r[0] or 0, r[1])) == want


def test_absorb_spaces_without_windows(spark, batch):
    rows = [(1, 0, 0, " "), (1, 0, 1, "a"), (1, 0, 2, "  "), (1, 0, 3, " "), (1, 0, 4, "b"), (1, 1, 0, ""), (1, 1, 1, "c"), (2, 0, 0, None), (2, 0, 1, " "), (2, 0, 2, "d")]
    pieces = spark.createDataFrame(rows, "doc long, line long, seq long, text string")
    want = [(1, 0, 1, " "), (1, 0, 2, "a   "), (1, 0, 3, "b"), (1, 1, 1, ""), (1, 1, 2, "c"), (2, 0, 1, " "), (2, 0, 2, "d")]
    for ordered, given in ((True, pieces.coalesce(1)), (False, pieces.orderBy("text"))):
        got = prose.absorb_spaces(given, ["doc", "line"], "seq", ordered=ordered)
        assert "Window" not in plan_of(got)
        assert sorted(map(tuple, got.collect())) == want


def test_hits_are_found_batch_by_batch(spark, batch):
    from corpusloom.operators import search

    rows = [(1, "aaaaa"), (2, "The\nthe"), (3, ""), (4, None), (5, "a.c abc 𝒳a.c\0a.c"), (6, "a"), (7, "a")]
    runs = spark.createDataFrame(rows, "run_no long, text string").selectExpr(
        "1L doc_id", "1L page_no", "0L row_no", "run_no", "text", "10L x", "60L * length(text) w").coalesce(1)
    hits = search.find(runs, ["aa", "the", " THE ", "a.c", ""])
    assert "split" not in plan_of(hits)
    got = sorted((r.run_no, r.q, r.pos, r.x, r.w) for r in hits.collect())
    assert got == sorted([(1, "aa", 0, 10.0, 120.0), (1, "aa", 2, 130.0, 120.0)] + 2 * [(2, "the", 0, 10.0, 180.0), (2, "the", 4, 250.0, 180.0)]
                         + [(5, "a.c", p, 10.0 + 60 * p, 180.0) for p in (0, 9, 13)])


def test_unique_names_in_one_pass(spark, batch):
    from corpusloom.functions.text import slug

    labels = ["a", "A 2", "a", "a!", "a 2", "b", None]
    rows = [(d, n, t) for d in (1, 2) for n, t in enumerate(labels)] + [(3, 0, "a"), (3, 1, "a")]
    given = spark.createDataFrame(rows, "doc long, n long, label string").coalesce(1)
    want = [(d, n, t, name) for d in (1, 2) for n, (t, name) in enumerate(zip(labels, ["a", "a_2", "a_3", "a_4", "a_2_2", "b", None]))] + [
        (3, 0, "a", "a"), (3, 1, "a", "a_2")]
    for ordered, df in ((True, given), (False, given.orderBy("label"))):
        got = prose.unique_names(df, "doc", "n", "label", slug("label"), ordered=ordered)
        assert "Join" not in plan_of(got) and "Window" not in plan_of(got)
        assert sorted(map(tuple, got.collect())) == want


def test_western_text_is_passed_over_before_the_many_ranges(spark):
    from corpusloom.functions.faces import needs_unicode

    texts = ["", "plain \xff\n", "€5 … Ÿ", "Ā", "a€bœcあ", "a" * 5000 + "\U0001f600", " ", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(needs_unicode("text").alias("wide"))
    assert [r.wide for r in df.collect()] == [False, False, False, True, True, True, True, None]
    assert r"[\x00-\xff]+" in df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().analyzed().toString()


def test_fragments_are_tidied_once(spark):
    from corpusloom.functions.text import squash_ws, tidy_fragments
    from corpusloom.plans.registry import run_query
    from .conftest import SMALL

    plan = run_query("f7_strip_soft_hyphen_ws", spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(f",{chr(0xAD)},") + plan.count(f", {chr(0xAD)},") == 1
    cases = [([" \xad a 　b ", " ", "c\t "], ["a b ", " ", "c"]), ([" a\xad "], ["a"]), ([" ", "x", "\n"], ["x"]), (["\xad"], []), ([], []), (["~ !"], ["~ !"])]
    df = spark.createDataFrame([([(t,) for t in given],) for given, _ in cases], "f array<struct<text string>>")
    assert [[f.text for f in r.t] for r in df.select(tidy_fragments("f").alias("t")).collect()] == [want for _, want in cases]
    odd = "".join(map(chr, [*range(1, 0x100), *range(0x1670, 0x1690), *range(0x1FF0, 0x2070), 0x3000, 0xFEFF]))
    squashed = "".join(" " if c in "\t\n\x0b\f\r \xa0     　﻿" or 0x2000 <= ord(c) <= 0x200A else c for c in odd)
    import re
    assert spark.createDataFrame([(odd,)], "t string").select(squash_ws("t")).first()[0] == re.sub("  +", " ", squashed)


def test_bundle_is_listed_by_a_task_per_core(spark, tmp_path):
    from pyspark.sql import functions as F

    from corpusloom.sources import sinks

    folders = 3 * max(32, spark.sparkContext.defaultParallelism)
    chunks = spark.range(folders).select(F.col("id").alias("chunk"), F.lit("text").alias("text"))
    sinks.write_bundle(chunks, str(tmp_path / "bundle"), ["chunk"])
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.sparkContext.setJobGroup("listing", "listing")
    try:
        back = sinks.read_bundle(spark, str(tmp_path / "bundle"), chunks.schema)
        status = spark.sparkContext.statusTracker()
        stages = [s for j in status.getJobIdsForGroup("listing") for s in status.getJobInfo(j).stageIds]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert stages and all(status.getStageInfo(s).numTasks <= spark.sparkContext.defaultParallelism for s in stages)
    assert spark.conf.get(key) == before
    assert back.count() == folders


def test_rows_are_labelled_in_arrow(views):
    import pyarrow as pa

    from corpusloom.operators import layout

    rows = layout.group_rows(views.runs.select("doc_id", "page_no", "baseline", "x", "row_no", "run_no", "size", "angle"))
    assert "ArrowEvalPython" in plan_of(rows) and layout.PAGES_AT_ONCE < rows.select("doc_id", "page_no").distinct().count()
    columns = [10, 11, 60, 10, 10, 60], [10] * 6, [0, 0, 0, 0, 45, 0]
    assert layout._rows_of_pages(*map(pa.array, columns), [3, 0, 3]).tolist() == [0, 0, 1, 0, -2, 1]
    assert layout._rows_of_pages(*(pa.array([], pa.int64()) for _ in columns), [0]).tolist() == []


@pytest.mark.parametrize("name", ["w7_bridge", "w6_stitch"])
def test_wrapped_lines_are_made_once(spark, name):
    from corpusloom.plans.registry import run_query

    from .conftest import SMALL

    plan = run_query(name, spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Relation [") == 1
