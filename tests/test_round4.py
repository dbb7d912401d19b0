"""Findings of round 4: queries against their SQL on made documents."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from corpusloom.operators import layout, pages, prose
from corpusloom.plans import pipelines
from corpusloom.plans.registry import run_query
from corpusloom.sources import layout as source
from oracle.check import connect, difference

from .conftest import SMALL

RUN = "doc_id long, page_no long, row_no long, run_no long, text string, x long, w long, baseline long, size long, angle long"


@pytest.fixture(scope="module")
def wordless(spark, tmp_path_factory):
    """The small tables with documents that hold no word: null, empty, spaces, line breaks; a tab alone is a word."""
    folder = tmp_path_factory.mktemp("wordless")
    for table in ("pages", "conversations", "embeddings", "events", "benchmark", "customer", "lineitem", "nation", "orders", "part", "region", "supplier"):
        (folder / f"{table}.parquet").symlink_to(f"{SMALL}/{table}.parquet")
    texts = [None, "", " ", "\n", "   \n \n", "\t", " \r\n", "One.", "a b\n\n" * 50, "\n\nlast"]
    made = {"documents": ([(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long"),
            "labels": ([(i, i % 2, 0) for i in (0, 1, 2, 4, 6, 8, 9, 11)], "doc_id long, quality int, toxic int")}
    for table, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / table))
        next((folder / table).glob("*.parquet")).rename(folder / f"{table}.parquet")
    return str(folder)


def test_facts_of_documents_without_words(spark, wordless):
    got = queries()["a14_doc_facts"](spark, wordless).toArrow()
    assert difference(got, connect(wordless).execute(oracle_sql()["a14_doc_facts"]).to_arrow_table()) is None


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name, shuffles", [("c2_corpus_to_chunks", 2), ("c2_contents", 3)])
def test_chunks_without_steps_over_runs(spark, name, shuffles):
    """Documents become paragraphs in one step and no run is a row; contents add a shuffle of items."""
    plan = plan_of(run_query(name, spark, SMALL))
    assert (plan.count("MapInArrow"), plan.count("Exchange hashpartitioning")) == (1, shuffles)


def test_contents_need_texts_of_headings_only(spark):
    """Lists are the same whether items bring their texts or their lengths."""
    rows = [(d, i, "h1" if (d * 7 + i) % 5 == d % 3 else "p", f"text {d} {i} " * (i + 1), 9) for d in range(4) for i in range(12)]
    items = spark.createDataFrame(rows, "doc_id long, item long, tag string, text string, sheets long")
    titles = spark.createDataFrame([(d, f"Document {d}") for d in range(4)], "doc_id long, title string")
    bare = items.withColumn("chars", F.length("text")).withColumn("text", F.when(F.col("tag") == "h1", F.col("text")))
    want = sorted(map(tuple, prose.toc(prose.chunk(items, 60), titles).collect()))
    assert sorted(map(tuple, prose.toc(prose.chunk(bare, 60, F.col("chars")), titles).collect())) == want
    assert len({href.split("#")[0] for _, _, href, _ in want}) > 2


def test_runs_made_in_batches(spark):
    texts = [None, "", " \n ", "\t", "one", "x\n\ny z\n" + "w " * 45, "\u00e9\r\nb  c " * 300, "t" * 141, "t" * 140, "a\n" * 90, "\U0001d4b3 \u00e9\u0301 b " * 200]
    rows = [(d, t) for d, t in enumerate(texts)] + [(None, "a"), (97, "one"), (-97, "one"), (96, "a\nb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    idx = (F.col("row_no") * 1000 + F.col("run_no")).alias("idx")
    want = source.layout_runs(docs, folios=True).select("doc_id", "page_no", "x", "w", "run_no", idx, "text", "size", "baseline", "angle")
    got = source.runs_in_batch(docs.toArrow())
    assert sorted(map(repr, got.to_pylist())) == sorted(repr(r.asDict()) for r in want.collect())
    assert source.runs_in_batch(docs.where("doc_id BETWEEN 0 AND 2").toArrow()).num_rows == 0


def messy_runs(rng, docs):
    """Pages whose baselines are close, sizes differ, runs are turned, tied or out of order."""
    words = ["one", "two", "-", "\u2022 x", "3) y", " ", "well-known", "Half-", "half-", "\u00e9a", "(12. z", "\x0b- v"]
    rows = []
    for d in range(docs):
        for page in range(1, rng.randint(1, 3) + 1):
            base = 100
            for i in range(rng.randint(1, 12)):
                base += rng.choice([0, 20, 35, 150, 154, 154, 154, 400])
                size, x = rng.choice([110, 110, 110, 120, 240, 0 if rng.random() < 0.02 else 110]), rng.choice([560, 560, 560, 680, 900])
                for j in range(rng.randint(1, 4)):
                    w = rng.choice([60, 300, 900])
                    rows.append((d, page, i, j, rng.choice(words), x, w, base + rng.choice([0, 0, 0, 3]), size, rng.choice([0] * 12 + [90])))
                    x += w + rng.choice([0, 10, 30, 60, 300])
            rows.append((d, page, 50, 0, "Page 1", 560, 60, 8250, 110, 0))
    return rng.sample(rows, len(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_pages_in_batches_follow_the_operators(spark, seed):
    """Rows, lines, blocks, alignment and paragraphs of odd pages, against the operators over windows."""
    runs = spark.createDataFrame(messy_runs(random.Random(seed), 60), RUN).withColumn("idx", F.col("row_no") * 1000 + F.col("run_no")).coalesce(1)
    block = ["doc_id", "page_no", "block"]
    rows = layout.group_rows(runs.select("doc_id", "page_no", "baseline", "x", "w", "run_no", "text", "size", "angle", "idx"), along=True)
    lines = layout.to_blocks(layout.to_text_lines(rows, row="row", ordered=True), turned=F.col("row") < 0)
    lines = lines.select(*block, "text", "x0", "x1", "baseline", "size", "idx").localCheckpoint()
    assert sorted(map(tuple, pages.page_lines(runs).select(lines.columns).collect())) == sorted(map(tuple, lines.collect()))

    paras = prose.paragraphs(layout.with_align(lines, block, "baseline"), block, ["baseline", "x0"])
    in_order = F.array_sort(F.collect_list(F.struct("baseline", "x0", "text")))["text"]
    want = paras.groupBy(*block, "para").agg(in_order.alias("lines"), F.count(F.lit(1)).alias("n_lines"), layout.lower_median("size").cast("long").alias("size"))
    got = pages.page_paragraphs(runs, 8419).where("lines is not null")
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    places = {tuple(r)[:3]: r.place for r in lines.groupBy(*block).agg(F.min("idx").alias("place")).collect()}
    assert all(r.place == places[r.doc_id, r.page_no, r.block] for r in got.collect())

    kept = pipelines.without_furniture(pages.page_paragraphs(runs, 8419))
    bodies = {r.doc_id: r.body for r in prose.with_document_facts(kept).where("lines is not null").select("doc_id", "body").distinct().collect()}
    whole = kept.select(*block, "para", F.col("lines").isNotNull().alias("held")).where("held")
    left = paras.join(whole, [*block, "para"], "left_semi").withColumn("sighted", F.col("page_no") * 1_000_000_000 + F.col("idx"))
    assert bodies == {r.doc_id: r.body for r in prose.with_body_size(left, order="sighted").select("doc_id", "body").distinct().collect()}


def test_lines_in_arrays_join_as_lines(spark):
    words = ["well-", "known", "Well-", "Known", "a-", "", "b ", "x\u00ad-", " tail", "-", "\u00e9-", "\u00c9a", "well-known"]
    rng = random.Random(3)
    rows = [(d, [rng.choice(words) for _ in range(rng.randint(1, 6))]) for d in range(80)]
    arrays = spark.createDataFrame(rows, "doc_id long, lines array<string>").withColumn("k", F.lit(1)).withColumn("n", F.lit(1)).withColumn("first", F.lit(1))
    flat = arrays.select("doc_id", F.posexplode("lines").alias("n", "text"))
    want = prose.join_lines(prose.bridge(prose.with_compounds(flat), None, ["doc_id"], ["n"]), ["doc_id"], "n")
    got = prose.with_document_facts(arrays).select("doc_id", prose.joined_lines("lines", "seen").alias("text"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_documents_stay_whole_however_batches_fall(monkeypatch):
    rng = random.Random(4)
    rows = [{"doc_id": d, "text": "x" * rng.randint(0, 30)} for d in (None, 1, 2, 2, 2, 3, 4, 5, 5, 6) for _ in range(rng.randint(1, 4))]
    for at_once in (1, 40, 1000):
        monkeypatch.setattr(pages, "AT_ONCE", at_once)
        for size in (1, 2, 3, 100):
            batches = [pa.RecordBatch.from_pylist(rows[i:i + size], pa.schema([("doc_id", pa.int64()), ("text", pa.string())])) for i in range(0, len(rows), size)]
            parts = [t.to_pylist() for t in pages._whole_documents(iter(batches))]
            assert sum(parts, []) == rows
            ids = [sorted({str(r["doc_id"]) for r in p}) for p in parts]
            assert len(set(sum(ids, []))) == len(sum(ids, []))
