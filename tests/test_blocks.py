"""Logs cut by measured counts: no block above the target, and the same answers as uncut."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import editlog, sequences, undo
from corpusloom.operators.ordered import hour_block, measured_blocks


@pytest.fixture(scope="module")
def crowded(spark):
    """One user with all events in one hour, most of them in one minute, and a quiet one."""
    rng = random.Random(11)
    start, ts, rows = datetime.datetime(2024, 1, 1, 10), 0, []
    for i in range(3000):
        ts += rng.choice([1, 5, 20_000]) if i > 2000 else 997_000
        op = rng.choice(["push", "push", "undo", "redo", "clear"] if i % 500 == 0 else ["push", "push", "undo", "redo"])
        rows.append((1, start + datetime.timedelta(microseconds=ts), i, op, f"e{i}", i % 7, i % 5))
    rows += [(2, start + datetime.timedelta(hours=h), 10_000 + h, "push", "q", 1, 1) for h in range(40)]
    return spark.createDataFrame(rows, "session long, ts timestamp, event_id long, op string, label string, id long, page long").repartition(4)


def test_no_block_above_the_target(crowded):
    cut = measured_blocks(crowded, ["session"], target=100)
    assert cut.columns == [*crowded.columns, "block"] and cut.count() == crowded.count()
    sizes = [r["count"] for r in cut.groupBy("session", "block").count().collect()]
    assert max(sizes) <= 150 and len(sizes) > 30
    assert cut.where("session = 2").select("block").distinct().collect() == [(0,)]
    out_of_order = cut.alias("a").join(cut.alias("b"), F.expr("a.session = b.session and a.ts < b.ts and a.block > b.block"))
    assert out_of_order.isEmpty()


def test_same_answers_however_cut(crowded):
    cut = measured_blocks(crowded, ["session"], target=100)
    want = sorted(map(tuple, undo.replay(crowded, hour_block()).collect()))
    assert sorted(map(tuple, undo.replay(cut, F.col("block")).collect())) == want
    ops = F.when(F.col("op") == "push", "add").when(F.col("op") == "undo", "remove").when(F.col("op") == "redo", "touch").otherwise("clear")
    marks, cut_marks = (d.withColumnRenamed("session", "doc").withColumn("op", ops) for d in (crowded, cut))
    minute = F.date_format("ts", "HH:mm")
    want = sorted(map(tuple, editlog.changed_pages(marks, minute).collect()))
    assert sorted(map(tuple, editlog.changed_pages(cut_marks, minute, F.col("block")).collect())) == want
    items, cut_items = (d.select(*[c for c in d.columns if c == "block"], F.col("session").alias("list"), F.col("id").alias("level"), "ts", F.col("event_id").alias("seq"), F.when(F.col("page") == 3, F.col("event_id")).alias("value")) for d in (crowded, cut))
    number = lambda d, b: sorted(map(tuple, sequences.number_items(d, ["list", "level"], b, ["ts", "seq"]).select("list", "level", "seq", "number").collect()))
    assert number(items, hour_block()) == number(cut_items, F.col("block"))
