"""Streams against the batch answer, for rows in any order and any split."""

from pyspark.sql import functions as F

from corpusloom.operators import editlog, undo
from corpusloom.operators.ordered import hour_block
from corpusloom.streaming import folds


def as_stream(spark, df, folder, files):
    """Write ``df`` in event-time slices, shuffled inside each, and stream it one file at a time."""
    n = df.count()
    ranked = df.withColumn("_slice", F.ntile(files).over(__import__("pyspark").sql.Window.orderBy("ts")))
    for i in range(1, files + 1):
        ranked.where(F.col("_slice") == i).drop("_slice").orderBy(F.rand(3)).coalesce(1).write.mode("append").parquet(str(folder))
    assert spark.read.parquet(str(folder)).count() == n
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def drain(query_of, path, out, checkpoint):
    q = (query_of.writeStream.outputMode("update").option("checkpointLocation", str(checkpoint))
         .foreachBatch(folds.upsert_latest(str(out))).trigger(availableNow=True).start())
    q.awaitTermination(240)
    assert q.exception() is None


def with_flush(df, keys):
    """A far-future row per key moves the watermark past everything real."""
    last = df.groupBy(*keys).agg(*[F.max(c).alias(c) for c in df.columns if c not in keys])
    return df, last.withColumn("ts", F.col("ts") + F.expr("INTERVAL 40 DAYS"))


def test_undo_stream_equals_batch(spark, views, tmp_path):
    edits = views.edits.withColumn("ts", F.col("ts").cast("timestamp"))
    real, flush = with_flush(edits, ["session"])
    src = tmp_path / "in"
    stream = as_stream(spark, real, src, 3)
    flush.select(*real.columns).coalesce(1).write.mode("append").parquet(str(src))
    flush.select(*real.columns).withColumn("ts", F.col("ts") + F.expr("INTERVAL 40 DAYS")).coalesce(1).write.mode("append").parquet(str(src))
    drain(folds.replay(stream), src, tmp_path / "out", tmp_path / "cp")
    # the flush rows themselves are folded too, except each key's last one, so compare where applied covers the log
    got = spark.read.parquet(str(tmp_path / "out"))
    counts = real.groupBy("session").agg(F.count(F.lit(1)).alias("n"))
    exact = got.join(counts, "session").where(F.col("applied") == F.col("n")).select("session", "depth", "redo", "label")
    want = undo.replay(edits, hour_block())
    assert exact.select("session").distinct().count() > 0
    assert exact.join(want, ["session", "depth", "redo", "label"], "left_anti").isEmpty()


def test_field_stream_equals_batch(spark, views, tmp_path):
    log = views.field_log.withColumn("ts", F.col("ts").cast("timestamp"))
    src = tmp_path / "in"
    stream = as_stream(spark, log, src, 4)
    drain(folds.field_state(stream), src, tmp_path / "out", tmp_path / "cp")
    got = folds.latest(spark.read.parquet(str(tmp_path / "out")), ["doc", "name"])
    counts = log.groupBy("doc", "name").agg(F.count(F.lit(1)).alias("n"))
    exact = got.join(counts, ["doc", "name"]).where("applied = n AND value IS NOT NULL").select("doc", "name", "kind", "value", "on", "seeded")
    want = editlog.field_state(log).select("doc", "name", "kind", "value", "on", "seeded")
    assert exact.count() > 100
    assert exact.join(want, exact.columns, "left_anti").isEmpty()


def test_bursts_stream_equals_batch(spark, views, tmp_path):
    log = views.field_log.withColumn("ts", F.col("ts").cast("timestamp"))
    src = tmp_path / "in"
    stream = folds.coalesce_bursts(as_stream(spark, log, src, 3), "6 hours")
    q = (stream.writeStream.outputMode("append").format("memory").queryName("bursts")
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination(240)
    got, want = spark.table("bursts"), editlog.coalesce_bursts(log, "6 hours")
    assert got.count() > 500
    assert got.exceptAll(want).isEmpty()


def test_handoff_stream_takes_once(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 1, "park", "a"), (1, "2024-01-01 00:01:00", 2, "park", "b"), (1, "2024-01-01 00:02:00", 3, "take", ""),
            (1, "2024-01-01 00:03:00", 4, "take", ""), (2, "2024-06-01 00:00:00", 5, "park", "z"), (2, "2024-09-01 00:00:00", 6, "park", "z")]
    df = spark.createDataFrame(rows, "doc long, ts string, event_id long, op string, value string").withColumn("ts", F.to_timestamp("ts"))
    src = tmp_path / "in"
    for i in range(len(rows)):
        df.where(F.col("event_id") == i + 1).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    drain(folds.handoff(stream), src, tmp_path / "out", tmp_path / "cp")
    got = folds.latest(spark.read.parquet(str(tmp_path / "out")), ["doc"]).where("doc = 1").first()
    assert (got.take_id, got.value, got.applied) == (4, None, 4)


def _annotations(spark, views, tmp_path, files):
    """The annotation log as a stream, then two rows per document that only move the watermark."""
    log = views.annot_log.drop("block").withColumn("ts", F.col("ts").cast("timestamp"))
    src = tmp_path / "in"
    stream = as_stream(spark, log, src, files)
    for days in (40, 80):
        end = log.groupBy("doc").agg(F.max("ts").alias("ts")).select("doc", F.lit(0).cast("long").alias("id"), F.lit("flush").alias("op"), F.lit(0).cast("long").alias("page"), F.lit(None).cast(dict(log.dtypes)["items"]).alias("items"),
                                                                     (F.col("ts") + F.expr(f"INTERVAL {days} DAYS")).alias("ts"), F.lit(10**12).cast("long").alias("event_id"))
        end.select(*log.columns).coalesce(1).write.mode("append").parquet(str(src))
    return log, stream


def test_changed_pages_stream_equals_batch(spark, views, tmp_path):
    for files in (2, 5):
        log, stream = _annotations(spark, views, tmp_path / str(files), files)
        drain(folds.changed_pages(stream), None, tmp_path / str(files) / "out", tmp_path / str(files) / "cp")
        out = spark.read.parquet(str(tmp_path / str(files) / "out"))
        assert out.agg(F.max("late")).first()[0] == 0
        got = {(r.doc, r.commit, r.page) for r in out.select("doc", F.date_format("commit", "yyyy-MM-dd HH").alias("commit"), "page").collect()}
        assert got == {tuple(r) for r in editlog.changed_pages(log, F.date_format("ts", "yyyy-MM-dd HH")).select("doc", "commit", "page").collect()}


def test_live_annotations_stream_equals_batch(spark, views, tmp_path):
    log, stream = _annotations(spark, views, tmp_path, 3)
    drain(folds.live_annots(stream), None, tmp_path / "out", tmp_path / "cp")
    last = folds.latest(spark.read.parquet(str(tmp_path / "out")), ["doc"]).select("doc", F.explode("marks").alias("m")).select("doc", "m.*")
    assert sorted(map(tuple, last.collect())) == sorted((r.doc, r.id, r.page, r.event_id) for r in editlog.live_annots(log).collect())


def test_a_restart_continues_with_loads(spark, tmp_path):
    """One query is stopped half way and started again; a load comes before the stop, what it loaded is touched after it."""
    day = "2024-01-01 "
    rows = [(1, "add", 5, 2, None, day + "00:00:00", 1), (1, "load", None, None, [(7, 3), (8, 4), (7, 9)], day + "01:00:00", 2), (1, "remove", 8, None, None, day + "02:00:00", 3),
            (1, "touch", 7, None, None, day + "03:00:00", 4), (1, "add", 9, 6, None, "2024-01-05 00:00:00", 5), (1, "add", 9, 6, None, "2024-01-07 00:00:00", 6)]
    log = spark.createDataFrame(rows, "doc long, op string, id long, page long, items array<struct<id:bigint,page:bigint>>, ts string, event_id long").withColumn("ts", F.to_timestamp("ts"))
    src = tmp_path / "in"
    for events in ((1, 2), (3, 4, 5, 6)):
        for e in events:
            log.where(F.col("event_id") == e).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
        drain(folds.changed_pages(stream, 86_400), src, tmp_path / "out", tmp_path / "cp")
    got = {(r.doc, r.day, r.page) for r in spark.read.parquet(str(tmp_path / "out")).select("doc", F.dayofmonth("commit").alias("day"), "page").collect()}
    assert got == {(1, 1, p) for p in (2, 3, 4, 9)} | {(1, 5, 6)}


def test_loads_by_hand(spark):
    schema = "doc long, op string, id long, page long, items array<struct<id:bigint,page:bigint>>, ts timestamp, event_id long"
    import datetime

    at = [datetime.datetime(2024, 1, 1, h) for h in range(8)]
    log = spark.createDataFrame([(1, "add", 1, 1, None, at[0], 1), (1, "add", 2, 2, None, at[1], 2), (1, "load", None, None, [(2, 5), (3, 6), (3, 7)], at[2], 3),
                                 (1, "touch", 1, None, None, at[3], 4), (1, "touch", 3, None, None, at[4], 5), (1, "load", None, None, [], at[5], 6), (1, "load", None, None, None, at[6], 7), (1, "add", 4, 4, None, at[7], 8)], schema)
    assert [tuple(r)[:3] for r in editlog.live_annots(log).collect()] == [(1, 4, 4)]
    assert sorted(tuple(r)[:3] for r in editlog.live_annots(log.where("event_id < 6")).collect()) == [(1, 2, 5), (1, 3, 7)]
    got = {}
    for r in editlog.changed_pages(log, F.hour("ts")).collect():
        got.setdefault(r["commit"], set()).add(r.page)
    assert got == {0: {1}, 1: {2}, 2: {1, 2, 5, 6, 7}, 4: {7}, 5: {5, 7}, 7: {4}}
