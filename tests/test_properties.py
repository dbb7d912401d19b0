"""Laws that hold for any input, checked on whole small tables."""

from pyspark.sql import functions as F

from corpusloom.operators import geometry, ordered, redaction, search
from corpusloom.plans.registry import run_query
from corpusloom.sources import files, sinks

from .conftest import SMALL


def test_redaction_leaves_nothing_under_a_box(views):
    kept = redaction.redact(views.runs, views.boxes)
    assert redaction.leaks(kept, views.boxes).isEmpty()
    assert not redaction.leaks(views.runs, views.boxes).isEmpty()


RECT = "page long, mark_id long, x long, y long, w long, h long"


def three_lines(page, mark, x, y, w):
    return [(page, mark, x - 5 * i, y + 12 * i, w + 10 * i, 12) for i in range(3)]


def test_toggling_twice_is_identity(spark):
    sel = spark.createDataFrame([("a", *r) for r in [*three_lines(1, 10, 50, 0, 100), (2, 11, 0, 0, 40, 10)]], f"action string, {RECT}")
    first = geometry.toggle_marks(spark.createDataFrame([], RECT), sel.drop("mark_id"))
    assert sorted((r.page, r.op, r.mark_id) for r in first.collect()) == [(1, "insert", None), (2, "insert", None)]
    second = geometry.toggle_marks(sel.drop("action"), sel.drop("mark_id"))
    assert sorted((r.op, r.mark_id) for r in second.collect()) == [("remove", 10), ("remove", 11)]


def test_one_match_anywhere_removes_and_inserts_nothing(spark):
    marks = spark.createDataFrame([(2, 5, 0, 0, 40, 10), (2, 6, 0, 0, 40, 10), (2, 7, 300, 0, 40, 10)], RECT)
    sel = spark.createDataFrame([("a", 1, 0, 0, 50, 10), ("a", 2, 0, 0, 40, 10)], "action string, page long, x long, y long, w long, h long")
    assert sorted((r.op, r.mark_id) for r in geometry.toggle_marks(marks, sel).collect()) == [("remove", 5), ("remove", 6)]


def test_marks_of_several_lines_count_as_a_whole(spark):
    """A line of a paragraph lies wholly under it; one line more or less of three is still the same; half of each is not."""
    whole = three_lines(1, 1, 100, 100, 400)
    marks = [*whole, *[(1, 2, *r[2:]) for r in whole[1:]], (1, 3, *whole[0][2:]), (1, 4, 100, 100, 200, 12), (1, 4, 95, 112, 205, 12), (1, 4, 700, 500, 450, 12), (1, 5, 0, 0, 0, 0), (1, 5, 0, 0, 0, 0)]
    got = {r.mark: (r.n_matches, r.match) for r in geometry.match_marks(spark.createDataFrame(marks, RECT), ["page"], "mark_id").collect()}
    assert got == {1: (2, 2), 2: (1, 1), 3: (1, 1)}
    for cell in (7, 1000):
        again = geometry.match_marks(spark.createDataFrame(marks, RECT), ["page"], "mark_id", cell=cell).collect()
        assert {r.mark: (r.n_matches, r.match) for r in again} == got


def test_copies_cost_one_shape(spark):
    marks = spark.createDataFrame([r for i in range(500) for r in three_lines(1, i, 50, 0, 100)], RECT)
    got = geometry.match_marks(marks, ["page"], "mark_id").collect()
    assert [(r.mark, r.copies, r.n_matches, r.match) for r in got] == [(0, 500, 499, None)]


def test_blocked_scans_equal_plain_windows(spark):
    from pyspark.sql import Window

    df = spark.range(5000).select((F.col("id") % 3).alias("k"), F.col("id").alias("s"), F.when(F.hash("id") % 7 == 0, F.col("id")).alias("v"))
    whole = Window.partitionBy("k").orderBy("s")
    block = ordered.ordinal_block("s", 64)
    total = ordered.running_total(df, ["k"], block, ["s"], F.coalesce("v", F.lit(1)), "got").withColumn("want", F.sum(F.coalesce("v", F.lit(1))).over(whole))
    assert total.where(~F.col("got").eqNullSafe(F.col("want"))).isEmpty()
    last = ordered.carry_forward(df, ["k"], block, ["s"], F.col("v"), "got").withColumn("want", F.last("v", True).over(whole))
    assert last.where(~F.col("got").eqNullSafe(F.col("want"))).isEmpty()
    prev = ordered.previous(df, ["k"], block, ["s"], ["s"], "got").withColumn("want", F.lag("s").over(whole))
    assert prev.where(~F.col("got.s").eqNullSafe(F.col("want"))).isEmpty()


def test_partition_count_changes_nothing(spark):
    names = ["w2_to_text_lines", "c1_drop_furniture", "w14_number_items", "t2_field_state", "c2_corpus_to_chunks"]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        seen = []
        for n in ("1", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append([sorted(map(str, run_query(q, spark, SMALL).collect())) for q in names])
        assert seen[0] == seen[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_chunks_hold_the_text_they_came_from(views, spark):
    """Every letter and digit survives; page numbers go with the edge lines that repeat, so from the second page on."""
    bare = F.sum(F.length(F.regexp_replace("text", r"[^\p{L}\p{Nd}]", "")))
    got = run_query("c2_corpus_to_chunks", spark, SMALL).groupBy("doc_id").agg(bare.alias("got"))
    text = views.runs.groupBy("doc_id").agg(bare.alias("text"), F.max("page_no").alias("pages"))
    whole = views.runs_with_folios.groupBy("doc_id").agg(bare.alias("whole"))
    both = text.join(whole, "doc_id").join(got, "doc_id", "left")
    assert both.where("pages > 1").count() > 0
    assert both.where(~F.col("got").eqNullSafe(F.when(F.col("pages") > 1, F.col("text")).otherwise(F.col("whole")))).isEmpty()


def test_find_is_non_overlapping_and_trims(spark):
    runs = spark.createDataFrame([(1, 1, 0, 0, "aaaaa The the", 0.0, 130.0)], "doc_id long, page_no long, row_no long, run_no long, text string, x double, w double")
    hits = sorted((r.q, r.pos, r.x, r.w) for r in search.find(runs, ["aa", " the ", ""]).collect())
    assert hits == [("aa", 0, 0.0, 20.0), ("aa", 2, 20.0, 20.0), ("the", 6, 60.0, 30.0), ("the", 10, 100.0, 30.0)]


def test_scan_files_reads_heads(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7" + b"x" * 5000)
    (tmp_path / "b.png").write_bytes(bytes.fromhex("89504E470D0A1A0A"))
    (tmp_path / "empty").write_bytes(b"")
    got = {r.path.rsplit("/", 1)[-1]: (r.length, r.kind, len(r.head)) for r in files.scan_files(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": (5008, "pdf", 32), "b.png": (8, "png", 8)}


def test_write_chunks_bounds_files_and_keeps_rows(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") % 2).alias("bucket"), F.col("id").alias("item")).coalesce(1)
    sinks.write_chunks(df, str(tmp_path / "out"), max_records=100)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 1000
    assert len(list((tmp_path / "out").glob("bucket=0/*.parquet"))) == 5
