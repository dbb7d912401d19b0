"""Registered plans: overlap, hit tests, redaction, merging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import geometry, redaction
from .registry import plan
from .views import L, Views


def selections(v: Views) -> DataFrame:
    """One mark action per hour: its signups select their lines, and part of the lines of every 50th view."""
    days = v.events.select(F.col("event_id").alias("mark_id"), F.date_format("ts", "yyyy-MM-dd HH").alias("action"))
    own = v.marks.where("variant = 'signup'")
    seen = v.marks.where("variant = 'view' AND mark_id % 50 = 0").withColumn("w", F.col("w") - F.col("mark_id") % 30)
    return own.unionByName(seen).join(days, "mark_id").select("action", "page", *geometry.BOX)


@plan
def j1_text_in(v: Views) -> DataFrame:
    """Per page a box, a wider one with the same corner, and one off the page that covers nothing."""
    base = L(F.col("doc_id") * 3000 + F.col("page_no") * 3)
    wide = v.boxes.withColumn("w", F.col("w") * 2)
    aside = v.boxes.withColumn("x", F.col("x") - 50_000)
    boxes = v.boxes.withColumn("box_id", base).unionByName(wide.withColumn("box_id", base + 1)).unionByName(aside.withColumn("box_id", base + 2))
    faces = F.array(*[F.lit(name) for name in ("Helvetica", "Times-Bold", "CourierNew,Bd", "PTSans-Serif", "NotoSerif-Medium")])
    faced = v.runs.withColumn("face", F.get(faces, ((F.col("doc_id") + F.col("row_no") + F.col("run_no")) % 5).cast("int")))
    return geometry.text_in(faced, boxes)


@plan
def j2_match_marks(v: Views) -> DataFrame:
    return geometry.match_marks(v.marks, ["page", "variant"], "mark_id")


@plan
def j3_toggle_marks(v: Views) -> DataFrame:
    return geometry.toggle_marks(v.marks.where("variant = 'view'"), selections(v))


@plan
def j4_hit_test(v: Views) -> DataFrame:
    return geometry.hit_test(v.rects, v.points, "rect_id")


@plan
def j5_overlapping_pairs(v: Views) -> DataFrame:
    return geometry.overlapping_pairs(v.rects, ["page"], "rect_id")


@plan
def j5_overlap_summary(v: Views) -> DataFrame:
    return geometry.overlap_summary(v.rects, ["page"], "rect_id")


@plan
def j6_redact(v: Views) -> DataFrame:
    return redaction.redact(v.runs, v.boxes).groupBy("doc_id", "page_no", "flattened").agg(
        F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.sum(F.col("x") * 31 + F.col("run_no")).alias("digest"))


@plan
def w17_merge_rects(v: Views) -> DataFrame:
    rects = v.runs.select("doc_id", "page_no", "x", (F.col("baseline") - F.col("size")).alias("y"), "w", F.col("size").alias("h"))
    return geometry.merge_rects(rects, ["doc_id", "page_no"])


@plan
def a3_extent(v: Views) -> DataFrame:
    parts = v.rects.withColumn("pad", L(F.when(F.col("variant") == "click", 3).otherwise(0)))
    return geometry.extent(parts, ["page"])


@plan
def p14_drop_trivial(v: Views) -> DataFrame:
    marks = v.rects.select("rect_id", F.when(F.col("variant") == "click", "ink").otherwise("shape").alias("kind"),
                           (F.col("rect_id") % 4).alias("n_points"), (F.col("w") % 7).alias("w"), (F.col("h") % 9).alias("h"))
    return geometry.drop_trivial(marks)
