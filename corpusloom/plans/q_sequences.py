"""Registered plans: ordered logs, strokes, tables, colours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import sequences
from ..operators.ordered import ordinal_block
from .registry import plan
from .views import L, Views

TS = ["ts", "event_id"]


@plan
def w14_number_items(v: Views) -> DataFrame:
    return sequences.number_items(v.list_items, ["list", "level"], F.col("block"), ["ts", "seq"]).select("list", "level", "seq", "number")


@plan
def w15_remap_pages(v: Views) -> DataFrame:
    return sequences.remap_pages(v.page_marks, v.page_edits)


@plan
def w16_erase(v: Views) -> DataFrame:
    return sequences.erase(v.strokes, ["stroke"], F.col("block"), TS)


@plan
def w16_surviving_points(v: Views) -> DataFrame:
    return sequences.surviving_points(v.strokes, ["stroke"], F.col("block"), TS).select("stroke", "island", "event_id", "x", "y")


@plan
def w16_flag_erased(v: Views) -> DataFrame:
    points = v.rects.select("page", "x", "y", "rect_id")
    nibs = v.rects.where("variant = 'error'").select("page", F.col("x") + 3, F.col("y") + 4).toDF("page", "x", "y")
    return sequences.flag_erased(points, nibs, 20).select("rect_id", "erased")


@plan
def w24_to_records(v: Views) -> DataFrame:
    return sequences.to_records(v.turns, ["conv_id"], ordinal_block("turn"), ["turn"]).select("conv_id", "turn", "record")


@plan
def w26_simplify_paths(v: Views) -> DataFrame:
    closed = v.strokes.select("stroke", "block", "ts", "event_id", (F.col("x") / 5).cast("long").alias("x"), "y",
                              (F.col("stroke") % 2 == 0).alias("closed"))
    return sequences.simplify_paths(closed, ["stroke"], F.col("block"), TS)


@plan
def w26_kept_points(v: Views) -> DataFrame:
    closed = v.strokes.select("stroke", "block", "ts", "event_id", (F.col("x") / 5).cast("long").alias("x"), "y", (F.col("stroke") % 2 == 0).alias("closed"))
    return sequences.kept_points(closed, ["stroke"], F.col("block"), TS).select("stroke", "event_id", "x", "y")


@plan
def w26_short_paths(v: Views) -> DataFrame:
    """Paths of a few points each: an order's lines, so lines and dots occur too."""
    li = v.table("lineitem").select(F.col("l_orderkey").alias("path"), L(F.col("l_linenumber")).alias("n"), "l_partkey", "l_suppkey",
                                    L(F.col("l_quantity") % 2).alias("x"), L(F.col("l_linenumber") % 2).alias("y"),
                                    (F.col("l_orderkey") % 2 == 0).alias("closed"))
    points = li.groupBy("path", "n").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.bool_or("closed").alias("closed"))
    return sequences.simplify_paths(points, ["path"], ordinal_block("n"), ["n"])


@plan
def a9_column_stops(v: Views) -> DataFrame:
    return sequences.column_stops(v.cells, 60, 2400).select("tbl", "col", "width", F.round("stop", 6).alias("stop"))


@plan
def a10_palette(v: Views) -> DataFrame:
    e = F.col("event_id")
    return sequences.palette(v.events.select((e * 37 % 256).alias("r"), L(F.floor("value") * 5 % 256).alias("g"), (e * 11 % 256).alias("b"),
                                             F.when(F.col("event_type") == "view", 0.5).otherwise(1.0).alias("alpha")))


@plan
def a17_endpoints(v: Views) -> DataFrame:
    return sequences.endpoints(v.strokes, ["stroke"], TS)


@plan
def a18_consensus(v: Views) -> DataFrame:
    s = v.table("lineitem").select(F.col("l_orderkey").alias("box"), L(200 + F.col("l_quantity") / 2).alias("r"),
                                   L(F.floor(F.col("l_tax") * 300 + 0.5)).alias("g"), L(F.floor(F.col("l_discount") * 300 + 0.5)).alias("b"))
    return sequences.consensus(s, "box")
