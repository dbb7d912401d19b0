"""Registered plans: ordered, inherited, nested and interval lookups; search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import lookups, search
from .registry import plan
from .views import L, Views

QUERIES = ["the", "und", "de la", "aa", " the ", "e"]
PART = r"^slides/slide([0-9]+)\.xml$"


def part_name(n: str) -> F.Column:
    return F.concat(F.lit("slides/slide"), F.col(n).cast("string"), F.lit(".xml"))


@plan
def j9_resolve_order(v: Views) -> DataFrame:
    """Non-user turns listed in reverse, plus a dangling entry per conversation."""
    t = v.turns.select(F.col("conv_id").alias("doc"), "turn", "role")
    listed = t.where("role <> 'user'").select("doc", (-F.col("turn")).alias("pos"), F.concat(F.lit("r"), F.col("turn").cast("string")).alias("rel"))
    dangling = t.where("turn = 0").select("doc", L(F.lit(-999)).alias("pos"), F.lit("rX").alias("rel"))
    relations = t.select("doc", F.concat(F.lit("r"), F.col("turn").cast("string")).alias("rel"), part_name("turn").alias("target"))
    return lookups.resolve_order(listed.unionByName(dangling), relations, t.select("doc", part_name("turn").alias("target")), PART)


@plan
def o2_natural_order(v: Views) -> DataFrame:
    parts = v.events.select(F.when(F.col("event_type") == "error", F.concat(F.lit("media/i"), F.col("event_id").cast("string")))
                            .otherwise(part_name("event_id")).alias("part"))
    return lookups.natural_order(parts, "part", PART)


@plan
def o3_title_first(v: Views) -> DataFrame:
    pieces = v.turns.select("conv_id", "turn", (F.col("role") == "assistant").alias("is_title"))
    return lookups.title_first(pieces, ["conv_id"], "turn")


@plan
def j13_resolve_styles(v: Views) -> DataFrame:
    return lookups.resolve_styles(v.styles, ["size", "bold"], {"size": 11, "bold": False})


@plan
def j14_expand_blocks(v: Views) -> DataFrame:
    return lookups.expand_blocks(v.inserts, 0).withColumn("copies", F.col("copies").cast("bigint"))


@plan
def j15_props_at(v: Views) -> DataFrame:
    """A probe every fifty characters of each turn, and one past the end of each."""
    r = v.turn_ranges
    probes = r.select("doc", F.explode(F.sequence(F.col("from"), F.col("to"), L(F.lit(50)))).alias("pos")).unionByName(
        r.select("doc", (F.col("to") + 7).alias("pos"))).distinct()
    return lookups.props_at(probes, r)


@plan
def j16_cell_props(v: Views) -> DataFrame:
    cells = v.table("orders").select(F.col("o_custkey").alias("tbl"), F.col("o_orderkey").alias("cell"),
                                     F.when(F.col("o_orderstatus") != "O", F.col("o_orderpriority")).alias("border"))
    tables = v.table("customer").select(F.col("c_custkey").alias("tbl"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("border"))
    return lookups.cell_props(cells, tables)


@plan
def x1_find(v: Views) -> DataFrame:
    return search.find(v.runs, QUERIES).groupBy("doc_id", "row_no", "q").agg(
        F.count(F.lit(1)).alias("n"), F.sum("pos").alias("pos"), F.sum("x").alias("x"), F.sum("w").alias("w"))


@plan
def x1_find_lines(v: Views) -> DataFrame:
    """Whole lines as runs, so phrases and repeated letters occur."""
    runs = v.lines.select("doc_id", L(F.lit(1)).alias("page_no"), F.col("line_no").alias("row_no"), L(F.lit(0)).alias("run_no"),
                          F.col("line").alias("text"), L(F.lit(0)).alias("x"), L(F.length("line") * 60).alias("w"))
    return search.find(runs, QUERIES).groupBy("doc_id", "row_no", "q").agg(
        F.count(F.lit(1)).alias("n"), F.sum("pos").alias("pos"), F.max("x").alias("last_x"), F.max("w").alias("w"))


@plan
def x2_hit_pages(v: Views) -> DataFrame:
    return search.hit_pages(search.find(v.runs, QUERIES))
