"""Registered plans: catalogue, facets, audits, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import catalogue as cat
from .registry import plan
from .views import L, Views

COLUMNS = ["slug", "code", "name", "category", "seq"]


def guide(v: Views) -> DataFrame:
    return v.table("part").groupBy(F.col("p_type").alias("category")).agg(
        F.concat(F.lit("General "), F.lower(F.max("p_type"))).alias("what"), F.concat(F.lit("Anyone, "), F.max("p_brand")).alias("guide_who"))


def ranked_parts(v: Views) -> DataFrame:
    return cat.ranked(v.catalogue, cat.popularity_list(v.popular))


def templates(v: Views) -> DataFrame:
    """Suppliers as a second catalogue."""
    s = v.table("supplier")
    return s.select(F.regexp_replace(F.lower("s_name"), "#", "-").alias("slug"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("code"),
                    F.col("s_name").alias("name"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("category"),
                    F.col("s_suppkey").alias("seq"))


@plan
def p5_search_catalogue(v: Views) -> DataFrame:
    return cat.search_catalogue(v.catalogue, " Brand#1", "SMALL").select("slug", "code")


@plan
def p5_search_count(v: Views) -> DataFrame:
    out = cat.search_count(cat.search_catalogue(v.catalogue, "ring")).withColumn("term", F.lit("ring"))
    return out.unionByName(cat.search_count(cat.search_catalogue(v.catalogue, "no such thing")).withColumn("term", F.lit("none")))


@plan
def p6_search_edges(v: Views) -> DataFrame:
    asked = [("brand2 to", "img"), ("", "pop"), ("", "from")]
    parts = [cat.search_edges(v.edges, term, tab).select("src", "dst", F.lit(term).alias("term"), F.lit(tab).alias("tab")) for term, tab in asked]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@plan
def p12_describe(v: Views) -> DataFrame:
    return cat.describe(v.catalogue).select("slug", "description")


@plan
def j7_enrich(v: Views) -> DataFrame:
    return cat.enrich(v.catalogue.select("slug", "category"), v.notes, guide(v))


@plan
def j8_coverage(v: Views) -> DataFrame:
    return cat.coverage(v.edges.select("src", "dst", "cat"), v.edges.where("live"))


@plan
def a12_status_by_category(v: Views) -> DataFrame:
    return cat.status_by_category(v.edges)


@plan
def a12_category_members(v: Views) -> DataFrame:
    return cat.category_members(v.edges)


@plan
def a6_skipped_report(v: Views) -> DataFrame:
    return cat.skipped_report(v.table("part").select(F.col("p_brand").alias("type")), ["Brand#1", "Brand#5", "Brand#9"])


@plan
def u1_all_items(v: Views) -> DataFrame:
    return cat.all_items(v.catalogue.select(*COLUMNS), templates(v))


@plan
def u2_missing(v: Views) -> DataFrame:
    return cat.missing(v.table("part").select("p_partkey"), v.table("lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey")), "p_partkey")


@plan
def u3_shared_keys(v: Views) -> DataFrame:
    return cat.shared_keys(v.defs.where("grp = 0"), v.defs.where("grp = 1"), "key")


@plan
def u4_upsert_registry(v: Views) -> DataFrame:
    log = v.events.select(F.concat(F.lit("face"), (F.col("k") % 40).cast("string")).alias("face"), "ts", "event_id",
                          F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("css_key"),
                          F.when(F.col("event_type") == "click", F.col("event_id")).alias("bytes"))
    return cat.upsert_registry(log, "face", ["ts", "event_id"])


@plan
def o4_top_k(v: Views) -> DataFrame:
    return cat.top_k(v.table("orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"],
                     [F.desc("o_totalprice"), F.col("o_orderkey")], 3)


@plan
def o5_faces(v: Views) -> DataFrame:
    return v.table("part").select(F.concat(F.replace(F.col("p_brand"), F.lit("#"), F.lit("-")), F.lit("-"), F.col("p_type")).alias("face")).distinct().orderBy("face")


@plan
def w18_ranked(v: Views) -> DataFrame:
    return ranked_parts(v).select("slug", "seq", "rank").orderBy("rank", "seq")


@plan
def w18_featured(v: Views) -> DataFrame:
    return ranked_parts(v).select("slug", "rank", "seq").orderBy("rank", "seq").limit(cat.FEATURED).select("slug", "rank")


@plan
def w19_related(v: Views) -> DataFrame:
    """By quantity sold and then number, which is the order of the ranks."""
    sold = v.catalogue.select("category", "seq").join(v.popular, "seq", "left")
    return cat.related(sold, order=[F.desc_nulls_last("qty"), F.col("seq")])


@plan
def w20_related_edges(v: Views) -> DataFrame:
    return cat.related_edges(v.edges)


@plan
def j11_collisions(v: Views) -> DataFrame:
    grp = F.when(F.col("grp") == 0, L(F.lit(1)))
    return cat.collisions(v.defs.withColumn("grp", grp))


@plan
def j11_bare_keys(v: Views) -> DataFrame:
    shared = v.defs.withColumn("grp", F.when(F.col("grp") == 0, L(F.lit(1))))
    return cat.bare_keys(shared, "^[a-m#]")
