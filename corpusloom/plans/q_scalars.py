"""Registered plans: every column function over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import faces, geometry, numerals, text
from ..sources.html import decode_html, pick_charset
from .registry import plan
from .views import Views


@plan
def f1_clean_html_text(v: Views) -> DataFrame:
    return v.noisy.select("doc_id", text.clean_html_text("text").alias("out"))


@plan
def f2_collapse_ws(v: Views) -> DataFrame:
    spaced = F.replace(F.replace(F.col("text"), F.lit(", "), F.lit(", \t  ")), F.lit(". "), F.lit(". \n \n\n  \n"))
    return v.documents.select("doc_id", text.collapse_ws(spaced).alias("out"))


@plan
def f3_printable(v: Views) -> DataFrame:
    gaps = F.concat(F.lit(" \n"), F.replace(F.col("text"), F.lit("."), F.lit(". \t\n\n\n\n")))
    return v.noisy.select("doc_id", text.printable("text").alias("dropped"), text.printable_text(gaps).alias("tidied"))


@plan
def f4_tidy_line(v: Views) -> DataFrame:
    return v.noisy.select("doc_id", text.tidy_line(F.concat(F.translate("text", ",", "\t"), F.lit(" \t "))).alias("out"))


@plan
def f5_xml_safe(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", text.xml_safe("html").alias("out"))


@plan
def f6_unescape_entities(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", text.unescape_entities("html").alias("out"))


@plan
def f6_unescape_numeric(v: Views) -> DataFrame:
    """Round trip: characters written as numeric references come back as themselves."""
    title = F.col("title")
    chars = F.regexp_extract_all(title, F.lit("(?s)."), F.lit(0))
    coded = F.array_join(F.transform(chars, lambda c: F.when(
        F.length(F.encode(c, "UTF-8")) > 1,
        F.concat(F.lit("&#x"), F.regexp_replace(F.hex(F.encode(c, "UTF-16BE")), "^0+", ""), F.lit(";")))
        .when(c.isin("&", "<", ">"), F.concat(F.lit("&#"), F.ascii(c).cast("string"), F.lit(";"))).otherwise(c)), "")
    return v.titles_raw.select("page_id", text.unescape_entities(coded).alias("out"))


@plan
def f7_strip_soft_hyphen_ws(v: Views) -> DataFrame:
    soft = F.replace(F.col("line"), F.lit("e"), F.lit("e" + chr(0xAD)))
    pieces = F.transform(F.split(soft, " "), lambda w: F.struct(F.concat(F.lit(" "), w, F.lit("  ")).alias("text"),
                                                                F.lit(False).alias("bold"), F.lit(False).alias("italic")))
    tidy = v.lines.select("doc_id", "line_no", text.tidy_fragments(pieces).alias("tidy"))  # worked out once, read twice
    return tidy.select("doc_id", "line_no", F.size("tidy").cast("long").alias("n"),
                       F.array_join(F.transform("tidy", lambda f: f["text"]), "|").alias("out"))


@plan
def f8_one_line(v: Views) -> DataFrame:
    return v.documents.select("doc_id", text.one_line("text").alias("out"))


@plan
def f9_clean_title(v: Views) -> DataFrame:
    return v.titles.select("page_id", text.clean_title("title", "name").alias("out"))


@plan
def f10_bcp47(v: Views) -> DataFrame:
    tag = F.concat(F.col("lang"), F.when(F.col("doc_id") % 3 == 0, "-x1").when(F.col("doc_id") % 3 == 1, "_bad").otherwise(" "))
    return v.documents.select("doc_id", text.bcp47(tag).alias("out"))


@plan
def f11_stable_uuid(v: Views) -> DataFrame:
    return v.documents.select("doc_id", text.stable_uuid(F.md5("text")).alias("out"))


@plan
def f12_slug(v: Views) -> DataFrame:
    return v.table("part").select("p_partkey", text.slug(F.concat(F.col("p_brand"), F.lit(" / "), F.col("p_name"), F.lit("!"))).alias("slug"),
                                  text.conv_slug(F.lower("p_type"), "p_name").alias("conv"),
                                  text.conv_title("p_type", "p_name").alias("title"))


@plan
def f13_out_name(v: Views) -> DataFrame:
    return v.heads.select("file_id", text.out_name("name", F.when(F.col("file_id") % 3 == 0, "word")
                                                   .when(F.col("file_id") % 3 == 1, "dxf").otherwise("excel")).alias("out"))


@plan
def f15_numerals(v: Views) -> DataFrame:
    n = F.col("p_partkey") % 3999 + 1
    return v.table("part").select("p_partkey", numerals.roman(n).alias("upper_roman"), numerals.counter(n, "i").alias("lower_roman"),
                                  numerals.letters(n).alias("letters"))


@plan
def f16_marker_text(v: Views) -> DataFrame:
    n = F.col("p_size")
    return v.table("part").select(
        "p_partkey", numerals.marker_text(F.concat(F.col("p_brand"), F.lit(" %1.")), n.cast("string")).alias("templated"),
        numerals.affixed_marker(F.lit("("), n, "I", F.lit(")")).alias("affixed"))


@plan
def f17_resolve_path(v: Views) -> DataFrame:
    target = F.concat(F.when(F.col("page_id") % 3 == 0, "../").when(F.col("page_id") % 3 == 1, "./../../").otherwise("/"),
                      F.regexp_extract("url", r"^[a-z]+://[^/]+/([^?#]*)", 1))
    return v.table("pages").select("page_id", text.resolve_path(F.lit("site/pages/"), target).alias("out"))


@plan
def f18_human_bytes(v: Views) -> DataFrame:
    n = F.floor("o_totalprice") * (F.col("o_orderkey") % 50)
    return v.table("orders").select("o_orderkey", text.human_bytes(n).alias("a"), text.human_bytes_min1(n).alias("b"))


@plan
def f19_faces(v: Views) -> DataFrame:
    """Face names built from every part's brand, size and type."""
    families = F.array(*[F.lit(f) for f in ("Courier New", "Times-Roman", "Arial", "Noto Serif", "Menlo", "Segoe UI", "")])
    weights = F.array(*[F.lit(w) for w in ("-Bold", "-Italic", "", "-SemiBold", "-700", "Black", "-Oblique", "-Medium", ",Bd")])
    raw = F.concat(F.when(F.col("p_size") % 2 == 0, "ABCDEF+").otherwise(""),
                   F.element_at(families, (F.col("p_partkey") % 7 + 1).cast("int")),
                   F.element_at(weights, (F.col("p_size") % 9 + 1).cast("int")))
    name = faces.clean_face("raw")
    sel = faces.selection_flags(name)
    return v.table("part").select("p_partkey", raw.alias("raw")).select(
        "p_partkey", name.alias("face"), faces.is_bold(name).alias("bold"), faces.is_italic(name).alias("italic"),
        faces.family_of(name).alias("family"), sel["is_bold"].alias("sel_bold"), sel["is_serif"].alias("sel_serif"),
        sel["is_mono"].alias("sel_mono"))


@plan
def f20_rect_of(v: Views) -> DataFrame:
    r = v.rects
    span = geometry.rect_of(F.col("x") - 50, "y", F.lit(270), F.col("h") * 9)
    crop = geometry.crop_clamp(F.col("x") - 50, F.col("y") - 20, F.col("w") * 9, F.col("h") * 20, F.lit(540), F.lit(800))
    return r.select("rect_id", *[c.cast("long").alias(f"span_{n}") for n, c in span.items()],
                    *[c.cast("long").alias(f"crop_{n}") for n, c in crop.items()])


@plan
def f21_units(v: Views) -> DataFrame:
    return v.table("part").select(
        "p_partkey", geometry.twips_to_points(F.col("p_size").cast("string")).alias("twips"),
        geometry.half_points_to_points(F.when(F.col("p_size") % 5 == 0, "x").otherwise(F.col("p_size").cast("string"))).alias("half"),
        geometry.pixels_to_emu("p_partkey").alias("emu"), geometry.points_to_mm(F.col("p_size") * 12).alias("mm"))


@plan
def f22_affine(v: Views) -> DataFrame:
    """Integer matrices, so every product is exact; rotation and scale rounded."""
    e = v.rects.select("rect_id", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h")])
    zero = F.lit(0.0)
    m = ["w", "h", -F.col("h"), "w", "x", "y"]
    n = [F.lit(2.0), zero, F.lit(1.0), F.lit(3.0), zero, F.lit(5.0)]
    px, py = geometry.affine_apply(m, "x", F.lit(7.0))
    prod = geometry.affine_multiply(m, n)
    return e.select("rect_id", px.alias("px"), py.alias("py"), *[c.alias(f"m{i}") for i, c in enumerate(prod)],
                    F.round(geometry.affine_rotation(m), 6).alias("turn"), F.round(geometry.affine_scale(m), 6).alias("grow"))


@plan
def f23_pick_charset(v: Views) -> DataFrame:
    """Every page re-encoded three ways; the picked charset must bring the text back."""
    html, p = F.col("html"), F.col("page_id")
    bare = F.regexp_replace(html, '<meta charset="utf-8">', "")
    raw = (F.when(p % 3 == 0, F.encode(html, "UTF-8"))
           .when(p % 3 == 1, F.encode(F.regexp_replace(bare, r"[^\x00-\xff]", "?"), "ISO-8859-1"))
           .otherwise(F.concat(F.unhex(F.lit("FFFE")), F.encode(html, "UTF-16LE"))))
    picked = v.table("pages").select("page_id", raw.alias("raw")).withColumn("charset", pick_charset("raw"))
    return picked.select("page_id", "charset", F.md5(decode_html("raw", "charset")).alias("digest"))


@plan
def f24_strip_metadata(v: Views) -> DataFrame:
    from ..operators.redaction import strip_metadata
    described = v.titles.select("page_id", "title", F.col("name").alias("author"), F.lit("s").alias("subject"),
                                F.lit("k").alias("keywords"), F.lit("p").alias("producer"), F.lit("c").alias("creator"))
    return strip_metadata(described)


@plan
def f26_replace_between(v: Views) -> DataFrame:
    out = text.replace_between("html", "<title", "</title>", F.lit("<title>x</title>"))
    foot = text.replace_between("html", "<footer", "</html>", F.lit("END"))
    return v.table("pages").select("page_id", out.alias("titled"), foot.alias("footed"),
                                   F.when(foot.isNull(), "error").otherwise("ok").alias("status"))
