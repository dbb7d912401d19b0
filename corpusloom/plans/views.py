"""Derived inputs: deterministic views of the corpus tables the operators run on.

Every view is a narrow projection of a table unless its comment says otherwise,
so it grows with the table and adds no shuffle.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import slug
from ..operators.ordered import measured_blocks, ordinal_block, running_total
from ..session import hashed_by
from ..sources import layout, tables

# ── fixed values ────────────────────────────────────────────────────────────
# One sample header per content kind, as hex; the last one matches no rule.
SAMPLE_HEADS = [
    ("jpg", "FFD8FFE000104A464946"), ("png", "89504E470D0A1A0A0000000D"), ("gif", "474946383961"),
    ("bmp", "424D36000C00"), ("ico", "000001000100"), ("eps", "252150532D41646F6265"),
    ("tiff", "49492A0008000000"), ("tiff", "4D4D002A00000008"), ("svg", "20203C73766720786D6C6E733D"),
    ("webp", "524946462400000057454250"), ("heic", "000000186674797068656963"),
    ("avif", "0000001C6674797061766966"), ("pdf", "255044462D312E37"), ("none", "7B226B223A317D"),
]
# ────────────────────────────────────────────────────────────────────────────

LONG = "long"


def L(c: Column | int) -> Column:
    return (F.lit(c) if isinstance(c, int) else c).cast(LONG)


class Views:
    """The tables under one folder and everything derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return tables.load(self.spark, self.folder, name)

    # text ------------------------------------------------------------------
    @cached_property
    def documents(self) -> DataFrame:
        return self.table("documents")

    @cached_property
    def texts(self) -> DataFrame:
        """Documents hashed by id before anything is exploded out of them.

        The text crosses the network once, in its compact form; lines, words
        and runs keep this partitioning, so windows, groupings and joins on
        (document, …) below need no shuffle of their own.
        """
        return hashed_by(self.documents.select("doc_id", "source", "text"), "doc_id")

    @cached_property
    def lines(self) -> DataFrame:
        """Lines for whole-corpus or per-source work: straight off the scan."""
        return layout.raw_lines(self.documents)

    @cached_property
    def doc_lines(self) -> DataFrame:
        """Lines for per-document work."""
        return layout.raw_lines(self.texts)

    @cached_property
    def words(self) -> DataFrame:
        return layout.words(self.texts)

    @cached_property
    def runs(self) -> DataFrame:
        return layout.layout_runs(self.texts)

    @cached_property
    def runs_with_folios(self) -> DataFrame:
        return layout.layout_runs(self.texts, folios=True)

    @cached_property
    def tracked(self) -> DataFrame:
        """Page titles set one letter per run with wide tracking."""
        letters = F.regexp_extract_all(F.col("title"), F.lit("(?s)."), F.lit(0))
        return (self.titles_raw.select(F.col("page_id").alias("doc_id"), F.posexplode(letters)
                                       .alias("run_no", "text"))
                .where("text <> ' '")
                .select("doc_id", L(1).alias("page_no"), L(0).alias("row_no"), L(F.col("run_no")).alias("run_no"),
                        "text", L(560 + 90 * F.col("run_no")).alias("x"), L(60).alias("w"),
                        L(600).alias("baseline"), L(110).alias("size")))

    @cached_property
    def wrapped(self) -> DataFrame:
        """Documents set eight words to a line with end-of-line and inner hyphens."""
        ws = F.filter(F.split("text", "[ \n]+"), lambda w: w != "")

        def last_of(i: Column) -> Column:
            return F.try_element_at(F.col("ws"), (i * 8 + 8).cast("int"))

        def cut(i: Column) -> Column:
            has_next = F.size("ws") > i * 8 + 8
            return (i >= 0) & (i % 5 == 0) & has_next & F.coalesce(last_of(i), F.lit("")).rlike(r"^\p{L}{6,}$")

        def half(i: Column) -> Column:
            return F.floor(F.length(last_of(i)) / 2).cast("int")

        def line(i: Column) -> Column:
            row = F.slice("ws", i * 8 + 1, F.lit(8))
            carry = F.when(cut(i - 1), F.array(F.substring(last_of(i - 1), half(i - 1) + 1, F.length(last_of(i - 1)))))
            head = F.slice(row, F.lit(1), F.lit(2))
            third = F.slice(row, F.lit(3), F.lit(2))
            middle = F.when(i % 4 == 1, F.array(F.array_join(third, "-"))).otherwise(third)
            tail = F.slice(row, F.lit(5), F.lit(4))
            tail = F.when(cut(i), F.concat(F.slice(row, F.lit(5), F.lit(3)), F.array(
                F.concat(F.substring(last_of(i), F.lit(1), half(i)), F.lit("-"))))).otherwise(tail)
            parts = F.concat(F.coalesce(carry, F.array().cast("array<string>")), head, middle, tail)
            return F.array_join(F.filter(parts, lambda p: p != ""), " ")

        n = F.ceil(F.size("ws") / F.lit(8)).cast("int")
        return (self.texts.select("doc_id", ws.alias("ws")).where(F.size("ws") > 0)
                .select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), line)).alias("vline", "text"))
                .withColumn("vline", L(F.col("vline"))))

    @cached_property
    def noisy(self) -> DataFrame:
        t = F.col("text")
        noise = F.repeat(F.char((F.col("doc_id") % 8 + 1).cast("int")), (F.col("doc_id") % 400).cast("int"))
        return self.documents.select("doc_id", F.concat(
            F.substring(t, 1, 20), noise, F.substring(t, F.lit(21), F.length(t))).alias("text"))

    @cached_property
    def scripted(self) -> DataFrame:
        """Documents with a tail of kana worth zero to nine percent of their length."""
        share = F.floor(F.length("text") * (F.col("doc_id") % 10) / 100).cast("int")
        return self.documents.select("doc_id", "source", F.concat("text", F.repeat(F.lit(chr(0x3042)), share)).alias("text"))

    @cached_property
    def gappy(self) -> DataFrame:
        """Documents with runs of blank lines between sentences and at both ends."""
        text = F.concat(F.lit("\n \n"), F.replace(F.col("text"), F.lit(". "), F.lit(".\n\n\t\n")), F.lit("\n\n"))
        return (self.texts.select("doc_id", F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
                .withColumn("line_no", L(F.col("line_no"))))

    # pages -----------------------------------------------------------------
    @cached_property
    def titles_raw(self) -> DataFrame:
        return self.table("pages").select("page_id", "url", F.regexp_extract(
            "html", r"(?s)<title>(.*?)</title>", 1).alias("title"))

    @cached_property
    def titles(self) -> DataFrame:
        p, t = F.col("page_id"), F.col("title")
        title = (F.when(p % 4 == 0, F.concat(F.lit("Microsoft Word - "), t, F.lit(".docx")))
                 .when(p % 7 == 0, F.lit("untitled")).otherwise(t))
        return self.titles_raw.select("page_id", title.alias("title"),
                                      F.concat(F.lit("page-"), p.cast("string")).alias("name"))

    @cached_property
    def routes(self) -> DataFrame:
        path = F.regexp_extract("url", r"^[a-z]+://[^/]+/([^?#]*)", 1)
        return self.table("pages").select(path.alias("route")).where("route <> ''").distinct()

    # events as files, rectangles and logs -----------------------------------
    @cached_property
    def events(self) -> DataFrame:
        return self.table("events").withColumn("k", F.get_json_object("props", "$.k").cast(LONG))

    @cached_property
    def logged(self) -> DataFrame:
        """Events with ``block``: each user's hours, crowded ones cut by measured counts."""
        return measured_blocks(self.events, ["user_id"])

    @cached_property
    def heads(self) -> DataFrame:
        n, e = len(SAMPLE_HEADS), F.col("event_id")
        hexes = F.array(*[F.lit(h) for _, h in SAMPLE_HEADS])
        kinds = F.array(*[F.lit(k) for k, _ in SAMPLE_HEADS])
        claimed = F.element_at(kinds, ((e + F.floor(F.col("value")).cast(LONG)) % n + 1).cast("int"))
        return self.events.select(
            e.alias("file_id"), F.concat(F.lit("f"), e.cast("string"), F.lit("."), claimed).alias("name"),
            claimed.alias("claimed"), F.unhex(F.element_at(hexes, (e % n + 1).cast("int"))).alias("head"),
            L(e * 37 % 3000).alias("bytes"), "event_type")

    @cached_property
    def rects(self) -> DataFrame:
        e = F.col("event_id")
        return self.events.select(
            e.alias("rect_id"), F.col("user_id").alias("page"), L(e * 37 % 540).alias("x"),
            L(F.floor("value") % 800).alias("y"), L(20 + e % 60).alias("w"),
            L(10 + F.floor(e / 7).cast(LONG) % 30).alias("h"), F.col("event_type").alias("variant"))

    @cached_property
    def marks(self) -> DataFrame:
        """Highlights of one to three lines under each other, one rectangle a line; every fourth is drawn a second time, shifted."""
        e, i = F.col("rect_id"), F.col("i")
        lines = self.rects.select("page", "variant", "rect_id", F.explode(F.sequence(L(0), e % 3)).alias("i"), "x", "y", "w", "h")
        again = lines.where(e % 4 == 0).select("page", "variant", (e + 1_000_000_000).alias("rect_id"), "i", (F.col("x") + e % 3 * 8).alias("x"), "y", "w", "h")
        return lines.unionByName(again).select("page", "variant", e.alias("mark_id"), (F.col("x") - i * 9).alias("x"), (F.col("y") + i * F.col("h")).alias("y"), (F.col("w") + i * 5).alias("w"), "h")

    @cached_property
    def points(self) -> DataFrame:
        e = F.col("event_id")
        return self.events.select(e.alias("point_id"), F.col("user_id").alias("page"),
                                  L(e * 53 % 560).alias("px"), L(F.floor("value") * 2 % 820).alias("py"))

    @cached_property
    def strokes(self) -> DataFrame:
        """Pen points per user in time order; a point is erased on an error event."""
        return self.logged.select(
            F.col("user_id").alias("stroke"), "block", "ts", "event_id", L(F.col("k") % 6).alias("x"),
            L(F.floor("value") % 3).alias("y"), (F.col("event_type") == "error").alias("erased"))

    @cached_property
    def edits(self) -> DataFrame:
        op = (F.when(F.col("event_type").isin("click", "view"), "push")
              .when(F.col("event_type") == "purchase", "undo")
              .when(F.col("event_type") == "error", "redo").otherwise("clear"))
        return self.logged.select(F.col("user_id").alias("session"), "block", "ts", "event_id", op.alias("op"),
                                  F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("label"))

    @cached_property
    def widgets(self) -> DataFrame:
        k, e = F.col("k"), F.col("event_id")
        return self.events.select(
            F.col("user_id").alias("doc"), e.alias("widget_id"),
            F.concat(F.lit("f"), (k % 20).cast("string")).alias("name"),
            F.when(k % 4 == 0, "Tx").when(k % 4 == 1, "Ch").otherwise("Btn").alias("field_type"),
            (k % 4 == 2).alias("radio_button"), ((k % 4 == 3) & (k % 8 == 7)).alias("push_button"),
            (F.col("event_type") == "error").alias("hidden"),
            (F.col("event_type") == "purchase").alias("read_only"),
            L(e * 41 % 500).alias("x0"), L(e * 29 % 700).alias("y0"),
            L(e * 41 % 500 + F.floor("value") - 2).alias("x1"), L(e * 29 % 700 - k % 12).alias("y1"),
            F.when(e % 9 == 0, "").when(e % 5 == 0, "Off")
            .otherwise(F.concat(F.lit("v"), e.cast("string"))).alias("field_value"))

    @cached_property
    def field_log(self) -> DataFrame:
        k, e = F.col("k"), F.col("event_id")
        kind = (F.when(k % 4 == 0, "text").when(k % 4 == 1, "choice").when(k % 4 == 2, "radio")
                .otherwise("check"))
        return self.events.select(
            F.col("user_id").alias("doc"), F.concat(F.lit("f"), (k % 20).cast("string")).alias("name"),
            kind.alias("kind"),
            F.when(e % 9 == 0, "").otherwise(F.concat(F.lit("v"), e.cast("string"))).alias("value"),
            F.col("event_type").isin("click", "purchase").alias("on"), "ts", "event_id",
            (F.col("event_type") == "signup").alias("seed"))

    @cached_property
    def annot_log(self) -> DataFrame:
        """Adds, removals, touches, clears, and loads of up to four marks at once; a load may name one mark twice."""
        e, v = F.col("event_id"), F.floor("value").cast(LONG)
        signup = F.col("event_type") == "signup"
        op = (F.when(F.col("event_type").isin("click", "view"), "add")
              .when(F.col("event_type") == "error", "remove")
              .when(signup & (e % 3 == 0), "load").when(signup, "clear").otherwise("touch"))
        items = F.transform(F.sequence(L(0), e % 5), lambda j: F.struct(L((e + j * (e % 2)) % 25).alias("id"), L((v + j) % 9 + 1).alias("page")))
        return self.logged.select(F.col("user_id").alias("doc"), "block", L(e % 25).alias("id"), op.alias("op"), L(v % 9 + 1).alias("page"),
                                  F.when(op == "load", F.slice(items, 1, F.greatest((e % 5).cast("int"), F.lit(0)))).alias("items"), "ts", "event_id")

    @cached_property
    def revisions(self) -> DataFrame:
        """Snapshots with the revision they belong to: structural edits so far, per document."""
        log = self.logged.select(F.col("user_id").alias("doc"), "block", "ts", "event_id", "event_type")
        return running_total(log, ["doc"], F.col("block"), ["ts", "event_id"],
                             F.when(F.col("event_type") == "purchase", 1).otherwise(0), "stamp")

    @cached_property
    def list_items(self) -> DataFrame:
        e = F.col("event_id")
        return self.logged.select(F.col("user_id").alias("list"), "block", L(e % 2).alias("level"), "ts", e.alias("seq"),
                                  F.when(e % 11 == 0, F.col("k")).alias("value"))

    @cached_property
    def page_marks(self) -> DataFrame:
        return self.rects.select(F.col("page").alias("doc"), "rect_id", L(F.col("x") % 9 + 1).alias("page"))

    @cached_property
    def page_edits(self) -> DataFrame:
        """One delete, one insert and one move per document (a small table of its users)."""
        docs = self.events.groupBy(F.col("user_id").alias("doc")).agg(L(F.max("k")).alias("k"))
        d, k = F.col("doc"), F.col("k")
        steps = F.array(
            F.struct(L(1).alias("seq"), F.lit("delete").alias("op"), L(d % 9 + 1).alias("at"), L(0).alias("to")),
            F.struct(L(2).alias("seq"), F.lit("insert").alias("op"), L(k % 8 + 1).alias("at"), L(0).alias("to")),
            F.struct(L(3).alias("seq"), F.lit("move").alias("op"), L(d % 7 + 1).alias("at"), L(k % 6 + 1).alias("to")))
        return docs.select("doc", F.explode(steps).alias("s")).select("doc", "s.*")

    # catalogue ---------------------------------------------------------------
    @cached_property
    def catalogue(self) -> DataFrame:
        p = self.table("part")
        return p.select(
            F.concat(F.regexp_replace("p_name", " ", "-"), F.lit("-"), F.col("p_partkey").cast("string")).alias("slug"),
            F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("code"), F.col("p_name").alias("name"),
            F.col("p_type").alias("category"), F.array("p_brand", "p_name").alias("tags"),
            F.col("p_partkey").alias("seq"), L(F.col("p_size") % 7).alias("pages"), L(F.col("p_size")).alias("fields"))

    @cached_property
    def popular(self) -> DataFrame:
        """Every part that was sold, with its quantity."""
        sold = self.table("lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("qty"))
        return sold.select(F.col("l_partkey").alias("seq"), "qty")

    @cached_property
    def notes(self) -> DataFrame:
        p = self.table("part")
        slugged = F.concat(F.regexp_replace("p_name", " ", "-"), F.lit("-"), F.col("p_partkey").cast("string"))
        return p.where("p_size <= 17").select(
            slugged.alias("slug"), F.concat(F.lit("About "), F.col("p_name")).alias("about"),
            F.when(F.col("p_size") > 8, F.concat(F.lit("Buyers of "), F.col("p_brand"))).alias("who"))

    @cached_property
    def edges(self) -> DataFrame:
        p = self.table("part").groupBy("p_brand", "p_type").agg(
            F.max("p_size").alias("top"), F.min("p_partkey").alias("seq"), F.count(F.lit(1)).alias("n"))
        cats = F.array(*[F.lit(c) for c in ("from", "to", "img", "other")])
        src, dst = F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit(""))), F.lower(F.col("p_type"))
        return p.select(src.alias("src"), dst.alias("dst"),
                        F.element_at(cats, (F.length(F.concat(src, dst)) % 4 + 1)).alias("cat"),
                        (F.col("n") > 12).alias("pop"), (F.col("top") > 45).alias("live"), "seq")

    @cached_property
    def manifest_prev(self) -> DataFrame:
        return self.table("orders").where("o_totalprice > 200000").select(
            F.col("o_orderkey").alias("slug"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("fetched"))

    @cached_property
    def manifest_new(self) -> DataFrame:
        o = F.col("o_orderkey")
        return self.table("orders").select(
            o.alias("slug"), (F.col("o_orderstatus") == "F").alias("cached"),
            L(F.floor("o_totalprice")).alias("bytes"), L(o % 9 + 1).alias("pages"), L(o % 6).alias("fields"),
            (F.col("o_orderpriority") != "5-LOW").alias("writable"),
            F.when(F.col("o_totalprice") < 5000, "too small").alias("skip_reason"))

    @cached_property
    def defs(self) -> DataFrame:
        """Name definitions: every non-empty masked line, owned by its source."""
        key = F.lower(F.trim(F.regexp_replace("line", "[0-9]+", "#")))
        return self.lines.select(F.col("source").alias("owner"), key.alias("key"),
                                 (F.substring("source", 4, 9).cast(LONG) % 2).alias("grp")).where("key <> ''")

    @cached_property
    def cells(self) -> DataFrame:
        o = self.table("orders")
        empty = F.col("o_orderkey") % 5 == 0
        values = F.array(F.col("o_orderkey").cast("string"), F.col("o_orderstatus"),
                         F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderpriority"))
        return (o.select(F.col("o_custkey").alias("tbl"), F.col("o_orderkey").alias("row"),
                         F.posexplode(values).alias("col", "v"), empty.alias("empty"))
                .select("tbl", "row", L(F.col("col")).alias("col"), F.when(F.col("empty"), "").otherwise(F.col("v")).alias("text")))

    @cached_property
    def styles(self) -> DataFrame:
        """A style table whose parents form a tree three wide, plus a two-style cycle."""
        p, k = self.table("part"), F.col("p_partkey")
        tree = p.select(k.alias("id"), F.when(k > 0, L(F.floor(k / 3))).alias("parent"),
                        F.when(F.col("p_size") % 4 == 0, L(F.col("p_size"))).alias("size"),
                        F.when(F.col("p_size") > 40, F.lit(True)).alias("bold"))
        loop = p.agg(F.count(F.lit(1)).alias("n")).select(F.explode(F.array(
            F.struct(L(-1).alias("id"), L(-2).alias("parent"), L(F.col("n")).alias("size")),
            F.struct(L(-2).alias("id"), L(-1).alias("parent"), L(F.lit(None)).alias("size")))).alias("s")).select(
            "s.*", F.lit(None).cast("boolean").alias("bold"))
        return tree.unionByName(loop)

    @cached_property
    def inserts(self) -> DataFrame:
        """Part n is placed inside part n div 2; the smallest parts also place themselves."""
        k = F.col("p_partkey")
        p = self.table("part").where("p_partkey > 0")
        cols, rows = L(1 + F.col("p_size") % 3).alias("cols"), L(1 + F.col("p_size") % 2).alias("rows")
        tree = p.select(L(F.floor(k / 2)).alias("block"), k.alias("child"), cols, rows)
        own = p.where("p_size = 1").select(k.alias("block"), k.alias("child"), cols, rows)
        return tree.unionByName(own)

    @cached_property
    def turns(self) -> DataFrame:
        return self.table("conversations").select("conv_id", "turn", "role", (F.col("role") == "user").alias("is_marker"), "text")

    @cached_property
    def turn_ranges(self) -> DataFrame:
        """Each turn's character range within its conversation."""
        t = self.turns.select("conv_id", "turn", "role", F.length("text").cast(LONG).alias("n"))
        t = running_total(t, ["conv_id"], ordinal_block("turn"), ["turn"], F.col("n"), "to")
        return t.select(F.col("conv_id").alias("doc"), F.col("turn").alias("seq"),
                        (F.col("to") - F.col("n")).alias("from"), "to", F.col("role").alias("prop"))

    @cached_property
    def tokens(self) -> DataFrame:
        """Words with instruction markers in every long row."""
        w = F.col("word_no") % 20
        marker = F.when(w == 5, "[").when(w == 7, "~").when(w == 9, "]")
        return self.words.select("doc_id", "line_no", "word_no", F.coalesce(marker, F.col("word")).alias("token"))

    @cached_property
    def boxes(self) -> DataFrame:
        """One redaction box on every page of every document labelled low quality."""
        low = self.table("labels").where("quality = 0").select("doc_id")
        return (layout.page_numbers(self.texts.join(low, "doc_id", "left_semi"))
                .select("doc_id", "page_no", L(1000).alias("x"), L(600 + 154 * 5 - 100).alias("y"),
                        L(2000).alias("w"), L(154 * 3).alias("h")))

    @cached_property
    def labels_of_fields(self) -> DataFrame:
        """Form labels: the lines of a document; every third is spelled with the number that a second one of its name would get."""
        label = F.concat("line", F.when(F.col("line_no") % 3 == 1, " 2").otherwise(""))
        return self.doc_lines.where(F.trim("line") != "").select("doc_id", "line_no", label.alias("label"))
