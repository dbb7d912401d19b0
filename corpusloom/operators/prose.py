"""Lines to clean prose: boilerplate, hyphens, paragraphs, headings, chunks.

Windows here are keyed by document, and a document's lines all come out of one
source row, so a group is never larger than a text the input already holds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import Col, col
from ..functions.geometry import points_to_mm
from ..functions.text import WS_CHARS, human_bytes, ltrim_ws, squash_trim, tidy_line
from ..session import hashed_by
from .streamed import in_order, islands

# ── fixed values ────────────────────────────────────────────────────────────
ENOUGH_SHEETS = 3
EDGE_SHARE = 0.08
DEFAULT_BODY = 120
COMPOUND = r"(\p{L}{2,}-\p{L}{2,})"
HYPHEN_HEAD = r"(\p{L}[\p{L}'\x{2019}]*)-$"
HYPHEN_LAST = r"-[^\p{L}\p{N}]*$"
HYPHEN_TAIL = r"^(\p{L}[\p{L}'\x{2019}]*)"
CLOSED = r"""[.!?:;\x{bb}\x{201d}"')\]]\s*$"""
CONTINUED = r"^[\p{Ll}\p{Nd}]"
H1_RATIO, H2_RATIO = 1.45, 1.15
HEADING_CHARS, HEADING_LINES = 140, 3
CHUNK_CHARS = 40_000
INDENT_EMS, SHORT_EMS = 0.5, 3
BASE_FACES = ["helvetica", "helvetica-bold"]
# ────────────────────────────────────────────────────────────────────────────


# boilerplate ------------------------------------------------------------------


def furniture_key(line: Col) -> Column:
    """Digits masked, whitespace collapsed, lower case."""
    return F.lower(squash_trim(F.regexp_replace(col(line), "[0-9]+", "#")))


def edge_lines(lines: DataFrame) -> Column:
    """First or last line of a sheet."""
    return (F.col("line_no") == 0) | (F.col("line_no") == F.col("n_lines") - 1)


def furniture_keys(edges: DataFrame, doc: str, sheet: str, key: str) -> DataFrame:
    """Sheets each edge key is seen on, a sheet counting once.

    Two-step counting: the first grouping is as wide as the sheets, so a key
    present everywhere is already folded per sheet before it meets itself.
    """
    once = edges.where(F.col(key) != "").select(doc, sheet, key).distinct()
    return once.groupBy(doc, key).agg(F.count(F.lit(1)).alias("n"))


def repeated_keys(at_edge: DataFrame, sheets: DataFrame, doc: str, sheet: str, key: str = "_key") -> DataFrame:
    """Keys on enough of a document's sheets: three, or all of two or three."""
    enough = F.when(F.col("_sheets") > ENOUGH_SHEETS, ENOUGH_SHEETS).otherwise(F.col("_sheets"))
    counted = sheets.select(doc, sheet).distinct().groupBy(doc).agg(F.count(F.lit(1)).alias("_sheets"))
    return (furniture_keys(at_edge, doc, sheet, key).where("n >= 2")
            .join(counted, doc).where(F.col("n") >= enough).select(doc, key))


def drop_furniture(lines: DataFrame, edge: Column, doc: str, sheet: str, text: str) -> DataFrame:
    """Remove edge lines repeated across a document's sheets; one-sheet documents are left alone.

    Only edge lines take part in the join; the body of every sheet passes
    through untouched.
    """
    at_edge = lines.where(edge).withColumn("_key", furniture_key(text))
    repeated = repeated_keys(at_edge, lines, doc, sheet)
    return lines.where(~edge).unionByName(at_edge.join(repeated, [doc, "_key"], "left_anti").select(*lines.columns))


def repeated_edge(edge: Column, doc: str, sheet: str, text: Col, sheets: Column | None = None) -> Column:
    """Whether :func:`drop_furniture` would remove a line, as windows over its document.

    For lines that are partitioned by document already. Only edge lines carry a
    key, so a window holds one key of one document, or the document's other lines.
    ``sheets`` is the number of the document's sheets, where it is known.
    """
    key = F.when(edge, F.nullif(furniture_key(text), F.lit("")))
    on = F.size(F.collect_set(F.when(key.isNotNull(), F.col(sheet))).over(Window.partitionBy(doc, key)))
    sheets = F.size(F.collect_set(sheet).over(Window.partitionBy(doc))) if sheets is None else sheets
    enough = F.when(sheets > ENOUGH_SHEETS, ENOUGH_SHEETS).otherwise(sheets)
    return F.coalesce(key.isNotNull() & (on >= 2) & (on >= enough), F.lit(False))


def removed_counts(documents: DataFrame, doc: str = "source", sheet: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines, and how many :func:`drop_furniture` would remove, per document of sheets.

    A sheet's edges are read straight from its text, so at most two rows per
    sheet are ever made.
    """
    lines = F.split(text, "\n")
    sheets = documents.select(doc, F.size(lines).alias("n"), F.element_at(lines, 1).alias("_first"), F.element_at(lines, -1).alias("_last"))
    totals = sheets.groupBy(doc).agg(F.sum("n").alias("n_lines"), F.count(F.lit(1)).alias("_sheets"))
    edges = F.when(F.col("n") == 1, F.array("_first")).otherwise(F.array("_first", "_last"))
    # masked and filtered inside the array, so each key is worked out once; a sheet's equal edges are one row that counts two
    keys = sheets.select(doc, F.filter(F.transform(edges, furniture_key), lambda k: k != "").alias("_keys"))
    per_sheet = keys.select(doc, F.explode(F.array_distinct("_keys")).alias("_key"), F.size("_keys").alias("_n"), F.size(F.array_distinct("_keys")).alias("_d"))
    counted = per_sheet.groupBy(doc, "_key").agg(F.count(F.lit(1)).alias("_on"), F.sum(F.when(F.col("_d") == 1, F.col("_n")).otherwise(1)).alias("_lines")).where("_on >= 2")
    enough = F.when(F.col("_sheets") > ENOUGH_SHEETS, ENOUGH_SHEETS).otherwise(F.col("_sheets"))
    removed = F.sum(F.when(F.col("_on") >= enough, F.col("_lines")))
    return totals.join(counted, doc, "left").groupBy(doc).agg(F.first("n_lines").alias("n_lines"), F.coalesce(removed, F.lit(0)).alias("n_removed"))


# whole-document statistics ------------------------------------------------------


def body_size(lines: DataFrame, size: str = "size", text: str = "text", order: str = "row_no") -> DataFrame:
    """The size most characters are set in, to half a point; the first seen wins a tie."""
    half_point = (F.floor(F.col(size) / 5 + 0.5) * 5).cast("long")
    weights = lines.groupBy("doc_id", half_point.alias("k")).agg(
        F.sum(F.length(text)).alias("n"), F.min(order).alias("first"))
    return weights.groupBy("doc_id").agg(F.coalesce(
        F.max_by("k", F.struct("n", -F.col("first"))), F.lit(DEFAULT_BODY)).cast("long").alias("body"))


def with_body_size(lines: DataFrame, size: str = "size", text: str = "text", order: str = "row_no") -> DataFrame:
    """Add the document's body size to every line without a second pass over the lines."""
    half_point = (F.floor(F.col(size) / 5 + 0.5) * 5).cast("long")
    weighed = _weighed(lines.withColumn("_k", half_point), "_k", F.length(text), F.col(order))
    return weighed.withColumn("body", _heaviest("_k")).drop("_k", "_w")


def _weighed(lines: DataFrame, k: str, n: Column, first: Column) -> DataFrame:
    by_size = Window.partitionBy("doc_id", k)
    return lines.withColumn("_w", F.struct(F.sum(n).over(by_size).alias("n"), (-F.min(first).over(by_size)).alias("first")))


def _heaviest(k: str) -> Column:
    return F.max_by(k, "_w").over(Window.partitionBy("doc_id"))


def with_document_facts(paras: DataFrame) -> DataFrame:
    """Add ``body`` and ``seen``, as :func:`with_body_size` and :func:`with_compounds` do, to paragraphs that hold their ``lines``.

    Some rows, with or without lines, count the ``n`` characters in a size ``k`` and say where it is seen ``first``.
    """
    hyphened = F.filter("lines", lambda line: line.contains("-"))
    found = F.flatten(F.transform(hyphened, lambda line: F.regexp_extract_all(F.lower(line), F.lit(COMPOUND), F.lit(1))))
    any_hyphen = F.exists("lines", lambda line: line.contains("-"))
    marked = _weighed(paras, "k", F.col("n"), F.col("first")).withColumn("_found", F.when(any_hyphen, F.array_distinct(found)))
    whole = F.collect_list("_found").over(Window.partitionBy("doc_id"))
    asks = F.exists("lines", lambda line: line.contains("-") & line.rlike(HYPHEN_LAST))
    return (marked.select(*marked.columns, _heaviest("k").alias("body"), whole.alias("_all"))
            .withColumn("seen", F.when(asks, F.array_distinct(F.flatten("_all")))).drop("_w", "_found", "_all"))


def _compounds_of(text: str) -> Column:
    return F.when(F.col(text).contains("-"), F.regexp_extract_all(F.lower(text), F.lit(COMPOUND), F.lit(1)))


def compounds(lines: DataFrame, text: str = "text") -> DataFrame:
    """Hyphenated compounds seen whole inside a line, per document."""
    found = F.explode(F.array_distinct(_compounds_of(text)))
    return lines.select("doc_id", found.alias("compound")).distinct()


def with_compounds(lines: DataFrame, text: str = "text") -> DataFrame:
    """Add ``seen``: the document's hyphenated compounds, for :func:`bridge`, without a second pass over the lines.

    Only lines that a hyphen ends carry them, as no other line asks; on every
    line they would weigh lines times compounds.
    """
    found = _compounds_of(text)
    whole = F.collect_list("_found").over(Window.partitionBy("doc_id"))
    return (lines.withColumn("_found", F.when(F.size(found) > 0, F.array_distinct(found))).withColumn("_all", whole)
            .withColumn("seen", F.when(F.col(text).rlike(HYPHEN_LAST), F.array_distinct(F.flatten("_all")))).drop("_found", "_all"))


def doc_facts(documents: DataFrame, pages: DataFrame, marks: DataFrame, width: int, height: int) -> DataFrame:
    """Pages, size, marks and paper size of each document (tenths of a point)."""
    n_marks = marks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_marks"))
    mm = [points_to_mm(F.lit(side / 10)).cast("string") for side in (width, height)]
    return (documents.join(pages, "doc_id").join(n_marks, "doc_id", "left")
            .select("doc_id", "n_pages", human_bytes("n_chars").alias("size"),
                    F.coalesce("n_marks", F.lit(0)).alias("n_marks"), F.concat(mm[0], F.lit("x"), mm[1], F.lit(" mm")).alias("page_size")))


def faces_needed(texts: DataFrame) -> DataFrame:
    """Faces in use, upgraded where any text needs more than a Western face."""
    base = texts.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, BASE_FACES))).alias("face"), F.lit(False).alias("wide"))
    return texts.select("face", "wide").unionByName(base).groupBy("face").agg(F.bool_or("wide").alias("unicode"))


# lines → paragraphs -------------------------------------------------------------


def paragraphs(lines: DataFrame, block: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Number the paragraphs inside each block (``x0``, ``x1``, ``size``, ``align``)."""
    whole = Window.partitionBy(*block)
    along = whole.orderBy(*order)
    indented = F.col("x0") - F.min("x0").over(whole) > F.col("size") * INDENT_EMS
    short_before = F.lag("x1").over(along) < F.col("_right") - F.col("size") * SHORT_EMS
    starts = F.lag(F.lit(1)).over(along).isNotNull() & ~F.col("align").isin("center", "right") & (
        (F.col("_indented") & ~F.coalesce(F.lead("_indented").over(along), F.lit(False)))
        | ((F.col("align") == "justify") & short_before))
    return (lines.withColumn("_indented", indented).withColumn("_right", F.max("x1").over(whole))
            .withColumn("_starts", starts).withColumn("para", F.count_if("_starts").over(along))
            .drop("_indented", "_right", "_starts"))


def _joint(head_text: Column, next_text: Column) -> tuple[Column, Column, Column]:
    # few lines hold a hyphen, and the next line is only asked about behind those
    head = F.when(head_text.contains("-"), F.regexp_extract(head_text, HYPHEN_HEAD, 1)).otherwise("")
    tail = F.when(head != "", F.regexp_extract(ltrim_ws(next_text), HYPHEN_TAIL, 1)).otherwise("")
    return head, tail, F.lower(F.concat(head, F.lit("-"), tail))


def _joined(text: Column, following: Column, pair: Column, stays: Column) -> Column:
    return (F.when(following.isNull() | (text == ""), text)
            .when(pair & stays, text)
            .when(pair, F.substring(text, F.lit(1), F.length(text) - 1))
            .when(text.rlike(r"\s$"), text).otherwise(F.concat(text, F.lit(" "))))


def bridge(lines: DataFrame, seen: DataFrame | None, keys: Sequence[str], order: Sequence[str], text: str = "text") -> DataFrame:
    """Add ``joined``: each line's text as it reads once the next line follows it.

    Inside ``keys`` (which start with ``doc_id``) an end-of-line hyphen goes,
    unless the word was seen whole in the document or a capital follows; any
    other line gets a space. ``seen`` is the table of compounds, or None where
    the lines carry them (``with_compounds``).
    """
    along = Window.partitionBy(*keys).orderBy(*order)
    following = lines.withColumn("_next", F.lead(text).over(along))
    head, tail, compound = _joint(F.col(text), F.col("_next"))
    paired = (head != "") & (tail != "")
    marked = (following.withColumn("_pair", F.coalesce(paired, F.lit(False)))
              .withColumn("_capital", F.coalesce(tail.rlike(r"^\p{Lu}"), F.lit(False)))
              .withColumn("_word", F.when(F.col("_pair") & ~F.col("_capital"), compound)))
    if seen is None:
        met = marked.withColumn("_whole", F.when(F.array_contains("seen", F.col("_word")), True))
    else:
        known = seen.select("doc_id", F.col("compound").alias("_word"), F.lit(True).alias("_whole"))
        met = marked.join(known, ["doc_id", "_word"], "left")
    joined = _joined(F.col(text), F.col("_next"), F.col("_pair"), F.col("_capital") | F.col("_whole").isNotNull())
    return (met.withColumn("joined", joined)
            .drop("_next", "_pair", "_capital", "_word", "_whole"))


def joined_lines(lines: str, seen: str) -> Column:
    """The text of lines in an array, joined as :func:`bridge` joins them."""

    def one(line: Column, i: Column) -> Column:
        following = F.get(lines, i + 1)
        head, tail, compound = _joint(line, following)
        pair = F.coalesce((head != "") & (tail != ""), F.lit(False))
        return _joined(line, following, pair, tail.rlike(r"^\p{Lu}") | F.coalesce(F.array_contains(seen, compound), F.lit(False)))

    return F.array_join(F.transform(lines, one), "")


def join_lines(bridged: DataFrame, keys: Sequence[str], order: str, **extra: Column) -> DataFrame:
    """Concatenate bridged lines in order."""
    return bridged.groupBy(*keys).agg(F.expr(f"listagg(joined, '') WITHIN GROUP (ORDER BY {order})").alias("text"),
                                      *[c.alias(n) for n, c in extra.items()])


def continues(before: Column, after: Column) -> Column:
    """A sentence that did not end and carries on in lower case (or with a digit)."""
    return ~before.rlike(CLOSED) & (before.endswith("-") | after.rlike(CONTINUED))


def stitch_groups(items: DataFrame) -> DataFrame:
    """Add ``item``: paragraphs joined across consecutive sheets share one number.

    A merged paragraph moves to the later sheet, so comparing with the
    immediately preceding item is enough.
    """
    along = Window.partitionBy("doc_id").orderBy("seq")
    merges = ((F.col("tag") == "p") & (F.lag("tag").over(along) == "p")
              & (F.col("page") == F.lag("page").over(along) + 1) & continues(F.lag("text").over(along), F.col("text")))
    flagged = items.withColumn("_new", ~F.coalesce(merges, F.lit(False)))
    return flagged.withColumn("item", F.count_if("_new").over(along)).drop("_new")


def stitch(items: DataFrame, seen: DataFrame | None) -> DataFrame:
    """Paragraphs rejoined across sheet boundaries: doc, item, tag, page, text (and sheets, if given)."""
    grouped = stitch_groups(items)
    bridged = bridge(grouped, seen, ["doc_id", "item"], ["seq"])
    extra = {"sheets": F.max("sheets")} if "sheets" in items.columns else {}
    return join_lines(bridged, ["doc_id", "item"], "seq", tag=F.min_by("tag", "seq"), page=F.max("page"), **extra)


def classify(items: DataFrame) -> DataFrame:
    """h1, h2 or p from the size of short texts relative to the document's ``body`` size."""
    short = (F.length("text") <= HEADING_CHARS) & (F.col("n_lines") <= HEADING_LINES)
    tag = (F.when(~short, "p").when(F.col("size") >= F.col("body") * H1_RATIO, "h1")
           .when(F.col("size") >= F.col("body") * H2_RATIO, "h2").otherwise("p"))
    return items.withColumn("tag", tag).drop("body")


# paragraphs → chunks ------------------------------------------------------------


def _chunks_of_doc(is_h1: np.ndarray, length: np.ndarray, sheets: int, limit: int) -> np.ndarray:
    by_heading = int(np.sum(is_h1)) <= sheets
    out, chunk, size = np.zeros(len(length), dtype=np.int64), 0, 0
    for i, (h1, n) in enumerate(zip(is_h1, length)):
        if i and ((by_heading and h1) or size > limit):
            chunk, size = chunk + 1, 0
        out[i] = chunk
        size += n
    return out


def chunk(items: DataFrame, limit: int = CHUNK_CHARS, length: Column | None = None) -> DataFrame:
    """Add ``chunk`` (1-based): a new one at each h1, or once the open one is over size.

    Headings stop opening chunks in a document with more of them than sheets.
    Items carry ``doc_id, item, tag, text, sheets``; ``length`` is that of their
    texts, where they don't carry them all.
    """

    @F.pandas_udf("array<long>")
    def label(is_h1: pd.Series, length: pd.Series, sheets: pd.Series) -> pd.Series:
        return pd.Series([_chunks_of_doc(*doc, limit) for doc in zip(is_h1, length, sheets)])

    # only lengths and flags travel to Python; the items wait in their document's array
    rest = [c for c in items.columns if c not in ("doc_id", "item")]
    whole = F.struct("item", *rest, (F.col("tag") == "h1").alias("_h1"), (F.length("text") if length is None else length).cast("long").alias("_n"))
    docs = items.groupBy("doc_id").agg(F.array_sort(F.collect_list(whole), lambda a, b: F.when(a["item"] < b["item"], -1).otherwise(1)).alias("i"), F.max("sheets").alias("s"))
    labelled = docs.withColumn("chunk", label("i._h1", "i._n", "s"))
    return labelled.select("doc_id", F.inline(F.transform(F.arrays_zip("i", "chunk"), lambda z: F.struct(
        *[z["i"][c].alias(c) for c in ("item", *rest)], (z["chunk"] + 1).alias("chunk")))))


def zero_padded(n: str, width: int) -> Column:
    """Leading zeros up to a width; longer numbers stay whole."""
    digits = F.col(n).cast("string")
    return F.concat(F.repeat(F.lit("0"), F.greatest(F.lit(width) - F.length(digits), F.lit(0))), digits)


def toc(chunked: DataFrame, titles: DataFrame) -> DataFrame:
    """Contents: every h1 linked to its chunk file or an anchor inside it.

    A document without headings gets one line carrying its title. Only
    headings bring their text along, and rows are hashed once, by document.
    """
    whole = Window.partitionBy("doc_id")
    doc = whole.orderBy("item")
    in_chunk = Window.partitionBy("doc_id", "chunk").orderBy("item")
    heading = F.col("tag") == "h1"
    rows = hashed_by(chunked.select("doc_id", "chunk", "item", "tag", F.when(heading, F.col("text")).alias("text")), "doc_id")
    marked = (rows.withColumn("_first", F.row_number().over(in_chunk) == 1).withColumn("_h", F.count_if(heading).over(doc))
              .withColumn("_all", F.count_if(heading).over(whole)).withColumn("_lead", F.row_number().over(doc) == 1)
              .where(heading | ((F.col("_all") == 0) & F.col("_lead"))))
    file = F.concat(F.lit("c"), zero_padded("chunk", 3), F.lit(".xhtml"))
    anchor = F.when(F.col("_first"), "").otherwise(F.concat(F.lit("#h"), F.col("_h").cast("string")))
    return marked.join(titles, "doc_id", "left").select(
        "doc_id", F.greatest("_h", F.lit(1)).alias("entry"), F.concat(file, anchor).alias("href"),
        F.when(heading, F.col("text")).otherwise(F.col("title")).alias("label"))


# spans and lines ----------------------------------------------------------------


def merge_runs(spans: DataFrame, keys: Sequence[str], order: Sequence[str], look: Sequence[str]) -> DataFrame:
    """Adjacent spans that look the same become one (nulls look alike)."""
    along = Window.partitionBy(*keys).orderBy(*order)
    look_now = F.struct(*look)
    differs = ~look_now.eqNullSafe(F.lag(look_now).over(along))
    islands = spans.withColumn("_new", differs).withColumn("span", F.count_if("_new").over(along))
    return islands.groupBy(*keys, "span", *look).agg(
        F.expr(f"listagg(text, '') WITHIN GROUP (ORDER BY {', '.join(order)})").alias("text"))


def absorb_spaces(spans: DataFrame, keys: Sequence[str], order: str, ordered: bool = False) -> DataFrame:
    """Whitespace-only pieces fold into the piece before them (``ordered``: the pieces of a key already follow each other)."""
    return islands(spans, keys, [order], "piece", first=1, opens=F.col("text").rlike(f"[^{WS_CHARS}]"), ordered=ordered)


def squeeze_blanks(lines: DataFrame, keys: Sequence[str], order: str, text: str = "line") -> DataFrame:
    """Tidied lines with at most one blank between texts and none at either end."""
    along = Window.partitionBy(*keys).orderBy(order)
    last_full = F.max(F.when(F.col(text) != "", F.col(order))).over(Window.partitionBy(*keys))
    previous = F.lag(text).over(along)
    keep = (F.col(text) != "") | (F.coalesce(previous, F.lit("")) != "")
    return (lines.withColumn(text, tidy_line(text)).withColumn("_keep", keep & (F.col(order) <= last_full))
            .where("_keep").drop("_keep"))


def eol_lines(items: DataFrame, keys: Sequence[str], order: Sequence[str], ordered: bool = False) -> DataFrame:
    """Concatenate items up to and including each end-of-line item (``ordered``: the items of a key already follow each other)."""
    return islands(items, keys, order, "line", closes=F.col("eol"), ordered=ordered)


def strip_instructions(tokens: DataFrame, keys: Sequence[str], order: Sequence[str],
                       begin: str = "[", separator: str = "~", end: str = "]") -> DataFrame:
    """Drop field instructions (begin … separator) and all three markers; keep results."""
    along = Window.partitionBy(*keys).orderBy(*order)
    switch = F.when(F.col("token").isin(begin, separator), F.col("token"))
    state = F.last(switch, ignorenulls=True).over(along)
    return (tokens.withColumn("_state", state)
            .where(~F.col("token").isin(begin, separator, end) & ~F.coalesce(F.col("_state") == begin, F.lit(False)))
            .drop("_state"))


def unique_names(labels: DataFrame, doc: str, order: str, label: str, slug: Column, ordered: bool = False) -> DataFrame:
    """Slugs made unique in document order with ``_2``, ``_3`` … suffixes.

    A suffixed name can also be spelled out by a label, so names are given out
    one by one; memory is that of a batch and of the names of the longest
    document (``ordered``: a document's labels already follow each other).
    """
    named = in_order(labels.select(doc, order, label, slug.alias("_base")), [doc], [order, label], ordered)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, give = None, _Names()
        for batch in batches:
            names = []
            for key, base in zip(batch[doc].to_pylist(), batch["_base"].to_pylist()):
                if key != last:
                    last, give = key, _Names()
                names.append(give(base))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in (doc, order, label)), pa.array(names, pa.string())], [doc, order, label, "name"])

    kinds = {f.name: f.dataType.simpleString() for f in named.schema.fields}
    return named.mapInArrow(name, ", ".join(f"{c} {kinds[c]}" for c in (doc, order, label)) + ", name string")


class _Names:
    """The names of one document so far."""

    def __init__(self) -> None:
        self.used: set[str] = set()
        self.tries: dict[str, int] = {}

    def __call__(self, base: str | None) -> str | None:
        name = base
        while name in self.used:
            self.tries[base] = self.tries.get(base, 1) + 1
            name = f"{base}_{self.tries[base]}"
        if name is not None:
            self.used.add(name)
        return name
