"""Multi-step pipelines assembled from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.guards import looks_binary
from ..functions.text import strip_soft_hyphen_ws
from ..operators import catalogue as cat
from ..operators import pages, prose, redaction
from ..operators.pages import page_lines
from ..session import hashed_by
from ..sources import html, manifest, sinks


def without_furniture(paras: DataFrame) -> DataFrame:
    """Drop one-line blocks in the top or bottom strip that repeat from page to page."""
    repeated = prose.repeated_edge(F.col("edge"), "doc_id", "page_no", F.get("lines", F.lit(0)), F.col("pages"))
    return paras.withColumn("repeated", repeated).where("NOT repeated").drop("repeated")


def corpus_to_items(rows: DataFrame, page_height: int, unpack: pages.Unpack | None = None) -> DataFrame:
    """Positioned runs, or rows that ``unpack`` makes runs of, to ordered, stitched and classified items of each document.

    Rows are hashed by document once; lines, blocks and paragraphs come out of
    one step. Paragraphs with their lines are hashed once more, and from there
    every step is a window or a grouping of one document. What the
    whole document decides (body size, compounds seen whole, repeated edge
    lines) rides along as windows.
    """
    paras = prose.with_document_facts(without_furniture(hashed_by(pages.page_paragraphs(rows, page_height, unpack), "doc_id")))
    # exploded, as a filter on a plain column would have the text made twice
    text = F.trim(strip_soft_hyphen_ws(prose.joined_lines("lines", "seen")))
    items = paras.select("doc_id", "page_no", "place", "block", "para", "n_lines", "size", "body", "sheets", "seen",
                         F.explode(F.filter(F.array(text), lambda t: t != "")).alias("text"))
    # a block is read where its earliest run came in the content stream
    ordered = prose.classify(items).select(
        "doc_id", F.struct("page_no", "place", "block", "para").alias("seq"), F.col("page_no").alias("page"), "tag", "text", "sheets", "seen")
    return prose.stitch(ordered, None)


def corpus_to_chunks(rows: DataFrame, page_height: int, limit: int = prose.CHUNK_CHARS, unpack: pages.Unpack | None = None) -> DataFrame:
    """The items of :func:`corpus_to_items`, cut into chunks."""
    return prose.chunk(corpus_to_items(rows, page_height, unpack), limit).select("doc_id", "chunk", "item", "page", "tag", "text")


def corpus_to_contents(rows: DataFrame, titles: DataFrame, page_height: int, limit: int = prose.CHUNK_CHARS, unpack: pages.Unpack | None = None) -> DataFrame:
    """Contents lists of the chunks of :func:`corpus_to_chunks`: each h1 linked to its chunk, or the title where there is none.

    Items are cut into chunks by their lengths, so only headings keep their text.
    """
    items = corpus_to_items(rows, page_height, unpack).withColumn("chars", F.length("text"))
    headings = items.withColumn("text", F.when(F.col("tag") == "h1", F.col("text")))
    return prose.toc(prose.chunk(headings, limit, F.col("chars")), titles)


def ingest(files: DataFrame, previous: DataFrame, generated: str) -> DataFrame:
    """Validate an inventory and turn what passes into a dated manifest."""
    checked = manifest.validate(files)
    return manifest.refresh_manifest(checked, previous, generated)


def ingest_report(files: DataFrame, previous: DataFrame, generated: str) -> DataFrame:
    """Count and size of what was kept, is flatten only, has no fields, or was skipped, by reason."""
    return manifest.manifest_report(ingest(files, previous, generated).withColumnRenamed("reason", "skip_reason"))


def publish(items: DataFrame, popular: DataFrame, notes: DataFrame, guide: DataFrame) -> DataFrame:
    """Catalogue pages: ranked, described, annotated, each with its related items."""
    ranked = cat.ranked(items, popular)
    near = (cat.related(ranked).groupBy("seq")
            .agg(F.expr("listagg(cast(related AS string), ',') WITHIN GROUP (ORDER BY position)").alias("related")))
    pages = cat.enrich(cat.describe(ranked).select("slug", "category", "seq", "rank", "description"), notes, guide)
    return pages.join(near, "seq", "left")


def publish_routes(items: DataFrame, site: str, stamp: str) -> DataFrame:
    return sinks.sitemap(items.select(F.concat(F.lit("forms/"), F.col("slug"), F.lit(".html")).alias("route")), site, stamp)


def html_to_text(raw: DataFrame, closed_references: bool = False) -> DataFrame:
    """Page bytes to clean text: decode, refuse binary, blocks, one text per page."""
    decoded = raw.withColumn("charset", html.pick_charset("raw")).select(
        "page_id", "charset", html.decode_html("raw", F.col("charset")).alias("html"))
    judged = decoded.withColumn("refused", looks_binary("html"))
    blocks = html.html_blocks(judged.where("NOT refused"), closed_references)
    text = blocks.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n_blocks"), F.expr("listagg(text, '\n\n') WITHIN GROUP (ORDER BY seq)").alias("text"))
    status = F.when(F.col("refused"), "binary").when(F.col("text").isNull(), "no text").otherwise("ok")
    return judged.select("page_id", "charset", "refused").join(text, "page_id", "left").select(
        "page_id", "charset", status.alias("status"), F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"), "text")


def redacted_release(runs: DataFrame, boxes: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """What is left of each document after redaction, with a proof that nothing leaked.

    ``values`` are the fields' values; they go onto the page first, so that boxes
    paint over them as over any text.
    """
    if values is not None:
        filled = redaction.field_runs(values)
        runs = runs.select(*filled.columns).unionByName(filled)
    kept = redaction.redact(runs, boxes)
    leaks = redaction.leaks(kept, boxes).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_leaks"))
    totals = kept.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_runs"), F.count_distinct(F.when(F.col("flattened"), F.col("page_no"))).alias("n_flattened"))
    return redaction.strip_metadata(totals.join(leaks, "doc_id", "left").withColumn("n_leaks", F.coalesce("n_leaks", F.lit(0)))
                                    .withColumn("title", F.concat(F.lit("Document "), F.col("doc_id").cast("string"))))
