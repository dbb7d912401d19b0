"""Outputs: chunk files, route index, structured data, row text."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import squash_trim

# ── fixed values ────────────────────────────────────────────────────────────
FIXED_ROUTES = ["", "editor.html", "converter.html", "forms.html", "privacy.html", "terms.html"]
PRIORITY = {"": "1.0", "editor.html": "0.9", "converter.html": "0.9", "forms.html": "0.9",
            "privacy.html": "0.3", "terms.html": "0.3"}
FREQUENCY = {"forms.html": "weekly", "converter.html": "weekly", "privacy.html": "yearly", "terms.html": "yearly"}
DEFAULT_PRIORITY, DEFAULT_FREQUENCY = "0.8", "monthly"
# ────────────────────────────────────────────────────────────────────────────


def write_chunks(chunks: DataFrame, path: str, by: str = "bucket", max_records: int = 100_000) -> None:
    """One folder per ``by`` value; files are bounded in rows, and a hot value gets many."""
    (chunks.write.mode("overwrite").partitionBy(by).option("maxRecordsPerFile", max_records).parquet(path))


def write_bundle(chunks: DataFrame, path: str, by: Sequence[str], text: str = "text", max_records: int = 100_000) -> None:
    """One group of files per chunk and a manifest beside them, put in place as a whole.

    Everything is written to a folder of its own next to ``path`` first: ``data``,
    a folder per value of ``by``, and ``manifest``, a row per chunk with its rows
    and characters. Renaming is the commit, so readers see the old bundle or the
    new one, a second run replaces the first, and a failed one leaves it alone.
    """
    spark, stage = chunks.sparkSession, f"{path}.staging-{uuid.uuid4().hex}"
    try:
        dealt = chunks.repartition(*by)  # a chunk is bounded by the rule that cut it
        dealt.write.partitionBy(*by).option("maxRecordsPerFile", max_records).parquet(f"{stage}/data")
        written = _opened(spark, f"{stage}/data", chunks.schema)
        written.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.length(text)).alias("chars")).write.json(f"{stage}/manifest")
        _put_in_place(spark, stage, path)
    finally:
        _folder(spark, stage)[0].delete(_folder(spark, stage)[1], True)


def read_bundle(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return _opened(spark, f"{path}/data", schema).select(*schema.names)


def _opened(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Parquet below folders of folders, listed by as many tasks a level as there are cores.

    Spark takes a task per folder otherwise, and most of its time for starting them.
    """
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    default = spark.conf.get(key)
    spark.conf.set(key, str(spark.sparkContext.defaultParallelism))
    try:
        return spark.read.schema(schema).parquet(path)
    finally:
        spark.conf.set(key, default)


def _folder(spark: SparkSession, path: str) -> tuple:
    """Hadoop's file system of a path, and the path there."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _put_in_place(spark: SparkSession, stage: str, path: str) -> None:
    fs, target = _folder(spark, path)
    aside = _folder(spark, f"{stage}-old")[1]
    replaced = fs.exists(target) and fs.rename(target, aside)
    if not fs.rename(_folder(spark, stage)[1], target):
        if replaced:
            fs.rename(aside, target)
        raise OSError(f"{stage} can't be moved to {path}")
    if replaced:
        fs.delete(aside, True)


def sitemap(listing: DataFrame, site: str, stamp: str) -> DataFrame:
    """Fixed routes, then the listed ones in order, with per-route or default attributes."""

    def lookup(table: dict[str, str], default: str) -> Column:
        mapped = F.create_map(*[F.lit(v) for kv in table.items() for v in kv])
        return F.coalesce(mapped[F.col("route")], F.lit(default))

    fixed = listing.sparkSession.range(1).select(
        F.posexplode(F.array(*map(F.lit, FIXED_ROUTES))).alias("ord", "route")).select("route", "ord")
    listed = listing.select("route", F.lit(len(FIXED_ROUTES)).alias("ord"))
    return (fixed.unionByName(listed).orderBy("ord", "route")
            .select(F.concat(F.lit(f"{site}/"), F.col("route")).alias("loc"), F.lit(stamp).alias("lastmod"),
                    lookup(FREQUENCY, DEFAULT_FREQUENCY).alias("changefreq"),
                    lookup(PRIORITY, DEFAULT_PRIORITY).alias("priority")))


def qa_jsonld(pages: DataFrame, question: str, answer: str) -> DataFrame:
    """Question-and-answer structured data read back out of page markup.

    ``question`` and ``answer`` are patterns with one group each; the first
    question of a page heads every answer. No pair is an error row.
    """

    def plain(c: Column) -> Column:
        return squash_trim(F.regexp_replace(c, "<[^>]+>", ""))

    head = plain(F.regexp_extract("html", question, 1))
    answers = F.transform(F.regexp_extract_all("html", F.lit(answer), F.lit(1)), plain)
    entity = F.transform(answers, lambda a: F.struct(
        F.lit("Question").alias("@type"), head.alias("name"),
        F.struct(F.lit("Answer").alias("@type"), a.alias("text")).alias("acceptedAnswer")))
    body = F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("FAQPage").alias("@type"),
                              entity.alias("mainEntity")))
    found = F.size(answers) > 0
    return pages.select("page_id", F.when(found, "ok").otherwise("error").alias("status"),
                        F.size(answers).cast("long").alias("n_pairs"), F.when(found, body).alias("jsonld"))


def rows_to_text(cells: DataFrame, separator: str = "\t") -> DataFrame:
    """The cells of a table row joined in column order; rows with nothing in them are dropped."""
    clean = F.trim(F.regexp_replace("text", "[\t\n]+", " "))
    ordered = F.array_sort(F.collect_list(F.struct("col", clean.alias("text"))))
    return (cells.groupBy("tbl", "row")
            .agg(ordered.alias("cells"), F.max(clean != "").alias("filled")).where("filled")
            .select("tbl", "row", F.array_join(F.transform("cells", lambda c: c["text"]), separator).alias("text")))
