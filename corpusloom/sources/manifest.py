"""Manifests: keyed JSON in, validation, carried-forward dates and totals out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_BYTES = 1000


def read_manifest(df: DataFrame, json: str, value_type: str = "string") -> DataFrame:
    """A JSON object keyed by name becomes one row per key."""
    others = [c for c in df.columns if c != json]
    parsed = F.from_json(json, f"map<string,{value_type}>")
    return df.select(*others, F.explode(parsed).alias("key", "value"))


def validate(files: DataFrame) -> DataFrame:
    """First failing check wins; an unwritable file is kept but marked degraded.

    Expects ``present``, ``kind``, ``expected``, ``readable``, ``writable`` and ``bytes``.
    """
    reason = (F.when(~F.col("present"), "missing")
              .when(~F.col("kind").eqNullSafe(F.col("expected")), F.concat(F.lit("not "), F.col("expected")))
              .when(~F.col("writable") & ~F.col("readable"), "neither writable nor readable")
              .when(F.col("bytes") < MIN_BYTES, F.concat(F.lit("only "), F.col("bytes").cast("string"), F.lit(" bytes"))))
    status = (F.when(F.col("reason").isNotNull(), "skipped")
              .when(~F.col("writable"), "flatten").otherwise("kept"))
    return files.withColumn("reason", reason).withColumn("status", status)


def refresh_manifest(new: DataFrame, previous: DataFrame, generated: str) -> DataFrame:
    """Stamp rows with today's date, except cached rows that already carry one."""
    old = previous.select("slug", F.col("fetched").alias("_old"))
    stamp = F.coalesce(F.when(F.col("cached"), F.col("_old")), F.lit(generated))
    return new.join(old, "slug", "left").withColumn("fetched", stamp).drop("_old")


def manifest_sections(manifest: DataFrame) -> DataFrame:
    """The report's lists as rows: one (section, slug) per membership."""
    kept = F.col("skip_reason").isNull()
    sections = F.array_compact(F.array(
        F.when(kept, F.lit("kept")), F.when(kept & ~F.col("writable"), F.lit("flatten only")),
        F.when(kept & (F.col("fields") == 0), F.lit("no fields")),
        F.when(~kept, F.concat(F.lit("skipped: "), F.col("skip_reason")))))
    return manifest.select("slug", "bytes", F.explode(sections).alias("section"))


def manifest_report(manifest: DataFrame) -> DataFrame:
    """Count and size of every section."""
    return manifest_sections(manifest).groupBy("section").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))


def pending(keys: DataFrame, outputs: DataFrame, key: str, targets: list[str]) -> DataFrame:
    """Keys for which any target output is missing or empty."""
    done = (outputs.where((F.col("bytes") > 0) & F.col("target").isin(targets))
            .groupBy(key).agg(F.count_distinct("target").alias("n")).where(F.col("n") == len(targets)))
    return keys.join(done, key, "left_anti")
