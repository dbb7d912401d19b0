"""Taking content out of a release for good."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELD_SIZE, FIELD_ADVANCE = 110, 60
DESCRIPTIVE = ("title", "author", "subject", "keywords", "producer", "creator")


def strip_metadata(df: DataFrame) -> DataFrame:
    """Blank the descriptive columns that are present."""
    return df.withColumns({c: F.lit("") for c in DESCRIPTIVE if c in df.columns})


def _painted(boxes: DataFrame) -> tuple[DataFrame, Column]:
    """Boxes under private names and the strict overlap test; touching edges do not count."""
    b = boxes.select(*[F.col(c).alias(f"_{c}") for c in ("doc_id", "page_no", "x", "y", "w", "h")])
    hit = ((F.col("doc_id") == F.col("_doc_id")) & (F.col("page_no") == F.col("_page_no"))
           & (F.col("x") < F.col("_x") + F.col("_w")) & (F.col("x") + F.col("w") > F.col("_x"))
           & (F.col("baseline") - F.col("size") < F.col("_y") + F.col("_h")) & (F.col("baseline") > F.col("_y")))
    return b, hit


def redact(runs: DataFrame, boxes: DataFrame) -> DataFrame:
    """Runs that no box overlaps; a page with any box stops being selectable text.

    The page equality keeps this a hash join however many boxes there are.
    """
    b, hit = _painted(boxes)
    flagged = boxes.select("doc_id", "page_no").distinct().withColumn("flattened", F.lit(True))
    return (runs.join(b, hit, "left_anti").join(flagged, ["doc_id", "page_no"], "left")
            .withColumn("flattened", F.coalesce("flattened", F.lit(False))))


def leaks(released: DataFrame, boxes: DataFrame) -> DataFrame:
    """Released runs a box should have removed; empty for a sound release."""
    b, hit = _painted(boxes)
    return released.join(b, hit, "left_semi")


def field_runs(values: DataFrame) -> DataFrame:
    """Field values as text on the page: filled in before anything is painted over.

    ``values``: doc_id, page_no, field, x, y and value; empty values leave
    nothing. Coordinates and sizes are those of runs.
    """
    whole = lambda n: F.lit(n).cast("long")
    return values.where("value <> ''").select(
        "doc_id", "page_no", whole(-1).alias("row_no"), F.col("field").alias("run_no"), F.col("value").alias("text"), F.col("x"),
        (F.length("value") * FIELD_ADVANCE).cast("long").alias("w"), (F.col("y") + FIELD_SIZE).cast("long").alias("baseline"), whole(FIELD_SIZE).alias("size"),
        F.lit(False).alias("bold"), F.lit(False).alias("italic"), whole(0).alias("angle"))
