"""Form widgets: which ones are real fields, and what they start out holding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import rect_of

MIN_SIDE = 3


def scan_fields(widgets: DataFrame) -> DataFrame:
    """Keep fillable widgets: not hidden, not buttons, not tiny, not locked and empty."""
    kind = (F.when(F.col("field_type") == "Tx", "text").when(F.col("field_type") == "Ch", "choice")
            .when(F.col("radio_button"), "radio").otherwise("check"))
    box = rect_of("x0", "y0", "x1", "y1")
    value = F.coalesce(F.col("field_value"), F.lit(""))
    texty = F.col("kind").isin("text", "choice")
    return (widgets
            .where("field_type IS NOT NULL AND NOT hidden AND NOT push_button")
            .select("doc", "widget_id", "name", kind.alias("kind"), *[c.alias(n) for n, c in box.items()],
                    "read_only", value.alias("initial"))
            .where((F.col("w") >= MIN_SIDE) & (F.col("h") >= MIN_SIDE) & ~(F.col("read_only") & (F.col("initial") == "")))
            .withColumn("seeds", (F.col("initial") != "") & (texty | (F.col("initial") != "Off"))))
