"""Accept-or-refuse filters; a refusal is a row with a reason, never a crash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from ..functions.text import trim_ws

# ── fixed values ────────────────────────────────────────────────────────────
ACCEPTS = {
    "image": ["jpg", "png", "webp", "avif", "gif", "bmp", "svg"],
    "jpg": ["jpg"], "jpeg": ["jpg"], "jfif": ["jpg"], "png": ["png"], "webp": ["webp"],
    "avif": ["avif"], "svg": ["svg"], "heic": ["heic"], "gif": ["gif"], "bmp": ["bmp"],
    "tiff": ["tiff"], "word": ["docx", "doc"], "video": ["mp4"],
}
SUGGESTIONS = {
    "jpg": "Image to JPG", "png": "Image to PNG", "webp": "WEBP to JPG", "avif": "AVIF to JPG",
    "gif": "Image to GIF", "svg": "SVG to PNG", "heic": "HEIC to JPG", "pdf": "the PDF converters",
}
# Content kept out of a converted document: tracked deletions, comments, machinery.
REVISION_KINDS = [
    "tracked-changes", "deletion", "annotation", "annotation-end", "binary-data", "event-listeners",
    "forms", "sequence-decls", "variable-decls", "user-field-decls", "change", "change-start",
    "change-end", "del", "delText", "instrText",
]
# ────────────────────────────────────────────────────────────────────────────


def route(files: DataFrame) -> DataFrame:
    """Compare what a file is with what its route accepts (``src``, ``kind``)."""
    accepts = F.create_map(*[x for s, ks in ACCEPTS.items() for x in (F.lit(s), F.array(*map(F.lit, ks)))])
    hints = F.create_map(*[F.lit(x) for kv in SUGGESTIONS.items() for x in kv])
    wanted = F.coalesce(accepts[F.col("src")], F.array("src"))
    fits = F.array_contains(wanted, F.col("kind"))
    names = F.transform(wanted, F.upper)
    listed = F.when(F.size(names) > 1, F.concat(
        F.array_join(F.slice(names, F.lit(1), F.size(names) - 1), ", "), F.lit(" or "), F.element_at(names, -1))
    ).otherwise(names[0])
    reason = (F.when(F.col("kind").isNull(), "unrecognised")
              .when(~fits, F.concat(F.lit("wanted "), listed, F.lit(", found "), F.upper("kind"))))
    return (files.withColumn("reason", reason)
            .withColumn("status", F.when(F.col("reason").isNull(), "accepted").otherwise("refused"))
            .withColumn("suggestion", F.when(F.col("kind").isNotNull() & ~fits, hints[F.col("kind")])))


def require_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Mark rows whose text is empty once trimmed."""
    empty = trim_ws(F.coalesce(col(text), F.lit(""))) == ""
    return df.withColumn("status", F.when(empty, "refused").otherwise("accepted")).withColumn(
        "reason", F.when(empty, "no text"))


def visible(records: DataFrame, layers: DataFrame) -> DataFrame:
    """Records not on a hidden layer; layer ``0`` always shows."""
    hidden = layers.where("hidden").select(F.trim("layer").alias("_hidden"))
    name = F.trim("layer")
    return records.join(hidden, (name == F.col("_hidden")) & (name != "0"), "left_anti")


def strip_revisions(items: DataFrame, kind: str = "kind") -> DataFrame:
    return items.where(~F.col(kind).isin(REVISION_KINDS))
