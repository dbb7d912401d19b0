"""Content guards: kind by signature, binary share, undrawable scripts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import Col, col
from .text import trim_ws

# ── fixed values ────────────────────────────────────────────────────────────
# Leading signatures in the order they are tried.
SIGNATURES = [
    ("FFD8FF", "jpg"), ("89504E47", "png"), ("47494638", "gif"), ("424D", "bmp"),
    ("00000100", "ico"), ("2521", "eps"), ("49492A00", "tiff"), ("4D4D002A", "tiff"),
]
AVIF_BRANDS = ["avif", "avis"]
HEIC_BRANDS = ["heic", "heix", "hevc", "mif1", "heim"]
PNG_FULL = "89504E470D0A1A0A"
ZIP = "504B0304"
OLE = "D0CF11E0A1B11AE1"
BINARY_SHARE = 0.05
# Code-point bands no embedded face covers, and what to call them.
SCRIPT_BANDS = [
    (0x0E00, 0x0E7F, "Thai"), (0x1100, 0x11FF, "Korean"), (0x3040, 0x30FF, "Japanese"),
    (0x3400, 0x9FFF, "Chinese or Japanese"), (0xAC00, 0xD7AF, "Korean"),
    (0xF900, 0xFAFF, "Chinese or Japanese"),
]
# ────────────────────────────────────────────────────────────────────────────


def sniff(head: Col) -> Column:
    """Content kind from the first bytes of a binary column; the name is ignored."""
    lead = F.substring(col(head), 1, 32)
    hexed = F.hex(lead)
    text = F.lower(trim_ws(F.make_valid_utf8(lead.cast("string"))))
    brand = F.lower(F.make_valid_utf8(F.substring(lead, 9, 4).cast("string")))
    kind = F.when(F.lit(False), F.lit(None).cast("string"))
    for signature, name in SIGNATURES:
        kind = kind.when(hexed.startswith(signature), name)
    return (kind.when(text.startswith("<svg") | text.startswith("<?xml"), "svg")
            .when(hexed.startswith("5249") & (F.substring(hexed, 17, 4) == "5745"), "webp")
            .when(brand.isin(AVIF_BRANDS), "avif")
            .when(brand.isin(HEIC_BRANDS), "heic")
            .when(hexed.startswith("25504446"), "pdf"))


def is_zip(head: Col) -> Column:
    return F.hex(F.substring(col(head), 1, 4)) == ZIP


def is_ole(head: Col) -> Column:
    return F.hex(F.substring(col(head), 1, 8)) == OLE


def embeddable_image(head: Col) -> Column:
    """The stricter picture test: the whole PNG signature, or JPEG."""
    h = F.hex(F.substring(col(head), 1, 8))
    return F.when(h == PNG_FULL, "png").when(h.startswith("FFD8FF"), "jpeg")


def looks_binary(text: Col, sample: int | None = None) -> Column:
    """More than one in twenty characters is a control or U+FFFD: of the whole text, or of the first ``sample``."""
    sample = col(text) if sample is None else F.substring(col(text), 1, sample)
    bad = F.regexp_count(sample, F.lit(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{fffd}]"))
    return bad > F.length(sample) * F.lit(BINARY_SHARE)


def script_share(text: Col) -> dict[str, Column]:
    """Counts behind the undrawable-script test and the first band met, if it fails."""
    bands = "".join(rf"\x{{{lo:x}}}-\x{{{hi:x}}}" for lo, hi, _ in SCRIPT_BANDS)
    solid = F.length(F.regexp_replace(col(text), r"[\x00-\x20]", "")).cast("long")
    missing = F.regexp_count(col(text), F.lit(f"[{bands}]")).cast("long")
    first = F.regexp_extract(col(text), f"[{bands}]", 0)
    name = F.when(F.lit(False), F.lit(None).cast("string"))
    for lo, hi, label in SCRIPT_BANDS:
        name = name.when(first.rlike(rf"^[\x{{{lo:x}}}-\x{{{hi:x}}}]"), label)
    refused = (solid > 0) & (missing * 20 > solid)
    return {"n_solid": solid, "n_missing": missing, "script": F.when(refused, name)}
