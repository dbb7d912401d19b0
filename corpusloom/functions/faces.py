"""Type-face names: cleaning and classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import Col, col

# ── fixed values ────────────────────────────────────────────────────────────
SUBSET_PREFIX = r"^[A-Z]{6}\+"
BOLD = r"(?i)bold|black|heavy|semib|demi|[-_,](6|7|8|9)00\b"
ITALIC = r"(?i)italic|oblique"
SELECTION_BOLD = r"bold|[-,]bd|black|blk|heavy|demi|semib|medi"
SELECTION_SERIF = r"times|serif|georgia|garamond|roman|book|minion|cambria|caslon"
SELECTION_MONO = r"mono|courier|consol"
SERIF_NAMES = [
    "times", "georgia", "garamond", "cambria", "book antiqua", "palatino", "baskerville",
    "liberation serif", "dejavu serif", "nimbus roman", "thorndale", "minion", "constantia",
    "bookman", "century", "droid serif", "noto serif", "pt serif", "source serif", "serif",
]
MONO_NAMES = [
    "courier", "consolas", "monaco", "menlo", "liberation mono", "dejavu sans mono",
    "lucida console", "cumberland", "nimbus mono", "source code", "roboto mono", "monospace",
]
LATIN_1 = r"[\x00-\xff]+"
# Anything outside what a standard Western face can draw: Latin-1 and the Windows-1252 extras.
NOT_WESTERN = (r"[^\x00-\xff\x{20ac}\x{201a}\x{192}\x{201e}\x{2026}\x{2020}\x{2021}\x{2c6}\x{2030}"
               r"\x{160}\x{2039}\x{152}\x{17d}\x{2018}\x{2019}\x{201c}\x{201d}\x{2022}\x{2013}"
               r"\x{2014}\x{2dc}\x{2122}\x{161}\x{203a}\x{153}\x{17e}\x{178}]")
# ────────────────────────────────────────────────────────────────────────────


def clean_face(c: Col) -> Column:
    return F.regexp_replace(col(c), SUBSET_PREFIX, "")


def is_bold(c: Col) -> Column:
    return col(c).rlike(BOLD)


def is_italic(c: Col) -> Column:
    return col(c).rlike(ITALIC)


def family_of(c: Col) -> Column:
    """mono, serif or sans by name; null when there is no name."""
    name = F.lower(col(c))
    return (F.when(F.coalesce(name, F.lit("")) == "", None)
            .when(name.rlike("|".join(MONO_NAMES)), "mono")
            .when(name.rlike("|".join(SERIF_NAMES)), "serif")
            .otherwise("sans"))


def selection_flags(face: Col) -> dict[str, Column]:
    """Bold, serif and mono as judged for a text selection."""
    name = F.lower(F.coalesce(col(face), F.lit("")))
    return {
        "is_bold": name.rlike(SELECTION_BOLD),
        "is_serif": name.rlike(SELECTION_SERIF) & ~name.contains("sans"),
        "is_mono": name.rlike(SELECTION_MONO),
    }


def needs_unicode(c: Col) -> Column:
    """Whether a text holds a character beyond a Western face; the many ranges are tried on what is not Latin-1 only."""
    return F.regexp_replace(col(c), LATIN_1, "").rlike(NOT_WESTERN)
