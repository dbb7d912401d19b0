"""Text cleaning, escaping and naming functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import Col, col, let

# ── fixed values ────────────────────────────────────────────────────────────
# Whitespace as the web platform defines it; Java's \s alone is ASCII only.
WS_CHARS = (r"\t\n\x0b\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}"
            r"\x{3000}\x{feff}")
WS = f"[{WS_CHARS}]"
WS_NOT_SPACE = "[" + WS_CHARS.replace(" ", "") + "]"
HORIZONTAL_WS = "[" + WS_CHARS.replace(r"\n", "") + "]"
CONTROLS = r"[\x00-\x08\x0b-\x1f\x7f-\x9f]"
CONTROLS_AND_NBSP = r"[\x00-\x08\x0b-\x1f\x7f-\x9f\xa0]"
LINE_ILLEGAL = r"[\x00-\x08\x0a-\x1f\x7f\x{fffe}\x{ffff}]"
XML_ILLEGAL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\x{fffe}\x{ffff}]"
SOFT_HYPHEN = chr(0xAD)
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
ENTITY_PIECE = r"&(?:#[xX][0-9a-fA-F]+|#[0-9]+|[a-zA-Z]+);|[^&]+|&"
PRODUCER_PREFIX = r"(?i)^Microsoft (?:Word|PowerPoint) - "
PRODUCER_SUFFIX = r"(?i)\.(?:docx?|pptx?|pages|indd|pdf|tex|rtf|odt)$"
JUNK_TITLE = r"(?i)^(untitled|document[0-9]*|no title|slide [0-9]+)$"
LANGUAGE_TAG = r"^[A-Za-z]{2,3}(-[A-Za-z0-9]{2,8})*$"
EXTENSIONS = {
    "jpg": "jpg", "jpeg": "jpg", "png": "png", "webp": "webp", "gif": "gif",
    "ico": "ico", "eps": "eps", "svg": "svg", "avif": "avif", "bmp": "bmp",
    "pdf": "pdf", "txt": "txt", "rtf": "rtf", "word": "docx", "docx": "docx",
    "excel": "xlsx", "powerpoint": "pptx", "pptx": "pptx", "epub": "epub",
    "image": "jpg", "picture": "jpg",
}
# ────────────────────────────────────────────────────────────────────────────


def _but_ascii(ws: str) -> str:
    """The same class of white space; a visible ASCII character fails its first test, not each range in turn."""
    return f"[[^!-~]&&{ws}]"


def ltrim_ws(c: Col) -> Column:
    return F.regexp_replace(col(c), f"^{WS}+", "")


def rtrim_ws(c: Col) -> Column:
    return F.regexp_replace(col(c), f"{WS}+$", "")


def trim_ws(c: Col) -> Column:
    return F.regexp_replace(col(c), f"^{WS}+|{WS}+$", "")


def squash_ws(c: Col) -> Column:
    """Every run of whitespace becomes one space (a lone space is left as it is)."""
    return F.regexp_replace(col(c), f"{_but_ascii(WS)}{{2,}}|{_but_ascii(WS_NOT_SPACE)}", " ")


def squash_trim(c: Col) -> Column:
    """One space between words and none at the ends; only plain spaces are left to trim."""
    return F.trim(squash_ws(c))


def clean_html_text(c: Col) -> Column:
    """Blank out control characters and no-break spaces; keep tab and newline."""
    return F.regexp_replace(col(c), CONTROLS_AND_NBSP, " ")


def collapse_ws(c: Col) -> Column:
    """HTML's whitespace rule, keeping line breaks and at most one blank line."""
    around_breaks = F.regexp_replace(col(c), f"{HORIZONTAL_WS}*\n{HORIZONTAL_WS}*", "\n")
    single = F.regexp_replace(around_breaks, f"{HORIZONTAL_WS}+", " ")
    return trim_ws(F.regexp_replace(single, "\n{3,}", "\n\n"))


def printable(c: Col) -> Column:
    """Drop (never blank) control characters; keep tab and newline."""
    return F.regexp_replace(col(c), CONTROLS, "")


def printable_text(c: Col) -> Column:
    """``printable`` plus the tidying a whole text gets."""
    no_trailing = F.regexp_replace(printable(c), "[\t ]+\n", "\n")
    return trim_ws(F.regexp_replace(no_trailing, "\n{3,}", "\n\n"))


def tidy_line(c: Col) -> Column:
    """One output line: tabs to spaces, illegal characters out, right-trimmed."""
    spaced = F.translate(col(c), "\t", " ")
    return rtrim_ws(F.regexp_replace(spaced, LINE_ILLEGAL, ""))


def xml_safe(c: Col) -> Column:
    """Legal XML text: illegal characters dropped, markup characters escaped."""
    out = F.regexp_replace(col(c), XML_ILLEGAL, "")
    for raw, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot")):
        out = F.replace(out, F.lit(raw), F.lit(f"&{name};"))
    return out


def _code_point(n: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")


def unescape_entities(c: Col) -> Column:
    """Named and numeric entities in one pass, so ``&amp;lt;`` yields ``&lt;``."""

    def numeric(piece: Column) -> Column:
        is_hex = F.lower(F.substring(piece, 1, 3)) == "&#x"
        digits = F.regexp_replace(piece, "^&#[xX]?0*|;$", "")
        number = F.when(F.length(digits) > 8, F.lit(-1)).otherwise(
            F.when(is_hex, F.conv(digits, 16, 10)).otherwise(digits).try_cast("long"))
        return let(number, lambda n: F.when(
            n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF), _code_point(n)).otherwise(""))

    def one(piece: Column) -> Column:
        out = F.when(~piece.startswith("&") | ~piece.endswith(";"), piece).when(piece.startswith("&#"), numeric(piece))
        for name, char in ENTITIES.items():
            out = out.when(piece == f"&{name};", char)
        return out.otherwise(piece)

    pieces = F.regexp_extract_all(col(c), F.lit(ENTITY_PIECE), F.lit(0))
    return F.array_join(F.transform(pieces, one), "")


def strip_soft_hyphen_ws(c: Col) -> Column:
    """Soft hyphens out, whitespace runs to one space."""
    return squash_ws(F.replace(col(c), F.lit(SOFT_HYPHEN), F.lit("")))


def tidy_fragments(fragments: Col) -> Column:
    """``array<struct<text,…>>``: clean each text, drop empties, trim both ends."""

    def retext(frag: Column, text: Column) -> Column:
        return frag.withField("text", text)

    def trim_ends(frags: Column) -> Column:
        def trimmed(f: Column, i: Column) -> Column:
            t, last = f["text"], i == F.size(frags) - 1
            ends = F.when((i == 0) & last, trim_ws(t)).when(i == 0, ltrim_ws(t)).otherwise(rtrim_ws(t))
            return F.when((i > 0) & ~last, f).otherwise(retext(f, ends))

        return F.transform(frags, trimmed)

    cleaned = F.filter(
        F.transform(col(fragments), lambda f: retext(f, strip_soft_hyphen_ws(f["text"]))),
        lambda f: f["text"] != "")
    return F.filter(let(cleaned, trim_ends), lambda f: f["text"] != "")


def one_line(c: Col, most: int | None = 200) -> Column:
    """White space squashed; ``most`` characters, or all of them."""
    whole = squash_trim(F.coalesce(col(c), F.lit("")))
    return whole if most is None else F.substring(whole, 1, most)


def clean_title(title: Col, name: Col, most: int | None = None) -> Column:
    """A usable title: producer artefacts stripped, junk replaced by the file name."""
    claimed = trim_ws(F.regexp_replace(
        F.regexp_replace(one_line(title, most), PRODUCER_PREFIX, ""), PRODUCER_SUFFIX, ""))
    junk = (claimed == "") | claimed.rlike(JUNK_TITLE)
    return F.when(~junk, claimed).otherwise(
        F.coalesce(F.nullif(one_line(name, most), F.lit("")), F.lit("Untitled")))


def bcp47(c: Col) -> Column:
    tag = trim_ws(F.coalesce(col(c), F.lit("")))
    return F.when(tag.rlike(LANGUAGE_TAG), tag).otherwise("und")


def stable_uuid(hex32: Col) -> Column:
    """A 32-digit hex fingerprint as a version-8 UUID URN; null for anything else."""
    h = F.lower(col(hex32))
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int")
    variant = F.lower(F.hex(nibble.bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8)).cast("long")))
    urn = F.concat(
        F.lit("urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-8"),
        F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"),
        F.substring(h, 21, 12))
    return F.when(h.rlike("^[0-9a-f]{32}$"), urn)


def slug(c: Col) -> Column:
    """A field-name slug; an empty one falls back to ``field``."""
    body = F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "_"), "^_|_$", "")
    return F.when(body == "", "field").otherwise(body)


def conv_slug(src: Col, dst: Col) -> Column:
    return F.concat_ws("-to-", col(src), col(dst))


def conv_title(src: Col, dst: Col) -> Column:
    return F.concat_ws(" to ", F.upper(col(src)), F.upper(col(dst)))


def out_name(name: Col, dst: Col) -> Column:
    """Swap the extension for the one the target format uses."""
    table = F.create_map(*[F.lit(v) for kv in EXTENSIONS.items() for v in kv])
    stem = F.regexp_replace(col(name), r"\.[^.]+$", "")
    return F.concat(stem, F.lit("."), F.coalesce(table[col(dst)], col(dst)))


def resolve_path(base: Col, target: Col) -> Column:
    """Resolve ``target`` against the folder ``base``; ``..`` never climbs past the root."""

    def step(parts: Column, seg: Column) -> Column:
        shorter = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
        return (F.when(seg == "..", shorter)
                .when((seg != "") & (seg != "."), F.concat(parts, F.array(seg)))
                .otherwise(parts))

    start = F.filter(F.split(col(base), "/"), lambda s: s != "")
    walked = F.aggregate(F.split(col(target), "/"), start, step)
    return F.when(col(target).startswith("/"), F.substring(col(target), F.lit(2), F.length(col(target)))
                  ).otherwise(F.array_join(walked, "/"))


def human_bytes(n: Col) -> Column:
    """Whole kilobytes below one megabyte, one decimal above."""
    b = col(n).cast("double")
    kb = F.floor(b / 1024 + 0.5).cast("string")
    return F.when(b < 1048576, F.concat(kb, F.lit(" KB"))).otherwise(
        F.concat(_one_decimal(b / 1048576), F.lit(" MB")))


def human_bytes_min1(n: Col) -> Column:
    """The download-link variant: never less than one kilobyte."""
    b = col(n).cast("double")
    kb = F.greatest(F.lit(1), F.floor(b / 1024 + 0.5)).cast("string")
    return F.when(b < 1048576, F.concat(kb, F.lit(" KB"))).otherwise(
        F.concat(_one_decimal(b / 1048576), F.lit(" MB")))


def _one_decimal(x: Column) -> Column:
    tenths = F.floor(x * 10 + 0.5)
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def replace_between(text: Col, opening: str, closing: str, replacement: Col) -> Column:
    """Replace from the first opening anchor through the next closing one.

    A missing anchor is data, not a crash: the result is null, and the caller
    turns it into an error row.
    """
    s = col(text)
    a = F.locate(opening, s)
    b = F.when(a > 0, F.instr(F.substring(s, a, F.length(s)), closing))
    head = F.substring(s, F.lit(1), a - 1)
    tail = F.substring(s, a + b - 1 + len(closing), F.length(s))
    return F.when((a > 0) & (b > 0), F.concat(head, col(replacement), tail))
