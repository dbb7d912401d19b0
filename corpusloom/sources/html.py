"""HTML pages to typed text blocks.

Python turns a page into a flat list of events (element starts and ends,
implied ones included, texts and breaks) and knows nothing of blocks. What a
block is comes from running sums over the events of many pages at once: depth
of lists, quotes and preformatted text, number of block borders so far, number
of items since a list's counter was last set. White space is the column
functions' work.

A page without text has no rows. A null page counts as empty. A page that the
parser can't take is one row of kind ``error``. Pages are taken in slices of
``SLICE`` characters, so memory is that of a slice or of the longest page.
"""

from __future__ import annotations

import codecs
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from html.entities import html5
from html.parser import HTMLParser
from math import isfinite

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import Col, col
from ..functions.text import collapse_ws, rtrim_ws

# ── fixed values ────────────────────────────────────────────────────────────
DROPPED = {"script", "style", "nav", "noscript", "template", "head", "svg", "math", "iframe",
           "object", "audio", "video", "canvas", "map", "select", "datalist"}
BLOCKS = {"p", "div", "section", "article", "main", "figure", "figcaption", "dl", "dt", "dd",
          "address", "details", "summary", "table", "thead", "tbody", "tfoot", "caption",
          "fieldset", "legend", "form", "center", "hgroup", "search", "dialog"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BULLETS = ["•", "–", "·"]
CELL_GAP = " · "
# Windows-1252 puts these characters where Latin-1 has C1 controls.
WINDOWS_1252 = {
    0x80: 0x20AC, 0x82: 0x201A, 0x83: 0x0192, 0x84: 0x201E, 0x85: 0x2026, 0x86: 0x2020, 0x87: 0x2021,
    0x88: 0x02C6, 0x89: 0x2030, 0x8A: 0x0160, 0x8B: 0x2039, 0x8C: 0x0152, 0x8E: 0x017D, 0x91: 0x2018,
    0x92: 0x2019, 0x93: 0x201C, 0x94: 0x201D, 0x95: 0x2022, 0x96: 0x2013, 0x97: 0x2014, 0x98: 0x02DC,
    0x99: 0x2122, 0x9A: 0x0161, 0x9B: 0x203A, 0x9C: 0x0153, 0x9E: 0x017E, 0x9F: 0x0178,
}
# Start tags that close an open paragraph, and elements whose end tags HTML lets authors omit:
# start tag, the element that it ends, the elements that it does not reach through.
CLOSES_P = BLOCKS | HEADINGS | {"ul", "ol", "pre", "hr", "blockquote", "header", "footer", "aside", "nav", "li"}
IMPLIED = [("li", "li", {"ul", "ol"}), ("td", "td", {"tr", "table"}), ("td", "th", {"tr", "table"}),
           ("th", "td", {"tr", "table"}), ("th", "th", {"tr", "table"}), ("tr", "tr", {"table"}),
           ("dt", "dt", {"dl"}), ("dt", "dd", {"dl"}), ("dd", "dt", {"dl"}), ("dd", "dd", {"dl"})]
OUT_OF_P = {"td", "th", "table", "button"}
# ────────────────────────────────────────────────────────────────────────────

LISTS = {"ul", "ol"}
BORDERS = BLOCKS | HEADINGS | LISTS | {"li", "tr", "pre", "blockquote"}
SLICE = 1 << 21

_CONTROLS = re.compile("[\x00-\x08\x0b-\x1f\x7f-\xa0]")
_INK = re.compile("[^\\s\ufeff]")
_REFERENCE = re.compile("&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[0-9A-Za-z]+;)?")
_COLUMNS = ["page_id", "seq", "kind", "text", "indent", "quoted", "marker"]
_BLOCK_SCHEMA = "page_id long, seq long, kind string, text string, indent long, quoted boolean, marker string"


def _number(attrs: list[tuple], name: str) -> int:
    """An attribute as a whole number; 0 where it is missing or none."""
    try:
        number = float(next((v for k, v in attrs if k == name and v), 0))
    except ValueError:
        return 0
    return int(number) if isfinite(number) and abs(number) < 1 << 53 else 0


class _Events(HTMLParser):
    """Rows (event, tag, text, number); elements that are left out leave no row, ends that HTML implies do."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple] = []
        self.path: list[str] = []
        self.places: dict[str, list[int]] = defaultdict(list)  # tag → depths at which it is open
        self.hidden = 0

    def cut(self, depth: int) -> None:
        while len(self.path) > depth:
            tag = self.path.pop()
            self.places[tag].pop()
            if tag in DROPPED:
                self.hidden -= 1
            elif not self.hidden:
                self.rows.append(("end", tag, "", 0))

    def end_implied(self, tag: str, barriers: set[str] = frozenset()) -> None:
        at = self.places[tag][-1] if self.places[tag] else -1
        if at >= 0 and not any(self.places[b] and self.places[b][-1] > at for b in barriers):
            self.cut(at)

    def handle_starttag(self, tag, attrs) -> None:
        if tag == "body":
            self.end_implied("head")
        if not self.hidden:
            if tag in CLOSES_P:
                self.end_implied("p", OUT_OF_P)
            for opened, closed, barriers in IMPLIED:
                if opened == tag:
                    self.end_implied(closed, barriers)
        if tag in VOID:
            if tag in ("br", "hr") and not self.hidden:
                self.rows.append((tag, tag, "\n", 0))
            return
        self.places[tag].append(len(self.path))
        self.path.append(tag)
        if tag in DROPPED:
            self.hidden += 1
        elif not self.hidden:
            self.rows.append(("start", tag, "", _number(attrs, "start" if tag in LISTS else "value")))

    def handle_startendtag(self, tag, attrs) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag) -> None:
        self.end_implied(tag)

    def handle_data(self, data) -> None:
        if not self.hidden:
            self.rows.append(("text", "", _CONTROLS.sub(" ", data), 0))

    def close(self) -> None:
        super().close()
        self.cut(0)
        self.rows.append(("page", "", "", 0))


def _closed_only(html: str) -> str:
    """Markup in which every ampersand that starts no whole reference stands for itself."""
    return _REFERENCE.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else "&amp;" + m[0][1:], html)


def _events_or_error(html: str | None, closed: bool = False) -> list[tuple]:
    """The events of a page; a page the parser can't take is one event that says so."""
    parser = _Events()
    try:
        parser.feed(_closed_only(html or "") if closed else html or "")
        parser.close()
    except Exception as e:  # any page of the web may come in; one must not end the job
        return [("error", "", f"{type(e).__name__}: {e}", 0), ("page", "", "", 0)]
    return parser.rows


def _markers(ev: pd.DataFrame) -> pd.Series:
    """Bullet or number of each list item, from the list that is innermost where it starts."""
    starts = ev["event"] == "start"
    began = pd.Series(np.where(starts & ev["tag"].isin(LISTS), ev.index, np.nan), index=ev.index)
    home = began.groupby([ev["page"], ev["level"]]).ffill()
    items = ev.assign(home=home).loc[starts & (ev["tag"] == "li"), ["level", "number", "home"]]
    bullets = np.array(BULLETS, dtype=object)[np.maximum(items["level"].to_numpy("int64") - 1, 0) % len(BULLETS)]
    numbered = items[items["level"] > 0]
    lists = ev.loc[numbered["home"].astype("int64")]
    numbered = numbered.assign(ordered=(lists["tag"] == "ol").to_numpy(), first=np.where(lists["number"] == 0, 1, lists["number"]))
    numbered["run"] = (numbered["number"] != 0).groupby(numbered["home"]).cumsum()
    run = numbered.groupby(["home", "run"])
    since = np.where(numbered["run"] == 0, numbered["first"], run["number"].transform("first")) + run.cumcount()
    count = since.astype("int64").astype(str)[numbered["ordered"]] + "."
    return pd.Series(bullets, index=items.index, dtype=object).where(~items.index.isin(count.index), count.reindex(items.index))


def _blocks(events: pd.DataFrame) -> pd.DataFrame:
    """Blocks of the events of whole pages: what lies between two borders, if it has any ink, and rules."""
    starts, ends = events["event"] == "start", events["event"] == "end"
    step = starts.astype("int64") - ends.astype("int64")

    def depth(*tags: str) -> pd.Series:
        return step.where(events["tag"].isin(tags), 0).groupby(events["page"]).cumsum()

    inside = depth("pre") - (starts & (events["tag"] == "pre")) > 0
    ev = events.assign(level=depth(*LISTS), quotes=depth("blockquote"), step=step)[~inside | events["event"].isin(["text", "br"])]
    starts, ends = ev["event"] == "start", ev["event"] == "end"
    border = (starts & ev["tag"].isin(BORDERS)) | (ends & ev["tag"].isin(BORDERS - LISTS)) | ev["event"].isin(["hr", "page"])
    block = border.cumsum()

    ink = (ev["event"] == "text") & ev["text"].str.contains(_INK)
    gap = starts & ev["tag"].isin(["td", "th"]) & (ink.groupby(block).cumsum() > 0)
    piece = ev["text"].where(ev["event"].isin(["text", "br"]), "").mask(gap, CELL_GAP)
    text = piece[~border].groupby(block).agg("".join)
    text = text[ink.groupby(block).any().reindex(text.index)]

    opener = ev.assign(block=block)[border & starts].set_index("block")
    kinds = opener["tag"].where(opener["tag"].isin(HEADINGS | {"li", "pre"}), "p")
    marks = _markers(ev)
    marks.index = block[marks.index]
    # A block is as deep as the border behind it: before that starts a list or a quote, after it ends one.
    grown = ev["step"].clip(lower=0).where(ev["tag"].isin(LISTS | {"blockquote"}), 0)
    quotes = ev["quotes"] - grown.where(ev["tag"] == "blockquote", 0)
    edge = pd.DataFrame({"page": ev["page"], "at": ev.index, "indent": ev["level"] + ev["quotes"] - grown, "quoted": quotes > 0})[border]
    closed = edge.set_axis(block[border] - 1)
    texts = closed.loc[text.index].assign(kind=kinds.reindex(text.index).fillna("p"), text=text, marker=marks.reindex(text.index))
    rules = edge[ev["event"][border] == "hr"].assign(kind="rule", text="", marker=None)
    errors = ev[ev["event"] == "error"].assign(at=lambda e: e.index, indent=0, quoted=False, kind="error", marker=None)
    out = pd.concat([texts, rules, errors[texts.columns]]).sort_values("at", kind="stable")
    return out.assign(seq=out.groupby("page").cumcount(), marker=out["marker"].astype(object).where(out["marker"].notna(), None))


def _page_blocks(closed: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def blocks_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            for _, pages in pdf.groupby(pdf["html"].map(lambda html: len(html or "")).cumsum() // SLICE):
                rows = [(page, *event) for page, html in zip(pages.index, pages["html"]) for event in _events_or_error(html, closed)]
                blocks = _blocks(pd.DataFrame(rows, columns=["page", "event", "tag", "text", "number"]))
                yield blocks.assign(page_id=pages["page_id"].reindex(blocks["page"]).to_numpy())[_COLUMNS]

    return blocks_of


def html_blocks(pages: DataFrame, closed_references: bool = False) -> DataFrame:
    """One row per block: heading, paragraph, list item, preformatted text, rule or table row.

    A browser also reads some references without their semicolon (``&amp`` at the
    end of a cut title); with ``closed_references`` those stay as written.
    """
    found = pages.select("page_id", "html").mapInPandas(_page_blocks(closed_references), _BLOCK_SCHEMA)
    text = F.when(F.col("kind") == "pre", rtrim_ws(F.regexp_replace("text", "^\n", ""))).when(F.col("kind") == "error", F.col("text"))
    return found.withColumn("text", text.otherwise(collapse_ws("text")))


#: Charsets that need no Python; all others are decoded there, on the rows that declare them.
_IN_JVM = ["utf-8", "utf-16le", "utf-16be", "windows-1252", "iso-8859-1", "latin1", "ascii", "us-ascii"]


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in the inside of a tag, with or without quotes; empty where it is missing."""
    forms = [rf'(?i)(?:^|[\s"\'/]){name}\s*=\s*{value}' for value in ('"([^"]*)"', "'([^']*)'", '([^\\s"\'>]+)')]
    return F.trim(F.concat(*[F.regexp_extract(tag, form, 1) for form in forms]))


def _declared(head: Column) -> Column:
    """The charset that the first meta tag to name one names, by itself or in its content type; empty without one."""
    def of(tag: Column) -> Column:
        own = _attribute(tag, "charset")
        return F.when(own != "", own).otherwise(F.regexp_extract(_attribute(tag, "content"), r"(?i)charset\s*=\s*([^\s;,]+)", 1))

    named = F.filter(F.transform(F.regexp_extract_all(head, F.lit("(?i)<meta\\b([^>]*)"), F.lit(1)), of), lambda name: name != "")
    return F.lower(F.coalesce(F.get(named, F.lit(0)), F.lit("")))


def pick_charset(content: Col) -> Column:
    """Charset of raw bytes: byte-order mark, then declaration, then valid UTF-8, then Windows-1252."""
    b = col(content)
    lead = F.hex(F.substring(b, 1, 3))
    head = F.decode(F.substring_index(b.cast("string"), "</head>", 1).cast("binary"), "ISO-8859-1")
    declared = _declared(head)
    return (F.when(lead == "EFBBBF", "utf-8").when(lead.startswith("FFFE"), "utf-16le")
            .when(lead.startswith("FEFF"), "utf-16be")
            .when((declared != "") & ~declared.rlike("^utf-?8$"), declared)
            .when(F.is_valid_utf8(b.cast("string")), "utf-8").otherwise("windows-1252"))


@F.pandas_udf(T.StringType())
def _decoded(content: pd.Series, charset: pd.Series) -> pd.Series:
    """Bytes in any charset that the standard codecs know; null for other names."""

    def one(b: bytes | None, name: str | None) -> str | None:
        try:
            return None if b is None or name is None else codecs.decode(b, name, "replace")
        except (LookupError, ValueError, TypeError, AssertionError):
            return None

    return pd.Series([one(b, c) for b, c in zip(content, charset)], dtype=object)


def decode_html(content: Col, charset: Col) -> Column:
    """Text of raw bytes in the picked charset; an unknown name falls back to UTF-8 or Windows-1252."""
    b, c = col(content), col(charset)
    text = F.make_valid_utf8(b.cast("string"))
    no_bom = F.regexp_replace(text, r"^\x{feff}", "")
    western = F.translate(F.decode(b, "ISO-8859-1"), "".join(map(chr, WINDOWS_1252)),
                          "".join(map(chr, WINDOWS_1252.values())))
    return (F.when(c == "utf-8", no_bom)
            .when(c == "utf-16le", F.regexp_replace(F.decode(b, "UTF-16LE"), r"^\x{feff}", ""))
            .when(c == "utf-16be", F.regexp_replace(F.decode(b, "UTF-16BE"), r"^\x{feff}", ""))
            .when(c.isin(*_IN_JVM[3:]), western)
            .otherwise(F.coalesce(_decoded(F.when(~c.isin(*_IN_JVM), b), c), F.when(F.is_valid_utf8(b.cast("string")), no_bom).otherwise(western))))
