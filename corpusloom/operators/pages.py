"""Whole documents from positioned runs to lines, blocks and paragraphs, in Arrow batches.

The rules are those of :mod:`layout` and :mod:`prose`, for documents whose rows
follow each other. What they ask is numbers, so a few documents at a time are
labelled by numpy, and only pages or blocks out of the ordinary go through the
greedy loops. Nothing is sorted that comes in order. Texts are cut and joined
by Arrow; rules on words stay in Spark. Memory is that of ``AT_ONCE`` and of
the longest document.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import hashed_by
from . import layout, prose
from .streamed import changes

# ── fixed values ────────────────────────────────────────────────────────────
AT_ONCE = 2_000_000
ASCENT, DESCENT, PAD = 0.92, 0.28, 15
BULLET = layout.BULLET.replace(r"\s", r"[ \t\n\x0b\f\r]").replace(r"\S", r"[^ \t\n\x0b\f\r]")
# ────────────────────────────────────────────────────────────────────────────

Unpack = Callable[[pa.Table], pa.Table]


def _whole_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole documents, of ``AT_ONCE`` bytes or of one document."""

    def parts(t: pa.Table) -> Iterator[pa.Table]:
        starts = _starts(t, ["doc_id"])
        bytes_of = pc.fill_null(pc.binary_length(t["text"]), 0).to_numpy().astype("int64")
        before = np.append(np.cumsum(bytes_of) - bytes_of, bytes_of.sum())
        bounds, a = np.append(starts, t.num_rows), 0
        while a < len(starts):
            b = max(a + 1, int(np.searchsorted(before[bounds], before[bounds[a]] + AT_ONCE, side="right")) - 1)
            yield t.slice(bounds[a], bounds[b] - bounds[a]).combine_chunks()
            a = b

    held: list[pa.Table] = []
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not t.num_rows:
            continue
        seam = held[-1].slice(held[-1].num_rows - 1) if held else t.slice(0, 0)
        last = int(_starts(pa.concat_tables([seam, t]), ["doc_id"])[-1]) - seam.num_rows
        if last >= 0:  # a document starts here, so those before it are whole
            before = [*held, t.slice(0, last)]
            if sum(p.num_rows for p in before):
                yield from parts(pa.concat_tables(before))
            held = []
        held.append(t.slice(max(last, 0)))
    if held:
        yield from parts(pa.concat_tables(held))


def _starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], changes(t, keys)]))


def _ascending(*keys: np.ndarray) -> bool:
    """Whether each row is above the row before it, by one key after the other."""
    less, equal = False, True
    for key in keys:
        less, equal = less | (equal & (key[:-1] < key[1:])), equal & (key[:-1] == key[1:])
    return bool(np.all(less))


def _number(starts: np.ndarray, n: int) -> np.ndarray:
    """The number of the group each of ``n`` rows is in."""
    return np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))


# runs → rows → lines ------------------------------------------------------------


def _in_page_order(t: pa.Table) -> pa.Table:
    """Runs of each document by page, baseline and x; sorted only if they are not."""
    doc = _number(_starts(t, ["doc_id"]), t.num_rows)
    page = t["page_no"].fill_null(np.iinfo("int64").min).to_numpy()
    if _ascending(doc, page, t["baseline"].to_numpy(), t["x"].to_numpy()):
        return t
    order = ["_doc", "page_no", "baseline", "x", "w", "run_no", "text", "size", "angle", "idx"]
    return t.append_column("_doc", pa.array(doc)).sort_by([(c, "ascending") for c in order]).drop_columns(["_doc"]).combine_chunks()


def _in_rows(t: pa.Table) -> pa.Table:
    """Add ``row`` as :func:`layout.group_rows` does; the runs of a row follow each other."""
    t = _in_page_order(t)
    n, starts = t.num_rows, _starts(t, layout.PAGE)
    page = _number(starts, n)
    baseline, size, angle = (t[c].to_numpy().astype("float64") for c in ("baseline", "size", "angle"))
    turned = np.abs(angle) >= layout.UPRIGHT_DEGREES
    row = np.where(turned, -1 - (np.arange(n) - starts[page]), 0)

    # baselines further apart than any tolerance of their page: each is a row
    up = np.flatnonzero(~turned)
    reach = layout.SAME_LINE * np.maximum.reduceat(size, starts)
    step, same = np.diff(baseline[up]), np.diff(page[up]) == 0
    odd = np.zeros(len(starts), dtype=bool)
    odd[page[up][1:][same & (step != 0) & ~(step >= reach[page[up][1:]])]] = True
    odd[page[up][size[up] <= 0]] = True
    opens = np.concatenate([[True], ~same | (step != 0)])[:len(up)]
    label = np.cumsum(opens)
    if len(up):
        firsts = np.flatnonzero(np.concatenate([[True], ~same]))
        row[up] = label - label[firsts][_number(firsts, len(up))]
    bounds = np.append(starts, n)
    for p in np.flatnonzero(odd):
        a, b = bounds[p], bounds[p + 1]
        row[a:b] = layout._rows_of_page(baseline[a:b], size[a:b], turned[a:b])

    stretches = 1 + np.count_nonzero(np.diff(page) | np.diff(row))
    t = t.append_column("row", pa.array(row))
    if not odd.any() and stretches == np.count_nonzero(opens) + np.count_nonzero(turned):
        return t
    return t.take(pa.array(np.lexsort((t["run_no"].to_numpy(), t["x"].to_numpy(), row, page)))).combine_chunks()


# lines → blocks -----------------------------------------------------------------


def _block_numbers(page: np.ndarray, baseline: np.ndarray, x0: np.ndarray, x1: np.ndarray, size: np.ndarray, bullet: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """The labels of :func:`layout.to_blocks` for lines in reading order, page after page."""
    out = np.zeros(len(page), dtype=np.int64)
    turns = np.flatnonzero(turned)
    if len(turns):
        firsts = np.flatnonzero(np.concatenate([[True], np.diff(page[turns]) != 0]))
        out[turns] = -1 - (np.arange(len(turns)) - firsts[_number(firsts, len(turns))])
    up = np.flatnonzero(~turned)
    if not len(up):
        return out
    page, baseline, x0, x1, size, bullet = (a[up] for a in (page, baseline, x0, x1, size, bullet))

    # the line above is the one before, whether they join or not, so all but the usual gap is known at once
    gap, big = np.diff(baseline), np.maximum(size[1:], size[:-1])
    narrower = np.minimum(x1[:-1] - x0[:-1], x1[1:] - x0[1:])
    axis = np.abs((x0[:-1] + x1[:-1]) - (x0[1:] + x1[1:])) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        may = ((np.diff(page) == 0) & ~bullet[1:] & (gap > 0) & (narrower > 0)
               & ((np.minimum(x1[:-1], x1[1:]) - np.maximum(x0[:-1], x0[1:])) / narrower >= layout.OVERLAP)
               & (np.abs(np.diff(size)) / big <= layout.SIZE_JUMP)
               & (np.minimum(np.minimum(np.abs(np.diff(x0)), np.abs(np.diff(x1))), axis) < layout.EDGE_SLACK * big))
    starts = np.concatenate([[True], ~may])
    stretches = np.flatnonzero(starts)
    # the usual gap is never below the least one of a stretch; where all pass that, none breaks
    usual = np.where(may, np.minimum(gap, size[:-1] * layout.LEADING), np.inf)
    least = np.minimum.reduceat(np.concatenate([[np.inf], usual]), stretches)
    widest = np.maximum.reduceat(np.concatenate([[-np.inf], np.where(may, gap, -np.inf)]), stretches)
    bounds = np.append(stretches, len(up))
    for k in np.flatnonzero(widest > layout.LINE_GAP * least):
        gaps: list = []
        for i in range(bounds[k] + 1, bounds[k + 1]):
            typical = gaps[(len(gaps) - 1) // 2] if gaps else size[i - 1] * layout.LEADING
            if gap[i - 1] <= layout.LINE_GAP * typical:
                insort(gaps, gap[i - 1])
            else:
                starts[i], gaps = True, []
    label = np.cumsum(starts)
    firsts = np.flatnonzero(np.concatenate([[True], np.diff(page) != 0]))
    out[up] = label - label[firsts][_number(firsts, len(up))]
    return out


def _lines_in_blocks(runs: pa.Table) -> pa.Table:
    """Lines of whole documents with their block, each block's lines together in reading order."""
    lines = pa.Table.from_batches([layout._lines_of_rows(_in_rows(runs), "row", None)])
    page = _number(_starts(lines, layout.PAGE), lines.num_rows)
    order = ("seg", "row", "x0", "baseline")
    if not _ascending(page, *(lines[c].to_numpy() for c in reversed(order))):
        lines = lines.take(pa.array(np.lexsort((*(lines[c].to_numpy() for c in order), page)))).combine_chunks()
    turned = lines["row"].to_numpy() < 0
    bullet = pc.match_substring_regex(lines["text"], BULLET).to_numpy()
    block = _block_numbers(page, *(lines[c].to_numpy() for c in ("baseline", "x0", "x1", "size")), bullet, turned)
    lines = lines.append_column("block", pa.array(block))
    return lines.take(pa.array(np.lexsort((block, page)))).combine_chunks() if np.any((np.diff(block) < 0) & (np.diff(page) == 0)) else lines


# blocks → paragraphs ------------------------------------------------------------


def _spread(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.maximum.reduceat(values, starts) - np.minimum.reduceat(values, starts)


def _alignments(x0: np.ndarray, x1: np.ndarray, size: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each block is justified, and whether it is centred or flush right only (:func:`layout.with_align`)."""
    n = np.diff(np.append(starts, len(x0)))
    last = np.zeros(len(x0), dtype=bool)
    last[starts + n - 1] = True
    slack = layout.EDGE_SLACK * size[starts]
    body = np.maximum.reduceat(np.where(last, -np.inf, x1), starts) - np.minimum.reduceat(np.where(last, np.inf, x1), starts)
    left = _spread(x0, starts) < slack
    right = np.where(n > 2, body, _spread(x1, starts)) < slack
    return (n > 1) & left & right, (n > 1) & ~left & ((_spread((x0 + x1) / 2, starts) < slack) | right)


def _paragraph_numbers(x0: np.ndarray, x1: np.ndarray, size: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The labels of :func:`prose.paragraphs` for lines whose blocks begin at ``starts``."""
    of = _number(starts, len(x0))
    first = np.zeros(len(x0), dtype=bool)
    first[starts] = True
    justified, loose = (a[of] for a in _alignments(x0, x1, size, starts))
    indented = x0 - np.minimum.reduceat(x0, starts)[of] > size * prose.INDENT_EMS
    next_too = np.append(indented[1:] & ~first[1:], False)
    short_before = np.concatenate([[np.inf], x1[:-1]]) < np.maximum.reduceat(x1, starts)[of] - size * prose.SHORT_EMS
    opens = ~first & ~loose & ((indented & ~next_too) | (justified & short_before))
    label = np.cumsum(opens)
    return label - label[starts][of]


def _paragraphs(lines: pa.Table, page_height: float) -> pa.Table:
    """One row per paragraph with its lines, and one per document and size with its characters outside the edges."""
    n = lines.num_rows
    blocks = _starts(lines, [*layout.PAGE, "block"])
    of = _number(blocks, n)
    x0, x1, size, baseline, idx, page_no = (lines[c].to_numpy() for c in ("x0", "x1", "size", "baseline", "idx", "page_no"))
    docs = _starts(lines, ["doc_id"])
    doc = _number(docs, n)

    alone = (np.diff(np.append(blocks, n)) == 1)[of]
    top, bottom = baseline - size * ASCENT - PAD, baseline + size * DESCENT + PAD
    edge = alone & ((top < page_height * prose.EDGE_SHARE) | (bottom > page_height * (1 - prose.EDGE_SHARE)))
    half_point = (np.floor(size / 5 + 0.5) * 5).astype("int64")
    chars = pc.utf8_length(lines["text"]).to_numpy().astype("int64")
    sighted = page_no * 1_000_000_000 + idx

    number = _paragraph_numbers(x0, x1, size, blocks)
    paras = np.flatnonzero(np.concatenate([[True], (np.diff(of) != 0) | (np.diff(number) != 0)]))
    at, of_para, edges = pa.array(paras), _number(paras, n), edge[paras]
    sheets, page_starts = np.maximum.reduceat(page_no, docs), _starts(lines, layout.PAGE)
    text = lines["text"].combine_chunks()

    def of_edges(values: np.ndarray) -> pa.Array:
        return pa.array(values[paras], mask=~edges)

    by_para = {
        "doc_id": lines["doc_id"].take(at).combine_chunks(), "page_no": lines["page_no"].take(at).combine_chunks(), "block": lines["block"].take(at).combine_chunks(),
        "para": pa.array(number[paras]), "place": pa.array(np.minimum.reduceat(idx, blocks)[of[paras]]),
        "sheets": pa.array(sheets[doc[paras]]), "pages": pa.array(np.bincount(doc[page_starts], minlength=len(docs))[doc[paras]]),
        "n_lines": pa.array(np.diff(np.append(paras, n))), "size": pa.array(layout._lower_medians(size, of_para, len(paras)).astype("int64")),
        "edge": pa.array(edges), "lines": pa.ListArray.from_arrays(pa.array(np.append(paras, n), pa.int32()), text),
        "k": of_edges(half_point), "n": of_edges(chars), "first": of_edges(sighted)}
    out = pa.Table.from_pydict(by_para)

    inner = np.flatnonzero(~edge)
    if not len(inner):
        return out
    inner = inner[np.lexsort((half_point[inner], doc[inner]))] if not _sorted_pairs(doc[inner], half_point[inner]) else inner
    groups = np.flatnonzero(np.concatenate([[True], (np.diff(doc[inner]) != 0) | (np.diff(half_point[inner]) != 0)]))
    by_size = {"doc_id": lines["doc_id"].take(pa.array(inner[groups])).combine_chunks(), "k": pa.array(half_point[inner][groups]),
               "n": pa.array(np.add.reduceat(chars[inner], groups)), "first": pa.array(np.minimum.reduceat(sighted[inner], groups))}
    weights = pa.Table.from_pydict({c: by_size.get(c, pa.nulls(len(groups), out.schema.field(c).type)) for c in out.column_names})
    return pa.concat_tables([out, weights])


def _sorted_pairs(a: np.ndarray, b: np.ndarray) -> bool:
    return bool(np.all((a[:-1] < a[1:]) | ((a[:-1] == a[1:]) & (b[:-1] <= b[1:]))))


# steps --------------------------------------------------------------------------


def _runs_of(rows: DataFrame) -> DataFrame:
    idx = F.col("row_no") * 1000 + F.col("run_no")
    return rows.select("doc_id", "page_no", "x", "w", "run_no", idx.alias("idx"), F.coalesce("text", F.lit("")).alias("text"), "size", "baseline", "angle")


def _together(rows: DataFrame) -> DataFrame:
    """The rows of a document one after the other in one partition."""
    return hashed_by(rows, "doc_id").sortWithinPartitions("doc_id")


def page_lines(runs: DataFrame) -> DataFrame:
    """Lines of runs with their block; each turned run is a line and a block of its own."""
    kinds = {f.name: f.dataType.simpleString() for f in runs.schema.fields}
    columns = ["doc_id", "page_no", "text", "x0", "x1", "baseline", "size", "block", "idx"]

    def lines_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_documents(batches):
            yield from _lines_in_blocks(t).select(columns).to_batches()

    return _together(_runs_of(runs)).mapInArrow(lines_of, (
        f"doc_id {kinds['doc_id']}, page_no {kinds['page_no']}, text string, x0 {kinds['x']}, x1 {kinds['x']}, baseline {kinds['baseline']}, size long, block long, idx long"))


def page_paragraphs(rows: DataFrame, page_height: float, unpack: Unpack | None = None) -> DataFrame:
    """Paragraphs of whole documents, in one step.

    A paragraph carries its ``lines`` and what its document or block decides:
    highest sheet, number of sheets with text, place of its block in the
    content stream, and whether it is a block of one line in the top or bottom
    strip (``edge``). Rows without lines hold the characters (``n``) that a document has in a
    size (``k``, to half a point) outside such edges, and where it is seen
    ``first``; an edge carries its own.

    Rows are runs, or what ``unpack`` makes runs of, so that runs need not
    cross from one step to another one by one.
    """

    def paragraphs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_documents(batches):
            runs = unpack(t) if unpack else t
            if runs.num_rows:
                yield from _paragraphs(_lines_in_blocks(runs), page_height).combine_chunks().to_batches()

    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}["doc_id"]
    return _together(rows if unpack else _runs_of(rows)).mapInArrow(paragraphs_of, (
        f"doc_id {kind}, page_no long, block long, para long, place long, sheets long, pages long, n_lines long, size long, edge boolean, "
        "lines array<string>, k long, n long, first long"))
