"""Rectangles and points: overlap, hit tests, merging, strokes.

Range joins go through a grid. A rectangle is listed in every cell it touches
and pairs meet only inside a shared cell, so a page holding a large share of
all rows still spreads over many tasks. Identical rectangles are folded into
one shape before any pairing: a pile of copies costs one row, not its square.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.faces import selection_flags
from ..session import cut_lineage

# ── fixed values ────────────────────────────────────────────────────────────
SAME_PASSAGE = 0.6
TRIVIAL_POINTS, TRIVIAL_SIDE = 2, 4
SAME_POINT = 1e-7
READING_BUCKET = 30  # three points, in tenths
# ────────────────────────────────────────────────────────────────────────────

BOX = ["x", "y", "w", "h"]


def _span(lo: Column, hi: Column, cell: int) -> Column:
    return F.sequence(F.floor(lo / cell), F.floor(hi / cell))


def in_cells(rects: DataFrame, cell: int) -> DataFrame:
    """One row per grid cell a rectangle touches (``_cx``, ``_cy``)."""
    across = rects.withColumn("_cx", F.explode(_span(F.col("x"), F.col("x") + F.col("w"), cell)))
    return across.withColumn("_cy", F.explode(_span(F.col("y"), F.col("y") + F.col("h"), cell)))


def shapes(rects: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """Identical rectangles as one row: its lowest id and how many copies it stands for."""
    return rects.groupBy(*keys, *BOX).agg(F.min(id_col).alias("id"), F.count(F.lit(1)).alias("copies"))


def shape_pairs(a: DataFrame, b: DataFrame, keys: Sequence[str], cell: int) -> DataFrame:
    """Pairs of shapes whose interiors overlap, with the shared area.

    A pair can meet in several cells; it is reported only by the cell holding
    the top-left corner of its intersection, so no distinct is needed.
    """
    left = in_cells(a, cell).select(*keys, "_cx", "_cy", *[F.col(c).alias(f"a_{c}") for c in (*BOX, "id", "copies")])
    right = in_cells(b, cell).select(*keys, "_cx", "_cy", *[F.col(c).alias(f"b_{c}") for c in (*BOX, "id", "copies")])
    x0, y0 = F.greatest("a_x", "b_x"), F.greatest("a_y", "b_y")
    w = F.least(F.col("a_x") + F.col("a_w"), F.col("b_x") + F.col("b_w")) - x0
    h = F.least(F.col("a_y") + F.col("a_h"), F.col("b_y") + F.col("b_h")) - y0
    owner = (F.col("_cx") == F.floor(x0 / cell)) & (F.col("_cy") == F.floor(y0 / cell))
    return (left.join(right, [*keys, "_cx", "_cy"]).where((w > 0) & (h > 0) & owner)
            .withColumn("shared", w * h).drop("_cx", "_cy"))


def overlapping_pairs(rects: DataFrame, keys: Sequence[str], id_col: str, cell: int = 64) -> DataFrame:
    """Neighbouring shapes that strictly overlap; a shape with copies overlaps itself."""
    s = shapes(rects, keys, id_col)
    pairs = shape_pairs(s, s, keys, cell)
    return pairs.where((F.col("a_id") < F.col("b_id")) | ((F.col("a_id") == F.col("b_id")) & (F.col("a_copies") > 1))).select(
        *keys, F.col("a_id").alias("a"), F.col("b_id").alias("b"), "a_copies", "b_copies")


def overlap_summary(rects: DataFrame, keys: Sequence[str], id_col: str, cell: int = 64) -> DataFrame:
    """One row per shape that overlaps anything: how many rectangles, what area in all, and with which shape the most.

    Linear in its output where :func:`overlapping_pairs` gives a row per pair;
    the pairs of a cell are summed where they are found.
    """
    s = shapes(rects, keys, id_col)
    others = F.col("b_copies") - (F.col("a_id") == F.col("b_id")).cast("long")
    pairs = shape_pairs(s, s, keys, cell).withColumn("_n", others).where("_n > 0")
    return pairs.groupBy(*keys, F.col("a_id").alias("shape"), F.col("a_copies").alias("copies")).agg(
        F.sum("_n").alias("n_others"), F.sum(F.col("shared") * F.col("_n")).alias("shared"), F.max_by("b_id", F.struct("shared", -F.col("b_id"))).alias("best"))


# marks: one or more rectangles, one per line of the text they lie on ----------------


SIGNATURE = ["area", "_n", "_sum", "_xor"]


def _signed(rects: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    return rects.groupBy(*keys, F.col(id_col).alias("id")).agg(
        F.sum(F.col("w") * F.col("h")).alias("area"), F.count(F.lit(1)).alias("_n"),
        F.sum(F.xxhash64(*BOX).cast("decimal(38,0)")).alias("_sum"), F.bit_xor(F.xxhash64(*reversed(BOX))).alias("_xor"))


def mark_shapes(rects: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """The rectangles of distinct marks, with ``id``, ``copies`` and ``area`` of the mark.

    ``rects`` has a row per rectangle, ``id_col`` naming its mark. Marks made of
    the same rectangles are one, named by the lowest id: equal in number, area and
    two sums of 64-bit hashes, so a mark's rectangles are never gathered.
    """
    distinct = _signed(rects, keys, id_col).groupBy(*keys, *SIGNATURE).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")).drop(*SIGNATURE[1:])
    return rects.select(*keys, F.col(id_col).alias("id"), *BOX).join(distinct, [*keys, "id"])


def _shared_area(a: DataFrame, b: DataFrame, keys: Sequence[str], cell: int, apart: bool) -> DataFrame:
    """Area that two marks share, summed over their rectangles: (keys, a_id, b_id, …, shared) for marks that overlap at all.

    A pair of rectangles counts in the cell of its intersection's corner only;
    sums leave a cell before they are shuffled. apart: of two marks in one list,
    the lower id is a's.
    """
    def side(d: DataFrame, name: str) -> DataFrame:
        rest = [c for c in d.columns if c not in keys]
        return in_cells(d, cell).select(*keys, "_cx", "_cy", *[F.col(c).alias(f"{name}_{c}") for c in rest])

    x0, y0 = F.greatest("a_x", "b_x"), F.greatest("a_y", "b_y")
    w = F.least(F.col("a_x") + F.col("a_w"), F.col("b_x") + F.col("b_w")) - x0
    h = F.least(F.col("a_y") + F.col("a_h"), F.col("b_y") + F.col("b_h")) - y0
    met = side(a, "a").join(side(b, "b"), [*keys, "_cx", "_cy"])
    met = met.where((w > 0) & (h > 0) & (F.col("_cx") == F.floor(x0 / cell)) & (F.col("_cy") == F.floor(y0 / cell)))
    met = met.where("a_id < b_id") if apart else met
    marks = [c for c in met.columns if c not in ("_cx", "_cy", *[f"{s}_{c}" for s in "ab" for c in BOX])]
    return met.groupBy(*marks).agg(F.sum(w * h).alias("shared"))


def _same_passage() -> Column:
    """One covers most of the other; a mark without an area covers nothing."""
    return F.greatest(*[F.when(F.col(f"{s}_area") > 0, F.col("shared") / F.col(f"{s}_area")).otherwise(0) for s in "ab"]) >= SAME_PASSAGE


def match_marks(rects: DataFrame, keys: Sequence[str], id_col: str, cell: int = 64) -> DataFrame:
    """Marks that cover the same passage as others: (keys, mark, copies, n_matches, match).

    One row per distinct mark that matches any: ``n_matches`` other marks, its own
    copies and those of others counted, and ``match``, the lowest of another shape
    (null where only copies match). No row per pair leaves the operator.
    """
    shapes_ = mark_shapes(rects, keys, id_col)
    pairs = _shared_area(shapes_, shapes_, keys, cell, apart=True).where(_same_passage())
    ways = [pairs.select(*keys, F.col(f"{s}_id").alias("mark"), F.col(f"{o}_id").alias("_o"), F.col(f"{o}_copies").alias("_c")) for s, o in ("ab", "ba")]
    others = ways[0].unionByName(ways[1]).groupBy(*keys, "mark").agg(F.sum("_c").alias("_c"), F.min("_o").alias("match"))
    marks = shapes_.groupBy(*keys, F.col("id").alias("mark")).agg(F.first("copies").alias("copies"))
    found = marks.join(others, [*keys, "mark"], "left").withColumn("n_matches", F.col("copies") - 1 + F.coalesce("_c", F.lit(0)))
    return found.where("n_matches > 0").select(*keys, "mark", "copies", "n_matches", "match")


def toggle_marks(marks: DataFrame, selection: DataFrame, keys: Sequence[str] = ("page",), cell: int = 64) -> DataFrame:
    """A mark action is a switch: any existing match anywhere removes them all, else it inserts.

    ``marks``: keys, mark_id and box, a row per rectangle. ``selection``: action,
    keys and box, a row per rectangle; what an action selects under the same keys
    is one selection, and one mark if it is inserted. Gives (action, keys,
    mark_id, op), mark_id null for inserts. An action never both removes and
    inserts.
    """
    keys = list(keys)
    shaped = mark_shapes(marks, keys, "mark_id")
    areas = selection.groupBy("action", *keys).agg(F.sum(F.col("w") * F.col("h")).alias("area"))
    chosen = selection.select("action", *keys, *BOX).join(areas, ["action", *keys]).withColumnRenamed("action", "id")
    matched = _shared_area(chosen, shaped, keys, cell, apart=False).where(_same_passage()).select(F.col("a_id").alias("action"), *keys, F.col("b_id").alias("shape"))
    signed = _signed(marks, keys, "mark_id")
    named = signed.groupBy(*keys, *SIGNATURE).agg(F.min("id").alias("shape"))
    members = signed.join(named, [*keys, *SIGNATURE]).select(*keys, "shape", F.col("id").alias("mark_id"))
    removed = matched.join(members, [*keys, "shape"]).select("action", *keys, "mark_id", F.lit("remove").alias("op"))
    kept = areas.join(matched.select("action").distinct(), "action", "left_anti")
    kind = dict(marks.dtypes)["mark_id"]
    return removed.unionByName(kept.select("action", *keys, F.lit(None).cast(kind).alias("mark_id"), F.lit("insert").alias("op")))


CELL = ["page", "_cx", "_cy"]


def _located(spots: DataFrame, cell: int) -> DataFrame:
    return spots.select("page", "px", "py", F.floor(F.col("px") / cell).alias("_cx"), F.floor(F.col("py") / cell).alias("_cy"))


def _tested(spots: DataFrame, parts: DataFrame) -> DataFrame:
    """Each spot against each shape of its cell."""
    inside = (F.col("px").between(F.col("x"), F.col("x") + F.col("w"))
              & F.col("py").between(F.col("y"), F.col("y") + F.col("h")))
    return spots.join(parts, CELL).where(inside).select("page", "px", "py", "hit")


def _quartered(parts: DataFrame, cell: int, side: int) -> DataFrame:
    """The part of each shape in its cell, listed in the smaller cells it touches there."""
    def span(at: str, lo: str, size: str) -> Column:
        first, last = F.col(at) * (cell // side), (F.col(at) + 1) * (cell // side) - 1
        return F.sequence(F.greatest(F.floor(F.col(lo) / side), first), F.least(F.floor((F.col(lo) + F.col(size)) / side), last))

    across = parts.select("page", *BOX, "hit", "_cy", F.explode(span("_cx", "x", "w")).alias("_sx"))
    return across.select("page", *BOX, "hit", F.col("_sx").alias("_cx"), F.explode(span("_cy", "y", "h")).alias("_cy"))


def hit_test(rects: DataFrame, points: DataFrame, id_col: str, cell: int = 64, crowded: int = 1 << 20) -> DataFrame:
    """The last-added rectangle containing each point, edges included; null where none does.

    Points at one spot and rectangles in one place are tested once each. A cell
    where spots times shapes exceed ``crowded`` is cut into sixteen, down to cells
    of side 1: of the shapes that cover a whole cell only the last matters, and
    only later ones whose edge runs through the cell go on to the smaller cells,
    and there only to cells that hold a spot. So shapes piled on each other
    cost what their edges cost, not a test per spot and shape. Cells that are not
    crowded are joined as they are.
    """
    top = rects.groupBy("page", *BOX).agg(F.max(id_col).alias("hit"))
    spots, parts = _located(points.select("page", "px", "py").distinct(), cell), in_cells(top, cell)
    found = []
    while cell > 1 and cell % 4 == 0:
        pairs = F.col("_spots").cast("double") * F.col("_shapes")
        hot = (spots.groupBy(*CELL).agg(F.count(F.lit(1)).alias("_spots"))
               .join(parts.groupBy(*CELL).agg(F.count(F.lit(1)).alias("_shapes")), CELL).where(pairs > crowded).select(*CELL))
        if hot.isEmpty():
            break
        hot = cut_lineage(hot)
        found.append(_tested(spots.join(hot, CELL, "left_anti"), parts))
        spots, parts = cut_lineage(spots.join(hot, CELL, "left_semi")), cut_lineage(parts.join(hot, CELL, "left_semi"))
        whole = F.lit(True)
        for at, lo, size in (("_cx", "x", "w"), ("_cy", "y", "h")):
            whole = whole & (F.col(lo) <= F.col(at) * cell) & (F.col(lo) + F.col(size) >= (F.col(at) + 1) * cell)
        covers = cut_lineage(parts.where(whole).groupBy(*CELL).agg(F.max("hit").alias("cover")))
        found.append(spots.join(covers, CELL).select("page", "px", "py", F.col("cover").alias("hit")))
        later = parts.where(~whole).join(covers, CELL, "left").where("cover IS NULL OR hit > cover")
        spots = _located(spots, cell // 4)
        parts = cut_lineage(_quartered(later, cell, cell // 4).join(spots.select(*CELL).distinct(), CELL, "left_semi"))
        cell //= 4
    last = reduce(DataFrame.unionByName, [*found, _tested(spots, parts)]).groupBy("page", "px", "py").agg(F.max("hit").alias("hit"))
    return points.join(last, ["page", "px", "py"], "left").select("point_id", "hit")


def text_in(runs: DataFrame, boxes: DataFrame) -> DataFrame:
    """The text under each box (``box_id``), in reading order; size and face from the first run.

    Any contact counts. Baselines within three points read as one line. Blank
    runs say nothing and are skipped; a box that covers no text has an empty one,
    and neither size nor face. ``bold``, ``serif`` and ``mono`` are read from the
    name of the face.
    """
    b = boxes.select("doc_id", "page_no", "box_id", *[F.col(c).alias(f"b_{c}") for c in BOX])
    r = runs.where(~F.col("text").rlike(r"^\s*$")).withColumn("y", F.col("baseline") - F.col("size"))
    apart = ((F.col("x") + F.col("w") < F.col("b_x")) | (F.col("x") > F.col("b_x") + F.col("b_w"))
             | (F.col("baseline") < F.col("b_y")) | (F.col("y") > F.col("b_y") + F.col("b_h")))
    order = F.struct(F.floor(F.col("y") / READING_BUCKET).alias("band"), "x", "run_no", "text", "size", "face")
    found = (r.join(b, ["doc_id", "page_no"]).where(~apart).select("box_id", order.alias("hit"))
             .groupBy("box_id").agg(F.array_sort(F.collect_list("hit")).alias("hits")))
    joined = F.array_join(F.transform("hits", lambda h: h["text"]), " ")
    first = F.get(F.col("hits"), F.lit(0))
    flags = [F.when(F.col("hits").isNotNull(), flag).alias(name.removeprefix("is_")) for name, flag in selection_flags(first["face"]).items()]
    return boxes.select("box_id", "doc_id", "page_no").join(found, "box_id", "left").select(
        "box_id", "doc_id", "page_no", F.coalesce(F.trim(F.regexp_replace(joined, r"\s+", " ")), F.lit("")).alias("text"),
        F.floor(first["size"] / 10 + 0.5).alias("size"), *flags, F.coalesce(F.size("hits"), F.lit(0)).cast("long").alias("n_runs"))


def extent(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bounding box of parts, each grown by its stroke ``pad``."""
    x1, y1 = F.col("x") + F.col("w") + F.col("pad"), F.col("y") + F.col("h") + F.col("pad")
    box = parts.groupBy(*keys).agg(F.min(F.col("x") - F.col("pad")).alias("x"), F.min(F.col("y") - F.col("pad")).alias("y"),
                                   F.max(x1).alias("_x1"), F.max(y1).alias("_y1"))
    return box.select(*keys, "x", "y", (F.col("_x1") - F.col("x")).alias("w"), (F.col("_y1") - F.col("y")).alias("h"))


def drop_trivial(marks: DataFrame) -> DataFrame:
    """A click that was meant to be a drag leaves nothing: short strokes and tiny boxes go."""
    ink = F.col("kind") == "ink"
    trivial = F.when(ink, F.col("n_points") < TRIVIAL_POINTS).otherwise(
        (F.col("w") < TRIVIAL_SIDE) & (F.col("h") < TRIVIAL_SIDE))
    return marks.where(~trivial)


# merging a selection's rectangles -------------------------------------------------


def _lines_of_page(x, y, w, h) -> list[dict]:
    """Lines of rectangles in (y, x) order, judged by the line's lower medians so far: ends, and medians of height and bottom."""
    active, lines = [], []
    for left, top, wide, tall in zip(x.tolist(), y.tolist(), w.tolist(), h.tolist()):
        live, home = [], None
        for line in active:
            bottom = line["b"][(len(line["b"]) - 1) // 2]
            if bottom <= top:  # later rectangles start lower still, so this line is finished
                continue
            live.append(line)
            typical = line["h"][(len(line["h"]) - 1) // 2]
            if home is None and min(bottom, top + tall) - max(bottom - typical, top) > min(typical, tall) * 0.5:
                home = line
        active = live
        if home is None:
            home = {"x": left, "right": left + wide, "h": [tall], "b": [top + tall]}
            active.append(home)
            lines.append(home)
        else:
            home["x"], home["right"] = min(home["x"], left), max(home["right"], left + wide)
            insort(home["h"], tall), insort(home["b"], top + tall)
    return [{"line": n, "x": e["x"], "right": e["right"], "h": e["h"][(len(e["h"]) - 1) // 2], "b": e["b"][(len(e["b"]) - 1) // 2]}
            for n, e in enumerate(lines)]


def merge_rects(rects: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One rectangle per line of a page's selection; its height and bottom are lower medians."""

    @F.pandas_udf("array<struct<line: long, x: long, right: long, h: long, b: long>>")
    def lines(x: pd.Series, y: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([_lines_of_page(*page) for page in zip(x, y, w, h)], dtype=object)

    pages = rects.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("y", "x", "w", "h"))).alias("r"))
    merged = pages.select(*keys, F.inline(lines("r.x", "r.y", "r.w", "r.h")))
    return merged.select(*keys, "line", "x", (F.col("b") - F.col("h")).alias("y"), (F.col("right") - F.col("x")).alias("w"), "h")
