"""Logs and point lists read in order; every scan is split so no key is one task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .geometry import SAME_POINT
from .layout import lower_median
from .ordered import neighbours, ordinal_block, running_total
from .streamed import grouped, mapped

# ── fixed values ────────────────────────────────────────────────────────────
PALETTE_LEVELS, PALETTE_SIZE = 4, 48
UNIFORM_SPREAD = 24
CELL_PAD = 140
EDITS_A_BLOCK = 1024
# ────────────────────────────────────────────────────────────────────────────


def number_items(items: DataFrame, keys: Sequence[str], block: Column, order: Sequence[str]) -> DataFrame:
    """Continue list numbering: an explicit ``value`` restarts the count from itself.

    One summary per block carries both how many items came before it and the
    last explicit value with the item it stood on.
    """
    local = Window.partitionBy(*keys, "_block").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    placed = items.withColumn("_block", block).withColumn("_n", F.row_number().over(local))
    valued = F.when(F.col("value").isNotNull(), F.struct(F.col("value").alias("v"), F.col("_n").alias("n")))
    summary = (placed.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_count"), F.max_by(valued, F.when(F.col("value").isNotNull(), F.col("_n"))).alias("_last"))
               .withColumn("_off", F.coalesce(F.sum("_count").over(before), F.lit(0)))
               .withColumn("_anchor", F.last(F.col("_last.v") - F.col("_last.n") - F.col("_off"), ignorenulls=True).over(before))
               .select(*keys, "_block", "_off", "_anchor"))
    joined = placed.join(summary, [*keys, "_block"])
    own = F.last(F.when(F.col("value").isNotNull(), F.col("value") - F.col("_n") - F.col("_off")), ignorenulls=True).over(local)
    base = F.coalesce(own, F.col("_anchor"), F.lit(0))
    return joined.withColumn("number", base + F.col("_n") + F.col("_off")).drop("_block", "_n", "_off", "_anchor")


def to_records(lines: DataFrame, keys: Sequence[str], block: Column, order: Sequence[str]) -> DataFrame:
    """A marker line starts a record; lines before the first marker belong to none."""
    return running_total(lines, keys, block, order, F.when(F.col("is_marker"), 1).otherwise(0), "record").where("record > 0")


def erase(points: DataFrame, keys: Sequence[str], block: Column, order: Sequence[str]) -> DataFrame:
    """Strokes cut at erased points; a leftover of one point goes, an untouched stroke stays whole."""
    cut = F.when(F.col("erased"), 1).otherwise(0)
    islands = running_total(points, keys, block, order, cut, "island")
    touched = points.groupBy(*keys).agg(F.bool_or("erased").alias("touched"))
    first = F.struct(*order)
    pieces = (islands.where("NOT erased").groupBy(*keys, "island")
              .agg(F.count(F.lit(1)).alias("n_points"), F.min_by("x", first).alias("x_first"), F.max_by("x", first).alias("x_last")))
    return pieces.join(touched, [*keys]).where("NOT touched OR n_points > 1").drop("touched")


def surviving_points(points: DataFrame, keys: Sequence[str], block: Column, order: Sequence[str]) -> DataFrame:
    """The points of what :func:`erase` leaves, each with the ``island`` it belongs to.

    A point left alone goes: one with no neighbour that is left. A stroke of a
    single point that nothing touched stays. So no island is counted or joined.
    """
    islands = running_total(points, keys, block, order, F.when(F.col("erased"), 1).otherwise(0), "island")
    near = neighbours(islands, keys, block, order, F.col("erased"))
    alone = F.coalesce(F.col("before.v"), F.lit(True)) & F.coalesce(F.col("after.v"), F.lit(True)) & (F.col("before").isNotNull() | F.col("after").isNotNull())
    return near.where(~F.col("erased") & ~alone).drop("before", "after")


def flag_erased(points: DataFrame, nibs: DataFrame, radius: int, key: str = "page") -> DataFrame:
    """Mark points within ``radius`` of any nib; nibs visit the nine cells around them."""
    cell = lambda c: F.floor(F.col(c) / radius)
    near = nibs.select(key, F.col("x").alias("_nx"), F.col("y").alias("_ny")).distinct()
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    spread = (near.withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps))
              .select(key, (cell("_nx") + F.col("_dx")).alias("_cx"), (cell("_ny") + F.col("_dy")).alias("_cy"), "_nx", "_ny"))
    spots = points.select(key, "x", "y").distinct().withColumn("_cx", cell("x")).withColumn("_cy", cell("y"))
    dx, dy = F.col("x") - F.col("_nx"), F.col("y") - F.col("_ny")
    hit = (spots.join(spread, [key, "_cx", "_cy"]).where(dx * dx + dy * dy <= radius * radius)
           .select(key, "x", "y").distinct().withColumn("erased", F.lit(True)))
    return points.join(hit, [key, "x", "y"], "left").withColumn("erased", F.coalesce("erased", F.lit(False)))


def endpoints(points: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """A stroke reduced to its two ends."""
    at, xy = F.struct(*order), F.struct("x", "y")
    ends = points.groupBy(*keys).agg(F.min_by(xy, at).alias("a"), F.max_by(xy, at).alias("b"))
    return ends.select(*keys, F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"))


def kept_points(points: DataFrame, keys: Sequence[str], block: Column, order: Sequence[str]) -> DataFrame:
    """Points that differ from the last one kept, in order, so that a slow drift is kept step by step; with ``last``, the last of its path.

    Each block is read in order from the point before it, which is first taken
    to be the last point of the block before. Where the point kept there turns
    out to be another, that block alone is read again.
    """
    rows = points.select(*keys, block.alias("_block"), *order, "x", "y", "closed")
    at = F.struct(*_columns(order))
    along = Window.partitionBy(*keys).orderBy("_block")
    ends = rows.groupBy(*keys, "_block").agg(F.max_by(F.struct("x", "y"), at).alias("_end"))
    begun = cut_lineage(ends.select(*keys, "_block", F.lag("_end").over(along).alias("_in")))
    kinds = dict(rows.dtypes)
    names = [*keys, "_block", *order, "x", "y", "closed"]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for key, group in grouped(batches, [*keys, "_block"], [*order, "x", "y", "closed", "_in"]):
            last = None
            for *cells, x, y, closed, incoming in group:
                if closed is None and incoming is not None:
                    last = incoming["x"], incoming["y"]
                elif x is not None and y is not None and (last is None or abs(x - last[0]) >= SAME_POINT or abs(y - last[1]) >= SAME_POINT):
                    last = x, y
                    yield *key, *cells, x, y, closed

    def read(some: DataFrame, starts: DataFrame) -> DataFrame:
        ahead = starts.where("_in is not null").select(*keys, "_block", "_in")
        both = some.withColumn("closed", F.coalesce("closed", F.lit(False))).unionByName(ahead, allowMissingColumns=True)
        dealt = both.repartition(*keys, "_block").sortWithinPartitions(*keys, "_block", F.col("closed").isNotNull(), *order)
        return mapped(dealt.select(*names, "_in"), keep, schema)

    out = read(rows, begun)
    if begun.where("_in is not null").isEmpty():
        return _with_last(out, keys, order)
    out = cut_lineage(out)
    while True:
        kept = out.groupBy(*keys, "_block").agg(F.max_by(F.struct("x", "y"), at).alias("_kept"))
        before = along.rowsBetween(Window.unboundedPreceding, -1)
        known = begun.join(kept, [*keys, "_block"], "left").withColumn("_now", F.last("_kept", ignorenulls=True).over(before))
        known = cut_lineage(known.select(*keys, "_block", "_in", "_now"))
        wrong = known.where(~F.col("_in").eqNullSafe(F.col("_now"))).select(*keys, "_block", F.col("_now").alias("_in"))
        first = cut_lineage(wrong.withColumn("_n", F.row_number().over(along)).where("_n = 1").drop("_n"))  # those after it may yet turn out right
        if first.isEmpty():
            return _with_last(out, keys, order)
        again = read(rows.join(first.select(*keys, "_block"), [*keys, "_block"], "left_semi"), first)
        out = cut_lineage(out.join(first.select(*keys, "_block"), [*keys, "_block"], "left_anti").unionByName(again))
        begun = cut_lineage(begun.join(first.withColumnRenamed("_in", "_new"), [*keys, "_block"], "left").select(*keys, "_block", F.coalesce("_new", "_in").alias("_in")))


def _with_last(kept: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Without a closing point that repeats the first."""
    at, xy = F.struct(*_columns(order)), F.struct("x", "y")
    path = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min_by(xy, at).alias("_a"), F.max_by(F.struct(*order, "x", "y"), at).alias("_b"), F.bool_or("closed").alias("_c"))
    shut = F.col("_c") & (F.col("_n") > 1) & (F.abs(F.col("_a.x") - F.col("_b.x")) < SAME_POINT) & (F.abs(F.col("_a.y") - F.col("_b.y")) < SAME_POINT)
    goes = path.where(shut).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in order])
    return kept.drop("_block").join(goes, [*keys, *order], "left_anti")


def _columns(order: Sequence[str]) -> list[Column]:
    return [F.col(c) for c in order]


def simplify_paths(points: DataFrame, keys: Sequence[str], block: Column, order: Sequence[str]) -> DataFrame:
    """Drop repeated points (and a repeated closing point), then tell lines from polylines; ``kind`` is none below two points."""
    path = kept_points(points, keys, block, order).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_points"))
    n = F.col("n_points")
    return path.select(*keys, n, F.when(n < 2, "none").when(n == 2, "line").otherwise("polyline").alias("kind"))


class PageMap:
    """Where pages go: runs of old numbers with one shift each, or gone. Maps compose, so a stretch of edits is one."""

    FIRST = -(1 << 60)

    def __init__(self, starts=(FIRST,), shifts=(0,), gone=(False,)):
        self.starts, self.shifts, self.gone = np.array(starts, np.int64), np.array(shifts, np.int64), np.array(gone, bool)

    @classmethod
    def of(cls, op: str, at: int, to: int | None) -> PageMap:
        """One edit: delete ``at``, insert behind ``at``, or move ``at`` to ``to``."""
        if op == "delete":
            return cls((cls.FIRST, at, at + 1), (0, 0, -1), (False, True, False))
        if op == "insert":
            return cls((cls.FIRST, at + 1), (0, 1), (False, False))
        starts = [cls.FIRST, *sorted({at, at + 1, to, to + 1})]
        shifts = [to - at if x == at else (x > at) * -1 + (x - (x > at) >= to) for x in starts]
        return cls(starts, shifts, [False] * len(starts))

    def __call__(self, pages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.starts, pages, "right") - 1
        return pages + self.shifts[at], self.gone[at]

    def then(self, later: PageMap) -> PageMap:
        ends = np.append(self.starts[1:], 1 << 60)
        cuts = later.starts[1:, None] - self.shifts  # the old numbers that arrive where a later run starts
        starts = np.union1d(self.starts, cuts[(cuts > self.starts) & (cuts < ends) & ~self.gone])
        now, gone = self(starts)
        new, lost = later(now)
        out = PageMap(starts, new - starts, gone | lost)
        same = np.append(False, (out.gone[1:] & out.gone[:-1]) | (~out.gone[1:] & ~out.gone[:-1] & (out.shifts[1:] == out.shifts[:-1])))
        return PageMap(out.starts[~same], out.shifts[~same], out.gone[~same])


def remap_pages(marks: DataFrame, edits: DataFrame, doc: str = "doc", block: Column | None = None) -> DataFrame:
    """Follow page numbers through each document's deletes, inserts and moves.

    A mark on a deleted page goes with it. Edits are cut into blocks by number
    (``block``, never decreasing along ``seq``); each block is read in order into
    one map, many blocks of a document at a time. A document's distinct pages
    then pass its maps, one row a block, and come back to the marks by a join.
    """
    kind = dict(marks.dtypes)[doc]
    block = ordinal_block("seq", EDITS_A_BLOCK) if block is None else block

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for key, group in grouped(batches, [doc, "_block"], ["op", "at", "to"]):
            whole = PageMap()
            for op, at, to in group:
                if at is not None and not (to is None and op == "move"):
                    whole = whole.then(PageMap.of(op, at, to))
            yield *key, whole.starts.tolist(), whole.shifts.tolist(), whole.gone.tolist()

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (key,), group in grouped(batches, [doc], ["page", "starts", "shifts", "gone"]):
            old, now, lost = [], None, None
            for page, *one in group:
                if one[0] is None:
                    old.append(page)
                    continue
                if now is None:
                    now, lost = np.array(old, np.int64), np.zeros(len(old), bool)
                now, gone = PageMap(*one)(now)
                lost |= gone
            for k, page in enumerate(old):
                if now is None or not lost[k]:
                    yield key, page, page if now is None else int(now[k])

    dealt = edits.select(doc, block.alias("_block"), "seq", "op", "at", "to").repartition(doc, "_block").sortWithinPartitions(doc, "_block", "seq")
    made = mapped(dealt.drop("seq"), maps, f"`{doc}` {kind}, _block bigint, starts array<bigint>, shifts array<bigint>, gone array<boolean>")
    pages = marks.where("page IS NOT NULL").select(doc, F.col("page").cast("long").alias("page")).distinct()
    both = pages.unionByName(made, allowMissingColumns=True).repartition(doc).sortWithinPartitions(doc, F.asc_nulls_first("_block"))
    new = mapped(both.select(doc, "page", "starts", "shifts", "gone"), follow, f"`{doc}` {kind}, page bigint, _new bigint")
    return marks.join(new, [doc, "page"]).drop("page").withColumnRenamed("_new", "page")


def column_stops(cells: DataFrame, char: int, room: int) -> DataFrame:
    """Tab stops of each table: widest cell per column, squeezed to the page, running total."""
    widths = cells.groupBy("tbl", "col").agg(F.max(char * F.length("text") + CELL_PAD).alias("width"))
    table = Window.partitionBy("tbl")
    total = F.sum("width").over(table)
    along = table.orderBy("col").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    squeeze = F.when(F.col("_total") > room, room / F.col("_total")).otherwise(1.0)
    return (widths.withColumn("_total", total).withColumn("_at", F.sum("width").over(along))
            .withColumn("_last", F.max("col").over(table)).where(F.col("col") < F.col("_last"))
            .select("tbl", "col", "width", (F.col("_at") * squeeze).alias("stop")))


def quantise(channel: Column, alpha: Column) -> Column:
    """A channel composited on white and snapped to the palette's levels."""
    flat = F.floor(channel * alpha + 255 * (1 - alpha) + 0.5)
    return F.floor(flat * (PALETTE_LEVELS - 1) / 255 + 0.5) * (255 // (PALETTE_LEVELS - 1))


def palette(pixels: DataFrame) -> DataFrame:
    """The most common quantised colours: a background and the next forty-seven.

    The histogram has at most levels³ rows, so the final ordering is tiny.
    """
    r, g, b = (quantise(F.col(c), F.col("alpha")) for c in ("r", "g", "b"))
    bins = pixels.select((r * 65536 + g * 256 + b).cast("long").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return (bins.orderBy(F.desc("n"), "key").limit(PALETTE_SIZE)
            .select(F.concat(F.lit("#"), F.lower(F.lpad(F.hex("key"), 6, "0"))).alias("colour"), "n"))


def consensus(samples: DataFrame, key: str) -> DataFrame:
    """One colour from a handful of probes; white when they disagree."""
    mids = samples.groupBy(key).agg(*[lower_median(c).cast("long").alias(f"m_{c}") for c in ("r", "g", "b")])
    off = F.greatest(*[F.abs(F.col(c) - F.col(f"m_{c}")) for c in ("r", "g", "b")])
    spread = samples.join(mids, key).groupBy(key, "m_r", "m_g", "m_b").agg(F.max(off).alias("spread"))
    hexed = F.concat(F.lit("#"), *[F.lower(F.lpad(F.hex(F.col(f"m_{c}")), 2, "0")) for c in ("r", "g", "b")])
    return spread.select(key, F.when(F.col("spread") > UNIFORM_SPREAD, "#ffffff").otherwise(hexed).alias("colour"))
