"""Ordered, inherited, nested and interval lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def natural_number(name: Column, pattern: str) -> Column:
    """The number inside a part name; null when the name is not a part."""
    return F.regexp_extract(name, pattern, 1).try_cast("long")


def natural_order(parts: DataFrame, name: str, pattern: str) -> DataFrame:
    """Parts in numeric order; names that do not match are not parts."""
    return parts.withColumn("n", natural_number(F.col(name), pattern)).where("n IS NOT NULL").orderBy("n", name)


def title_first(pieces: DataFrame, keys: list[str], order: str) -> DataFrame:
    """A sort key putting titles ahead of everything else, otherwise stable."""
    return pieces.withColumn("sort_key", F.when(F.col("is_title"), 0).otherwise(1).cast("long")).orderBy(*keys, "sort_key", order)


def resolve_order(listed: DataFrame, relations: DataFrame, parts: DataFrame, pattern: str) -> DataFrame:
    """List entries resolved to parts, then unlisted parts in numeric order.

    ``listed``: doc, pos, rel. ``relations``: doc, rel, target. ``parts``: doc,
    target. The order is carried as (tier, n), so no document is ranked whole.
    """
    resolved = (listed.join(relations, ["doc", "rel"]).join(parts, ["doc", "target"], "left_semi")
                .select("doc", "target", F.lit(0).cast("long").alias("tier"), F.col("pos").alias("n")))
    rest = (parts.join(resolved.select("doc", "target"), ["doc", "target"], "left_anti")
            .select("doc", "target", F.lit(1).cast("long").alias("tier"), natural_number(F.col("target"), pattern).alias("n"))
            .where("n IS NOT NULL"))
    return resolved.unionByName(rest)


def resolve_styles(styles: DataFrame, properties: list[str], defaults: dict) -> DataFrame:
    """Each style with everything it inherits: the nearest definition wins.

    Pointer doubling: after r rounds a style has read 2**r ancestors, so a long
    chain needs few joins and a cycle is harmless. A round that fills nothing
    is the last: a value still out of reach would pass through some style at
    exactly this round's distance from it.
    """
    state = cut_lineage(styles.select("id", "parent", *properties))
    while True:
        above = state.select(F.col("id").alias("parent"), F.col("parent").alias("_next"), *[F.col(p).alias(f"_{p}") for p in properties])
        filled = F.lit(False)
        for p in properties:
            filled = filled | (F.col(p).isNull() & F.col(f"_{p}").isNotNull())
        # a style that has read its whole chain has no parent left; all those would meet in one partition of the join
        read = state.where("parent IS NULL").withColumn("_filled", F.lit(False))
        met = state.where("parent IS NOT NULL").join(above, "parent", "left").select(
            "id", F.col("_next").alias("parent"), *[F.coalesce(p, f"_{p}").alias(p) for p in properties], filled.alias("_filled"))
        state = cut_lineage(met.unionByName(read))
        if state.where("_filled").isEmpty():
            break
        state = state.drop("_filled")
    return state.select("id", *[F.coalesce(p, F.lit(defaults[p])).alias(p) for p in properties])


#: Copies are counted up to here; beyond, the count stays and is flagged.
MOST_COPIES = 10**36


def _on_cycles(edges: DataFrame) -> DataFrame:
    """The blocks left when those that nothing is inside of, or that are inside of nothing, are taken away again and again.

    Blocks on cycles are among them, and those between two cycles; none if there
    is no cycle. Two rounds a job.
    """
    left = cut_lineage(edges.select("block", "child").distinct())
    n = left.count()
    while n:
        for _ in range(2):
            left = left.join(left.select(F.col("child").alias("block")).distinct(), "block", "left_semi").join(left.select(F.col("block").alias("child")).distinct(), "child", "left_semi")
        left = cut_lineage(left)
        n, before = left.count(), n
        if n == before:
            break
    return left.select("block").distinct()


def expand_blocks(inserts: DataFrame, root: int, levels: int = 4, most_copies: int | None = None) -> DataFrame:
    """Every block reached from ``root`` and how many copies of it are drawn: (block, status, copies, depth, saturated).

    One join per nesting level over the frontier alone, ``levels`` of them per
    job. An insert that would put a block inside itself is cut; one arrayed
    more than ``most_copies`` times (default: no limit) is flagged ``refused``,
    and what is in it still counted. Only blocks that may lie on a cycle are
    remembered on the way down, so a block that many others share is one row a
    level, however many paths lead to it. ``copies`` is a decimal of 38 digits
    that stays at MOST_COPIES, ``saturated``, rather than overflow.
    """
    wide = "decimal(38,0)"
    full = F.lit(str(MOST_COPIES)).cast(wide)

    def bounded(c: Column) -> Column:
        return F.least(F.coalesce(c, full), full)

    per = bounded(F.try_multiply(F.col("cols").cast(wide), F.col("rows").cast(wide)).cast(wide))
    edges = inserts.where("block <> child").select("block", "child", per.alias("per"))
    marked = _on_cycles(edges).select(F.col("block").alias("child"), F.lit(True).alias("looped"))
    edges = cut_lineage(edges.join(marked, "child", "left").withColumn("looped", F.coalesce("looped", F.lit(False))))
    start = edges.where((F.col("child") == root) & F.col("looped")).limit(1).count() > 0

    def descend(frontier: DataFrame) -> DataFrame:
        met = frontier.join(edges, "block").where(~F.array_contains("path", F.col("child")))
        path = F.when(F.col("looped"), F.array_sort(F.concat("path", F.array("child")))).otherwise(F.col("path"))
        status = F.lit("ok") if most_copies is None else F.when(F.col("per") > most_copies, "refused").otherwise("ok")
        one = met.select(F.col("child").alias("block"), bounded(F.try_multiply("n", "per").cast(wide)).alias("n"), path.alias("path"), (F.col("depth") + 1).alias("depth"), status.alias("status"))
        return one.groupBy("block", "path", "depth", "status").agg(bounded(F.try_sum("n").cast(wide)).alias("n"))

    frontier = inserts.sparkSession.range(1).select(
        F.lit(root).cast("long").alias("block"), F.array(*([F.lit(root).cast("long")] if start else [])).cast("array<bigint>").alias("path"),
        F.lit(0).cast("long").alias("depth"), F.lit("ok").alias("status"), F.lit(1).cast(wide).alias("n"))
    out, depth = frontier, 0
    while True:
        steps = [descend(frontier)]
        for _ in range(levels - 1):
            steps.append(descend(steps[-1]))
        step = steps[0]
        for s in steps[1:]:
            step = step.unionByName(s)
        step = cut_lineage(step)
        out, depth = out.unionByName(step), depth + levels
        frontier = step.where(F.col("depth") == depth)
        if frontier.isEmpty():
            break
    total = out.groupBy("block", "status").agg(bounded(F.try_sum("n").cast(wide)).alias("copies"), F.min("depth").alias("depth"))
    return total.withColumn("saturated", F.col("copies") >= full)


def props_at(positions: DataFrame, ranges: DataFrame, width: int = 512) -> DataFrame:
    """The first ``[from, to)`` range holding each position; null where none does.

    Ranges are listed under every stretch of ``width`` they touch, which turns
    the range test into an equality and spreads a long document over tasks.
    """
    last = F.greatest(F.col("to") - 1, F.col("from"))
    spread = (ranges.where(F.col("to") > F.col("from"))
              .withColumn("_bin", F.explode(F.sequence(F.floor(F.col("from") / width), F.floor(last / width)))))
    spots = positions.select("doc", "pos").distinct().withColumn("_bin", F.floor(F.col("pos") / width))
    found = (spots.join(spread, ["doc", "_bin"]).where((F.col("pos") >= F.col("from")) & (F.col("pos") < F.col("to")))
             .groupBy("doc", "pos").agg(F.min_by("prop", "seq").alias("prop")))
    return positions.join(found, ["doc", "pos"], "left")


def cell_props(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """A cell's own border, or its table's."""
    return cells.join(tables.select("tbl", F.col("border").alias("_border")), "tbl", "left").withColumn(
        "border", F.coalesce("border", "_border")).drop("_border")


def mirror_values(boxes: DataFrame, values: DataFrame) -> DataFrame:
    """One value fans out to every box of its field name."""
    return boxes.join(values.select("doc", "name", "value", "on"), ["doc", "name"])
