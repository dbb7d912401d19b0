"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets. Sources in code point order, null last, get the weights 3, 1, 2 in
turn and share ``share`` times all words. A target stops at ``most`` times its
source's words and the excess is shared out again by weight. The fixed point is
found at once: in order of cap / weight, a source is capped as long as the level
that the words left over would give exceeds its own ratio.

Selection. A source is first taken whole as often as its target holds it
(epochs). For the rest its documents are ordered by the exponential key
-ln(u) / w, where u comes from a digest of seed and key, and w is the quality
weight; documents are taken in this order up to the words still missing, the
last one if its middle lies within them. So reruns agree.

Prefix sums. Keys fall into ``BUCKETS`` ranges; words are summed per (source,
range) with map-side combine, and only the one range per source where the budget
ends is sorted. No task sees a source as a whole.

Null text counts 0 words, a null source is a source of its own. Rows with a null
key are drawn by a digest of their text. Rows of one key are ordered by words; of
rows that agree in key and words, and of repeated rows, all are taken or none. An
empty table gives an empty mix. Columns may have any name: only those named are
read, and ``mixed_rows`` carries the row as one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

WEIGHTS = (3, 1, 2)
BUCKETS = 4096


def word_count(text: Column) -> Column:
    """Runs of anything but the six ASCII blanks; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def sampling_key(key: Column, weight: Column, seed: str) -> Column:
    """-ln(u) / weight, u uniform in (0, 1) from 52 bits of a digest."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / float(1 << 52)) / weight


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Per source (source, source_size): its target, the whole epochs in it and the words beyond them. One row a source."""
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    every = Window.partitionBy()
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size"))
    order = Window.orderBy((F.col("cap") / F.col("weight")), F.asc_nulls_last("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("level", (F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    rows = rows.withColumn("capped", F.col("level") * F.col("weight") >= F.col("cap"))
    rows = rows.withColumn("nth", F.row_number().over(order))
    level = F.min_by("level", F.when(~F.col("capped"), F.col("nth"))).over(every)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(level * F.col("weight"))
    rows = rows.withColumn("target", target)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    return rows.select("source", "source_size", "target", epochs.alias("epochs"), (F.col("target") - epochs * F.col("source_size")).alias("rest"))


def _drawn(docs: DataFrame, quality: DataFrame | None, seed: str, key: Column, text: Column, source: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, source, size, key, bucket and s (the source as a key of joins), with the columns ``keep``."""
    draw = F.coalesce(key.cast("string"), F.concat(F.lit("text/"), F.sha2(text, 256)))
    rows = docs.select(*keep, key.alias("id"), source.cast("string").alias("source"), word_count(text).alias("size"), draw.alias("draw"))
    if quality is None:
        rows = rows.withColumn("w", F.lit(1.0))
    else:
        known = quality.select(F.col("doc_id").alias("id"), F.col("weight").cast("double").alias("w"))
        named = rows.where("id is not null").join(known, "id", "left").withColumn("w", F.coalesce(F.when(F.col("w") > 0, F.col("w")), F.lit(1.0)))
        rows = named.unionByName(rows.where("id is null").withColumn("w", F.lit(1.0)))  # one key of a join otherwise
    drawn = rows.withColumn("key", sampling_key(F.col("draw"), F.col("w"), seed))
    bucket = F.least(F.floor((1 - F.exp(-F.col("key"))) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
    return drawn.select(*keep, "id", "source", "size", "key", bucket.alias("bucket"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("s"))


def _plan(drawn: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Per source (s): source_size, target, epochs, the range where its budget ends, and the last row taken there."""
    sums = cut_lineage(drawn.groupBy("s", "source", "bucket").agg(F.sum("size").alias("words")))
    goals = targets(sums.groupBy("source", "s").agg(F.sum("words").alias("source_size")), weights, share, most).withColumn("s", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    goals = cut_lineage(goals)
    so_far = F.sum("words").over(Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("words")
    last = sums.withColumn("before", so_far).join(goals.select("s", "rest"), "s").where("before <= rest and rest < before + words").select("s", "bucket", "before", "rest")
    edge = drawn.join(last, ["s", "bucket"])
    upto = F.sum("size").over(Window.partitionBy("s").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    fits = edge.withColumn("upto", F.col("before") + upto).where("2 * upto - size <= 2 * rest")
    cut = fits.groupBy("s").agg(F.max(F.struct("key", "id", "size")).alias("cut"))
    return cut_lineage(goals.select("s", "source_size", "target", "epochs").join(last.select("s", F.col("bucket").alias("edge")), "s", "left").join(cut, "s", "left"))


def _taken(drawn: DataFrame, plan: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    chosen = F.coalesce((F.col("bucket") < F.col("edge")) | ((F.col("bucket") == F.col("edge")) & (F.struct("key", "id", "size") <= F.col("cut"))), F.lit(False))
    copies = F.col("epochs") + chosen.cast("bigint")
    return drawn.join(plan, "s").select(*keep, "id", "source", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def mix(docs: DataFrame, quality: DataFrame | None = None, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5,
        most: float = 2.0, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per row: id, source, size, source_size, target and ``taken``, the words that the mix takes of it.

    ``quality`` holds (doc_id, weight), one row a document; others weigh 1.
    """
    drawn = cut_lineage(_drawn(docs, quality, seed, F.col(key), F.col(text), F.col(source)))
    return _taken(drawn, _plan(drawn, weights, share, most))


def mixed_rows(docs: DataFrame, quality: DataFrame | None, row: str, key: Column, text: Column, source: Column, seed: str = "mix",
               weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The column ``row`` of each row, and how often (``copies``) the mix takes that row; decided row by row, not by key."""
    plan = _plan(cut_lineage(_drawn(docs, quality, seed, key, text, source)), weights, share, most)
    return _taken(_drawn(docs, quality, seed, key, text, source, (row,)), plan, (row,)).select(row, "copies")
