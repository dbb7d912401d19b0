"""Order-dependent scans that survive hot keys.

A plain window sends every row of a key to one task. Where a key can be
arbitrarily large (a user's events, a conversation's turns) these helpers cut
it into blocks along the order, scan each block on its own, and carry one
summary row per block across the key. ``block`` must be a deterministic column
that never decreases along ``order``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

_BLOCK = "_block"


def _cols(order: Sequence[str]) -> list[Column]:
    return [F.col(c) for c in order]


def _joined(df: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(summary, [*keys, _BLOCK], "left")


def running_total(df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[str],
                  value: Column, out: str) -> DataFrame:
    """Inclusive running sum of ``value`` within ``keys`` along ``order``."""
    df = df.withColumn(_BLOCK, block).withColumn("_value", value.cast("long"))
    before = Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    local = (Window.partitionBy(*keys, _BLOCK).orderBy(*_cols(order))
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    offsets = (df.groupBy(*keys, _BLOCK).agg(F.sum("_value").alias("_t"))
               .select(*keys, _BLOCK, F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off")))
    return (_joined(df, offsets, keys)
            .withColumn(out, F.sum("_value").over(local) + F.col("_off"))
            .drop(_BLOCK, "_value", "_off"))


def carry_forward(df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[str],
                  value: Column, out: str, inclusive: bool = True) -> DataFrame:
    """Latest non-null ``value`` at (or strictly before) each row."""
    df = df.withColumn(_BLOCK, block).withColumn("_value", value)
    before = Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    local = (Window.partitionBy(*keys, _BLOCK).orderBy(*_cols(order))
             .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    stamp = F.when(F.col("_value").isNotNull(), F.struct(*_cols(order)))
    carried = (df.groupBy(*keys, _BLOCK).agg(F.max_by("_value", stamp).alias("_t"))
               .select(*keys, _BLOCK, F.last("_t", ignorenulls=True).over(before).alias("_off")))
    return (_joined(df, carried, keys)
            .withColumn(out, F.coalesce(F.last("_value", ignorenulls=True).over(local), F.col("_off")))
            .drop(_BLOCK, "_value", "_off"))


def previous(df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[str],
             fields: Sequence[str], out: str) -> DataFrame:
    """The previous row's ``fields`` as a struct (null on the first row of a key)."""
    return carry_forward(df, keys, block, order, F.struct(*fields), out, inclusive=False)


def neighbours(df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[str], value: Column) -> DataFrame:
    """Add ``before`` and ``after``: struct<v> of ``value`` on the row before and after along ``order``, null at the ends."""
    df = df.withColumn(_BLOCK, block).withColumn("_value", F.struct(value.alias("v")))
    local, along, at = Window.partitionBy(*keys, _BLOCK).orderBy(*_cols(order)), Window.partitionBy(*keys).orderBy(_BLOCK), F.struct(*_cols(order))
    ends = df.groupBy(*keys, _BLOCK).agg(F.min_by("_value", at).alias("_a"), F.max_by("_value", at).alias("_z"))
    ends = ends.select(*keys, _BLOCK, F.lag("_z").over(along).alias("_in"), F.lead("_a").over(along).alias("_out"))
    rows = _joined(df.withColumns({"before": F.lag("_value").over(local), "after": F.lead("_value").over(local)}), ends, keys)
    return rows.withColumns({"before": F.coalesce("before", "_in"), "after": F.coalesce("after", "_out")}).drop(_BLOCK, "_value", "_in", "_out")


def hour_block(ts: str = "ts") -> Column:
    """A block column for timestamped logs: hours since the epoch."""
    return F.floor(F.unix_timestamp(F.col(ts)) / 3600).cast("long")


def measured_blocks(log: DataFrame, keys: Sequence[str], target: int = 1 << 20, cuts: int = 1023, ts: str = "ts") -> DataFrame:
    """Add ``block``: a whole key, its hours where it holds more than ``target`` rows, and parts of hours that do.

    Rows are counted per key and hour first, with map-side combine. Where no key
    holds more than ``target`` rows each is one block and the log stays as it
    was. Otherwise the keys that do are cut into hours, and hours above the
    target at up to ``cuts`` quantiles of their own time stamps, so a user with
    very many events in one hour is many blocks. Rows of one microsecond stay
    together.
    """
    hour, micros = hour_block(ts).alias("_hour"), F.unix_micros(F.col(ts).cast("timestamp"))
    counts = log.groupBy(*keys, hour).agg(F.count(F.lit(1)).alias("_n"))
    large = counts.groupBy(*keys).agg(F.sum("_n").alias("_n")).where(F.col("_n") > target).select(*keys, F.lit(True).alias("_large"))
    if large.isEmpty():
        return log.withColumn("block", F.lit(0).cast("long"))
    large, log = cut_lineage(large), log.withColumn("_hour", hour)
    crowded = counts.where(F.col("_n") > target)
    places = F.percentile_approx(F.col("_m"), F.array(*[F.lit(i / (cuts + 1)) for i in range(1, cuts + 1)]), F.lit(100_000))
    rows = log.select(*keys, "_hour", micros.alias("_m")).join(crowded, [*keys, "_hour"])
    seams = rows.groupBy(*keys, "_hour").agg(places.alias("_all"), F.ceil(F.count(F.lit(1)) / F.lit(target)).alias("_k"))
    step = F.greatest(F.floor(F.lit(cuts + 1) / F.col("_k")), F.lit(1))
    seams = cut_lineage(seams.select(*keys, "_hour", F.array_distinct(F.filter("_all", lambda x, i: (i + 1) % step == 0)).alias("_seams")))
    inside = F.coalesce(F.size(F.filter("_seams", lambda x: x <= micros)), F.lit(0))
    met = log.join(large, [*keys], "left").join(seams, [*keys, "_hour"], "left")
    return met.withColumn("block", F.when(F.col("_large"), F.col("_hour") * (cuts + 1) + F.greatest(inside, F.lit(0))).otherwise(0)).drop("_hour", "_seams", "_large")


def ordinal_block(seq: str, size: int = 65536) -> Column:
    return F.floor(F.col(seq) / size).cast("long")
