"""Contiguous balanced shards from global byte-size prefix sums.

Rows are dealt into ranges of consecutive keys, each range is totalled, and the
totals are summed up in order of the ranges (one small row each). With its
range's offset every row knows the bytes before it in the whole table, from a
running sum inside its range. The bytes are cut at equal targets: a row goes to
the shard that holds its middle. Shards are contiguous in key order and differ
from the target by less than a row at either end.

Null text counts as no bytes (size 1); a null key comes first; rows with one key
are ordered by the text's checksum and then by place in the input. An empty
table has no shards. Columns other than the two named are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def shard(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, size, text_crc32, shard (0 to shards - 1) and slot, the place in the shard from 0."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("k"), (F.octet_length(whole) + 1).cast("bigint").alias("size"), F.crc32(whole.cast("binary")).alias("crc"), F.monotonically_increasing_id().alias("place"))
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut_lineage(rows.repartitionByRange(ranges, "k", "crc", "place").withColumn("part", F.spark_partition_id()))
    totals = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("rows_before"),
                            F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"))
    inside = Window.partitionBy("part").orderBy("k", "crc", "place")
    upto = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    summed = dealt.withColumn("upto", upto).withColumn("nth", F.row_number().over(inside)).join(offsets, "part")
    number = F.least(F.lit(shards - 1), F.expr(f"(2 * (bytes_before + upto) - size) * {shards} div (2 * all_bytes)")).cast("int")
    placed = cut_lineage(summed.select("k", "size", "crc", number.alias("shard"), (F.col("rows_before") + F.col("nth")).alias("nth")))
    first = placed.groupBy("shard").agg(F.min("nth").alias("first"))
    return placed.join(first, "shard").select(F.col("k").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("nth") - F.col("first")).alias("slot"))
