"""Parquet scans of the corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One corpus table; columns and filters prune at the scan."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def table_counts(spark: SparkSession, folder: str, names: tuple[str, ...] = TABLES) -> DataFrame:
    """Rows per table; every count is answered from a column-free scan."""
    counts = [load(spark, folder, n).agg(F.count(F.lit(1)).alias("n_rows"))
              .select(F.lit(n).alias("table_name"), "n_rows") for n in names]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out
