"""File inventory: path, size and what the first bytes say."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.guards import sniff

HEAD_BYTES = 32


def _read_heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    def head(path: str) -> bytes | None:
        uri = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file:///") else path
        try:
            where, inner = fs.FileSystem.from_uri(uri)
            with where.open_input_stream(inner) as f:
                return f.read(HEAD_BYTES)
        except OSError:
            return None

    for pdf in batches:
        yield pdf.assign(head=[head(p) for p in pdf["path"]])


def scan_files(spark: SparkSession, glob: str) -> DataFrame:
    """List files and read only their first bytes; an empty file counts as absent.

    The listing prunes the content column, so no file is read whole.
    """
    listing = spark.read.format("binaryFile").load(glob).select("path", "length").where("length > 0")
    heads = listing.mapInPandas(_read_heads, "path string, length long, head binary")
    return heads.withColumn("kind", sniff("head"))
