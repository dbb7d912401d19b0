"""Find text inside runs."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ── fixed values ────────────────────────────────────────────────────────────
MIN_HIT = 20  # two points, in tenths
# ────────────────────────────────────────────────────────────────────────────


def _places(needles: list[str], keys: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of lower-cased texts to a row per text and query found in it, with the places of its hits.

    The texts of a batch are searched as one, with a character between them that no query holds.
    """
    between = next(c for c in map(chr, range(0x10FFFF)) if not any(c in q for q in needles))
    patterns = [(q, re.compile(re.escape(q))) for q in needles]  # a query given twice counts twice

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["_lower"]
            starts = np.cumsum(np.append(0, pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype("int64") + 1))[:-1]
            whole = between.join(texts.to_pylist())
            for q, pattern in patterns:
                at = np.fromiter((m.start() for m in pattern.finditer(whole)), dtype=np.int64)
                if not len(at):
                    continue
                text = np.searchsorted(starts, at, side="right") - 1
                first = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
                bounds = pa.array(np.append(first, len(at)), pa.int32())
                columns = {k: batch[k].take(pa.array(text[first])) for k in keys}
                yield pa.RecordBatch.from_pydict({**columns, "q": pa.array([q] * len(first)), "pos": pa.ListArray.from_arrays(bounds, pa.array(at - starts[text]))})

    return places


def find(runs: DataFrame, queries: list[str]) -> DataFrame:
    """Case-insensitive, non-overlapping hits inside single runs.

    The box is the query's share of the run's width. A phrase crossing two runs
    is not found. The query list is a literal, so the scan stays narrow: no
    join, no shuffle. Only runs that hold a query are searched for its places,
    a batch at a time and each in time linear in its text and hits.
    """
    needles = [q for q in (q.strip().lower() for q in queries) if q]
    keys = ["doc_id", "page_no", "row_no", "run_no", "x", "_unit"]
    unit = F.col("w") / F.greatest(F.lit(1), F.length("text"))
    asked = runs.withColumn("_lower", F.lower("text")).where(reduce(or_, (F.col("_lower").contains(q) for q in needles), F.lit(False)))
    asked = asked.select(*keys[:-1], unit.alias("_unit"), "_lower")
    kinds = {f.name: f.dataType.simpleString() for f in asked.schema.fields}
    found = asked.mapInArrow(_places(needles, keys), ", ".join(f"{k} {kinds[k]}" for k in keys) + ", q string, pos array<bigint>")
    hits = found.select(*keys, "q", F.explode("pos").alias("pos"))
    unit = F.col("_unit")
    return hits.select("doc_id", "page_no", "row_no", "run_no", "q", "pos",
                       (F.col("x") + unit * F.col("pos")).alias("x"), F.greatest(unit * F.length("q"), F.lit(float(MIN_HIT))).alias("w"))


def hit_pages(hits: DataFrame) -> DataFrame:
    """Hits per page and query, and where the first one is."""
    # one number, so that the first hit is kept in a hash table; a struct would have all hits sorted
    step = F.lit(10**10).cast("decimal(11,0)")
    place = ((F.col("row_no").cast("decimal(10,0)") * step + F.col("run_no")).cast("decimal(20,0)") * step + F.col("pos")).cast("decimal(38,0)")
    return hits.groupBy("doc_id", "page_no", "q").agg(
        F.count(F.lit(1)).alias("n"), F.min("row_no").alias("first_row"), F.min_by("x", place).alias("first_x"))
