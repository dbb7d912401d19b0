"""Steps that read sorted rows one by one, a batch in memory at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str], columns: list[str]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Rows that come sorted by keys, group by group, a batch in memory at a time."""
    rows = (row for b in batches for row in zip(*[b.column(c).to_pylist() for c in (*keys, *columns)], strict=True))
    held = next(rows, None)
    k = len(keys)

    def of(key: tuple) -> Iterator[tuple]:
        nonlocal held
        while held is not None and held[:k] == key:
            yield held[k:]
            held = next(rows, None)

    while held is not None:
        key = held[:k]
        yield key, (group := of(key))
        for _ in group:
            pass


def _batched(rows: Iterator[tuple], schema: pa.Schema, most: int = 4096) -> Iterator[pa.RecordBatch]:
    part: list[tuple] = []
    for row in rows:
        part.append(row)
        if len(part) == most:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in part], schema)
            part = []
    if part:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in part], schema)


def mapped(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]], columns: str) -> DataFrame:
    """``fn`` from an iterator of batches to rows, as a step over partitions."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(columns)
    arrow = to_arrow_schema(schema)
    return df.mapInArrow(lambda batches: _batched(fn(batches), arrow), schema)


def in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str], ordered: bool) -> DataFrame:
    """Rows of a key one after the other in one partition; ``ordered`` if they already are, as they come out of a text."""
    return df if ordered else df.repartition(*keys).sortWithinPartitions(*keys, *order)


def changes(t: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Whether each row but the first has other keys than the row before it (nulls are alike)."""
    out = np.zeros(max(t.num_rows - 1, 0), dtype=bool)
    for key in keys:
        c = t[key].combine_chunks()
        now, before = c.slice(1), c.slice(0, max(t.num_rows - 1, 0))
        out |= pc.fill_null(pc.not_equal(now, before), False).to_numpy(zero_copy_only=False)
        if c.null_count:
            out |= pc.xor(pc.is_null(now), pc.is_null(before)).to_numpy(zero_copy_only=False)
    return out


def islands(items: DataFrame, keys: Sequence[str], order: Sequence[str], number: str, first: int = 0, opens: Column | None = None,
            closes: Column | None = None, text: str = "text", ordered: bool = False) -> DataFrame:
    """Rows of a key joined to longer texts, numbered from ``first``: a new one at a row that ``opens``, or after one that ``closes``.

    A batch at a time; the last island of a batch waits for the next, so memory
    is that of a batch and of the longest island.
    """
    flags = [F.coalesce(F.lit(False) if c is None else c, F.lit(False)).alias(name) for c, name in ((opens, "_opens"), (closes, "_closes"))]
    marked = in_order(items, keys, order, ordered).select(*keys, text, *flags)
    kinds = {f.name: f.dataType.simpleString() for f in items.schema.fields}

    def joined(t: pa.Table, starts: np.ndarray, numbers: np.ndarray) -> pa.RecordBatch:
        words, at = t[text].combine_chunks(), pa.array(starts)
        bounds = pa.array(np.append(starts, t.num_rows), pa.int32())
        out = pc.binary_join(pa.ListArray.from_arrays(bounds, words.fill_null("")), "")
        if words.null_count:  # a text of nulls alone is null
            out = pc.if_else(pa.array(np.add.reduceat(words.is_valid().to_numpy(zero_copy_only=False).astype("int64"), starts) > 0), out, None)
        return pa.RecordBatch.from_pydict({**{k: t[k].take(at).combine_chunks() for k in keys}, number: numbers, text: out})

    def joined_islands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, base = None, first
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            if not t.num_rows:
                continue
            opening, closing = (t[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("_opens", "_closes"))
            other = np.concatenate([[True], changes(t, keys)])
            starts = np.flatnonzero(other | opening | np.concatenate([[False], closing[:-1]]))
            groups = np.flatnonzero(other[starts])
            numbers = np.arange(len(starts)) - np.repeat(groups, np.diff(np.append(groups, len(starts)))) + np.where(
                np.arange(len(starts)) < (groups[1] if len(groups) > 1 else len(starts)), base, first)
            last = starts[-1]
            if last:
                yield joined(t.slice(0, last), starts[:-1], numbers[:-1])
            rest, base = t.slice(last), int(numbers[-1])
        if rest is not None:
            yield joined(rest, np.zeros(1, dtype=np.int64), np.array([base]))

    return marked.mapInArrow(
        joined_islands, ", ".join(f"{k} {kinds[k]}" for k in keys) + f", {number} long, {text} string")
