"""Integer vectors from float columns, and their way into NumPy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest size of an integer component. A hundred times the product of two vectors of up to 2,048 components then fits 64 bits.
LARGEST = 1 << 22


def usable(vector: Column, scale: int) -> Column:
    """True where a vector is there and all its components are finite, and at most LARGEST once scaled."""
    return F.coalesce(F.forall(vector, lambda x: F.abs(x.cast("double") * scale) <= LARGEST), F.lit(False))


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, computed in double precision."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("int"))


def widest(rows: DataFrame, vector: str = "q") -> int:
    """Components of the longest vector."""
    return rows.agg(F.max(F.size(vector))).first()[0] or 0


def matrix(column: pa.Array, width: int, kind: type = np.int64) -> np.ndarray:
    """A list column as rows of ``width`` numbers; shorter lists are filled up with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(column), width).astype(kind)
    out = np.zeros((len(column), width), kind)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Rows of a matrix as a list column."""
    offsets = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32) if rows.size else np.zeros(len(rows) + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.reshape(-1), type=kind))
