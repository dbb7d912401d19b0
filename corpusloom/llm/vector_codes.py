"""Vectors as short codes: a product quantiser in exact integers, assigned by LAESA.

Vectors are cut into equal parts, each with a codebook of its own. LAESA keeps a
few fixed pivots per part. Distances from every part to its pivots are computed
once and written beside the vector; a round then needs only the distances
between pivots and the codebook's entries. By the triangle inequality the
difference of both is a lower bound of the distance from part to entry. Entries
are taken in the order of their bounds, evaluated exactly in integers, and left
out once the bound exceeds the best distance found. Bounds carry a margin for
rounding, so the result equals a full search, ties to the lower index included.

Codebooks (parts x entries) are the only state on the driver; their size is
fixed by ``Codes`` and the width of a vector. Each task sends one sum per entry,
which Spark adds up. Nothing is grouped by document or label on the way, so no
key is hot; the sums per label are joined back by a broadcast where there are at
most MOST_LABELS of them, and by an ordinary join beyond.

Null vectors, and those with a component that is null, not finite or beyond
``vectors.LARGEST`` once scaled, are left out. A vector shorter than the longest
one, or than a multiple of the parts, is filled up with zeros. Repeated rows
count as often as they come. Rows without id come last where ids are compared;
rows of equal id are ordered by their components. With fewer rows than entries
the codebooks are shorter. An empty table gives an empty result. Only the three
columns named are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .vectors import integers, lists, matrix, usable, widest

#: Sums of more labels than this are joined rather than broadcast; a sum takes some 30 bytes.
MOST_LABELS = 1 << 16
#: Rows that a worker looks at together.
ROWS = 4096


@dataclass(frozen=True)
class Codes:
    parts: int = 16
    entries: int = 64
    rounds: int = 2
    pivots: int = 4
    scale: int = 256


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances between the rows of both, as integers."""
    return ((a[:, None, :] - b[None, :, :]) ** 2).sum(2)


def spread(entries: np.ndarray, most: int) -> np.ndarray:
    """Pivots out of the entries: the first, then each time the one farthest from those taken."""
    taken, away = [0], squares(entries, entries[:1])[:, 0]
    while len(taken) < most and away.max() > 0:
        taken.append(int(away.argmax()))
        away = np.minimum(away, squares(entries, entries[taken[-1:]])[:, 0])
    return entries[taken]


def nearest(x: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of x: index of the nearest entry, squared distance, and number of distances evaluated.

    to_pivots: squared distances of x to the pivots.
    """
    a, b = np.sqrt(to_pivots.astype(float)), np.sqrt(squares(entries, pivots).astype(float))
    bound = np.zeros((len(x), len(entries)))
    for p in range(len(pivots)):
        np.maximum(bound, np.abs(a[:, p, None] - b[None, :, p]), out=bound)
    bound -= 1e-15 * (a.max(1, keepdims=True) + b.max())  # more than roots and difference lose by rounding
    np.maximum(bound, 0, out=bound)
    order = bound.argsort(1)
    bound = np.take_along_axis(bound, order, 1) ** 2 * (1 - 1e-12)
    best, at, seen = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    left = np.arange(len(x))
    for k in range(len(entries)):
        left = left[bound[left, k] <= best[left]]
        if not len(left):
            break
        e = order[left, k]
        d = ((x[left] - entries[e]) ** 2).sum(1)
        closer = (d < best[left]) | ((d == best[left]) & (e < at[left]))
        rows = left[closer]
        best[rows], at[rows] = d[closer], e[closer]
        seen[left] += 1
    return at, best, seen


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


def encode(rows: DataFrame, how: Codes = Codes(), key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, label, code, error, evaluated, label_error, codebooks_sha256) of each usable vector.

    code: index of the entry of each part, in hex; error: squared distances summed over the parts; evaluated: exact
    distances that this assignment took; label_error: errors summed over equal labels, nulls together.
    """
    spark = rows.sparkSession
    kept = rows.where(usable(F.col(vector), how.scale)).select(F.col(key).alias("id"), F.col(label).alias("label"), integers(F.col(vector), how.scale).alias("q"))
    first = [r[0] for r in kept.orderBy(F.asc_nulls_last("id"), "q").limit(how.entries).select("q").collect()]
    span = max(1, -(-widest(kept) // how.parts)) if first else 1
    width = span * how.parts
    start = np.array([r + [0] * (width - len(r)) for r in first], np.int64).reshape(len(first), how.parts, span)
    books = start.transpose(1, 0, 2)  # part, entry, position
    pivots = [spread(b, how.pivots) for b in books] if first else []

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            q = matrix(batch.column("q"), width)
            far = [squares(q[:, p * span: (p + 1) * span], pivots[p]) for p in range(how.parts)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), lists(q, pa.int32()), lists(np.concatenate(far, 1), pa.int64())], ["id", "label", "q", "to_pivots"])

    kinds = dict(kept.dtypes)
    head = f"id {kinds['id']}, label {kinds['label']}"
    measured = cut_lineage(kept.mapInArrow(measure, f"{head}, q array<int>, to_pivots array<bigint>")) if first else spark.createDataFrame([], f"{head}, q array<int>, to_pivots array<bigint>")
    edges = np.concatenate([[0], np.cumsum([len(p) for p in pivots])]).astype(int)

    def assigned(batch: pa.RecordBatch, books: np.ndarray) -> Iterator[tuple]:
        q, far = matrix(batch.column("q"), width), matrix(batch.column("to_pivots"), int(edges[-1]))
        for p in range(how.parts):
            part = q[:, p * span: (p + 1) * span]
            yield part, *nearest(part, far[:, edges[p]: edges[p + 1]], books[p], pivots[p])

    def sums_of(books: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            size = (how.parts, books.shape[1])
            sums, counts = np.zeros((*size, span), np.int64), np.zeros(size, np.int64)
            for batch in _blocks(batches):
                for p, (part, at, _, _) in enumerate(assigned(batch, books)):
                    counts[p] += np.bincount(at, minlength=size[1])
                    for i in range(span):  # below 2**53, so exact
                        sums[p, :, i] += np.bincount(at, part[:, i], size[1]).astype(np.int64)
            p, e = counts.nonzero()
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(counts[p, e]), lists(sums[p, e], pa.int64())], ["part", "entry", "n", "sums"])

        return run

    for _ in range(how.rounds if first else 0):
        partial = measured.select("q", "to_pivots").mapInArrow(sums_of(books), "part bigint, entry bigint, n bigint, sums array<bigint>")
        exact = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(span)]
        books = books.copy()
        for part, entry, n, *sums in partial.groupBy("part", "entry").agg(F.sum("n"), *exact).collect():  # parts x entries at most
            books[part, entry] = [int(s) // n for s in sums]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            found = [x[1:] for x in assigned(batch, books)]
            codes = [bytes(r).hex() for r in np.stack([f[0] for f in found], 1).astype(np.uint8)]
            error, seen = sum(f[1] for f in found), sum(f[2] for f in found)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(codes), pa.array(error), pa.array(seen)], ["id", "label", "code", "error", "evaluated"])

    coded = cut_lineage(measured.mapInArrow(code, f"{head}, code string, error bigint, evaluated bigint"))
    of_label = cut_lineage(coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("bigint").alias("label_error")).withColumnRenamed("label", "of"))
    side = F.broadcast(of_label) if of_label.count() <= MOST_LABELS else of_label
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    met = coded.join(side, F.col("label").eqNullSafe(F.col("of")))
    return met.select(F.col("id").alias(key), F.col("label").alias(label), "code", "error", "evaluated", "label_error", F.lit(digest).alias("codebooks_sha256"))
