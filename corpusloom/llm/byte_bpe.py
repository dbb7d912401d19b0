"""Byte-level BPE by monoid tree reduction.

A text's encoding is the product of its halves' encodings: halves are encoded
recursively, down to leaves of ``LEAF`` code points, and two neighbours are
joined by encoding a window around their seam once more. The window grows, on
each side by doubling, until its edges are *firm*: places where the split
pattern ends a match whatever stands further left or right. These are

* a blank or line feed after anything that is no white space, and
* an ASCII digit next to an ASCII letter, and a letter or digit before ASCII
  punctuation other than the apostrophe.

No alternative of the pattern matches across such a place, and none looks back,
so a match starts there in the half and in the joined text alike. Merges never
leave a match; therefore the tokens outside the window are those of the joined
text. Where no firm place exists the window reaches the end of the half, which
is then encoded as a whole: always right, only slower.

Decoding concatenates the bytes of token runs up the same kind of tree.

Null and empty texts have no tokens, repeated rows the same ones. Every input column is kept; ``ids`` and
``decoded`` are added (or replaced, when the input has such columns).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import list_array, text_slices, texts_of
from .vocabulary import broadcast_ranks, ranks_of

LEAF = 2048


def _firm(text: str, at: int) -> bool:
    """Whether every match of the split pattern ends or starts at ``at``, whatever the rest of the text is."""
    left, right = text[at - 1], text[at]
    if right in " \n":
        return left > " " and left.isprintable() and not left.isspace()
    if not (left.isascii() and right.isascii()):
        return False
    if left.isalpha():
        return right.isdigit() or ("!" <= right <= "~" and not right.isalnum() and right != "'")
    if left.isdigit():
        return right.isalpha() or ("!" <= right <= "~" and not right.isalnum() and right != "'")
    return False


def _edge(text: str, seam: int, stop: int, step: int) -> int:
    """The firm place nearest to the seam on one side, else the end of that half."""
    at, reach = seam, 16
    while at != stop:
        until = max(stop, seam - reach) if step < 0 else min(stop, seam + reach)
        while at != until:
            at += step
            if at != stop and _firm(text, at):
                return at
        reach *= 2
    return stop


def join(codec, sizes: list[int], text: str, lo: int, seam: int, hi: int, left: list[int], right: list[int]) -> list[int]:
    """Tokens of text[lo:hi] from those of text[lo:seam] and text[seam:hi]; ``left`` is used up."""
    a, b = _edge(text, seam, lo, -1), _edge(text, seam, hi, 1)
    redo, k = len(text[a:seam].encode()), len(left)
    while redo > 0:
        k -= 1
        redo -= sizes[left[k]]
    skip, j = len(text[seam:b].encode()), 0
    while skip > 0:
        skip -= sizes[right[j]]
        j += 1
    del left[k:]
    left += codec.encode_ordinary(text[a:b])
    left += right[j:] if j else right
    return left


def encode_text(codec, sizes: list[int], text: str, lo: int = 0, hi: int | None = None, leaf: int = LEAF) -> list[int]:
    hi = len(text) if hi is None else hi
    if hi - lo <= leaf:
        return codec.encode_ordinary(text[lo:hi])
    seam = (lo + hi) // 2
    return join(codec, sizes, text, lo, seam, hi, encode_text(codec, sizes, text, lo, seam, leaf), encode_text(codec, sizes, text, seam, hi, leaf))


def decode_ids(codec, ids: np.ndarray, leaf: int = LEAF) -> bytes:
    if len(ids) <= leaf:
        return codec.decode_bytes(ids.tolist())
    half = len(ids) // 2
    return decode_ids(codec, ids[:half], leaf) + decode_ids(codec, ids[half:], leaf)




def _encoded(codec, sizes: list[int], texts: list[str], leaf: int) -> pa.ListArray:
    return list_array([np.array(encode_text(codec, sizes, t, leaf=leaf), dtype=np.int32) for t in texts], pa.int32())


def _decoded(codec, lists: pa.ListArray, leaf: int) -> pa.Array:
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
    return pa.array([decode_ids(codec, flat[a:b], leaf) for a, b in zip([0, *ends[:-1]], ends)], pa.binary())


def _kept(df: DataFrame, *added: str) -> list[str]:
    return [c for c in df.columns if c not in added]


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", leaf: int = LEAF) -> DataFrame:
    """Add ``ids``: the tokens of each whole text by the ranks at ``path``, without special tokens."""
    ranks, keep = broadcast_ranks(df.sparkSession, path, pattern), _kept(df, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ranks_of(ranks)
        for batch in batches:
            for part in text_slices(batch, text):
                ids = _encoded(own.codec, own.sizes, texts_of(part, text), leaf)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), ids], [*keep, "ids"])

    return df.mapInArrow(run, df.select(*keep, F.lit(None).cast("array<int>").alias("ids")).schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", leaf: int = LEAF) -> DataFrame:
    """Add ``decoded``: the bytes that each list of tokens stands for."""
    ranks, keep = broadcast_ranks(df.sparkSession, path, pattern), _kept(df, "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ranks_of(ranks).codec
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), _decoded(codec, part.column(ids), leaf)], [*keep, "decoded"])

    return df.mapInArrow(run, df.select(*keep, F.lit(None).cast("binary").alias("decoded")).schema)


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", leaf: int = LEAF) -> DataFrame:
    """Add ``ids`` and ``decoded`` in one Python step, so a task needs one worker and one codec."""
    ranks, keep = broadcast_ranks(df.sparkSession, path, pattern), _kept(df, "ids", "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ranks_of(ranks)
        for batch in batches:
            for part in text_slices(batch, text):
                ids = _encoded(own.codec, own.sizes, texts_of(part, text), leaf)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), ids, _decoded(own.codec, ids, leaf)], [*keep, "ids", "decoded"])

    return df.mapInArrow(run, df.select(*keep, F.lit(None).cast("array<int>").alias("ids"), F.lit(None).cast("binary").alias("decoded")).schema)
