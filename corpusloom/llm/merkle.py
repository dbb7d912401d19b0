"""Document fingerprints: a Merkle tree over sections, paragraphs and sentences.

Sections are parted by blank lines, paragraphs by line feeds; a paragraph's
leaves are its sentences (up to and including ``.``, ``!`` or ``?`` and the
blanks after it). A sentence of more than ``LONG`` code points is cut after each
word whose checksum is even, so an edit moves no cut but those next to
it. Every node is the BLAKE2b digest of its children's digests under a name for
its level; the root is the fingerprint.

Equal texts have equal roots. Two trees are compared from the root down: where
digests agree the whole branch is skipped, what differs in both from the front
and from the back bounds the edit. Likeness is twice the code points in leaves
that both trees hold (counted with repeats) over the code points of both; it is
1 for equal roots and 0 without a common leaf. Null counts as the empty text,
whose tree is one section of one empty paragraph. Texts of any length are read
whole; a tree is as large as its text. Repeated rows follow each other as
documents of their own, an empty table gives an empty result, and columns other
than those named are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG = 24
BLOCK_BYTES, MOST_BLOCKS = 4 << 20, 1 << 16
_SENTENCE = re.compile(r"[^.!?]*[.!?]+\s*|[^.!?]+")
_WORD = re.compile(r"\S+\s*|\s+")


def _digest(level: bytes, data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16, person=level).digest()


@dataclass
class Tree:
    """Root, sections (digest, paragraphs), paragraphs (digest, leaves), leaves (digest, code points)."""

    root: bytes
    sections: list[tuple[bytes, list[tuple[bytes, list[tuple[bytes, int]]]]]]
    size: int

    def leaves(self) -> Iterator[tuple[bytes, int]]:
        for _, paragraphs in self.sections:
            for _, leaves in paragraphs:
                yield from leaves


def leaves_of(paragraph: str) -> list[str]:
    out = []
    for sentence in _SENTENCE.findall(paragraph):
        if len(sentence) <= LONG:
            out.append(sentence)
            continue
        held: list[str] = []
        for word in _WORD.findall(sentence):
            held.append(word)
            if zlib.crc32(word.encode()) % 2 == 0:
                out.append("".join(held))
                held = []
        if held:
            out.append("".join(held))
    return out


def tree(text: str, known: Tree | None = None, known_text: str = "") -> Tree:
    """The tree of a text; paragraphs it shares with ``known`` are taken over from there."""
    held = dict(zip((p for x in known_text.split("\n\n") for p in x.split("\n")), (p for _, x in known.sections for p in x))) if known else {}
    sections = []
    for section in text.split("\n\n"):
        paragraphs = []
        for paragraph in section.split("\n"):
            if paragraph in held:
                paragraphs.append(held[paragraph])
                continue
            leaves = [(_digest(b"leaf", x.encode()), len(x)) for x in leaves_of(paragraph)]
            paragraphs.append((_digest(b"paragraph", b"".join(d for d, _ in leaves)), leaves))
        sections.append((_digest(b"section", b"".join(d for d, _ in paragraphs)), paragraphs))
    return Tree(_digest(b"root", b"".join(d for d, _ in sections)), sections, len(text))


def likeness(a: Tree, b: Tree) -> float:
    if a.root == b.root:
        return 1.0
    held = Counter()
    for leaf in a.leaves():
        held[leaf] += 1
    common = total = 0
    for leaf in b.leaves():
        total += leaf[1]
        if held[leaf] > 0:
            held[leaf] -= 1
            common += leaf[1]
    total += sum(n for _, n in a.leaves())
    return 2 * common / total if total else 0.0


def _agreeing(a: Tree, b: Tree, back: bool) -> int:
    """Code points of ``a`` at one end over which both trees agree, by whole branches."""
    turn = reversed if back else iter
    done = 0
    for (da, pa_), (db, pb) in zip(turn(a.sections), turn(b.sections)):
        if da == db:
            done += sum(n for _, leaves in pa_ for _, n in leaves) + len(pa_) + 1
            continue
        for (dp, la), (dq, lb) in zip(turn(pa_), turn(pb)):
            if dp == dq:
                done += sum(n for _, n in la) + 1
                continue
            for x, y in zip(turn(la), turn(lb)):
                if x != y:
                    break
                done += x[1]
            break
        break
    return min(done, a.size)


def differing(a: Tree, b: Tree) -> tuple[int, int]:
    """The code points [start, end) of ``a`` outside which both trees agree; (0, 0) for equal roots."""
    if a.root == b.root:
        return 0, 0
    start = _agreeing(a, b, False)
    return start, max(start, a.size - _agreeing(a, b, True))


def edited(text: str, following: str) -> str:
    """The last quarter replaced by as many first code points of the following text, or by all of it."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


_OUT = ("n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double,"
        " n_sections bigint, n_paragraphs bigint, n_leaves bigint, edit_start bigint, edit_end bigint")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: its tree against that of its edited text and of the next row by key (after the last: the first).

    Rows are dealt into blocks of consecutive keys. The first row of a block goes
    to the block before as well, so each row meets its successor in one shuffle.
    A task streams one block in order and holds two texts at a time. A null key
    comes first; rows with one key are ordered by text.
    """
    base = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t"), F.coalesce(F.col(key).cast("bigint"), F.lit(-(1 << 63))).alias("o"))
    total, least = base.agg(F.sum(F.octet_length("t")), F.min("o")).first()
    n = int(min(MOST_BLOCKS, max(1, (total or 0) // BLOCK_BYTES)))
    cuts = base.agg(F.percentile_approx("o", [i / n for i in range(1, n)], 1_000_000)).first()[0] if n > 1 else []
    starts = np.unique(np.array([*(cuts or []), least if least is not None else 0], dtype=np.int64))  # keys that occur: each block's first

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = batch.column(2).to_numpy(zero_copy_only=False)
            block = np.searchsorted(starts, order, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block, pa.int64()), pa.array(np.zeros(len(block), np.int32))], ["k", "t", "o", "block", "guest"])
            first = np.flatnonzero(starts[block] == order)
            if len(first):
                rows = batch.take(pa.array(first))
                before = (block[first] - 1) % len(starts)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(before, pa.int64()), pa.array(np.ones(len(first), np.int32))], ["k", "t", "o", "block", "guest"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        rows: list[tuple] = []
        for batch in batches:
            for k, t, block, guest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                if guest and (held is None or held[2] != block):
                    continue
                here = (k, t or "", block, tree(t or ""))
                if held is not None:
                    rows.append(_compared(held, here))
                held = None if guest else here
                if len(rows) >= 1000:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)

    dealt = base.mapInArrow(deal, "k bigint, t string, o bigint, block bigint, guest int").repartitionById(len(starts), F.col("block").cast("int")).sortWithinPartitions("block", "guest", "o", "t")
    return dealt.mapInArrow(walk, "k bigint, " + _OUT).withColumnRenamed("k", key)


def _compared(here: tuple, following: tuple) -> tuple:
    key, text, _, own = here
    new = edited(text, following[1])
    changed = tree(new, own, here[1])
    start, end = differing(own, changed)
    return (key, len(text), hashlib.sha256(new.encode()).hexdigest(), own.root.hex(), changed.root.hex(), likeness(own, changed), likeness(own, following[3]),
            len(own.sections), sum(len(p) for _, p in own.sections), sum(1 for _ in own.leaves()), start, end)


_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), *[pa.int64()] * 5]
_NAMES = ["k", *(x.split()[0] for x in _OUT.split(", "))]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _KINDS)], _NAMES)
