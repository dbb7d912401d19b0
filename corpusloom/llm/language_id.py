"""Language identification with language-bitmask n-gram filters.

Training. Of each language a bounded sample of documents is read (``per_language``
documents, picked by a hash of their key). Byte n-grams of their lower-cased
letters are counted per language by Spark. An n-gram belongs to a language if
it is seen there ``least`` times and at least ``contrast`` times as often, per
n-gram of the language, as where it is most frequent; that keeps out what stray
quotations and wrong labels bring. The ``most_grams`` most frequent n-grams go
into one Bloom filter that is bit-sliced by language: each slot is a mask with
one bit a language, an n-gram sets its languages' bits in ``PROBES`` slots, and
the AND of its slots gives back every language that contains it. The filter has
a fixed size, whatever the size of the corpus, and is sent to the workers.

Prediction. Every n-gram of a whole text is looked up; the hits of each language
are counted over the text and corrected for the false positives that the
language's fill allows: (hits / n - p) / (1 - p) with p = fill ** PROBES. The
largest corrected share decides (ties: the first language by name); ``score`` is
its part of the sum of all shares. A text without letters, or null, is ``und``
with score 0. A text with letters but no hit gets the most frequent language of
the training sample and score 0. As ``score`` compares languages only, it is 1/k
at least for k languages once anything hits; ``share``, the largest corrected
share, and ``n_grams`` tell how like the language the text is at all.

The filter takes one bit a slot and language (``Fit.slots`` x languages / 8
bytes), its only growth; up to ``Fit.most_languages`` are learned. Long texts are
read whole, n-gram by n-gram in slices of a bounded size; repeated rows get the
same answer, an empty training table a filter that knows nothing, and an empty
table no rows. Columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .batches import bytes_of, per_slice, text_slices
from .wordhash import mixed

ORDERS = (3, 5)
WORD = 64  # languages a mask
SLICE = 1 << 18  # bytes of text looked at together; their n-grams take some 100 times as much
PROBES = 3


@dataclass(frozen=True)
class Fit:
    """Bounds and thresholds of training; documented in the module."""

    per_language: int = 3000
    most_grams: int = 1 << 19
    slots: int = 1 << 21
    least: int = 3
    contrast: float = 0.05
    most_languages: int = 1024


def letters_of(data: np.ndarray) -> np.ndarray:
    """ASCII lower-cased, everything in ASCII but letters a blank; other bytes stay."""
    low = data | 32
    return np.where((low >= 97) & (low <= 122) & (data < 128), low, np.where(data >= 128, data, 32)).astype(np.uint8)


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per order: (code, position) of each n-gram with two letters at least, no two blanks together, inside one text.

    Every text is read as if blanks stood around it, so one letter is enough for an n-gram.
    """
    sizes = np.diff(offsets) + 2
    starts = np.concatenate(([0], np.cumsum(sizes)))
    wide = np.full(starts[-1], 32, dtype=np.uint8)
    if len(data):
        wide[np.arange(len(data)) + 1 + 2 * np.repeat(np.arange(len(sizes)), sizes - 2)] = letters_of(data)
    keep = np.concatenate(([True], (wide[1:] != 32) | (wide[:-1] != 32)))
    keep[starts[:-1]] = True
    at = np.flatnonzero(keep)
    wide = wide[at]
    owner_end = np.repeat(np.searchsorted(at, starts[1:]), np.diff(np.searchsorted(at, starts)))
    codes = np.zeros(len(wide), dtype=np.uint64)
    place = np.arange(len(wide))
    for k in range(max(ORDERS)):
        codes[: len(wide) - k] |= wide[k:].astype(np.uint64) << np.uint64(8 * k)
        if k + 1 in ORDERS:
            ok = place + k + 1 <= owner_end
            here = place[ok]
            yield codes[ok] | np.uint64((k + 1) << 56), np.searchsorted(np.searchsorted(at, starts), here, "right") - 1


def slots_of(codes: np.ndarray, slots: int) -> list[np.ndarray]:
    h = mixed(codes)
    return [((h >> np.uint64(k * 21)) ^ (h << np.uint64(k))).astype(np.uint64) & np.uint64(slots - 1) for k in range(PROBES)]


class Filter:
    """The bit-sliced Bloom filter and the languages of its bits: a table of masks for every 64 languages."""

    def __init__(self, languages: list[str], fallback: str, tables: list[np.ndarray], p: np.ndarray):
        self.languages, self.fallback, self.tables, self.p = languages, fallback, tables, p

    @classmethod
    def empty(cls, languages: list[str], fallback: str, slots: int) -> Filter:
        tables = []
        for k in range(0, max(1, len(languages)), WORD):
            kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if np.iinfo(k).bits >= min(WORD, max(1, len(languages)) - len(tables) * WORD))
            tables.append(np.zeros(slots, dtype=kind))
        return cls(languages, fallback, tables, np.zeros(len(languages)))

    def add(self, codes: np.ndarray, *masks: np.ndarray) -> None:
        """Enter n-grams with their masks, one array of masks for every 64 languages."""
        for table, of in zip(self.tables, masks, strict=True):
            for at in slots_of(codes, len(table)):
                np.bitwise_or.at(table, at, of.astype(table.dtype))
        self.p = np.array([self._bit(self.tables[k // WORD], k).mean() ** PROBES for k in range(len(self.languages))])

    @staticmethod
    def _bit(masks: np.ndarray, k: int) -> np.ndarray:
        return (masks >> masks.dtype.type(k % WORD)) & masks.dtype.type(1)

    def masks(self, codes: np.ndarray) -> list[np.ndarray]:
        a, *rest = slots_of(codes, len(self.tables[0]))
        out = [t[a] for t in self.tables]
        for b in rest:
            out = [m & t[b] for m, t in zip(out, self.tables)]
        return out

    def decide(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Per text: language, score, largest corrected share, number of n-grams."""
        n, k = len(offsets) - 1, len(self.languages)
        hits, total = np.zeros((n, k)), np.zeros(n)
        for codes, owner in grams(data, offsets):
            masks = self.masks(codes)
            total += np.bincount(owner, minlength=n)
            bounds = np.searchsorted(owner, np.arange(n + 1))
            for j in range(k):
                counted = np.concatenate(([0], np.cumsum(self._bit(masks[j // WORD], j), dtype=np.int64)))
                hits[:, j] += counted[bounds[1:]] - counted[bounds[:-1]]
        share = np.clip((hits / np.maximum(total, 1)[:, None] - self.p) / (1 - self.p), 0, None)
        best, sums = share.argmax(axis=1) if k else np.zeros(n, int), share.sum(axis=1)
        top = share.max(axis=1, initial=0)
        score = np.where(sums > 0, top / np.where(sums > 0, sums, 1), 0.0)
        return [self.languages[b] if s > 0 else self.fallback for b, s in zip(best, sums)], score, top, total.astype(np.int64)


def train(docs: DataFrame, fit: Fit = Fit(), key: str = "doc_id", text: str = "text", language: str = "lang") -> Filter:
    """Learn the filter from labelled rows (those with a language and a text)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(language).alias("l")).where("l is not null and t is not null")
    sizes = {r[0]: r[1] for r in rows.groupBy("l").count().orderBy(F.desc("count"), "l").limit(fit.most_languages + 1).collect()}
    if len(sizes) > fit.most_languages:
        raise ValueError(f"more than {fit.most_languages} languages: the filter holds a bit for each in each slot; raise most_languages for more")
    languages = sorted(sizes)
    out = Filter.empty(languages, max(languages, key=lambda x: (sizes[x], x), default="und"), fit.slots)
    if not languages:
        return out
    chance = F.coalesce(*[F.when(F.col("l") == x, F.lit(min(1.0, fit.per_language / sizes[x]))) for x in languages])
    number = F.coalesce(*[F.when(F.col("l") == x, F.lit(i)) for i, x in enumerate(languages)])
    sample = rows.where(F.pmod(F.xxhash64(F.col("k"), F.lit("fit")), F.lit(1 << 20)) < chance * (1 << 20)).select("t", number.cast("int").alias("n"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "t"):
                of = part.column(1).to_numpy(zero_copy_only=False)
                for codes, owner in grams(*bytes_of(part, "t")):
                    for lang in np.unique(of):
                        g, c = np.unique(codes[of[owner] == lang], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(np.full(len(g), lang, np.int32)), pa.array(c.astype(np.int64))], ["g", "n", "c"])

    counts = cut_lineage(sample.mapInArrow(count, "g bigint, n int, c bigint").groupBy("g").agg(*[F.sum(F.when(F.col("n") == i, F.col("c")).otherwise(0)).alias(f"c{i}") for i in range(len(languages))]))
    totals = counts.agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(len(languages))]).first()
    rate = [F.col(f"c{i}") / F.lit(float(totals[i] or 1)) for i in range(len(languages))]
    top = F.greatest(*rate) if len(rate) > 1 else rate[0]
    masks = []
    for start in range(0, len(languages), WORD):
        mask: Column = F.lit(0).cast("bigint")
        for i, r in enumerate(rate[start: start + WORD]):
            mask = mask.bitwiseOR(F.when((F.col(f"c{start + i}") >= fit.least) & (r >= fit.contrast * top), F.lit(1 << i if i < 63 else -(1 << 63)).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
        masks.append(mask.alias(f"m{start // WORD}"))
    names = [f"m{w}" for w in range(len(masks))]
    best = counts.select("g", *masks, top.alias("top")).where(" or ".join(f"{m} <> 0" for m in names)).orderBy(F.desc("top"), "g").limit(fit.most_grams).select("g", *names).toArrow()
    out.add(best.column("g").to_numpy().view(np.uint64), *[best.column(m).to_numpy().view(np.uint64) for m in names])
    return out


def predict(docs: DataFrame, model: Filter, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: the columns ``keep``, ``lang_pred``, ``score``, ``share`` and ``n_grams``, from the text alone."""
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.fallback, model.tables, model.p))  # of fixed size: see Fit
    rows = docs.select(*keep, F.col(text).alias("_text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("_letter"))

    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        names, score, share, total = Filter(*sent.value).decide(*bytes_of(part, "_text"))
        some = np.array(part.column("_letter").to_pylist(), dtype=bool)
        pred = pa.array([n if s else "und" for n, s in zip(names, some)], pa.string())
        told = [pred, pa.array(np.where(some, score, 0.0), pa.float64()), pa.array(np.where(some, share, 0.0), pa.float64()), pa.array(total, pa.int64())]
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *told], [*keep, "lang_pred", "score", "share", "n_grams"])

    out = rows.select(*keep, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("share"), F.lit(0).cast("bigint").alias("n_grams")).schema
    return rows.mapInArrow(per_slice(one, "_text", SLICE), out)
