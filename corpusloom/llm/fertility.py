"""Tokeniser fertility as a quality rule.

Each whole text is encoded with a public byte-level vocabulary and measured:

* ``chars_per_token``: code points per token;
* ``fallback_share``: share of the UTF-8 bytes that belong to characters which a
  second public vocabulary (pieces with byte fallback) does not hold, and would
  spell byte by byte;
* ``entropy``: bits per token of the text's own token frequencies, as a share of
  the most that so many tokens allow, log2(min(tokens, vocabulary)).

A text is kept if every measure lies in the band of its language, or of its
main script where the language is unknown or has no band. Bands are wide by
design: they are to catch text that a tokeniser cannot work with (noise, blobs,
one thing repeated for ever), not unusual prose. A text of fewer than
``least_tokens`` tokens says too little and is kept.

Words, symbols, repeated lines and windows are counted as in rule lists for web
text: see ``base_counts``. Null and empty texts have no words and no tokens. Texts of any length are
measured whole, a slice of a bounded size at a time, and repeated rows alike. An
empty table gives an empty result. Only the columns named are read, so others may
have any name.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import per_slice, texts_of
from .vocabulary import broadcast_ranks, ranks_of
from .wordhash import mixed

# ── fixed values ────────────────────────────────────────────────────────────
_BLANKS = " \t\n\v\f\r"
_SYMBOLS = "#*$%&|<>"
WINDOW = 5
# ────────────────────────────────────────────────────────────────────────────


@dataclass(frozen=True)
class Band:
    """Least and most of each measure; outside is rejected."""

    chars_per_token: tuple[float, float] = (1.0, 12.0)
    fallback_share: tuple[float, float] = (0.0, 0.25)
    entropy: tuple[float, float] = (0.25, 1.0)


@dataclass(frozen=True)
class Bands:
    """By language code, then by script (the first word of a letter's Unicode name), then for all else."""

    languages: dict[str, Band] = field(default_factory=dict)
    scripts: dict[str, Band] = field(default_factory=lambda: {
        "LATIN": Band(chars_per_token=(1.3, 12.0), fallback_share=(0.0, 0.1)),
        "CYRILLIC": Band(chars_per_token=(1.0, 10.0)),
        "GREEK": Band(chars_per_token=(0.7, 8.0)),
        "ARABIC": Band(chars_per_token=(0.7, 8.0)),
        "CJK": Band(chars_per_token=(0.3, 4.0), fallback_share=(0.0, 0.6)),
    })
    other: Band = Band(chars_per_token=(0.2, 16.0), fallback_share=(0.0, 1.0))
    least_tokens: int = 50

    def of(self, language: str | None, script: str) -> Band:
        return self.languages.get(language or "") or self.scripts.get(script) or self.other


def base_counts(text: str, chars: Counter) -> tuple[int, int, int, int, int]:
    """(words, code points in words, symbols, repeated lines, words in repeated windows) of one text, given its characters.

    Words are what ``bytes.split`` gives: runs of anything but the six ASCII blanks.
    """
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.uint64, count=len(words))
    n_blank = sum(chars[c] for c in _BLANKS)
    return len(words), len(text) - n_blank, sum(chars[c] for c in _SYMBOLS), len(lines) - len(set(lines)), _in_repeated_windows(codes)


def _in_repeated_windows(codes: np.ndarray, width: int = WINDOW) -> int:
    """Words that stand in a window of ``width`` words found at least twice, overlaps included; windows meet as 64-bit hashes."""
    n = len(codes) - width + 1
    if n < 2:
        return 0
    names = mixed(codes + np.uint64(1))
    rolled = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        rolled = mixed(rolled + names[k: k + n])
    order = np.argsort(rolled, kind="stable")
    same = rolled[order[1:]] == rolled[order[:-1]]
    starts = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]
    edges = np.bincount(starts, minlength=len(codes) + 1) - np.bincount(starts + width, minlength=len(codes) + 1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def main_script(counts: Counter) -> str:
    """First word of the Unicode name of most letters; empty without letters."""
    scripts: Counter = Counter()
    for c, n in counts.items():
        if c.isalpha():
            scripts["LATIN" if c.isascii() else unicodedata.name(c, "NONE").split(" ")[0]] += n
    return max(scripts, key=lambda s: (scripts[s], s), default="")


def piece_characters(model_file: str) -> frozenset[str]:
    """The characters that a piece vocabulary with byte fallback can write without falling back."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = (p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i)))
    return frozenset(x for x in pieces if len(x) == 1) | {" ", "▁"}


def token_entropy(ids: np.ndarray, vocabulary: int) -> float:
    if len(ids) < 2:
        return 1.0
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    return float(-(share * np.log2(share)).sum() / np.log2(min(len(ids), vocabulary))) + 0.0


COLUMNS = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"),
           ("n_tokens", "long"), ("chars_per_token", "double"), ("fallback_share", "double"), ("entropy", "double"), ("script", "string"), ("in_band", "boolean")]
_ARROW = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}


def measure(docs: DataFrame, ranks_path: str, pattern: str, pieces_path: str, bands: Bands = Bands(), key: str = "doc_id",
            text: str = "text", language: str = "lang") -> DataFrame:
    """Per row: the key, the counts, the three measures, the main script, and whether all measures are in their bands."""
    ranks = broadcast_ranks(docs.sparkSession, ranks_path, pattern)
    covered = docs.sparkSession.sparkContext.broadcast(piece_characters(pieces_path))  # one entry a piece at most

    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        codec, known, rows = ranks_of(ranks).codec, covered.value, []
        for t, lang in zip(texts_of(part, text), part.column(2).to_pylist()):
            ids = np.array(codec.encode_ordinary(t), dtype=np.int32)
            chars = Counter(t)
            size = {c: len(c.encode()) * n for c, n in chars.items()}
            missing = sum(b for c, b in size.items() if c not in known and not c.isspace())
            got = (len(t) / max(1, len(ids)), missing / max(1, sum(size.values())), token_entropy(ids, codec.n_vocab))
            script = main_script(chars)
            band = bands.of(lang, script)
            fits = len(ids) < bands.least_tokens or all(lo <= x <= hi for x, (lo, hi) in zip(got, (band.chars_per_token, band.fallback_share, band.entropy)))
            rows.append((*base_counts(t, chars), len(ids), *got, script, fits))
        cols = list(zip(*rows)) or [()] * len(COLUMNS)
        return pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, _ARROW[kind]) for c, (_, kind) in zip(cols, COLUMNS))], [key, *(n for n, _ in COLUMNS)])

    rows = docs.select(key, text, language)
    return rows.mapInArrow(per_slice(one, text), f"`{key}` {rows.schema[0].dataType.simpleString()}, " + ", ".join(f"{n} {k}" for n, k in COLUMNS))
