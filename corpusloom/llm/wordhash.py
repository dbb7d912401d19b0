"""64-bit hashes of words and of word shingles, a whole batch of texts at a time.

A word's hash is a polynomial over its bytes, read off one running sum per
batch, then mixed. Words are runs of bytes other than blank, tab, line feed,
vertical tab, form feed and carriage return; A-Z count as a-z.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every word, in order."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    opens = ~blank & (first[:-1] | np.concatenate(([True], blank[:-1])))
    closes = ~blank & (first[1:] | np.concatenate((blank[1:], [True])))
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    low = data + ((data >= 65) & (data <= 90)) * np.uint8(32)
    letters = mixed(np.arange(1, 257, dtype=np.uint64) * _BASE)
    powers = np.cumprod(np.full(n, _BASE))
    undo = np.cumprod(np.full(n, _INVERSE))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(letters[low] * powers)))
    h = (sums[ends] - sums[starts]) * undo[starts]
    return mixed(h + (ends - starts).astype(np.uint64)), np.searchsorted(offsets, starts, "right") - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Per text its distinct shingles of ``width`` words, sorted; a text of fewer words is one shingle as a whole."""
    words, owner = word_hashes(data, offsets)
    bounds = np.searchsorted(owner, np.arange(len(offsets)))
    n = len(words)
    rolled = np.zeros(max(0, n - width + 1), dtype=np.uint64)
    for k in range(width):
        rolled = (rolled + words[k: k + len(rolled)]) * _BASE
    rolled = mixed(rolled ^ np.uint64(width))
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= width:
            out.append(np.unique(rolled[a: b - width + 1]))
        elif b > a:
            h = np.zeros(1, dtype=np.uint64)
            for w in words[a:b]:
                h = (h + w) * _BASE
            out.append(mixed(h ^ np.uint64(b - a)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
