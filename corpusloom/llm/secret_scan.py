"""Secrets in plain and in encoded form.

Every text is a first layer. A worklist takes layers one by one: each is
searched for all kinds, then unwrapped into new layers wherever it holds

* percent escapes (the layer with all of them decoded),
* backslash or numeric character escapes (likewise). After ``LEVELS`` such layers
  in a row what is nested deeper is decoded at once, to where no escape is left,
  so that escapes of escapes cost no more than a few readings of the text,
* base64 runs, whose bytes are text, or gzip, zlib, bzip2, xz or zstd data,
  which is unpacked, again and again while it is still compressed. As a run may
  touch other characters of its alphabet, it is read from each of its first four
  characters on, stretches of text in the bytes count (``STRETCH`` characters or
  more, in UTF-8 or UTF-16; no secret is shorter), and compressed data may start after any ``/``,
  ``-``, ``_`` or line break. Runs are joined over line breaks; unless that gives
  one text, their lines are read one by one, too.

This goes on until nothing new appears. A layer already seen for the same place
of the source is not taken again, so archives and escapes that contain
themselves end. Each layer knows the piece of its parent behind every stretch
of it; a finding is carried down those pieces to code points of the source (the
whole run, or the part of it that was read, for base64). Unpacked data is read in blocks of ``BLOCK`` bytes that
overlap by ``OVERLAP``, one at a time and through all archives inside each
other, so a small archive that unpacks to gigabytes is scanned in bounded
memory; all its blocks map to the same run. All members of appended data are
read as one.

Null and empty texts have no findings, repeated rows the same ones, and an empty
table gives no rows. Equal findings of several layers count
once, with the smallest depth. Columns other than the two named are not read.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import partial
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import per_slice, texts_of

BLOCK, OVERLAP = 4 << 20, 1 << 16
STRETCH, SHORTEST, PIECE = 12, 16, 1 << 16
LEVELS = 8

# ── fixed values: what counts as a secret ───────────────────────────────────
WORDS = "password|passwd|secret|token|api_?key"
ASSIGNED = r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
LEAST = {"assign": 6, "access": 20, "hex": 24}
# ────────────────────────────────────────────────────────────────────────────
KINDS = {
    "assign": re.compile("(" + "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in WORDS) + ")" + ASSIGNED),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]{24,}"),
}
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(
    r"\\u[dD][89aAbB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|\\u\{[0-9a-fA-F]{1,6}\}|\\u[0-9a-fA-F]{4}|\\U[0-9a-fA-F]{8}|\\x[0-9a-fA-F]{2}"
    r"|&#[0-9]{1,7};|&#[xX][0-9a-fA-F]{1,6};"
)
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % SHORTEST)
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:\r?\n[ \t]*[A-Za-z0-9+/_-]++)+={0,2}")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+")
_TEXT = re.compile(rb"(?:[\t\n\r\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}){%d,}" % STRETCH)
_ZEROS = re.compile(rb"\x00{%d,}" % (STRETCH - 1))
_PRINTED = re.compile(rb"[\t\n\r\x20-\x7e]{%d,}" % STRETCH)
_LAST = re.compile(rf"(?:%[0-9A-Fa-f]{{2}}|{_ESCAPE.pattern})\Z")
_SCHEMA = "findings array<struct<kind:string,start:bigint,end:bigint,depth:int>>, n_layers bigint"
_FINDINGS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("depth", pa.int32())]))


class Layer:
    """A text and, for each stretch of it from ``cuts[i]`` on, the stretch ``sources[i]`` of the parent behind it."""

    def __init__(self, text: str, parent: Layer | None = None, cuts: list[int] | None = None, sources: list[tuple[int, int, bool]] | None = None):
        self.text, self.parent, self.cuts, self.sources = text, parent, cuts, sources
        self.depth: int = parent.depth + 1 if parent else 0
        self.levels = 0  # escapes undone in a row to get here

    def origin(self, start: int, end: int) -> tuple[int, int]:
        """Code points of the first text behind text[start:end]."""
        layer = self
        while layer.parent is not None:
            i, j = bisect_right(layer.cuts, start) - 1, bisect_right(layer.cuts, max(start, end - 1)) - 1
            (a, _, plain_a), (b, b_end, plain_b) = layer.sources[i], layer.sources[j]
            start, end = a + (start - layer.cuts[i]) * plain_a, b + end - layer.cuts[j] if plain_b else b_end
            layer = layer.parent
        return start, end


def _rewritten(layer: Layer, pattern: re.Pattern, pieces) -> Layer | None:
    """The layer with every match replaced; ``pieces`` turns one into (text, length in the parent) parts."""
    out, cuts, sources, at, done = [], [], [], 0, 0
    for m in pattern.finditer(layer.text):
        if m.start() > done:
            out.append(layer.text[done: m.start()])
            cuts.append(at)
            sources.append((done, m.start(), True))
            at += m.start() - done
        place = m.start()
        for text, length in pieces(m.group()):
            out.append(text)
            cuts.append(at)
            sources.append((place, place + length, False))
            at, place = at + len(text), place + length
        done = m.end()
    if not cuts:
        return None
    if done < len(layer.text):
        out.append(layer.text[done:])
        cuts.append(at)
        sources.append((done, len(layer.text), True))
    return Layer("".join(out), layer, cuts, sources)


def _percent(run: str) -> list[tuple[str, int]]:
    raw = bytes.fromhex(run.replace("%", ""))
    return [(chr(b), 3) for b in raw] if raw.isascii() else [(raw.decode("utf-8", "replace"), len(run))]


def _escape(s: str) -> list[tuple[str, int]]:
    if s.startswith("&#"):
        code = int(s[3:-1], 16) if s[2] in "xX" else int(s[2:-1])
    elif len(s) == 12:
        code = 0x10000 + ((int(s[2:6], 16) & 0x3FF) << 10) + (int(s[8:], 16) & 0x3FF)
    else:
        code = int(s[2:].strip("{}"), 16)
    return [(chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�", len(s))]


def _settled(layer: Layer) -> Layer | None:
    """The layer with its escapes decoded until none is left, in one pass: an escape is decoded as soon as its last character stands."""
    codes: list[int] = []  # bytes from 0x80 on are negative until their run is complete
    spans: list[tuple[int, int, bool]] = []
    undone = False
    for at, c in enumerate(layer.text):
        codes.append(ord(c))
        spans.append((at, at + 1, True))
        while codes[-1] in _ENDS and (m := _LAST.search("".join(chr(max(x, 0)) for x in codes[-12:]))):
            n = len(m.group())
            start, end = spans[-n][0], spans[-1][1]
            del codes[-n:], spans[-n:]
            code = int(m.group()[1:], 16) if m.group()[0] == "%" else ord(_escape(m.group())[0][0]) if not _SURROGATE.fullmatch(m.group()) else int(m.group()[2:], 16)
            if 0xDC00 <= code < 0xE000 and codes and 0xD800 <= codes[-1] < 0xDC00:
                code, start = 0x10000 + ((codes.pop() & 0x3FF) << 10) + (code & 0x3FF), spans.pop()[0]
            codes.append(-code if m.group()[0] == "%" and code >= 0x80 else code)
            spans.append((start, end, False))
            undone = True
    if not undone:
        return None
    out, cuts, sources, size, k = [], [], [], 0, 0
    while k < len(codes):
        j = k + 1
        if codes[k] < 0:
            while j < len(codes) and codes[j] < 0:
                j += 1
            text, span = bytes(-x for x in codes[k:j]).decode("utf-8", "replace"), (spans[k][0], spans[j - 1][1], False)
        elif spans[k][2]:
            while j < len(codes) and spans[j][2]:
                j += 1
            text, span = layer.text[spans[k][0]: spans[j - 1][1]], (spans[k][0], spans[j - 1][1], True)
            if len(text) != j - k:  # something decoded to nothing between them
                j, text, span = k + 1, layer.text[spans[k][0]], spans[k]
        else:
            text, span = chr(codes[k]) if not 0xD800 <= codes[k] < 0xE000 else "�", spans[k]
        out.append(text)
        cuts.append(size)
        sources.append(span)
        size, k = size + len(text), j
    return Layer("".join(out), layer, cuts, sources)


_ENDS = frozenset(map(ord, "0123456789abcdefABCDEF;}"))
_SURROGATE = re.compile(r"\\u[dD][89a-fA-F][0-9a-fA-F]{2}")


class _Source:
    """Bytes of an iterator of pieces, none of them empty, that can be looked at before they are read."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, b""

    def peek(self, n: int) -> bytes:
        while len(self.held) < n and (more := next(self.pieces, b"")):
            self.held += more
        return self.held[:n]

    def read(self, n: int) -> bytes:
        out = self.held or next(self.pieces, b"")
        out, self.held = out[:n], out[n:]
        return out


def _packed(head: bytes) -> str | None:
    """The kind of compressed data that starts like this, or None for anything else."""
    if head[:2] == b"\x1f\x8b" or (head[:1] == b"\x78" and len(head) > 1 and int.from_bytes(head[:2]) % 31 == 0):
        return "zlib"
    return next((kind for kind, start in (("bz2", b"BZh"), ("xz", b"\xfd7zXZ\x00"), ("zstd", b"\x28\xb5\x2f\xfd")) if head.startswith(start)), None)


def _member(kind: str, source: _Source) -> Iterator[bytes]:
    """What one member of compressed data holds (all frames, for zstd); the source is left at its end."""
    if kind == "zstd":
        import zstandard

        reader = zstandard.ZstdDecompressor().stream_reader(source, read_size=PIECE, read_across_frames=True)
        while out := reader.read1(PIECE):
            yield out
        return
    d, data = {"zlib": lambda: zlib.decompressobj(47), "bz2": bz2.BZ2Decompressor, "xz": lzma.LZMADecompressor}[kind](), b""
    while not d.eof:
        out = d.decompress(data, PIECE)
        data = d.unconsumed_tail if kind == "zlib" else b""
        if out:
            yield out
        elif not data and not d.eof and (kind == "zlib" or d.needs_input) and not (data := source.read(PIECE)):
            return
    source.held = d.unused_data + source.held


def _members(source: _Source) -> Iterator[bytes]:
    """What all members hold, one after the other. Damage ends it; bytes after the last member come as they are."""
    try:
        while kind := _packed(source.peek(6)):
            yield from _member(kind, source)
            while source.peek(1) == b"\0":  # padding between members
                source.held = source.held.lstrip(b"\0")
        while out := source.read(PIECE):
            yield out
    except Exception:  # the codecs each raise their own
        return


def unpacked(raw: bytes, block: int = BLOCK, overlap: int = OVERLAP, seen: set | None = None) -> Iterator[bytes]:
    """Blocks of what compressed data holds, unpacked until it is not compressed; damaged data gives what comes before the damage.

    Archives are told apart by their first ``block`` bytes; one in ``seen`` gives nothing again.
    """
    seen, source = set() if seen is None else seen, _Source(raw[i: i + PIECE] for i in range(0, len(raw), PIECE))
    while _packed(source.peek(6)):
        start, held = [], 0
        while held < block and (piece := source.read(PIECE)):
            start.append(piece)
            held += len(piece)
        key = hashlib.blake2b(b"".join(start), digest_size=16).digest()
        if key in seen:
            return
        seen.add(key)
        inner = _members(_Source(chain(iter(start), iter(partial(source.read, PIECE), b""))))
        # A small archive is unpacked at once, so that many small ones inside each other are no deep chain of readers.
        start, held = [], 0
        while held < block and (piece := next(inner, b"")):
            start.append(piece)
            held += len(piece)
        source = _Source(iter(start) if held < block else chain(start, inner))
    carry, more, fresh = b"", True, True
    while more:
        got, short = [], block - len(carry)
        while short > 0 and (piece := source.read(short)):
            got.append(piece)
            short -= len(piece)
        if got or fresh:
            yield (whole := carry + b"".join(got))
            carry, fresh = whole[-overlap:], False
        more = short <= 0


def _is_text(run: str) -> bool:
    """Whether all of a base64 run is one text."""
    body = "".join(_LINE.findall(run)).translate({45: 43, 95: 47})
    return len(body) % 4 != 1 and _TEXT.fullmatch(base64.b64decode(body + "=" * (-len(body) % 4))) is not None


def _base64(run: str) -> Iterator[tuple[str, int, int]]:
    """The texts that a base64 run holds, each with the stretch of the run behind it."""
    lines = [m.span() for m in _LINE.finditer(run)]
    body = "".join(run[a:b] for a, b in lines)
    firsts = [0, *accumulate(b - a for a, b in lines)]

    def place(k: int) -> int:
        i = bisect_right(firsts, k) - 1
        return lines[i][0] + k - firsts[i] if i < len(lines) else len(run)

    starts = sorted({m.end() for m in re.finditer("[/_-]", body)} | set(firsts[:-1]))
    plain, seen = body.translate({45: 43, 95: 47}), set()
    for at in range(4):
        part = plain[at: len(plain) - ((len(plain) - at) % 4 == 1)]
        raw, whole = base64.b64decode(part + "=" * (-len(part) % 4)), False
        for k in starts:
            first = (k - at) * 3 // 4
            if k >= at and (k - at) % 4 == 0 and (k == 0 or _packed(raw[first: first + 6]) is not None):
                for text in _texts(raw[first:], seen):
                    whole = whole or k == 0
                    yield text, place(k), len(run)
        for text, first, last in chain(((m.group().decode("utf-8", "replace"), *m.span()) for m in _TEXT.finditer(raw)), _wide(raw)):
            if not (whole and last - first == len(raw)):
                end = at - (-last * 4 // 3)
                yield text, place(at + first * 4 // 3), place(end - 1) + 1 if end < len(body) else len(run)


def _wide(raw: bytes) -> Iterator[tuple[str, int, int]]:
    """Stretches of ASCII in UTF-16 of either order, with their first byte and the one after the last."""
    for odd in (0, 1) if b"\0" in raw else ():
        zeros, others = raw[odd::2], raw[1 - odd:: 2]
        for m in _ZEROS.finditer(zeros):
            for t in _PRINTED.finditer(others, max(0, m.start() - 1 + odd), m.end() + odd):
                yield t.group().decode("ascii"), 2 * t.start(), 2 * t.end()


def _texts(raw: bytes, seen: set) -> Iterator[str]:
    """The texts that bytes stand for, through any number of compressed layers."""
    if _packed(raw[:6]):
        for block in unpacked(raw, seen=seen):
            yield block.decode("utf-8", "replace")
            yield from (text for text, _, _ in _wide(block))
        return
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return
    if sum(c.isprintable() or c in "\t\r\n" for c in text) >= 0.9 * len(text):
        yield text


def unwrapped(layer: Layer) -> Iterator[Layer]:
    """The layers directly inside one."""
    if layer.levels < LEVELS:
        escapes = [_rewritten(layer, _PERCENT, _percent) if "%" in layer.text else None, _rewritten(layer, _ESCAPE, _escape) if "\\" in layer.text or "&#" in layer.text else None]
    else:
        escapes = [_settled(layer)] if layer.levels == LEVELS else []
    for x in filter(None, escapes):
        x.levels = layer.levels + 1
        yield x
    joined: list[tuple[int, int]] = []
    for pattern in (_WRAPPED, _BASE64):
        for m in pattern.finditer(layer.text):
            i = bisect_right(joined, (m.start(), len(layer.text))) - 1
            if m.end() - m.start() < SHORTEST or i >= 0 and pattern is _BASE64 and m.end() <= joined[i][1]:
                continue
            for text, a, b in _base64(m.group()):
                if text:
                    yield Layer(text, layer, [0], [(m.start() + a, m.start() + b, False)])
            if pattern is _WRAPPED and _is_text(m.group()):
                joined.append(m.span())


def findings(text: str) -> tuple[list[tuple[int, int, int, int]], int]:
    """(start, kind number, end, depth) of each secret, in order, and the number of layers inside the text."""
    found: dict[tuple[int, int, int], int] = {}
    seen: dict[tuple[bytes, int, int], int] = {}
    work = [iter([Layer(text)])]  # the layers inside each layer on the way to the current one: none is made before it is needed
    while work:
        if (layer := next(work[-1], None)) is None:
            work.pop()
            continue
        key = (hashlib.blake2b(layer.text.encode("utf-8", "replace"), digest_size=16).digest(), *layer.origin(0, len(layer.text)))
        if layer.depth >= seen.get(key, layer.depth + 1):
            continue
        seen[key] = layer.depth
        for k, (kind, pattern) in enumerate(KINDS.items()):
            for m in pattern.finditer(layer.text):
                if len(m.group(m.lastindex or 0)) >= LEAST[kind] if kind != "assign" else len(m.group(2)) >= LEAST[kind]:
                    place = layer.origin(m.start(), m.end())
                    place = (place[0], k, place[1])
                    found[place] = min(layer.depth, found.get(place, layer.depth))
        work.append(unwrapped(layer))
    return sorted((*k, d) for k, d in found.items()), len(seen) - 1


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, ``findings`` (kind, start, end in code points, depth 0 for the text itself) and ``n_layers``."""
    names = list(KINDS)

    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        rows, layers = [], []
        for t in texts_of(part, text):
            got, n = findings(t)
            rows.append([{"kind": names[k], "start": a, "end": b, "depth": d} for a, k, b, d in got])
            layers.append(n)
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, _FINDINGS), pa.array(layers, pa.int64())], [key, "findings", "n_layers"])

    rows = docs.select(key, text)
    return rows.mapInArrow(per_slice(one, text), f"`{key}` {rows.schema[0].dataType.simpleString()}, {_SCHEMA}")
