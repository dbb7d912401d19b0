"""Secrets: the base rules against a plain search, and nested layers planted by hand."""

import base64
import bz2
import gzip
import lzma
import random
import re
import tracemalloc
import urllib.parse
import zlib

import pytest
import zstandard

from corpusloom.llm import secret_scan
from corpusloom.llm.queries import op1_secret_scan

from .cases import awkward, empty

BASE = {
    "assign": (re.compile(r"""(?a:(?i:(password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m.group(2)) >= 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m.group()) >= 20),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m.group()) >= 24),
}
FOLDER = "/root/testdata/sf0.01"
KEY = "AKIA" + "Z7" * 8


def plain(text):
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(BASE.values()) for m in p.finditer(text) if ok(m))


def found(text):
    return [(a, k, b) for a, k, b, _ in secret_scan.findings(text)[0]]


@pytest.mark.parametrize("text", [
    "", "password=abc", "PassWord : 'hunter22' token=token=abcdef", "api_key=\"a.b-c_d\" apikey:x apikey = 123456", KEY, KEY[:-1], "0123456789abcdef01234567", "ToKen = AKIA" + "A" * 20,
    "secretsecret=secret", "paſsword=abcdef Key apikey=abcdef", "é" * 5 + "token=abcdef",
])
def test_base_rules(text):
    assert [x for x in found(text) if x in plain(text)] == plain(text)


def b64(raw):
    return base64.b64encode(raw).decode()


PACKERS = [gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.compress]


@pytest.mark.parametrize("pack", PACKERS)
def test_compressed_layers_map_to_the_run(pack):
    run = b64(pack(pack(f"deep password = swordfish1 and {KEY}".encode())))
    text = f"see <{run}> here"
    a, b = text.index(run), text.index(run) + len(run)
    assert found(text) == [(a, 0, b), (a, 1, b)]


def wrapped(run, n):
    return "\n".join(run[i: i + n] for i in range(0, len(run), n))


@pytest.mark.parametrize("pack", [bytes, *PACKERS])
def test_base64_beside_its_own_characters(pack):
    for extra in range(3):
        run = b64(pack(f"key is {KEY} or password = swordfish1".encode() + b"!" * extra)).rstrip("=")
        for before, after in (("https://example.com/", ""), ("id-", ""), ("v1_", " x"), ("a/b/", ","), ("", "\nRegards, x"), ("", "\nHello, x"), ("Data\n", "\n")):
            got = [(a, b) for a, k, b in found(f"{before}{run}{after}") if k == 1]
            assert any(a <= len(before) and b >= len(before) + len(run) - 5 for a, b in got), (before, after)
        for n in (20, 32, 57, 76):
            text = f"see <{wrapped(run, n)}> here"
            assert {(5, 0, text.index("> here")), (5, 1, text.index("> here"))} <= set(found(text))


def test_text_among_other_bytes():
    run = b64(b"\xff\xfe\x00\x01" + f"token={KEY}".encode() + b"\x80\x81\x00")
    assert {k for _, k, _ in found(f"<{run}>")} == {0, 1}
    assert 1 in {k for _, k, _ in found(b64(f"key {KEY} is here".encode()).rstrip("=")[:-1])}


def test_escapes_map_to_their_own_characters():
    text = "go password%3Dabc%31%32%33 end"
    assert (3, 0, text.index(" end")) in found(text)
    text = "go \\u0070assword\\x3dabcdef; and &#116;oken=abcdef."
    assert (3, 0, text.index(";")) in found(text) and (text.index("&#"), 0, len(text)) in found(text)


def test_every_order_of_layers():
    wrap = [lambda s: b64(s.encode()), lambda s: "".join(f"%{c:02X}" for c in s.encode()), lambda s: "".join(f"\\u{ord(c):04x}" for c in s), lambda s: b64(gzip.compress(s.encode())), urllib.parse.quote]
    for x in wrap:
        for y in wrap:
            for z in wrap:
                inner = z(y(x(f"secret: abcdef99 {KEY}")))
                kinds = {k for _, k, _ in found(f"« {inner} »")}
                assert {0, 1} <= kinds
                assert all(2 <= a < b <= 2 + len(inner) for a, k, b in found(f"« {inner} »") if k != 2)


def test_layers_that_hold_themselves_end():
    text = "%25" * 2000 + "41"
    assert secret_scan.findings(text)[1] < 2100
    raw = b"x"
    for _ in range(30):
        raw = gzip.compress(raw)
    assert found(b64(raw)) == []


def test_unpacking_is_read_in_blocks():
    raw = gzip.compress(b" " * 50_000_000 + f"token=abcdefgh {KEY}".encode() + b" " * 9_000_000)
    run = b64(raw)
    assert found(run) == [(0, 0, len(run)), (0, 1, len(run))]
    assert max(len(x) for x in secret_scan.unpacked(raw)) <= secret_scan.BLOCK
    assert list(secret_scan.unpacked(gzip.compress(b"abc" * 1000)[:-20]))  # damaged data gives what it holds


@pytest.mark.parametrize("pack", PACKERS)
def test_every_member_is_read(pack):
    for parts in ([b"nothing ", KEY.encode()], [b"a", b"pass", b"word = swordfish1 " + KEY.encode(), b"end"]):
        run = b64(b"".join(map(pack, parts)))
        assert (0, 1, len(run)) in found(run) and ((0, 0, len(run)) in found(run)) == (len(parts) > 2)
    padded = b64(gzip.compress(b"x") + bytes(100_000) + gzip.compress(KEY.encode()))
    assert (0, 1, len(padded)) in found(padded)


def test_nested_archives_beyond_one_block():
    noise = random.Random(3).randbytes(6_000_000)
    inner = gzip.compress(b64(noise).encode() + f" {KEY} ".encode(), 1)
    assert len(inner) > secret_scan.BLOCK
    text = b"".join(secret_scan.unpacked(gzip.compress(inner, 1), overlap=1))
    assert text.endswith(f" {KEY} ".encode())
    blocks = secret_scan._texts(gzip.compress(gzip.compress(bytes(300_000_000))), set())
    tracemalloc.start()
    assert sum(map(len, blocks)) >= 300_000_000
    assert tracemalloc.get_traced_memory()[1] < 60_000_000
    tracemalloc.stop()


def test_query(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    n = 0
    for r in op1_secret_scan(spark, FOLDER).collect():
        want = plain(docs[r.doc_id])
        names = list(BASE)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[1] == k for x in want) for k in range(3))
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if s in {f"{names[k]}:{a}:{b}" for a, k, b in want}] == [f"{names[k]}:{a}:{b}" for a, k, b in want]
        n += len(want)
    assert n > 0


def test_awkward_rows(spark):
    rows = secret_scan.scan(awkward(spark)).collect()
    assert len(rows) == 13 and all(r.findings == [] for r in rows)
    assert secret_scan.scan(empty(spark)).count() == 0


SECRET = "password=hunter2secret"


@pytest.mark.parametrize("unit", ["%" + "25" * 50_000, "25", "%25", "\\x5c", "\\u005c", "&#38;", "%5C", "\\x25", "QUJD", "a-_/", "=\n", "H4sI", "token=", "\\\\", "%", "&#x"])
def test_long_nested_escapes_end_soon(unit):
    """Half a million characters of one thing take seconds, and twice as many about twice as long."""
    import time

    def seconds(n):
        start = time.process_time()
        secret_scan.findings(unit * max(1, n // len(unit)))
        return time.process_time() - start

    once, twice = seconds(100_000), seconds(200_000)
    assert twice < 3 * once + 1 and twice < 20


def test_secrets_deep_below_escapes():
    for depth in (1, 5, 30, 200):
        hidden = SECRET.replace("=", "%" + "25" * depth + "3D")
        assert (4, "assign", 4 + len(hidden)) in {(a, list(secret_scan.KINDS)[k], b) for a, k, b, _ in secret_scan.findings("abc " + hidden + " def")[0]}
    mark = "%3D"
    for k in range(40):
        mark = mark.replace("%", "\\x25") if k % 2 else mark.replace("\\", "%5C")
    found = secret_scan.findings("abc " + SECRET.replace("=", mark))[0]
    assert (4, 4 + len(SECRET) - 1 + len(mark)) in {(a, b) for a, _, b, _ in found}


def test_settled_text_is_where_layers_end():
    """One pass over the characters ends where undoing layer after layer does, and maps to the same stretches."""
    rng = random.Random(8)
    atoms = ["%25", "%32", "%35", "5", "2", "\\x25", "\\u0025", "&#37;", "&#x25;", "%5C", "\\x5c", "x", "u", "a", " ", "\\u{25}", "3", "%26", "#37;", "%4", "1"]
    for _ in range(400):
        text = "".join(rng.choices(atoms, k=rng.randrange(1, 14)))
        layer = secret_scan.Layer(text)
        while True:
            nxt = secret_scan._rewritten(layer, secret_scan._PERCENT, secret_scan._percent) or secret_scan._rewritten(layer, secret_scan._ESCAPE, secret_scan._escape)
            if nxt is None:
                break
            layer = nxt
        got = secret_scan._settled(secret_scan.Layer(text))
        assert (got.text if got else text) == layer.text
        if got:
            assert got.origin(0, len(got.text)) == (0, len(text))
            assert "".join(text[slice(*got.origin(i, i + 1))] for i in range(len(got.text))) == text


@pytest.mark.parametrize("code", ["utf-16-le", "utf-16-be", "utf-16"])
def test_wide_text_in_base64(code):
    import base64
    import gzip

    raw = f"the {SECRET} is here".encode(code)
    for data in (raw, gzip.compress(raw), b"\x00\x01\x02\xff\xfe\xfd" + raw):
        run = base64.b64encode(data).decode()
        assert any(k == 0 and 2 <= a and b <= 2 + len(run) for a, k, b, _ in secret_scan.findings(f"x {run} y")[0])
