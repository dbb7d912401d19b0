"""Mixing, sharding, pseudonyms and chat formatting: column expressions against plain Python."""

import datetime
import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import chat, mixing, pseudonyms, sharding
from corpusloom.llm.queries import op3_pseudonyms, op5_mixing, op6_sharding, op8_chat_format

from ..conftest import SMALL
from .cases import awkward, empty

FOLDER = "/root/testdata/sf0.01"


def python_nodes(df):
    return re.findall(r"Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


# ── mixing ──────────────────────────────────────────────────────────────────


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Targets by sharing the excess out again until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    goal, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > most * sizes[s]}
        if not over:
            return goal | {s: level * w[s] for s in free}
        for s in over:
            goal[s] = most * sizes[s]
            left -= goal[s]
        free -= over
    return goal


def check_mix(rows):
    """rows: dicts of the query; whole epochs first, then a prefix by key that ends near the budget."""
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
    goals = brute_targets(sizes)
    for s, n in sizes.items():
        own = [r for r in rows if r["source"] == s]
        assert all(r["source_size"] == n and math.isclose(r["target"], goals[s], abs_tol=1e-6) for r in own)
        taken = sum(r["taken"] for r in own)
        assert abs(taken - goals[s]) <= max((r["size"] for r in own), default=0) / 2 + 1e-6
        assert all(r["taken"] <= 2 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0) for r in own)


def test_mixing_query(spark):
    a, b = ([r.asDict() for r in op5_mixing(spark, FOLDER).collect()] for _ in range(2))
    check_mix(a)
    assert sorted(map(str, a)) == sorted(map(str, b))
    assert len({r["source"] for r in a}) > 3


def test_quality_shifts_the_odds(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.concat(F.lit("s"), F.col("id") % 2).alias("source"))
    good = docs.select("doc_id", F.when(F.col("doc_id") % 4 < 2, 4.0).otherwise(0.5).alias("weight"))
    rows = mixing.mix(docs, good, weights=(1,), share=0.5).collect()
    taken = Counter(r.id % 4 < 2 for r in rows if r.taken)
    assert taken[True] > 3 * taken[False] and sum(taken.values()) == 2000


def test_mixing_awkward_rows(spark):
    rows = [r.asDict() for r in mixing.mix(awkward(spark)).collect()]
    assert len(rows) == 13
    check_mix(rows)
    assert mixing.mix(empty(spark)).count() == 0
    assert not python_nodes(mixing.mix(awkward(spark)))


# ── sharding ────────────────────────────────────────────────────────────────


def check_shards(rows, texts, n=16):
    order = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    keys = [r["doc_id"] for r in order if r["doc_id"] is not None]
    assert keys == sorted(keys)  # contiguous in key order
    total, at, count = sum(r["size"] for r in rows), 0, Counter()
    for r in order:
        assert r["slot"] == count[r["shard"]]
        count[r["shard"]] += 1
        assert r["shard"] == min(n - 1, (2 * at + r["size"]) * n // (2 * total))
        at += r["size"]
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)


def test_sharding_query(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    df = op6_sharding(spark, SMALL)
    assert not python_nodes(df)
    check_shards([r.asDict() for r in df.collect()], [tuple(r) for r in docs])


def test_sharding_awkward_rows(spark):
    docs = awkward(spark)
    check_shards([r.asDict() for r in sharding.shard(docs, 4).collect()], [(r.doc_id, r.text) for r in docs.collect()], 4)
    assert sharding.shard(empty(spark)).count() == 0


# ── pseudonyms ──────────────────────────────────────────────────────────────

KEY = "k"


def draw(*parts):
    return int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def pair(left, right, a, b, kind, back=False):
    for i in reversed(range(8)) if back else range(8):
        if i % 2 == 0:
            left = (left + (-1 if back else 1) * draw(KEY, kind, i, right)) % a
        else:
            right = (right + (-1 if back else 1) * draw(KEY, kind, i, left)) % b
    return left, right


def string(s, kind):
    l, r = s[: len(s) // 2], s[len(s) // 2:]

    def move(half, other, i):
        out = ""
        for j, c in enumerate(half):
            first, n = ("0", 10) if c.isdigit() else ("a", 26) if c.islower() else ("A", 26)
            out += chr((ord(c) - ord(first) + draw(KEY, kind, i, j, other)) % n + ord(first))
        return out

    for i in range(8):
        l, r = (move(l, r, i), r) if i % 2 == 0 else (l, move(r, l, i))
    return l + r


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10


def fill(spelling, chars, kept):
    it = iter(chars)
    return re.sub(f"[{kept}]", lambda m: next(it), spelling)


def expected(m):
    """A Python account of every kind, written from the module's description."""
    digits = re.sub("[^0-9]", "", m)
    if "@" in m:
        head, tail = m.lower().rsplit(".", 1)
        return fill(head, string(re.sub("[^a-z0-9]", "", head), "email"), "a-z0-9") + "." + tail
    if re.fullmatch(r"\d{4}-\d\d-\d\d", m):
        n = (datetime.date.fromisoformat(m) - datetime.date(1800, 1, 1)).days
        l, r = pair(n // 773, n % 773, 189, 773, "date")
        return (datetime.date(1800, 1, 1) + datetime.timedelta(l * 773 + r)).isoformat()
    if re.fullmatch(r"\d+\.\d+\.\d+\.\d+", m):
        o = list(map(int, m.split(".")))
        l, r = pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip")
        return f"{l >> 8}.{l & 255}.{r >> 8}.{r & 255}"
    if re.fullmatch(r"\d{3}-\d\d-\d{4}", m):
        area = int(m[:3])
        l, r = pair((area - (2 if area > 666 else 1)) * 99 + int(m[4:6]) - 1, int(m[7:]) - 1, 898 * 99, 9999, "ssn")
        i = l // 99
        return f"{i + (2 if i >= 665 else 1):03}-{l % 99 + 1:02}-{r + 1:04}"
    if m[0].isalpha():
        s = m.replace(" ", "")
        new = string(s[4:], "iban")
        check = 98 - int("".join(str(int(c, 36)) for c in new + s[:2] + "00")) % 97
        return fill(m, s[:2] + f"{check:02}" + new, "A-Z0-9")
    if m[0] in "+(" or re.fullmatch(r"\d{3}[.-]\d{3}[.-]\d{4}", m):
        national = digits[1:] if m[0] == "+" else digits
        l, r = pair((int(national[:3]) - 200) * 800 + int(national[3:6]) - 200, int(national[6:]), 640_000, 10_000, "phone")
        return fill(m, ("1" if m[0] == "+" else "") + f"{l // 800 + 200}{l % 800 + 200}{r:04}", "0-9")
    body = digits[0] + string(digits[1:-1], "card")
    return fill(m, body + str((10 - luhn(body + "0")) % 10), "0-9")


VALUES = [
    "ann.lee+x@mail.example.org", "a@b.io", "x_y-9@sub.site-1.co.uk", "2020-02-29", "1800-01-01", "2199-12-31", "10.0.0.1", "255.255.255.255", "123-45-6789", "899-99-9999", "665-01-0001", "667-01-0001",
    "+1 (988) 555-2485", "988-555-2485", "(988) 555-2485", "+19885552485", "4524132264652876", "4524 1322 6465 2876", "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000",
]


def replaced(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in pseudonyms.pseudonymise(rows, KEY).orderBy("doc_id").collect()]


def test_every_kind_by_hand(spark):
    got = replaced(spark, [f"see {v}, then" for v in VALUES])
    assert got == [f"see {expected(v)}, then" for v in VALUES]
    assert all(g != f"see {v}, then" for g, v in zip(got, VALUES))


def test_spellings_of_one_value_stay_linked(spark):
    a, b, c, d = (re.sub(r"\D", "", x)[-10:] for x in replaced(spark, VALUES[12:16]))
    assert a == b == c == d
    x, y = (x.replace(" ", "") for x in replaced(spark, VALUES[16:18]))
    assert x == y and luhn(x) == 0
    lower, upper = replaced(spark, ["ann@mail.org", "ANN@Mail.ORG"])
    assert lower == upper
    iso, local, padded = replaced(spark, ["2020-03-04", "4/3/2020", "04.03.2020"])
    y, m, d = map(int, iso.split("-"))
    assert [*map(int, local.split("/"))] == [d, m, y] == [*map(int, padded.split("."))] and len(padded) == 10


def test_phones_in_any_grouping(spark):
    cases = [("+33 1 42 68 53 00", "33"), ("+33 6 12 34 56 78", "33"), ("+33 (0)6 12 34 56 78", "33"), ("+49 151 12 34 56 78", "49"), ("+49 (0)30/1234567", "49"), ("+358 40 123 4567", "358"), ("415 555 2671", "")]
    texts, want = [], []
    for phone, country in cases:
        digits = re.sub(r"\D", "", phone.replace("(0)", ""))
        new = country + string(digits[len(country):], "phone") if country else re.sub(r"\D", "", expected("415-555-2671"))
        spelled = fill(phone.replace("(0)", "(o)"), new, "0-9").replace("(o)", "(0)")
        texts += [f"call {phone}, x", f"call +{digits if country else '1' + digits}, x", f"call {phone} 4524132264652876 2020-02-29"]
        want += [f"call {spelled}, x", f"call +{new if country else '1' + new}, x", f"call {spelled} {expected('4524132264652876')} {expected('2020-02-29')}"]
    assert replaced(spark, texts) == want


def test_ibans_end_at_their_country_s_length(spark):
    ibans = ["ES91 2100 0418 4502 0005 1332", "BE68 5390 0754 7034", "AT61 1904 3002 3457 3201", "GB82 WEST 1234 5698 7654 32", "FR14 2004 1010 0505 0001 3M02 606"]
    tails = ["", " BIC CAIXESBB", " 2020", " EUR 12", " ES91 2100 0418 4502 0005 1332"]
    got = replaced(spark, [f"to {i}{t}" for i in ibans for t in tails])
    assert got == [f"to {expected(i)}{' ' + expected(t[1:]) if len(t) > 20 else t}" for i in ibans for t in tails]


def test_permutations_are_bijections():
    for a, b in ((189, 773), (7, 3), (1, 5)):
        seen = {pair(l, r, a, b, "date") for l in range(a) for r in range(b)}
        assert len(seen) == a * b
        assert all(pair(*pair(l, r, a, b, "date"), a, b, "date", back=True) == (l, r) for l in range(0, a, 9) for r in range(0, b, 7))
    assert len({string(f"{i:03}", "card") for i in range(1000)}) == 1000


@pytest.mark.parametrize("text", ["4524132264652877", "000-12-3456", "666-12-3456", "2020-02-30", "256.1.1.1", "1.2.3.4.5", "GB83 WEST 1234 5698 7654 32", "v1.2.3", "12345", "a@b", "user@", "99/99/2020", "nothing"])
def test_invalid_values_stay(spark, text):
    assert replaced(spark, [text, f"x {text} y"]) == [text, f"x {text} y"]


def test_pseudonym_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    df = op3_pseudonyms(spark, FOLDER)
    assert not python_nodes(df)
    whole = re.compile("|".join(f"(?:{pseudonyms.PATTERNS[k]})" for k in ("email", "ip", "phone")) + r"|(?<![\w.+-])\d{16}(?![\w-]|\.\d)")
    n = 0
    for r in df.collect():
        pieces = [m.group() for m in whole.finditer(docs[r.doc_id]) if not re.fullmatch(r"\d{16}", m.group()) or luhn(m.group()) == 0]
        assert all(p not in r.text for p in pieces)
        n += len(pieces)
    assert n > 20


def test_pseudonyms_awkward_rows(spark):
    docs = awkward(spark)
    out = pseudonyms.pseudonymise(docs, KEY)
    assert out.schema.simpleString() == docs.schema.simpleString()
    assert Counter(map(tuple, out.collect())) == Counter(map(tuple, docs.collect()))
    assert pseudonyms.pseudonymise(empty(spark), KEY).count() == 0


# ── chat ────────────────────────────────────────────────────────────────────


def test_escapes_are_reversible(spark):
    texts = ["", "\\", "\\\\", "\\0;", "[INST]", "[IN[INST]ST]", "</s>[INST] ok [/INST]", "<<SYS>> <</SYS>>\\4;", "a\\[OUT]b", "<s></s", None, "\\\\1;<s>"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escaped(F.col("t")).alias("e"), chat.unescaped(chat.escaped(F.col("t"))).alias("u")).collect()
    for r in rows:
        assert r.u == (r.t or "") and not any(c in r.e for c in chat.TEMPLATE.controls)


def test_chat_query(spark):
    turns = {}
    for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect():
        turns.setdefault(r.conv_id, []).append((r.turn, r.role, r.text or ""))
    turns[-7] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    df = op8_chat_format(spark, SMALL)
    assert not python_nodes(df)
    rows = df.collect()
    assert {r.conv_id for r in rows} == set(turns)
    for r in rows:
        own = sorted(turns[r.conv_id])
        learned = "".join(t for _, role, t in own if role == "assistant")
        assert r.n_turns == len(own) and r.loss_chars == len(learned) and r.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in own).encode()).hexdigest()


def test_turn_order_machine(spark):
    talks = {"u": True, "ua": True, "sua": True, "suau": True, "a": False, "uu": False, "us": False, "ss": False, "s": False, "sa": False, "uax": False}
    names = {"u": "user", "a": "assistant", "s": "system", "x": "tool"}
    rows = [(i, k, names[c], f"{c}{k}") for i, t in enumerate(talks) for k, c in enumerate(t)]
    got = {r.conv_id: r for r in chat.chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [got[i].valid for i in range(len(talks))] == list(talks.values())
    assert (got[4].broken_at, got[5].broken_at, got[10].broken_at, got[0].broken_at) == (0, 1, 2, None)


def test_chat_awkward_rows(spark):
    rows = [(1, None, "user", "late"), (1, 0, None, None), (1, 0, None, None), (1, 2, "to[INST]ol", "a</s>"), (None, 0, "user", "x"), (2, 1, "assistant", "<s>" * 5000)]
    made = chat.chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).withColumn("back", chat.read_back(chat.formatted(F.col("segments"))))
    got = {r.conv_id: [tuple(x) for x in r.back] for r in made.collect()}
    assert got == {1: [("user", "late"), ("", ""), ("", ""), ("to[INST]ol", "a</s>")], None: [("user", "x")], 2: [("assistant", "<s>" * 5000)]}
    assert chat.chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string, segments int")).count() == 0


def test_long_texts_of_any_kind_end_soon(spark):
    """A million characters of labels, dots, digits and separators neither exhaust the stack nor take long; half of it about half."""
    import time

    units = ["a.", "a@", "x@a.", "1.", "12/", "+1", "+33 1 ", "(1)", "1-", "12-34-", "FR14 ", "FR76 3000 ", "4111 ", "4111-", "192.168.", "é.", "%+-._", "A1", " ", "-"]

    def seconds(n):
        texts = {i: "x@" + u * (n // len(u)) + "1" for i, u in enumerate(units)}
        docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(8)
        start = time.time()
        out = {r.doc_id: r.n for r in pseudonyms.pseudonymise(docs, "key").select("doc_id", F.length("text").alias("n")).collect()}
        assert all(out[i] >= len(t) // 2 for i, t in texts.items())
        return time.time() - start

    seconds(1000)
    half, whole = seconds(500_000), seconds(1_000_000)
    assert whole < 3 * half + 10


def test_addresses_of_many_labels(spark):
    texts = ["x@" + "a." * n + "com" for n in (1, 50, 120, 126, 2000, 6000)] + ["a" * 64 + "@b.org", "a" * 65 + "@b.org", "me x@a.com...then", "x@a..com", "x@a.com1", "x@a.com."]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.text != texts[r.doc_id], r.text) for r in pseudonyms.pseudonymise(rows, "key").collect()}
    assert [got[i][0] for i in range(12)] == [True, True, True, True, False, False, True, False, True, False, True, True]
    assert got[8][1].endswith(".com...then") and got[8][1].startswith("me ") and got[11][1].endswith(".com.")
