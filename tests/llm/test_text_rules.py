"""Fertility, fingerprints and language identification against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import fertility, language_id, merkle
from corpusloom.llm.batches import text_slices
from corpusloom.llm.queries import PIECES, RANKS, held_out, op2_tokeniser_fertility, op7_merkle_fingerprints, op9_language_id
from corpusloom.llm.vocabulary import Ranks

from ..conftest import SMALL
from .cases import awkward, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ── fertility ───────────────────────────────────────────────────────────────


def brute_counts(text):
    words = WORD.findall(text)
    windows = [tuple(words[i: i + 5]) for i in range(len(words) - 4)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    marked = {k for i, w in enumerate(windows) if w in twice for k in range(i, i + 5)}
    seen, repeats = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeats += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeats, len(marked)


@pytest.mark.parametrize("text", ["", " ", "a", "a b c d e a b c d e", "x " * 40, "l\nl\nl\n\n \n \nm", "a\x1cb c\x85d\xa0e", "a\vb\fc\rd", "#*$%&|<> é#", "a b c d e f " * 2 + "a b c d e"])
def test_base_counts(text):
    assert fertility.base_counts(text, Counter(text)) == brute_counts(text)


def test_random_base_counts():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(["a ", "b ", "c", " ", "\n", "#", "é"]) for _ in range(rng.randrange(120)))
        assert fertility.base_counts(text, Counter(text)) == brute_counts(text)


def test_fertility_query(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    with open(public_tokenizers.path(RANKS), "rb") as f:
        codec = Ranks(f.read(), public_tokenizers.PATTERN).codec
    rows = op2_tokeniser_fertility(spark, SMALL).collect()
    assert len(rows) == len(docs) and any(r.base_failed for r in rows) and any(r.kept for r in rows)
    for r in rows:
        t = docs[r.doc_id].text
        want = brute_counts(t)
        assert tuple(r[1:6]) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.base_failed and r.kept)
        ids = codec.encode_ordinary(t)
        assert r.n_tokens == len(ids) and math.isclose(r.chars_per_token, len(t) / len(ids))
        share = [n / len(ids) for n in Counter(ids).values()]
        assert math.isclose(r.entropy, -sum(p * math.log2(p) for p in share) / math.log2(min(len(ids), codec.n_vocab)))


def test_bands_reject_what_no_tokeniser_can_use(spark):
    rng = random.Random(2)
    blob = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(4000))
    strange = "".join(chr(rng.randrange(0x1E900, 0x1E943)) for _ in range(300)) + " a b c"
    texts = [(0, "The committee met on Tuesday and agreed on a plan for the coming year. " * 3, "en"), (1, blob, "en"), (2, "spam " * 500, "en"), (3, strange, None), (4, "あいうえお、今日はとても良い天気ですから、" * 6, "ja"), (5, "short", "en")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    bands = fertility.Bands(scripts={**fertility.Bands().scripts, "ADLAM": fertility.Band(fallback_share=(0.0, 0.25))})
    got = {r.doc_id: (r.in_band, r.script) for r in fertility.measure(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, public_tokenizers.path(PIECES), bands).collect()}
    assert got == {0: (True, "LATIN"), 1: (False, "LATIN"), 2: (False, "LATIN"), 3: (False, "ADLAM"), 4: (True, "HIRAGANA"), 5: (True, "LATIN")}


def test_fertility_awkward_rows(spark):
    args = (public_tokenizers.path(RANKS), public_tokenizers.PATTERN, public_tokenizers.path(PIECES))
    rows = fertility.measure(awkward(spark), *args).collect()
    assert len(rows) == 13 and all(r.in_band for r in rows if r.n_tokens < 50) and all(r.n_words == 0 for r in rows if r.doc_id in (3, 4, 5, 10))
    assert fertility.measure(empty(spark), *args).count() == 0


# ── fingerprints ────────────────────────────────────────────────────────────


def test_fingerprint_query(spark):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    got = {r.doc_id: r for r in op7_merkle_fingerprints(spark, SMALL).collect()}
    assert set(got) == {i for i, _ in docs}
    roots = {}
    for (i, t), (_, u) in zip(docs, docs[1:] + docs[:1]):
        r, k = got[i], len(t) // 4
        new = t[: len(t) - k] + u[:k]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert r.fingerprint == merkle.tree(t).root.hex() and r.edited_fingerprint == merkle.tree(new).root.hex()
        assert math.isclose(r.near_edited, merkle.likeness(merkle.tree(t), merkle.tree(new))) and math.isclose(r.near_next, merkle.likeness(merkle.tree(t), merkle.tree(u)))
        assert 0 <= r.near_next <= 1 and (r.near_edited > 0.5 or len(t) < 100)
        assert t[: r.edit_start] == new[: r.edit_start] and (r.edit_end <= r.n_chars)
        roots.setdefault(t, set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in roots.values()) and len(set().union(*roots.values())) == len(roots)


def test_blocks_do_not_change_the_result(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = sorted(map(tuple, merkle.fingerprints(docs).collect()))
    monkeypatch.setattr(merkle, "BLOCK_BYTES", 20_000)
    assert sorted(map(tuple, merkle.fingerprints(docs.repartition(5)).collect())) == want


def test_trees_locate_edits():
    text = "First one. Second one.\nA line. Another.\n\nNext section here. It ends."
    for old, new in (("Second", "Changed"), ("Another", "Other"), ("Next", "New"), ("First", "1st"), ("It ends.", "")):
        a, b = merkle.tree(text), merkle.tree(text.replace(old, new))
        start, end = merkle.differing(a, b)
        assert start <= text.index(old) and text.index(old) + len(old) <= end and end - start < 25
        assert 0.5 < merkle.likeness(a, b) < 1
    assert merkle.likeness(merkle.tree(""), merkle.tree("")) == 1.0 and merkle.likeness(merkle.tree("a"), merkle.tree("b")) == 0.0
    assert "".join(merkle.leaves_of("word " * 5000)) == "word " * 5000


def test_fingerprint_awkward_rows(spark):
    rows = merkle.fingerprints(awkward(spark)).collect()
    assert len(rows) == 13 and rows[0].doc_id is None
    assert len({r.fingerprint for r in rows if r.doc_id in (3, 4, 10)}) == 1
    assert merkle.fingerprints(empty(spark)).count() == 0
    one = merkle.fingerprints(awkward(spark).where("doc_id = 7")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


# ── language ID ─────────────────────────────────────────────────────────────


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op9_language_id(spark, folder).collect()
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert 0.2 < len(held) / len(rows) < 0.3
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) / len(held) > 0.97


def test_filters_return_every_language_of_a_gram(spark):
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 1 << 62, 20_000, dtype=np.uint64)
    masks = rng.integers(1, 16, 20_000, dtype=np.uint64)
    f = language_id.Filter.empty(["a", "b", "c", "d"], "a", 1 << 18)
    f.add(codes, masks)
    assert ((f.masks(codes)[0] & masks.astype(np.uint8)) == masks).all()
    strange = f.masks(rng.integers(0, 1 << 62, 20_000, dtype=np.uint64))[0]
    for k in range(4):
        assert abs(((strange >> k) & 1).mean() - f.p[k]) < 0.01


def test_grams_match_a_plain_walk():
    texts = ["", "a", "Ab, c!", "  x  ", "é9z", "one two"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    want = Counter()
    for i, b in enumerate(raw):
        s = b" " + bytes(c | 32 if c < 128 and chr(c).isalpha() else c if c >= 128 else 32 for c in b) + b" "
        s = re.sub(rb" +", b" ", s)
        for n in language_id.ORDERS:
            want.update((i, n, s[k: k + n]) for k in range(len(s) - n + 1))
    got = Counter()
    for codes, owner in language_id.grams(data, offsets):
        for c, o in zip(codes.tolist(), owner.tolist()):
            n = c >> 56
            got[(o, n, (c & ((1 << 56) - 1)).to_bytes(7, "little")[:n])] += 1
    assert got == want


def test_more_languages_than_a_mask_holds(spark):
    """130 languages of words of their own are told apart, as a plain count of the n-grams of each would."""
    rng = random.Random(4)
    words = {f"l{k:03d}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(40)] for k in range(130)}
    rows = [(i, " ".join(rng.choices(words[name], k=30)), name) for i in range(4) for name in words]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), language_id.Fit(most_grams=1 << 17, slots=1 << 18))
    assert [t.dtype for t in model.tables] == [np.uint64, np.uint64, np.uint8]
    asked = [(i, " ".join(rng.choices(words[name], k=12)), name) for i, name in enumerate(words)]
    got = language_id.predict(spark.createDataFrame(asked, "doc_id long, text string, lang string"), model, keep=("lang",)).collect()
    assert all(r.lang_pred == r.lang for r in got) and len(got) == 130


def test_decisions_against_plain_sets(spark):
    """Training and decision by dictionaries: counts, contrast, and shares of n-grams, which the filter may exceed by chance only."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("text is not null")
    rows = [(r.text, r.lang) for r in docs.collect()]
    model = language_id.train(docs)

    def walk(text):
        low = bytes(b | 32 if chr(b).isascii() and chr(b).isalpha() else b if b >= 128 else 32 for b in text.encode())
        low = re.sub(rb" +", b" ", b" " + low + b" ")
        return [low[i: i + n] for n in language_id.ORDERS for i in range(len(low) - n + 1)]

    names = sorted({lang for _, lang in rows if lang})
    counts = {name: Counter(g for t, lang in rows if lang == name for g in walk(t)) for name in names}
    totals = {name: sum(c.values()) for name, c in counts.items()}
    known = {}
    for g in set().union(*counts.values()):
        top = max(counts[n][g] / totals[n] for n in names)
        known[g] = {n for n in names if counts[n][g] >= 3 and counts[n][g] / totals[n] >= 0.05 * top}
    told = {r.text: r for r in language_id.predict(docs, model, keep=("text",)).collect()}
    for text, _ in rows:
        found = walk(text)
        if not re.search(r"[^\W\d_]", text):
            assert told[text].lang_pred == "und"
            continue
        assert told[text].n_grams == len(found)
        share = {n: sum(n in known[g] for g in found) / len(found) for n in names}
        best = max(share.values())
        assert share[told[text].lang_pred] >= best - 0.02
        assert told[text].share == pytest.approx(best, abs=0.02)


def test_language_awkward_rows(spark):
    docs = awkward(spark)
    model = language_id.train(docs)
    rows = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (3, 4, 5, 9, 10))
    assert all(rows[i].lang_pred in ("de", "en") for i in (1, 6, 7, 8, 11, None))
    nothing = language_id.train(empty(spark))
    assert language_id.predict(docs, nothing).where("lang_pred <> 'und'").count() == 0
    assert language_id.predict(empty(spark), model).count() == 0


def test_held_out_rule(spark):
    import zlib

    rows = spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)


def test_slices_hold_every_row_once():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"k": list(range(7)), "t": ["a" * 5, None, "b" * 100, "", "c", "d" * 9, "e"]})
    parts = list(text_slices(batch, "t", 10))
    assert [x for p in parts for x in p.column("k").to_pylist()] == list(range(7)) and max(p.num_rows for p in parts) < 7
