"""Byte-level BPE against the library that defines it, and exact round trips."""

import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import byte_bpe
from corpusloom.llm.queries import RANKS, op10_byte_bpe
from corpusloom.llm.vocabulary import Ranks

from ..conftest import SMALL
from .cases import awkward, empty

PATH, PATTERN = public_tokenizers.path(RANKS), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as f:
        return Ranks(f.read(), PATTERN)


PIECES = ["a", "Z", "9", "10", " ", "  ", "\n", "\t", " ", " ", "'", "'s", "'re", "'l", "l", "!", "...", "%%%", "é", "ß", "中", "文", "🙂", "é", "\x1c", "\x85", "-", "_", "the", "tion"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PIECES), st.characters(blacklist_categories=["Cs"])), max_size=60), st.integers(1, 9))
def test_any_leaf_gives_the_same_tokens(ranks, parts, leaf):
    text = "".join(parts)
    ids = byte_bpe.encode_text(ranks.codec, ranks.sizes, text, leaf=leaf)
    assert ids == ranks.codec.encode_ordinary(text)


@pytest.mark.parametrize("alphabet", ["ab", "aB3", "x'", "ab ", "中文", "a\n ", "'s're ", "12a!"])
def test_long_runs(ranks, alphabet):
    rng = random.Random(alphabet)
    text = "".join(rng.choice(alphabet) for _ in range(20_000))
    assert byte_bpe.encode_text(ranks.codec, ranks.sizes, text) == ranks.codec.encode_ordinary(text)


def test_query(spark, ranks):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = op10_byte_bpe(spark, SMALL).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = ranks.codec.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_awkward_rows(spark, ranks):
    docs = awkward(spark)
    rows = byte_bpe.decode(byte_bpe.encode(docs, PATH, PATTERN), PATH, PATTERN)
    assert rows.columns == [*docs.columns, "ids", "decoded"]
    for r in rows.collect():
        assert r.ids == ranks.codec.encode_ordinary(r.text or "") and bytes(r.decoded).decode() == (r.text or "")
    assert sorted(map(str, byte_bpe.round_trip(docs, PATH, PATTERN).collect())) == sorted(map(str, rows.collect()))
    assert byte_bpe.encode(empty(spark), PATH, PATTERN).count() == 0 and byte_bpe.round_trip(empty(spark), PATH, PATTERN).count() == 0
