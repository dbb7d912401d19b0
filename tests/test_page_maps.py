"""Page maps against one page at a time, for any cut into blocks and for a long history."""

import random

import numpy as np
import pytest

from corpusloom.operators import sequences
from corpusloom.operators.ordered import ordinal_block

EDIT = "doc long, seq long, op string, at long, to long"


def step(page, op, at, to):
    if page is None:
        return None
    if op == "delete":
        return None if page == at else page - (page > at)
    if op == "insert":
        return page + (page > at)
    lifted = page - (page > at)
    return to if page == at else lifted + (lifted >= to)


def script(rng, n, pages):
    return [(rng.choice(["delete", "insert", "move"]), rng.randint(0, pages), rng.randint(0, pages)) for _ in range(n)]


def test_maps_compose():
    rng = random.Random(1)
    for _ in range(300):
        edits = script(rng, rng.randrange(12), 9)
        whole = sequences.PageMap()
        for e in edits:
            whole = whole.then(sequences.PageMap.of(*e))
        now, gone = whole(np.arange(-3, 25))
        for k, page in enumerate(range(-3, 25)):
            want = page
            for e in edits:
                want = step(want, *e)
            assert (None if gone[k] else now[k]) == want


@pytest.mark.parametrize("size", [1, 4, 1024])
def test_any_blocks(spark, size):
    rng = random.Random(size)
    edits = {d: script(rng, rng.randrange(1, 30), 12) for d in range(20)}
    marks = [(d, i, rng.randint(1, 14)) for d in range(25) for i in range(6)] + [(1, 99, None)]
    table = spark.createDataFrame([(d, k, *e) for d, es in edits.items() for k, e in enumerate(es)], EDIT)
    got = sequences.remap_pages(spark.createDataFrame(marks, "doc long, mark long, page long"), table, block=ordinal_block("seq", size))
    want = []
    for d, i, page in marks:
        for e in edits.get(d, []):
            page = step(page, *e)
        want += [(d, i, page)] if page is not None else []
    assert sorted((r.doc, r.mark, r.page) for r in got.collect()) == sorted(want)


def test_a_long_history_is_many_maps(spark):
    """Fifty thousand edits of one document."""
    rng = random.Random(3)
    edits = [(rng.choice(["insert", "move", "move"]) if k % 3 else "delete", rng.randint(1, 2000), rng.randint(1, 2000)) for k in range(50_000)]
    table = spark.createDataFrame([(7, k, *e) for k, e in enumerate(edits)], EDIT)
    marks = spark.createDataFrame([(7, i, i) for i in range(1, 2000, 97)], "doc long, mark long, page long")
    want = {}
    for i in range(1, 2000, 97):
        page = i
        for e in edits:
            page = step(page, *e)
        if page is not None:
            want[i] = page
    assert {r.mark: r.page for r in sequences.remap_pages(marks, table).collect()} == want
