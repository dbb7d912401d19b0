"""Near duplicates against all pairs."""

import random
import re

from corpusloom.llm import near_dedup
from corpusloom.llm.components import components

from ..conftest import SMALL
from .cases import awkward, empty


def brute(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = {tuple(w[k: k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def linked(docs, **near):
    return {r.id: (r.n_shingles, r.component) for r in near_dedup.link(docs, near_dedup.Near(**near)).collect()}


def test_small_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert linked(docs, width=4) == brute(rows, 4, 80)


def test_a_large_family_of_edited_copies(spark):
    """Hundreds of copies in one bucket, many of them just beyond the threshold from the base and from each other."""
    rng = random.Random(5)
    words = [f"w{rng.randrange(60)}" for _ in range(120)]
    rows = [(0, " ".join(words))]
    for i in range(1, 260):
        copy = list(words)
        for k in rng.sample(range(120), rng.randrange(9)):
            copy[k] = rng.choice(["the", "of", f"w{rng.randrange(60)}", f"new{rng.randrange(10**6)}"])
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert linked(docs, width=4) == brute(rows, 4, 80)


def test_chains_are_one_component(spark):
    """Each text is linked with the next one only."""
    words = [f"t{k}" for k in range(400)]
    rows = [(i, " ".join(words[i * 4: i * 4 + 60])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert linked(docs) == brute(rows, 5, 80)
    assert {c for _, c in linked(docs).values()} == {0}


def test_awkward_rows(spark):
    got = near_dedup.link(awkward(spark), near_dedup.Near(width=4)).collect()
    assert len(got) == 13
    by = {}
    for r in got:
        by.setdefault(r.id, []).append((r.n_shingles, r.component, r.kept))
    assert by[1] == [(7, 1, True)] and by[2] == [(7, 1, False)] and by[11] == [(7, 1, False)]
    assert by[3] == [(0, 3, True)] and by[4] == [(0, 4, True)] and by[5] == [(0, 5, True)] and by[10] == [(0, 10, True)]
    assert by[8] == [(1, 8, True)] * 2 and by[None] == [(2, None, True)] and by[7] == [(1, 7, True)]
    assert near_dedup.link(empty(spark)).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, k) for k in range(1001, 1300)] + [(k, k + 1) for k in range(2000, 2050)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    want = {x: find(x) for x in list(root)}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: c for x, c in want.items() if x != c}


def test_one_id_with_several_texts(spark):
    """A link between single rows stands even where an exact copy of each is headed by an id that has other texts, too."""
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    c = " ".join(f"c{k}" for k in range(60))
    rows = [(5, a), (5, b), (5, c), (9, a), (10, a + " x"), (11, b), (12, b + " y"), (13, c + " z"), (20, "nothing like it at all here"), (None, a), (5, a)]
    got = near_dedup.link(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r.id, r.component) for r in got.collect()} == {(5, 5), (9, 5), (10, 5), (11, 5), (12, 5), (13, 5), (20, 20), (None, None)}
    assert got.count() == len(rows)
