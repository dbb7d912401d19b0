"""Codes and hard negatives against full searches."""

import hashlib

import numpy as np
import pytest

from corpusloom.llm import hard_negatives as hard
from corpusloom.llm import vector_codes as codes

SCHEMA = "vec_id long, embedding array<float>, label int, id string, q int, row string, code string, slot int, low int"
NAN, INF = float("nan"), float("inf")


def vectors(spark, n=240, width=32, seed=1, kinds=5):
    """Loose clusters, many copies of one vector, near copies, and rows that can't be used."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.1, (kinds, width))
    x = centres[rng.integers(0, kinds, n)] + rng.normal(0, 0.05, (n, width))
    x[n // 2: n // 2 + n // 3] = x[0]
    x[-5:] = x[1] + 0.004
    rows = [(int(i), [float(v) for v in np.float32(r)], int(k)) for i, r, k in zip(rng.permutation(n), x, rng.integers(0, kinds, n), strict=True)]
    rows += [(n + 1, None, 1), (n + 2, [NAN] * width, 1), (n + 3, [INF] + [0.0] * (width - 1), 2), (n + 4, [None] + [0.0] * (width - 1), 2), (n + 5, rows[3][1], None), (n + 6, rows[4][1][:7], 3), (n + 7, [], 4), rows[7], rows[7], (None, rows[9][1], 2), (0, rows[11][1], 1)]
    return spark.createDataFrame([(*r, "clash", 1, "clash", "clash", 2, 3) for r in rows], SCHEMA).repartition(3), rows


def usable(rows, width):
    for i, v, k in rows:
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            yield i, np.array([int(np.floor(256 * float(x))) for x in v] + [0] * (width - len(v)), np.int64), k


def coded(rows, how, width):
    kept = sorted(usable(rows, width), key=lambda r: (r[0] is None, r[0] or 0, list(r[1])))
    span = width // how.parts
    x = np.array([r[1] for r in kept]).reshape(len(kept), how.parts, span)
    books = x[: how.entries].transpose(1, 0, 2).copy()

    def away():
        return [((x[:, p, None] - books[p][None]) ** 2).sum(2) for p in range(how.parts)]

    for _ in range(how.rounds):
        at = [d.argmin(1) for d in away()]
        for p in range(how.parts):
            for e in range(books.shape[1]):
                if (at[p] == e).any():
                    books[p, e] = x[at[p] == e, p].sum(0) // (at[p] == e).sum()
    d = away()
    digest = hashlib.sha256(",".join(str(v) for v in books.ravel()).encode()).hexdigest()
    errors = sum(v.min(1) for v in d)
    total = {}
    for (_, _, k), e in zip(kept, errors, strict=True):
        total[k] = total.get(k, 0) + int(e)
    return sorted(((i, k, "".join(f"{d[p][n].argmin():02x}" for p in range(how.parts)), int(errors[n]), total[k]) for n, (i, _, k) in enumerate(kept)), key=str), digest


@pytest.mark.parametrize(("entries", "pivots", "parts"), [(64, 4, 16), (7, 1, 4), (200, 300, 8)])
def test_codes(spark, entries, pivots, parts):
    how = codes.Codes(parts=parts, entries=entries, pivots=pivots)
    table, rows = vectors(spark)
    got = codes.encode(table, how).collect()
    want, digest = coded(rows, how, 32)
    assert sorted(((r.vec_id, r.label, r.code, r.error, r.label_error) for r in got), key=str) == want
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_bounds_leave_out_most_entries():
    rng = np.random.default_rng(3)
    x, entries = rng.integers(-100, 100, (500, 4)), rng.integers(-100, 100, (64, 4))
    pivots = codes.spread(entries, 4)
    at, best, seen = codes.nearest(x, codes.squares(x, pivots), entries, pivots)
    full = codes.squares(x, entries)
    assert (at == full.argmin(1)).all() and (best == full.min(1)).all()
    assert seen.mean() < 16


def test_codes_of_large_components_are_exact():
    rng = np.random.default_rng(4)
    x, entries = rng.integers(-(1 << 22), 1 << 22, (200, 4)), rng.integers(-(1 << 22), 1 << 22, (20, 4))
    x[:50], entries[10:] = entries[0] + rng.integers(-1, 2, (50, 4)), entries[:10]  # ties and near ties
    pivots = codes.spread(entries, 3)
    at, best, _ = codes.nearest(x, codes.squares(x, pivots), entries, pivots)
    full = codes.squares(x, entries)
    assert (at == full.argmin(1)).all() and (best == full.min(1)).all()


def mined(rows, is_anchor, how, width):
    kept = [(n, i, q, k) for n, (i, q, k) in enumerate(usable(rows, width)) if k is not None]
    out = []
    for n, i, q, k in kept:
        if i is None or not is_anchor(i):
            continue
        scored = sorted((-int(q @ v), j is None, j or 0, m, label == k) for m, j, v, label in kept if m != n)
        positives = [s for s in scored if s[4]][: how.positives]
        for p in positives:
            fits = [s for s in scored if not s[4] and how.low * -p[0] <= 100 * -s[0] <= how.high * -p[0]][: how.negatives]
            out += [(i, None if p[1] else p[2], rank, None if s[1] else s[2], -p[0], -s[0]) for rank, s in enumerate(fits, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("how", [
    hard.Mine(), hard.Mine(leaf=2, base=1.1, least_rows=16, most_rows=64, most_anchors=7, together=3),
    hard.Mine(positives=2, negatives=9, low=10, high=150, leaf=4, base=2.0, least_rows=50, most_rows=50),
])
def test_negatives(spark, how):
    from pyspark.sql import functions as F

    table, rows = vectors(spark, seed=5)
    got = hard.mine(table, F.col("vec_id") % 4 == 0, F.col("label"), how).collect()
    assert sorted((tuple(r) for r in got), key=str) == mined(rows, lambda i: i % 4 == 0, how, 32)
    assert len(got) > 100


def test_tree_covers_its_points():
    q = np.random.default_rng(6).integers(-50, 50, (400, 8))
    q[100:200] = q[0]
    tree = hard.CoverTree(q, leaf=4, base=1.3)
    assert sorted(tree.order) == list(range(400))
    x = q[tree.order].astype(float)
    top = (q * q).sum(1).max()
    lifted = np.column_stack([x, np.sqrt(np.maximum(top - (x * x).sum(1), 0))])
    for (a, b), (first, end), centre, radius in zip(tree.spans, tree.children, tree.centres, tree.radii, strict=True):
        c = np.append(centre, np.sqrt(max(top - centre @ centre, 0)))
        assert np.sqrt(((lifted[a:b] - c) ** 2).sum(1)).max() <= radius + 1e-6
        if end:
            assert (tree.radii[first:end] <= radius / 1.3 + 1e-9).all()
            assert sum(tree.spans[first:end, 1] - tree.spans[first:end, 0]) == b - a


def test_search_of_clustered_rows_opens_few_nodes():
    rng = np.random.default_rng(7)
    q = np.floor(np.repeat(rng.normal(0, 100, (40, 16)), 50, 0) + rng.normal(0, 3, (2000, 16))).astype(np.int64)
    ids, labels = np.arange(2000), np.repeat(np.arange(40), 50)
    slot = hard.Slot(q, labels, ids, ids, hard.Mine())
    slot.x = slot.x.view(Counted)
    Counted.rows = 0
    b, _, score, at = slot.search(q[:10], labels[:10], ids[:10], np.full((10, 1), -hard.FAR), np.full((10, 1), hard.FAR), True, 5)
    for i in range(10):
        want = sorted((-int(q[i] @ q[j]), j) for j in range(2000) if j != i and labels[j] == labels[i])[:5]
        assert [(-s, slot.ids[p]) for s, p in zip(score[b == i], at[b == i], strict=True)] == want
    assert Counted.rows < 1000


class Counted(np.ndarray):
    rows = 0

    def __getitem__(self, k):
        Counted.rows += k.stop - k.start
        return np.asarray(self)[k]


def test_empty_tables(spark):
    from pyspark.sql import functions as F

    none = spark.createDataFrame([], SCHEMA)
    assert codes.encode(none).count() == 0
    assert hard.mine(none, F.col("vec_id") % 100 == 0, F.col("label")).count() == 0
    nulls = spark.createDataFrame([(1, None, None, "", 1, "", "", 1, 1)], SCHEMA)
    assert codes.encode(nulls).count() == 0
    assert hard.mine(nulls, F.col("vec_id") % 100 == 0, F.col("label")).count() == 0
    one = spark.createDataFrame([(100, [0.5], 3, "", 1, "", "", 1, 1)], SCHEMA)
    assert [(r.vec_id, r.code, r.error) for r in codes.encode(one).collect()] == [(100, "00" * 16, 0)]
    assert hard.mine(one, F.col("vec_id") % 100 == 0, F.col("label")).count() == 0
