"""Points of erased strokes and simplified paths, however they are cut into blocks, against a walk."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import sequences

POINT = "path long, seq long, x double, y double, erased boolean, closed boolean"


def drifting(rng, n):
    x = y = 0.0
    out = []
    for i in range(n):
        x += rng.choice([0, 0, 3e-8, 3e-8, 6e-8, 1.0])
        y += rng.choice([0, 0, 0, 4e-8, -1.0])
        out.append((x, y, rng.random() < 0.3))
    return out + ([(0.0, 5e-8, False)] if rng.random() < 0.5 else [])


def walk(points, closed):
    kept = []
    for i, (x, y, _) in enumerate(points):
        if not kept or abs(x - kept[-1][1]) >= 1e-7 or abs(y - kept[-1][2]) >= 1e-7:
            kept.append((i, x, y))
    if closed and len(kept) > 1 and abs(kept[0][1] - kept[-1][1]) < 1e-7 and abs(kept[0][2] - kept[-1][2]) < 1e-7:
        kept.pop()
    return kept


def pieces(points):
    runs, run = [], []
    for i, (_, _, gone) in enumerate(points):
        if gone:
            runs, run = [*runs, run], []
        else:
            run.append(i)
    runs.append(run)
    touched = any(p[2] for p in points)
    return {(k, i) for k, r in enumerate(runs) if len(r) > 1 or not touched for i in r}


@pytest.mark.parametrize("size", [3, 7, 1000])
def test_any_blocks(spark, size):
    rng = random.Random(size)
    paths = {p: drifting(rng, rng.randint(1, 40)) for p in range(60)}
    rows = [(p, i, x, y, gone, p % 2 == 0) for p, pts in paths.items() for i, (x, y, gone) in enumerate(pts)]
    points, block = spark.createDataFrame(rows, POINT), F.floor(F.col("seq") / size).cast("long")
    got = {(r.path, r.seq, r.x, r.y) for r in sequences.kept_points(points, ["path"], block, ["seq"]).collect()}
    assert got == {(p, *k) for p, pts in paths.items() for k in walk(pts, p % 2 == 0)}
    kinds = {r.path: (r.n_points, r.kind) for r in sequences.simplify_paths(points, ["path"], block, ["seq"]).collect()}
    assert all(kinds[p] == (n, "none" if n < 2 else "line" if n == 2 else "polyline") for p, n in ((p, len(walk(pts, p % 2 == 0))) for p, pts in paths.items()))
    left = {(r.path, r.island, r.seq) for r in sequences.surviving_points(points, ["path"], block, ["seq"]).collect()}
    assert left == {(p, *k) for p, pts in paths.items() for k in pieces(pts)}
