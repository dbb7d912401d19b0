"""Blocks inside blocks: shared children, cycles and very many copies against a direct walk."""

import random

import pytest

from corpusloom.operators.lookups import MOST_COPIES, expand_blocks

INSERT = "block long, child long, cols long, rows long"


def walked(inserts, root):
    out = {}

    def visit(block, n, path):
        copies, depth = out.get(block, (0, len(path)))
        out[block] = (copies + n, min(depth, len(path)))
        for b, child, cols, rows in inserts:
            if b == block and child != block and child not in path:
                visit(child, n * cols * rows, [*path, block])

    visit(root, 1, [])
    return out


def expanded(spark, inserts, root, **how):
    return {r.block: (int(r.copies), r.depth, r.saturated) for r in expand_blocks(spark.createDataFrame(inserts, INSERT), root, **how).collect()}


@pytest.mark.parametrize("seed", range(4))
def test_any_graph_equals_a_walk(spark, seed):
    rng = random.Random(seed)
    nodes = 7
    pairs = {(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(11 + seed)}
    pairs = [p for p in pairs if seed or p[0] < p[1]]  # the first has no cycle
    inserts = [(a, b, rng.randint(1, 3), rng.randint(1, 2)) for a, b in pairs] + [(0, 1, 1, 1), (0, 1, 2, 1)]
    got = expanded(spark, inserts, 0)
    assert {b: v[:2] for b, v in got.items()} == walked(inserts, 0)


def test_a_ladder_of_shared_levels_is_a_row_a_block(spark):
    """Two blocks a level, each inside both of the level above: 2**40 paths, 81 rows."""
    inserts = [(0, 1, 1, 1), (0, 2, 1, 1)] + [(2 * k - 1 + i, 2 * k + 1 + j, 1, 1) for k in range(1, 40) for i in (0, 1) for j in (0, 1)]
    got = expanded(spark, inserts, 0, levels=10)
    assert len(got) == 81 and got[79] == (2**39, 40, False)


def test_copies_saturate(spark):
    inserts = [(k, k + 1, 10_000, 10_000) for k in range(6)] + [(0, 100, 1 << 62, 1 << 62)]
    got = expanded(spark, inserts, 0)
    assert got[4] == (10**32, 4, False) and got[5][0] == MOST_COPIES and got[5][2] and got[6][2] and got[100][2]


def test_large_arrays_are_flagged_and_counted(spark):
    rows = expand_blocks(spark.createDataFrame([(0, 1, 200, 100), (1, 2, 2, 1), (0, 2, 1, 1)], INSERT), 0, most_copies=10_000).collect()
    assert sorted((r.block, r.status, int(r.copies)) for r in rows) == [(0, "ok", 1), (1, "refused", 20_000), (2, "ok", 40_001)]
