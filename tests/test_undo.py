"""Parallel undo replay against a direct fold."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import undo

EDIT = "session long, ts long, event_id long, op string, label string"


def fold(ops, limit):
    past, redo = [], 0
    for op, label in ops:
        if op == "push":
            past, redo = [*past, label][-limit:] if limit else [*past, label], 0
        elif op == "undo" and past:
            past.pop()
            redo += 1
        elif op == "redo" and redo:
            past.append("")
            redo -= 1
        elif op == "clear":
            past, redo = [], 0
    return len(past), redo, past[-1] if past else ""


def replayed(spark, sessions, limit, block):
    rows = [(s, i, i, op, label) for s, ops in sessions.items() for i, (op, label) in enumerate(ops)]
    out = undo.replay(spark.createDataFrame(rows, EDIT), F.floor(F.col("ts") / block).cast("long"), limit)
    return {r.session: (r.depth, r.redo, r.label) for r in out.collect()}


def test_limit_and_redo_branch(spark):
    pushes = [("push", f"e{i}") for i in range(201)]
    sessions = {1: pushes, 2: pushes + [("undo", "")] * 250, 3: [("push", "a"), ("undo", ""), ("push", "b"), ("redo", "")],
                4: [("push", "a"), ("push", "b"), ("undo", ""), ("redo", "")], 5: [("push", "a"), ("clear", "")]}
    got = replayed(spark, sessions, undo.UNDO_LIMIT, 50)
    assert got == {1: (200, 0, "e200"), 2: (0, 200, ""), 3: (1, 0, "b"), 4: (2, 0, ""), 5: (0, 0, "")}


def test_no_limit(spark):
    pushes = [("push", f"e{i}") for i in range(10_000)]
    sessions = {1: pushes, 2: pushes + [("undo", "")] * 9_000, 3: pushes + [("undo", "")] * 12_000 + [("redo", "")] * 3, None: pushes[:3]}
    got = replayed(spark, sessions, None, 100)
    assert got == {1: (10_000, 0, "e9999"), 2: (1_000, 9_000, "e999"), 3: (3, 9_997, ""), None: (3, 0, "e2")}


def mixed(rng, n):
    mixes = [(5, 3, 3, 0), (1, 5, 5, 0), (3, 6, 2, 0.2), (8, 1, 1, 0.1), (2, 4, 4, 0)]
    return [(rng.choices(["push", "undo", "redo", "clear"], rng.choice(mixes))[0], f"l{i}") for i in range(rng.randint(1, n))]


@pytest.mark.parametrize("limit, block, fan", [(3, 7, 1024), (5, 4, 2), (200, 11, 1024), (None, 6, 2), (None, 3, 3)])
def test_any_blocking_equals_a_direct_fold(spark, limit, block, fan, monkeypatch):
    monkeypatch.setattr(undo, "FAN", fan)
    rng = random.Random((limit or 0) * 100 + block)
    sessions = {s: mixed(rng, 80) for s in range(120)}
    assert replayed(spark, sessions, limit, block) == {s: fold(ops, limit) for s, ops in sessions.items()}


@pytest.mark.parametrize("limit", [None, 1, 3, 7])
def test_summaries_compose(limit):
    """A stretch, and the stretch of its pieces, give what a fold gives from every start."""
    rng = random.Random(limit or 0)
    codes = {"push": undo.PUSH, "undo": undo.UNDO, "redo": undo.REDO, "clear": undo.CLEAR}
    for _ in range(600):
        ops = [op for op, _ in mixed(rng, 40)]
        whole, part, pieces = undo.Stretch(limit), undo.Stretch(limit), []
        for op in ops:
            whole.step(codes[op])
            part.step(codes[op])
            if rng.random() < 0.2:
                pieces, part = [*pieces, part], undo.Stretch(limit)
        joined = undo.Stretch(limit)
        for p in [*pieces, part]:
            joined.then(undo.Stretch.of(*p.row()))
        for depth in range(limit + 1 if limit else 12):
            for redo in range((limit - depth if limit else 6) + 1):
                d, r = depth, redo
                for op in ops:
                    if op == "push":
                        d, r = min(d + 1, limit or d + 1), 0
                    elif op == "undo" and d:
                        d, r = d - 1, r + 1
                    elif op == "redo" and r:
                        d, r = d + 1, r - 1
                    elif op == "clear":
                        d, r = 0, 0
                assert whole.end(depth, redo) == joined.end(depth, redo) == (d, r)


def test_summaries_stay_short():
    """Twenty thousand steps of every kind are summarised in a few hundred numbers."""
    rng = random.Random(1)
    part = undo.Stretch()
    for _ in range(20_000):
        part.step(rng.choice([undo.PUSH, undo.UNDO, undo.UNDO, undo.REDO]))
    lead, _, runs, _, tail = part.row()
    assert len(lead) + len(runs) + len(tail) < 600
