"""Undo and redo of histories of any length, replayed in parallel.

A stretch of log is a function of where the history stood before it, and such
functions compose:

* until its first push, undo and redo swing between nothing and everything the
  history holds, and swings reduce to a short zigzag;
* a push drops the redo branch, so from there on the outcome depends on the
  depth ``h`` before that push alone. It is a number that holds for ``h = 0``,
  and one more for each of the ``h`` entries that isn't lost on the way. Lost
  entries are runs: undoing takes the first ones left, redoing gives the first
  ones back, and a limit loses all above it;
* the swings after the last push are a zigzag again.

So a session is cut into blocks, each block is read row by row into such a
summary, summaries are composed by the thousand, level by level, until one row a
session is left, and the levels are gone down again to find where each block
starts. The entry on top at the end was written by the last block that began or
went below it; blocks tell whether they wrote their own top, and only where
the last one didn't is one earlier block read again. A task holds a few rows of
a batch, a summary, and the labels its block has pushed; nothing is collected by
session.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .streamed import grouped, mapped

# ── fixed values ────────────────────────────────────────────────────────────
UNDO_LIMIT = 200  # of the editor this follows; pass it as ``limit`` to have its cut
PUSH, UNDO, REDO, CLEAR = 0, 1, 2, 3
# ────────────────────────────────────────────────────────────────────────────

#: Summaries composed into one.
FAN = 1024

SUMMARY = "lead array<bigint>, depth bigint, runs array<bigint>, open boolean, tail array<bigint>"


def swung(swings: list[int], step: int) -> None:
    """Add a step to signed swings and fold away what can't matter.

    A swing no longer than both its neighbours never meets a stop that they do
    not meet themselves.
    """
    if swings and (swings[-1] > 0) == (step > 0):
        swings[-1] += step
    else:
        swings.append(step)
    while len(swings) >= 3 and abs(swings[-2]) <= min(abs(swings[-1]), abs(swings[-3])):
        c, b, a = swings.pop(), swings.pop(), swings.pop()
        swings.append(a + b + c)


def moved(depth: int, redo: int, swings: Iterable[int]) -> tuple[int, int]:
    for s in swings:
        n = min(s, redo) if s > 0 else -min(-s, depth)
        depth, redo = depth + n, redo - n
    return depth, redo


class Runs:
    """Which entries, counted from the bottom, are kept: runs of (kept, length); those beyond the runs are kept if ``open``."""

    def __init__(self, runs: Iterable[tuple[bool, int]] = (), open: bool = True):
        self.runs: list[tuple[bool, int]] = []
        self.open = open
        for keep, n in runs:
            self.add(keep, n)

    def add(self, keep: bool, n: int) -> None:
        if n and self.runs and self.runs[-1][0] == keep:
            self.runs[-1] = (keep, self.runs[-1][1] + n)
        elif n:
            self.runs.append((keep, n))

    def flat(self) -> list[int]:
        """Lengths by turns, kept ones first."""
        out = [0] if self.runs and not self.runs[0][0] else []
        return out + [n for _, n in self.runs]

    @classmethod
    def of(cls, lengths: Iterable[int], open: bool) -> Runs:
        return cls(((i % 2 == 0, int(n)) for i, n in enumerate(lengths)), open)

    @classmethod
    def after(cls, swings: Iterable[int]) -> Runs:
        """What a history that could redo nothing keeps after swings."""
        up: list[tuple[bool, int]] = []  # the lowest run last
        for s in swings:
            left, taken, undo = abs(s), 0, s < 0
            while left and up:
                keep, n = up.pop()
                if keep == undo:
                    part = min(n, left)
                    left, taken = left - part, taken + part
                    if part < n:
                        up.append((keep, n - part))
                else:
                    taken += n
            if undo:
                taken += left
            if up and up[-1][0] != undo:
                taken += up.pop()[1]
            if up or undo:
                up.append((not undo, taken))
        return cls(reversed(up))

    def count(self, n: int) -> int:
        """Kept ones among the first n."""
        out = 0
        for keep, m in self.runs:
            m = min(m, n)
            out, n = out + keep * m, n - m
        return out + n * self.open

    def through(self, first: int, later: Runs) -> tuple[int, Runs]:
        """``first`` certain entries and these above them, seen through ``later``: what is left of both."""
        rest, out = list(reversed(later.runs)), Runs(open=self.open and later.open)

        def pieces(n: int) -> Iterator[tuple[bool, int]]:
            while n:
                keep, m = rest.pop() if rest else (later.open, n)
                part = min(m, n)
                if part < m:
                    rest.append((keep, m - part))
                yield keep, part
                n -= part

        left = sum(m for keep, m in pieces(first) if keep)
        for keep, n in self.runs:
            for piece in pieces(n) if keep else ((False, n),):
                out.add(*piece)
        if self.open:
            for piece in reversed(rest):
                out.add(*piece)
        return left, out

    def capped(self, most: int) -> Runs:
        """Only the lowest ``most`` of the kept ones."""
        out = Runs(open=False)
        for keep, n in self.runs:
            out.add(keep, min(n, most) if keep else n)
            most -= min(n, most) if keep else 0
        if self.open:
            out.add(True, most)
        return out


class Stretch:
    """A summary: swings before the first push, depth and kept entries since, swings after the last push."""

    def __init__(self, limit: int | None = None):
        self.limit = limit
        self.lead: list[int] = []
        self.depth: int | None = None
        self.kept = Runs()
        self.tail: list[int] = []

    def step(self, op: int) -> None:
        if op == PUSH:
            self._settle()
            self.depth += 1
            if self.limit is not None:
                self.depth = min(self.depth, self.limit)
                self.kept = self.kept.capped(self.limit - self.depth)
        elif op == CLEAR:
            self.lead, self.depth, self.kept, self.tail = [], 0, Runs(open=False), []
        else:
            swung(self.lead if self.depth is None else self.tail, 1 if op == REDO else -1)

    def _settle(self) -> None:
        """Swings so far become part of the depth, as the next push forgets what could be redone."""
        if self.depth is None:
            self.depth = 0
        elif self.tail:
            self.depth, self.kept = self.kept.through(self.depth, Runs.after(self.tail))
            self.tail = []

    def then(self, other: Stretch) -> None:
        """Append another stretch."""
        for s in other.lead:
            swung(self.lead if self.depth is None else self.tail, s)
        if other.depth is None:
            return
        if self.depth is None:
            self.depth, self.kept = other.depth, other.kept
        else:
            self._settle()
            left, self.kept = self.kept.through(self.depth, other.kept)
            self.depth = left + other.depth
        self.tail = list(other.tail)

    def end(self, depth: int, redo: int) -> tuple[int, int]:
        depth, redo = moved(depth, redo, self.lead)
        if self.depth is not None:
            depth, redo = moved(self.depth + self.kept.count(depth), 0, self.tail)
        return depth, redo

    def row(self) -> tuple:
        return self.lead, self.depth, self.kept.flat(), self.kept.open, self.tail

    @classmethod
    def of(cls, lead, depth, runs, open, tail, limit: int | None = None) -> Stretch:
        out = cls(limit)
        out.lead, out.depth, out.kept, out.tail = list(lead), depth, Runs.of(runs, open), list(tail)
        return out


def _starts(level: DataFrame, kind: str) -> DataFrame:
    """(session, n, depth, redo) before each summary (session, n, …); n counts from 0 within a session."""
    names = [c.split()[0] for c in SUMMARY.split(", ")]
    group = F.floor(F.col("n") / FAN).alias("g")
    by_group = level.groupBy("session", group).agg(F.array_sort(F.collect_list(F.struct("n", *names))).alias("parts"))  # FAN at most

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for session, parts, depth, redo in zip(*[b.column(c).to_pylist() for c in ("session", "parts", "depth", "redo")], strict=True):
                for p in parts:
                    yield session, p["n"], depth, redo
                    depth, redo = Stretch.of(*[p[c] for c in names]).end(depth, redo)

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for session, n, parts in zip(*[b.column(c).to_pylist() for c in ("session", "g", "parts")], strict=True):
                whole = Stretch()
                for p in parts:
                    whole.then(Stretch.of(*[p[c] for c in names]))
                yield session, n, *whole.row()

    if (level.agg(F.max("n")).first()[0] or 0) < FAN:
        begun = by_group.select("session", "parts", F.lit(0).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("redo"))
    else:
        upper = cut_lineage(mapped(by_group, compose, f"session {kind}, n bigint, {SUMMARY}"))
        above = _starts(upper, kind).select(F.col("session").alias("s"), F.col("n").alias("of"), "depth", "redo")
        begun = by_group.join(above, F.col("session").eqNullSafe(F.col("s")) & (F.col("g") == F.col("of"))).select("session", "parts", "depth", "redo")
    return mapped(begun, walk, f"session {kind}, n bigint, depth bigint, redo bigint")


class _Stack:
    """A history of which only the entries written here are known."""

    def __init__(self, depth: int, redo: int, limit: int | None):
        self.depth, self.redo, self.limit = depth, redo, limit
        self.height = self.low = 0  # since the start; what a limit cuts off below still counts
        self.own: list[str | None] = []

    def step(self, op: int, label: str | None) -> None:
        if op == PUSH:
            self.height += 1
            self.depth = self.depth + 1 if self.limit is None else min(self.depth + 1, self.limit)
            self.redo = 0
            self.own.append(label)
        elif op == UNDO and self.depth:
            self.height, self.depth, self.redo = self.height - 1, self.depth - 1, self.redo + 1
            if self.own:
                self.own.pop()
        elif op == REDO and self.redo:
            self.height, self.depth, self.redo = self.height + 1, self.depth + 1, self.redo - 1
            self.own.append("")
        elif op == CLEAR:
            self.height, self.depth, self.redo, self.own = self.height - self.depth, 0, 0, []
        self.low = min(self.low, self.height)


def replay(edits: DataFrame, block: Column, limit: int | None = None) -> DataFrame:
    """Final undo depth, redo count and undo label of every session.

    ``edits``: session, ts, event_id, op (push, undo, redo, clear), label. A
    push forgets what could be redone; a redone step comes back without a name;
    clear forgets everything. ``block`` never decreases along (ts, event_id).
    ``limit``: most steps that can be undone; none by default.
    """
    order = ["ts", "event_id"]
    code = F.when(F.col("op") == "push", PUSH).when(F.col("op") == "undo", UNDO).when(F.col("op") == "redo", REDO).otherwise(CLEAR)
    live = edits.select("session", block.alias("block"), *order, code.alias("op"), "label")
    kinds = dict(live.dtypes)
    key = f"session {kinds['session']}, block {kinds['block']}"

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for at, rows in grouped(batches, ["session", "block"], ["op"]):
            part = Stretch(limit)
            for (op,) in rows:
                part.step(op)
            yield *at, *part.row()

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for at, rows in grouped(batches, ["session", "block"], ["op", "label", "depth", "redo", "target"]):
            part = _Stack(0, 0, limit)
            for op, label, depth, redo, _ in rows:
                if op is None:
                    part = _Stack(depth, redo, limit)
                else:
                    part.step(op, label)
            yield *at, part.depth, part.redo, part.low, part.height, bool(part.own), part.own[-1] if part.own else None

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for at, rows in grouped(batches, ["session", "block"], ["op", "label", "depth", "redo", "target"]):
            _, _, depth, redo, target = next(rows)
            part, found = _Stack(depth, redo, limit), None
            for op, label, *_ in rows:
                before = part.height
                part.step(op, label)
                if before < target == part.height:
                    found = label if op == PUSH else ""
            yield at[0], found

    def led(starts: DataFrame, rows: DataFrame) -> DataFrame:
        """Each block's start ahead of its rows."""
        ahead = starts.select("session", "block", F.lit(0).alias("kind"), "depth", "redo", "target")
        both = ahead.unionByName(rows.withColumn("kind", F.lit(1)), allowMissingColumns=True)
        return both.repartition("session", "block").sortWithinPartitions("session", "block", "kind", *order).select("session", "block", "op", "label", "depth", "redo", "target")

    def ended(told: DataFrame) -> DataFrame:
        return told.select("session", "depth", "redo", F.when(F.col("depth") > 0, F.col("label")).otherwise("").alias("label"))

    answer = f"{key}, depth bigint, redo bigint, low bigint, rise bigint, written boolean, label string"
    if live.groupBy("session").agg((F.min("block") < F.max("block")).alias("cut")).where("cut").isEmpty():  # each session is one block
        none = [F.lit(None).cast("bigint").alias(c) for c in ("depth", "redo", "target")]
        whole = live.repartition("session", "block").sortWithinPartitions("session", "block", *order).select("session", "block", "op", "label", *none)
        return ended(mapped(whole, follow, answer))

    dealt = live.select("session", "block", *order, "op").repartition("session", "block").sortWithinPartitions("session", "block", *order).drop(*order)
    sums = mapped(dealt, summarise, f"{key}, {SUMMARY}")
    numbered = cut_lineage(sums.withColumn("n", (F.row_number().over(Window.partitionBy("session").orderBy("block")) - 1).cast("bigint")))
    named = numbered.select("session", "n", "block")
    starts = _starts(numbered.drop("block"), kinds["session"]).withColumnRenamed("session", "s").withColumnRenamed("n", "of")
    placed = cut_lineage(named.join(starts, F.col("session").eqNullSafe(F.col("s")) & (F.col("n") == F.col("of"))).select("session", "block", "depth", "redo", F.lit(None).cast("bigint").alias("target")))

    followed = cut_lineage(mapped(led(placed, live), follow, answer))
    final = followed.groupBy("session").agg(F.max_by(F.struct("depth", "redo", "written", "label"), "block").alias("f"), F.sum("rise").alias("top"))
    done = F.col("f.written") | (F.col("f.depth") == 0)
    early = ended(final.where(done).select("session", "f.*"))

    # elsewhere the block where the stack last stood below its final height wrote the entry now on top
    older = final.where(~done).select(F.col("session").alias("s"), "top", F.col("f.depth").alias("end_depth"), F.col("f.redo").alias("end_redo"))
    before = Window.partitionBy("session").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    based = followed.withColumn("base", F.coalesce(F.sum("rise").over(before), F.lit(0)))
    wrote = (based.join(older, F.col("session").eqNullSafe(F.col("s"))).where(F.col("base") + F.col("low") < F.col("top"))
             .groupBy("session").agg(F.max_by(F.struct("block", (F.col("top") - F.col("base")).alias("target"), "end_depth", "end_redo"), "block").alias("w"))
             .select("session", "w.*"))
    wrote = cut_lineage(wrote)
    again = placed.drop("target").join(wrote.select(F.col("session").alias("s"), F.col("block").alias("b"), "target"), F.col("session").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).drop("s", "b")
    there = wrote.select(F.col("session").alias("s"), F.col("block").alias("b"))
    rows = live.join(there, F.col("session").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left_semi")
    labels = mapped(led(again, rows), find, f"s {kinds['session']}, label string")
    late = wrote.join(labels, F.col("session").eqNullSafe(F.col("s"))).select("session", F.col("end_depth").alias("depth"), F.col("end_redo").alias("redo"), "label")
    return early.unionByName(late)
