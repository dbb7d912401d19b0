"""Hard negatives: per anchor and positive, the best scoring rows of other labels within a window of scores.

Candidates are norm-augmented: a coordinate is added that gives all vectors of a
tree the same length, so that a larger inner product means a smaller distance.
They lie in cover trees: a node has a centre and a covering radius; its children
are centres taken farthest first until they cover its points within a radius
smaller by the level's base, so siblings stand apart by more than that. Distance
and radius bound all inner products below a node from both sides. The descent
opens each anchor's nodes best first, leaves out nodes whose bounds miss all its
open windows or can't beat what is found, and verifies leaves in exact integers.
It runs for many anchors at a time. Bounds carry a margin for rounding, so the
result equals a full search.

Work is dealt by fragment and replicate: candidates lie in slots of bounded size,
ranges of (label, key, row), so no label, copy or key is hot; anchors, the stated
query set, are sent to every slot and streamed through its tree. Where anchors
are many, slots are repeated and the anchors split among them. Each slot answers
with at most k rows per window, and Spark ranks those. Anchors first ask for
their positives, then for the windows that these open.

A row whose vector, label and smaller keys occur k times and more before it in
one slot can't be among the first k of any anchor, and isn't kept in the tree.

Rows with a null label, a null vector, or a component that is null, not finite or
beyond ``vectors.LARGEST`` once scaled take no part. Shorter vectors are filled
up with zeros. Repeated rows are rows of their own: each may be anchor, positive
and negative of the other. Rows without key are never anchors unless the caller
says so, and come last among equal scores. Anchors without a positive, or
without a negative in the window, give no row. An empty table gives an empty
result. Only the columns named are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .vectors import integers, matrix, usable

#: Beyond any score.
FAR = 1 << 62


@dataclass(frozen=True)
class Mine:
    positives: int = 5
    negatives: int = 5
    #: low * positive score <= 100 * negative score <= high * positive score
    low: int = 80
    high: int = 100
    scale: int = 256
    base: float = 1.3
    leaf: int = 32
    #: Bounds of the rows of a slot; between them, about four slots for each core.
    least_rows: int = 1 << 10
    most_rows: int = 1 << 16
    #: Anchors that pass one copy of a slot, and those that go through its tree together.
    most_anchors: int = 1 << 14
    together: int = 256


class CoverTree:
    """A cover tree over integer vectors, its nodes in breadth-first order and its points in the order of the leaves."""

    def __init__(self, q: np.ndarray, leaf: int, base: float):
        x = q.astype(float)
        norms = (x * x).sum(1)
        self.top = float(norms.max(initial=0))
        x = np.concatenate([x, np.sqrt(np.maximum(self.top - norms, 0))[:, None]], 1)
        order = np.arange(len(x))
        todo, centres, radii, spans, children = [], [], [], [], []

        def add(start: int, end: int, centre: int) -> None:
            away = np.sqrt(((x[order[start:end]] - x[centre]) ** 2).sum(1))
            centres.append(centre)
            radii.append(float(away.max()))
            spans.append((start, end))
            children.append((0, 0))
            todo.append(away)

        if len(x):
            add(0, len(x), 0)
        at = 0
        while at < len(centres):
            (start, end), radius, away = spans[at], radii[at], todo[at]
            todo[at] = None
            if end - start > leaf and radius > 0:
                own, taken, part = x[order[start:end]], [centres[at]], np.zeros(end - start, np.int64)
                while away.max() > radius / base:
                    far = int(away.argmax())
                    taken.append(int(order[start + far]))
                    now = np.sqrt(((own - own[far]) ** 2).sum(1))
                    part[now < away] = len(taken) - 1
                    away = np.minimum(away, now)
                order[start:end] = order[start:end][np.argsort(part, kind="stable")]
                cuts = start + np.concatenate([[0], np.cumsum(np.bincount(part, minlength=len(taken)))])
                children[at] = (len(centres), len(centres) + len(taken))
                for k, centre in enumerate(taken):
                    add(int(cuts[k]), int(cuts[k + 1]), centre)
            at += 1
        self.order = order
        self.centres, self.radii = x[centres, :-1] if len(x) else x[:, :-1], np.array(radii)
        self.spans, self.children = np.array(spans, np.int64).reshape(-1, 2), np.array(children, np.int64).reshape(-1, 2)


def _spread(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of the range, and number, for all numbers of all ranges."""
    sizes = ends - starts
    of = np.repeat(np.arange(len(starts)), sizes)
    return of, np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[of]


class Slot:
    """The rows of a slot under a cover tree."""

    def __init__(self, q: np.ndarray, labels: np.ndarray, ids: np.ndarray, rows: np.ndarray, how: Mine):
        k = max(how.positives, how.negatives) + 1  # one may be the anchor itself
        if len(q):
            same = np.unique(np.ascontiguousarray(np.column_stack([labels, q])).view(f"V{8 * (q.shape[1] + 1)}").ravel(), return_inverse=True)[1]
            order = np.lexsort((rows, ids, same))
            starts = np.searchsorted(same[order], same[order])
            order = order[np.arange(len(order)) - starts < k]
            q, labels, ids, rows = q[order], labels[order], ids[order], rows[order]
        self.tree = tree = CoverTree(q, how.leaf, how.base)
        self.q, self.labels, self.ids, self.rows = q[tree.order], labels[tree.order], ids[tree.order], rows[tree.order]
        self.x = self.q.astype(float)
        self.largest = int(np.abs(self.q).max(initial=0))
        ends = [(self.labels[a:b].min(), self.labels[a:b].max()) for a, b in tree.spans]
        self.least, self.most = (np.array(v) for v in zip(*ends)) if ends else (labels, labels)

    def search(self, q: np.ndarray, labels: np.ndarray, rows: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> tuple[np.ndarray, ...]:
        """The first k rows of the same or of other labels in each window of each anchor: anchor, window, score, position.

        low, high: bounds of the windows, anchors x windows; a window whose low is above its high is empty.
        """
        tree, n, windows = self.tree, len(q), low.shape[1]
        x = q.astype(float)
        lengths = (x * x).sum(1)
        exact = int(np.abs(q).max(initial=0)) * self.largest * q.shape[1] < 1 << 53
        floor = np.where(low > high, FAR, low)  # raised to the k-th score found
        found = tuple(np.zeros(0, np.int64) for _ in range(4))

        def bounds(b: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            dot, r = np.einsum("ij,ij->i", x[b], tree.centres[node]), tree.radii[node]
            both, lean = lengths[b] + tree.top, np.sqrt(lengths[b]) * r
            d = np.sqrt(np.maximum(both - 2 * dot, 0))
            slack = 1e-9 * both + 1e-6
            return np.maximum(dot - lean, (both - (d + r) ** 2) / 2) - slack, np.minimum(dot + lean, (both - np.maximum(d - r, 0) ** 2) / 2) + slack

        def fits(b: np.ndarray, node: np.ndarray) -> np.ndarray:
            if same:
                return (self.least[node] <= labels[b]) & (labels[b] <= self.most[node])
            return (self.least[node] != labels[b]) | (self.most[node] != labels[b])

        b, node = np.arange(n), np.zeros(n, np.int64)
        if not len(tree.radii):
            return found
        least, most = bounds(b, node)
        take = 4
        while len(b):
            reach = np.minimum(most[:, None], high[b])
            open_ = (reach >= floor[b]) & (least[:, None] <= high[b])
            rank = np.where(open_, reach, -np.inf).max(1)
            keep = open_.any(1) & fits(b, node)
            b, node, least, most, rank = b[keep], node[keep], least[keep], most[keep], rank[keep]
            if not len(b):
                break
            order = np.lexsort((-rank, b))
            b, node, least, most = b[order], node[order], least[order], most[order]
            now = np.arange(len(b)) - np.searchsorted(b, b) < take
            take *= 2
            ob, on = b[now], node[now]
            b, node, least, most = b[~now], node[~now], least[~now], most[~now]
            inner = tree.children[on, 1] > 0
            of, child = _spread(tree.children[on[inner], 0], tree.children[on[inner], 1])
            if len(of):
                cb = ob[inner][of]
                lower, upper = bounds(cb, child)
                b, node, least, most = np.concatenate([b, cb]), np.concatenate([node, child]), np.concatenate([least, lower]), np.concatenate([most, upper])
            ob, on = ob[~inner], on[~inner]
            order = np.argsort(on, kind="stable")
            ob, on = ob[order], on[order]
            hits = []
            for own, leaf in zip(*[np.split(v, np.flatnonzero(np.diff(on)) + 1) for v in (ob, on)], strict=True) if len(on) else ():
                s, e = tree.spans[leaf[0]]
                score = (x[own] @ self.x[s:e].T).astype(np.int64) if exact else q[own] @ self.q[s:e].T
                there = (score >= floor[own].min(1, keepdims=True)) & (score <= high[own].max(1, keepdims=True)) & (rows[own, None] != self.rows[s:e]) & ((labels[own, None] == self.labels[s:e]) == same)
                i, j = there.nonzero()
                hits.append((own[i], score[i, j], s + j))
            if hits:
                hb, hs, hp = (np.concatenate(v) for v in zip(*hits))
                i, w = ((hs[:, None] >= floor[hb]) & (hs[:, None] <= high[hb])).nonzero()
                found = tuple(np.concatenate(v) for v in zip(found, (hb[i], w, hs[i], hp[i])))
                order = np.lexsort((self.ids[found[3]], -found[2], found[1], found[0]))
                group = (found[0] * windows + found[1])[order]
                at = np.arange(len(group)) - np.searchsorted(group, group)
                found = tuple(v[order[at < k]] for v in found)
                full = tuple(v[at[at < k] == k - 1] for v in found)
                floor[full[0], full[1]] = full[2]
        return found


def _slots(batches: Iterator[pa.RecordBatch], width: int, how: Mine) -> Iterator[tuple[Slot, pa.RecordBatch]]:
    """Slots, each with the batches of anchors sent to it; rows come by (slot, copy, kind), points first."""
    key, points, trees = None, [], None
    last = np.iinfo(np.int64).max

    def grown() -> list[Slot]:
        q = np.concatenate([matrix(p.column("q"), width) for p in points]) if points else np.zeros((0, width), np.int64)
        labels, ids, rows = ([p.column(c).fill_null(last).to_numpy(zero_copy_only=False) for p in points] for c in ("label", "id", "row"))
        labels, ids, rows = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (labels, ids, rows))
        return [Slot(*(v[s: s + how.most_rows] for v in (q, labels, ids, rows)), how) for s in range(0, len(q), how.most_rows)]

    for batch in batches:
        marks = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("slot", "copy", "asks")])
        cuts = np.concatenate([[0], np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0)) + 1, [batch.num_rows]])
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            if start == end:
                continue
            if tuple(marks[:2, start]) != key:
                key, points, trees = tuple(marks[:2, start]), [], None
            part = batch.slice(start, end - start)
            if not marks[2, start]:
                points.append(part)
                continue
            if trees is None:
                trees, points = grown(), []
            for s in range(0, part.num_rows, how.together):
                for tree in trees:
                    yield tree, part.slice(s, how.together)


def _windows(scores: pa.Array, how: Mine) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the windows that the scores of positives open; all scores, where positives are still asked for (null)."""
    if scores.null_count:
        return np.full((len(scores), 1), -FAR), np.full((len(scores), 1), FAR)
    s, none = matrix(scores, how.positives), np.arange(how.positives) >= pc.list_value_length(scores).to_numpy(zero_copy_only=False)[:, None]
    return np.where(none, FAR, -(-how.low * s // 100)), np.where(none, -FAR, how.high * s // 100)


def _asked(points: DataFrame, anchors: DataFrame, width: int, slots: int, copies: int, how: Mine, same: bool) -> DataFrame:
    """The answers of all slots to all anchors: (row, window, id, score)."""
    k = how.positives if same else how.negatives

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slot, part in _slots(batches, width, how):
            rows, labels = (part.column(c).to_numpy(zero_copy_only=False) for c in ("row", "label"))
            low, high = _windows(part.column("scores"), how)
            b, w, score, at = slot.search(matrix(part.column("q"), width), labels, rows, low, high, same, k)
            ids = slot.ids[at]
            yield pa.RecordBatch.from_arrays([pa.array(rows[b]), pa.array(w.astype(np.int32)), pa.array(ids, mask=ids == np.iinfo(np.int64).max), pa.array(score)], ["row", "window", "id", "score"])

    held = points.select("slot", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), F.lit(0).alias("asks"), "row", "id", "label", "q", F.lit(None).cast("array<bigint>").alias("scores"))
    sent = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"), F.pmod(F.xxhash64("row"), F.lit(copies)).cast("int").alias("copy"), F.lit(1).alias("asks"), "row", "id", "label", "q", "scores")
    dealt = held.unionByName(sent).repartition(slots * copies, "slot", "copy").sortWithinPartitions("slot", "copy", "asks")
    return dealt.mapInArrow(run, "row bigint, window int, id bigint, score bigint")


def _ranked(found: DataFrame, most: int, *group: str) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def mine(rows: DataFrame, anchor: Column, label: Column, how: Mine = Mine(), key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    anchor: which rows are anchors; label: their labels, whole numbers. Keys are whole numbers.
    """
    spark = rows.sparkSession
    kept = rows.where(usable(F.col(vector), how.scale)).select(F.col(key).cast("bigint").alias("id"), label.cast("bigint").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), integers(F.col(vector), how.scale).alias("q")).where("label is not null")
    total, width = kept.agg(F.count("*"), F.max(F.size("q"))).first()
    width = max(1, width or 0)
    size = min(max(total // (4 * spark.sparkContext.defaultParallelism), how.least_rows), how.most_rows)
    parted = kept.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(max(1, -(-total // size)), "label", "id", "tie").drop("tie")
    points = cut_lineage(parted.select(F.spark_partition_id().alias("slot"), F.monotonically_increasing_id().alias("row"), "id", "label", "anchor", "q"))
    anchors = points.where("anchor").select("row", "id", "label", "q")
    most, asking = points.agg(F.max("slot"), F.count_if("anchor")).first()
    slots, copies = (most or 0) + 1, max(1, -(-asking // how.most_anchors))

    asks = anchors.withColumn("scores", F.lit(None).cast("array<bigint>"))
    best = _ranked(_asked(points, asks, width, slots, copies, how, same=True), how.positives, "row")
    positives = best.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("positives"))  # how.positives at most
    windows = cut_lineage(anchors.join(positives, "row").withColumn("scores", F.col("positives.score")))
    found = _ranked(_asked(points, windows, width, slots, copies, how, same=False), how.negatives, "row", "window")
    named = windows.select("row", F.col("id").alias("anchor_id"), F.posexplode("positives").alias("window", "positive"))
    met = found.join(named, ["row", "window"])
    return met.select("anchor_id", F.col("positive")["id"].alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("positive")["score"].alias("positive_score"), F.col("score").alias("negative_score"))
