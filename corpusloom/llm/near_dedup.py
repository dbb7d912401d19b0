"""Near duplicates by MinHash, banding, verification and connected components.

1. One pass over the texts gives per document the number of distinct shingles,
   a 128-bit digest of the whole set, and ``HASHES`` minima of universal hash
   functions (multiply, add, take the upper half of 64 bits). Documents with one
   digest are copies: they hang on one representative and go no further.
2. The minima are cut into ``bands`` of ``rows``. Representatives that agree in
   a whole band share a bucket. A pair at the threshold meets in no bucket with
   probability (1 - t ** rows) ** bands, 5e-8 here.
3. In a bucket of up to ``SMALL`` members every pair is a candidate. Larger
   buckets are never paired out. Their members are compared with one *leader*
   each, the member with the smallest share of shingles that no other document
   of a large bucket has (``alone``). Two exact rules then tell what is left:

   - a document whose own ``alone`` shingles exceed what the threshold leaves
     room for has no partner at all;
   - x and y have in common at most min(|x n z|, |y n z|) shingles inside a
     leader z, and outside it at most the lesser number of those that are not
     alone. Where this is too little for a link, x and y need no comparison.

   A member that is linked with its leader, has all its other shingles alone and
   is no smaller than the leader is settled: by the second rule whatever links
   with it links with the leader. The rest is compared with the next leader, and
   so on for ``ROUNDS`` rounds; the pairs still open after them (members of
   different components that neither rule excludes) are candidates as in a small
   bucket. In groups made from one text next to nothing is left by then.
4. A candidate's signatures are compared first: a pair that agrees in fewer of
   ``HASHES`` minima than six standard deviations below what the threshold
   gives is dropped. All others are confirmed on the full sets.
5. Links are joined by large-star and small-star; the component is named after
   its least document.

Rows with null or wordless text have an empty set and are linked with nothing.
Rows that share a ``doc_id`` are one document in linking; should they differ in
text, each text finds its copies and near copies, and all that are linked with
one of them are one component. A row without ``doc_id`` takes no part: its
component is null and it is kept. Repeated rows each get a row of the result.
Texts of any length are read whole; a document's set and signature are bounded by
its own text. An empty table gives an empty result. Columns other than the two
named are not read.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .batches import bytes_of, list_array, per_slice
from .components import components
from .wordhash import mixed, shingle_sets

HASHES = 128
SMALL = 8
ROUNDS = 3


@dataclass(frozen=True)
class Near:
    """Shingle width in words, threshold in hundredths, and how the minima are banded."""

    width: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 4

    @property
    def agree(self) -> int:
        """Fewest equal 4-bit minima of a pair at the threshold, six standard deviations below the mean."""
        p = self.percent / 100 + (1 - self.percent / 100) / 16
        return max(0, math.floor(HASHES * p - 6 * math.sqrt(HASHES * p * (1 - p))))


_FACTORS = mixed(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)
_TERMS = mixed(np.arange(1001, HASHES + 1001, dtype=np.uint64))


def minima(shingles: np.ndarray, block: int = 2048) -> np.ndarray:
    """The least of each universal hash function over a set."""
    out = np.full(HASHES, np.iinfo(np.uint32).max, dtype=np.uint32)
    for k in range(0, len(shingles), block):
        h = (shingles[k: k + block, None] * _FACTORS + _TERMS) >> np.uint64(32)
        np.minimum(out, h.min(axis=0).astype(np.uint32), out=out)
    return out


def signed(base: DataFrame, near: Near) -> DataFrame:
    """Per row of (id, t): id, n (set size), digest, bands (one bucket key a band), sig (the low four bits of each minimum, packed)."""
    salt = mixed(np.arange(2001, 2001 + near.bands, dtype=np.uint64))
    used = near.bands * near.rows
    if used > HASHES:
        raise ValueError("bands x rows exceeds the number of hashes")
    shifts = (np.arange(16, dtype=np.uint64) * np.uint64(4))

    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(*bytes_of(part, "t"), near.width)
        sizes, digests, bands, sigs = [], [], [], []
        for s in sets:
            sizes.append(len(s))
            digests.append(_digest(s))
            m = minima(s).astype(np.uint64)
            h = salt.copy()
            for k in range(near.rows):
                h = mixed(h ^ m[k:used:near.rows])
            bands.append(h.view(np.int64) if len(s) else np.zeros(0, np.int64))
            sigs.append(((m.reshape(-1, 16) & np.uint64(15)) << shifts).sum(axis=1, dtype=np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), list_array(bands, pa.int64()), list_array(sigs, pa.int64())], ["id", "n", "digest", "bands", "sig"])

    return base.mapInArrow(per_slice(one, "t"), "id bigint, n bigint, digest binary, bands array<bigint>, sig array<bigint>")


def _digest(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def sets_of(base: DataFrame, near: Near) -> DataFrame:
    """Per row of (id, t): id, the whole shingle set and its digest."""

    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(*bytes_of(part, "t"), near.width)
        return pa.RecordBatch.from_arrays([part.column(0), pa.array([_digest(s) for s in sets], pa.binary()), list_array([s.view(np.int64) for s in sets], pa.int64())], ["id", "digest", "shingles"])

    return base.mapInArrow(per_slice(one, "t"), "id bigint, digest binary, shingles array<bigint>")


def _agreeing(a: str = "sig_a", b: str = "sig_b") -> str:
    """SQL for the number of equal 4-bit minima of two packed signatures."""
    differ = "bit_count((({x} | shiftright({x}, 1) | shiftright({x}, 2) | shiftright({x}, 3)) & 1229782938247303441L))"
    return f"{HASHES} - (" + " + ".join(differ.format(x=f"({a}[{i}] ^ {b}[{i}])") for i in range(HASHES // 16)) + ")"


def _linked(near: Near, common: str = "common", na: str = "n_a", nb: str = "n_b") -> str:
    return f"100 * {common} >= {near.percent} * ({na} + {nb} - {common})"


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b, …) with ``common``, the size of the intersection of their full sets."""
    a = sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a"))
    b = sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b"))
    return pairs.join(a, "a").join(b, "b").withColumn("common", F.size(F.array_intersect("set_a", "set_b"))).drop("set_a", "set_b")


def link(docs: DataFrame, near: Near = Near(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component and kept, as described in the module."""
    base = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("t"))
    rows = cut_lineage(signed(base, near))
    whole = rows.where("id is not null and n > 0")
    heads = whole.groupBy("digest").agg(F.min("id").alias("head"))
    copies = whole.join(heads, "digest").where("id <> head").select(F.col("id").alias("u"), F.col("head").alias("v"))
    of_id = heads.groupBy(F.col("head").alias("id")).agg(F.min("digest").alias("digest"), F.count("*").alias("sets"))
    reps = whole.join(of_id.drop("sets"), ["id", "digest"]).dropDuplicates(["id"])
    if not whole.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").isEmpty():
        # an id that heads several sets stands for the least; the others get numbers of their own beyond all ids, tied to it by an edge
        several = of_id.where("sets > 1").select(F.col("id").alias("head"), F.col("digest").alias("least"))
        others = cut_lineage(heads.join(several, "head").where("digest <> least").select("head", "digest", F.monotonically_increasing_id().alias("nth")))
        beyond = rows.agg(F.max("id")).first()[0] + 1
        others = others.select(F.col("head").alias("id"), "digest", (F.lit(beyond) + F.col("nth")).alias("own"))
        more = whole.join(others, ["id", "digest"]).dropDuplicates(["own"])
        reps = reps.unionByName(more.withColumn("id", F.col("own")).drop("own"))
        base = base.unionByName(base.join(others.select("id", "own"), "id").select(F.col("own").alias("id"), "t"))
        copies = copies.unionByName(others.select(F.col("own").alias("u"), F.col("id").alias("v")))
    links = _representative_links(base, reps, near)
    found = components(copies.unionByName(links))
    out = rows.select("id", F.col("n").alias("n_shingles")).join(found.select(F.col("node").alias("id"), "component"), "id", "left")
    component = F.coalesce("component", "id")
    return out.select("id", "n_shingles", component.alias("component"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def _representative_links(base: DataFrame, reps: DataFrame, near: Near) -> DataFrame:
    """Edges (u, v) between representatives, enough to join every linked pair."""
    buckets = reps.select("id", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    members = cut_lineage(buckets.join(shared, "bucket"))
    busy = members.select("id").distinct()
    sets = sets_of(base.join(busy, "id", "left_semi"), near)
    info = cut_lineage(sets.join(reps.select("id", "digest", "n", "sig"), ["id", "digest"]).drop("digest").dropDuplicates(["id"]))
    small = _pairs_within(members.where(F.col("members") <= SMALL).select("bucket", "id"), info, near)
    large = members.where(F.col("members") > SMALL).select("bucket", "id")
    edges = _edges(cut_lineage(confirmed(small, info)), near)
    return edges if large.isEmpty() else edges.unionByName(_links_in_large(large, info, edges, near))


def _edges(pairs: DataFrame, near: Near) -> DataFrame:
    return pairs.where(_linked(near)).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _side(rows: DataFrame, side: str, *columns: str) -> DataFrame:
    return rows.select("bucket", *[F.col(c).alias(side if c == "id" else f"{c}_{side}") for c in ("id", *columns)])


def _pairs_within(members: DataFrame, info: DataFrame, near: Near) -> DataFrame:
    """Candidate pairs a < b of each bucket whose sizes and signatures allow a link."""
    rows = members.join(info.select("id", "n", "sig"), "id")
    possible = f"a < b and 100 * least(n_a, n_b) >= {near.percent} * greatest(n_a, n_b) and {_agreeing()} >= {near.agree}"
    return _side(rows, "a", "n", "sig").join(_side(rows, "b", "n", "sig"), "bucket").where(possible).select("a", "b", "n_a", "n_b").distinct()


def _links_in_large(large: DataFrame, info: DataFrame, known: DataFrame, near: Near) -> DataFrame:
    """Edges found in buckets of more than ``SMALL`` members."""
    inside = info.join(large.select("id").distinct(), "id", "left_semi")
    lonely = inside.select("id", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("df"), F.min("id").alias("id")).where("df = 1")
    alone = lonely.groupBy("id").agg(F.count("*").alias("alone"))
    facts = cut_lineage(inside.join(alone, "id", "left").select("id", "n", "sig", F.coalesce("alone", F.lit(0)).alias("alone")))
    room = f"(100 - {near.percent})"
    open_members = cut_lineage(large.join(facts.where(f"100 * alone <= {room} * n").select("id", "n", "alone"), "id").withColumns({f"i{r}": F.lit(None).cast("bigint") for r in range(ROUNDS)}))
    edges = known.limit(0)
    for r in range(ROUNDS):
        best = open_members.groupBy("bucket").agg(F.min(F.struct(F.col("alone") / F.col("n"), "n", "id", "alone")).alias("z"), F.count("*").alias("left"))
        best = best.where("left > 1").select("bucket", F.col("z.id").alias("b"), F.col("z.n").alias("n_b"))
        met = cut_lineage(open_members.join(best, "bucket"))
        tried = cut_lineage(confirmed(met.where("id <> b").select(F.col("id").alias("a"), "b", F.col("n").alias("n_a"), "n_b", "alone").distinct(), info))
        edges = edges.unionByName(_edges(tried, near))
        judged = tried.select(F.col("a").alias("id"), "b", F.col("common").cast("bigint").alias("seen"), F.expr(f"{_linked(near)} and common = n_a - alone and n_b <= n_a").alias("settled"))
        after = met.where("id <> b").join(judged, ["id", "b"]).where("not settled").withColumn(f"i{r}", F.col("seen"))
        open_members = cut_lineage(after.select("bucket", "id", "n", "alone", *[f"i{k}" for k in range(ROUNDS)]))
        if open_members.isEmpty():
            return edges
    found = components(known.unionByName(edges))
    others = open_members.groupBy("id").agg(F.collect_set("bucket").alias("where"))  # at most one a band
    rows = open_members.join(found.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("part", F.coalesce("component", "id")).join(facts.select("id", "sig").join(others, "id"), "id")
    most = "least(" + ", ".join(f"least(i{r}_a, i{r}_b) + least(n_a - alone_a - i{r}_a, n_b - alone_b - i{r}_b)" for r in range(ROUNDS)) + ")"
    possible = (
        f"a < b and part_a <> part_b and {_linked(near, most)}"
        f" and {near.percent} * (alone_a + alone_b) <= {room} * least(n_a - alone_a, n_b - alone_b) and {_agreeing()} >= {near.agree}"
        " and bucket = array_min(array_intersect(where_a, where_b))"  # each pair in one bucket only
    )
    columns = ("n", "alone", "part", "sig", "where", *[f"i{r}" for r in range(ROUNDS)])
    rest = _side(rows, "a", *columns).join(_side(rows, "b", *columns), "bucket").where(possible).select("a", "b", "n_a", "n_b")
    return edges.unionByName(_edges(cut_lineage(confirmed(rest, info)), near))
