"""Catalogue operators: search, ranking, related items, coverage, audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

# ── fixed values ────────────────────────────────────────────────────────────
PLACE_BITS = 33  # of a monotonically increasing id, below the partition
RELATED_ITEMS, RELATED_EDGES, FEATURED, SKIPPED_SHOWN = 6, 11, 3, 6
# ────────────────────────────────────────────────────────────────────────────


def search_catalogue(catalogue: DataFrame, term: str = "", category: str = "") -> DataFrame:
    """Category equality and a term found in the code-and-name or in any tag."""
    needle = term.strip().lower()
    named = F.lower(F.concat_ws(" ", "code", "name")).contains(needle)
    tagged = F.lower(F.array_join("tags", " ")).contains(needle)
    hits = catalogue
    if category:
        hits = hits.where(F.col("category") == category)
    if needle:
        hits = hits.where(named | tagged)
    return hits


def search_count(hits: DataFrame) -> DataFrame:
    """How many, in words, and whether to show the empty notice."""
    n = hits.agg(F.count(F.lit(1)).alias("n"))
    return n.select("n", plural("n", "form").alias("label"), (F.col("n") == 0).alias("empty"))


def search_edges(edges: DataFrame, term: str = "", tab: str = "pop") -> DataFrame:
    """A term looks across every tab; without one, ``pop`` is a flag and other tabs a category."""
    needle = term.strip().lower()
    if needle:
        return edges.where(F.lower(F.concat_ws(" to ", "src", "dst")).contains(needle))
    return edges.where("pop") if tab == "pop" else edges.where(F.col("cat") == tab)


def plural(n: str, noun: str) -> Column:
    return F.concat(F.col(n).cast("string"), F.lit(f" {noun}"), F.when(F.col(n) == 1, "").otherwise("s"))


def describe(catalogue: DataFrame) -> DataFrame:
    """One descriptive line per row; counts of zero are left out."""
    parts = [F.concat(F.col("name"), F.lit(" ("), F.col("code"), F.lit(")")),
             F.when(F.col("pages") > 0, plural("pages", "page")),
             F.when(F.col("fields") > 0, plural("fields", "fillable field"))]
    return catalogue.withColumn("description", F.concat_ws(f" {chr(0xB7)} ", *parts))


def enrich(catalogue: DataFrame, notes: DataFrame, guide: DataFrame) -> DataFrame:
    """A row's own note where there is one, its category's guide text otherwise."""
    return (catalogue.join(notes, "slug", "left").join(guide, "category", "left")
            .withColumn("about", F.coalesce("about", "what")).withColumn("who", F.coalesce("who", "guide_who"))
            .drop("what", "guide_who"))


def coverage(edges: DataFrame, live: DataFrame) -> DataFrame:
    """Edges marked by whether something implements them."""
    key = ["src", "dst"]
    done = edges.join(live.select(*key), key, "left_semi").withColumn("status", F.lit("live"))
    return done.unionByName(edges.join(live.select(*key), key, "left_anti").withColumn("status", F.lit("not built")))


def status_by_category(edges: DataFrame) -> DataFrame:
    return edges.groupBy("live", "cat").agg(F.count(F.lit(1)).alias("n"), F.count_if("pop").alias("n_popular"))


def category_members(edges: DataFrame) -> DataFrame:
    """Who is counted there: one row per member, named ``src-to-dst``; a list as long as its category stays rows."""
    return edges.select("live", "cat", F.concat_ws("-to-", "src", "dst").alias("member"))


def all_items(*sources: DataFrame) -> DataFrame:
    """Several catalogues as one; ``source_no`` then ``seq`` keeps their order."""
    parts = [s.withColumn("source_no", F.lit(i).cast("long")) for i, s in enumerate(sources)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ranked(catalogue: DataFrame, popular: DataFrame, key: str = "seq") -> DataFrame:
    """Add ``rank``: place on the popularity list, or its length for everything else.

    ``popular`` is (key, rank). Order by (rank, seq); unlisted rows keep theirs.
    """
    listed = popular.select(key, F.col("rank").cast("long").alias("_rank"))
    length = popular.agg(F.count(F.lit(1))).scalar()
    return catalogue.join(listed, key, "left").withColumn("rank", F.coalesce(F.col("_rank"), length)).drop("_rank")


def popularity_list(sold: DataFrame) -> DataFrame:
    """Rank by quantity, ties by ``seq``, lists of any length.

    Rows are dealt by ranges of (quantity, seq) and numbered inside their range;
    what is ahead of a range is added from the ranges' sizes, one number a
    partition. So neither the list nor the rows of one quantity meet in a task.
    """
    dealt = sold.repartitionByRange(F.desc("qty"), F.asc("seq")).sortWithinPartitions(F.desc("qty"), F.asc("seq"))
    at = F.monotonically_increasing_id()  # partition, then place in it
    placed = cut_lineage(dealt.withColumns({"_part": F.shiftright(at, PLACE_BITS).cast("int"), "_nth": at.bitwiseAND((1 << PLACE_BITS) - 1)}))
    sizes = sorted(tuple(r) for r in placed.groupBy("_part").count().collect())  # a row a partition
    ahead, so_far = [], 0
    for part, n in sizes:
        ahead.append((part, so_far))
        so_far += n
    offsets = sold.sparkSession.createDataFrame(ahead, "_part int, _ahead long")
    return placed.join(F.broadcast(offsets), "_part").withColumn("rank", F.col("_ahead") + F.col("_nth")).drop("_part", "_nth", "_ahead")


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows of each group, with their position.

    The rank filter lets Spark keep only k rows per group before the shuffle.
    """
    return (df.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
            .where(F.col("position") <= k))


def related(catalogue: DataFrame, k: int = RELATED_ITEMS, order: Sequence[Column] | None = None) -> DataFrame:
    """For every item, the first ``k`` others of its category, by rank or by ``order``.

    Whoever the item is, its neighbours are among the first k+1 of the
    category, so only that shelf is joined: k+1 rows a category, never pairs.
    An order within the category needs no rank over all items.
    """
    shelf = top_k(catalogue, ["category"], list(order or [F.col("rank"), F.col("seq")]), k + 1).select(
        "category", F.col("seq").alias("related"), F.col("position").alias("_p"))
    own = shelf.select("category", F.col("related").alias("seq"), F.col("_p").alias("_own"))
    placed = catalogue.select("category", "seq").join(own, ["category", "seq"], "left")
    position = F.col("_p") - F.when(F.col("_p") > F.col("_own"), 1).otherwise(0)
    return (placed.join(shelf, "category").where(F.col("related") != F.col("seq"))
            .withColumn("position", position).where(F.col("position") <= k).select("seq", "related", "position"))


def related_edges(edges: DataFrame, k: int = RELATED_EDGES) -> DataFrame:
    """Neighbours of an edge: its own category first, then popular ones from the others.

    Both candidate lists are short and fixed in length whatever the catalogue:
    k+1 of each category, and the first 2k popular ones overall once no
    category may take more than k of them. Every edge then reads two arrays.
    """

    listed = F.array_sort(F.collect_list(F.struct("seq", "cat")))
    near = (top_k(edges.select("cat", "seq"), ["cat"], [F.col("seq")], k + 1)
            .groupBy("cat").agg(listed.alias("near")))
    popular = top_k(edges.where("pop").select("cat", "seq"), ["cat"], [F.col("seq")], k)
    shelf = popular.orderBy("seq").limit(2 * k).agg(listed).scalar()
    others = F.filter("shelf", lambda e: e["cat"] != F.col("cat"))
    own = F.filter("near", lambda e: e["seq"] != F.col("seq"))
    picked = F.slice(F.concat(own, others), F.lit(1), F.lit(k))
    lists = near.select("cat", "near", shelf.alias("shelf"))
    return (edges.select("cat", "seq").join(lists, "cat").select("seq", F.posexplode(picked).alias("position", "e"))
            .select("seq", F.col("e.seq").alias("related"), (F.col("position") + 1).cast("long").alias("position")))


def collisions(defs: DataFrame) -> DataFrame:
    """Keys claimed by several owners; two owners of one local group may share.

    ``defs`` holds owner, key and grp (null for a shared owner). Each key is
    one row with its owners and the number of clashing pairs, so a key everyone
    claims costs its owners once, not their pairs.
    """
    claims = defs.select("key", "owner", "grp").distinct()
    sizes = claims.groupBy("key", "grp").agg(F.count(F.lit(1)).alias("n"), F.min("owner").alias("lo"), F.max("owner").alias("hi"))
    n = F.sum("n")
    exempt = F.sum(F.when(F.col("grp").isNotNull(), F.col("n") * (F.col("n") - 1) / 2).otherwise(0))
    folded = sizes.groupBy("key").agg(n.alias("n_owners"), (n * (n - 1) / 2 - exempt).cast("long").alias("n_clashes"),
                                      F.min("lo").alias("first_owner"), F.max("hi").alias("last_owner"))
    return folded.where("n_clashes > 0")


def bare_keys(defs: DataFrame, marker: str) -> DataFrame:
    """Keys of shared owners that do not start with a scope marker."""
    return defs.where(F.col("grp").isNull() & ~F.col("key").rlike(marker)).select("owner", "key").distinct()


def missing(every: DataFrame, made: DataFrame, key: str) -> DataFrame:
    return every.select(key).distinct().join(made.select(key), key, "left_anti")


def shared_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def upsert_registry(log: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Latest sighting of each name; one without bytes never replaces one with them."""
    stamp = F.struct(F.col("bytes").isNotNull(), *order)
    return log.where(F.col(key) != "").groupBy(key).agg(F.max_by(F.struct("css_key", "bytes"), stamp).alias("v")).select(key, "v.*")


def skipped_report(records: DataFrame, silent: Sequence[str], k: int = SKIPPED_SHOWN) -> DataFrame:
    """The most common skipped types, silent ones left out."""
    counts = records.where(~F.col("type").isin(*silent)).groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "type").limit(k)
