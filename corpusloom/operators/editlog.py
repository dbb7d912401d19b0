"""State folded from edit logs.

Most folds are order-insensitive once phrased as "the latest row that …", so
they are plain aggregates with map-side combining. Scans that need neighbours
use the blocked helpers of :mod:`ordered`. Rows are ordered by (ts, event_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import carry_forward, hour_block, previous

ORDER = ["ts", "event_id"]


def stamp() -> Column:
    return F.struct(*ORDER)


# field values -------------------------------------------------------------------


def field_state(log: DataFrame) -> DataFrame:
    """Last write wins per field; an emptied text field is gone; seeds only fill gaps.

    A seed (a value found in the file) counts only while nothing is present:
    the first non-empty one after the latest edit, if that edit cleared the field.
    """
    texty = F.col("kind").isin("text", "choice")
    cells = ["kind", "value", "on"]
    edits = log.where("NOT seed").groupBy("doc", "name").agg(
        F.max_by(F.struct(*cells, *ORDER), stamp()).alias("e"))
    cleared = (F.col("e.kind") == "text") & (F.col("e.value") == "")
    seeds = log.where(F.col("seed") & (F.col("value") != "") & (texty | (F.col("value") != "Off")))
    open_ = (seeds.join(edits, ["doc", "name"], "left")
             .where(F.col("e").isNull() | (cleared & (F.struct(*ORDER) > F.struct("e.ts", "e.event_id")))))
    first = open_.groupBy("doc", "name").agg(F.min_by(F.struct(*cells, *ORDER), stamp()).alias("s"))
    both = edits.join(first, ["doc", "name"], "full_outer")
    present = F.col("e").isNotNull() & ~cleared
    chosen = (both.withColumn("seeded", ~F.coalesce(present, F.lit(False)))
              .withColumn("v", F.when(F.col("seeded"), F.col("s")).otherwise(F.col("e"))).where("v IS NOT NULL")
              .select("doc", "name", "v.*", "seeded"))
    # a seeded tick box is on
    return chosen.withColumn("on", F.when(F.col("seeded") & ~texty, F.lit(True)).otherwise(F.col("on")))


def completion(state: DataFrame) -> DataFrame:
    """Fields touched and fields actually filled in, per document."""
    ticked = F.when(F.col("kind").isin("check", "radio"), F.col("on")).otherwise(F.col("value") != "")
    return state.groupBy("doc").agg(F.count(F.lit(1)).alias("touched"), F.count_if(ticked).alias("filled"))


# annotations ----------------------------------------------------------------------


STEP = [*ORDER, "sub"]


def annot_steps(log: DataFrame) -> DataFrame:
    """The log in single steps, with ``sub`` after (ts, event_id): a load is a clear, then an add of each of its items.

    ``log``: doc, id, op (add, remove, touch, clear, load), page, ts, event_id,
    and ``items``, an array of (id, page), where there are loads. Works on streams.
    """
    if "items" not in log.columns:
        return log.withColumn("sub", F.lit(0).cast("long"))
    loaded = F.transform("items", lambda x, i: F.struct(F.lit("add").alias("op"), x["id"].alias("id"), x["page"].alias("page"), (i + 1).cast("long").alias("sub")))
    ids = dict(log.dtypes)
    alone = F.struct(F.when(F.col("op") == "load", F.lit("clear")).otherwise(F.col("op")).alias("op"), F.when(F.col("op") != "load", F.col("id")).cast(ids["id"]).alias("id"),
                     F.when(F.col("op") != "load", F.col("page")).cast(ids["page"]).alias("page"), F.lit(0).cast("long").alias("sub"))
    steps = F.concat(F.array(alone), F.when(F.col("op") == "load", F.coalesce(loaded, F.array().cast(f"array<struct<op:string,id:{ids['id']},page:{ids['page']},sub:bigint>>")))
                     .otherwise(F.array().cast(f"array<struct<op:string,id:{ids['id']},page:{ids['page']},sub:bigint>>")))
    rest = [c for c in log.columns if c not in ("op", "id", "page", "items")]
    return log.select(*rest, F.explode(steps).alias("s")).select(*rest, "s.*")


def live_annots(log: DataFrame) -> DataFrame:
    """Annotations standing at the end: added or loaded last, and after the document's last clear or load."""
    log, at = annot_steps(log), F.struct(*STEP)
    cleared = log.where("op = 'clear'").groupBy("doc").agg(F.max(at).alias("_clear"))
    last = log.where(F.col("op").isin("add", "remove")).groupBy("doc", "id").agg(F.max_by(F.struct("op", "page", *STEP), at).alias("e"))
    return (last.where("e.op = 'add'").join(cleared, "doc", "left")
            .where(F.col("_clear").isNull() | (F.struct(*[f"e.{c}" for c in STEP]) > F.col("_clear")))
            .select("doc", "id", F.col("e.page").alias("page"), F.col("e.event_id").alias("event_id")))


def _negated(c: str) -> Column:
    return -F.unix_micros(F.col(c).cast("timestamp")) if c == "ts" else -F.col(c)


def changed_pages(log: DataFrame, commit: Column, block: Column | None = None) -> DataFrame:
    """Pages each commit repaints: every add's page, and a touched, removed, cleared or replaced mark's own page.

    An add is followed to its end: the next add or remove of its id, or the
    document's next clear or load, whichever is first. Both searches run
    backwards in blocks.
    """
    log = annot_steps(log.withColumn("commit", commit).withColumn("_b", hour_block() if block is None else block))
    log = log.withColumns({f"_{c}": _negated(c) for c in STEP})
    back, block = [f"_{c}" for c in STEP], -F.col("_b")
    cells = ["doc", "id", "op", "page", *STEP, "commit", *back, "_b"]
    event = F.struct(*STEP, "op", "commit")
    own = log.where(F.col("op").isin("add", "remove"))
    ended = carry_forward(own, ["doc", "id"], block, back, event, "_own", inclusive=False)
    relevant = ended.select(*cells, "_own").unionByName(log.where("op = 'clear'").select(*cells), allowMissingColumns=True)
    both = carry_forward(relevant, ["doc"], block, back, F.when(F.col("op") == "clear", event), "_clear", inclusive=False)
    end = F.when(F.col("_own").isNull(), F.col("_clear")).when(F.col("_clear").isNull(), F.col("_own")).otherwise(F.least("_own", "_clear"))
    adds = both.where("op = 'add'").withColumn("_end", end)
    shown = adds.select("doc", "commit", "page")
    gone = adds.where(F.col("_end.op").isin("remove", "clear")).select("doc", F.col("_end.commit").alias("commit"), "page")
    return shown.unionByName(gone).unionByName(_touched_pages(log)).distinct()


def _touched_pages(log: DataFrame) -> DataFrame:
    """The page of the mark that stands where a touch comes: the last add of its id, unless removed or cleared since."""
    marks = log.where(F.col("op").isin("add", "remove", "touch"))
    event = F.struct(*STEP, "op", "page")
    held = carry_forward(marks, ["doc", "id"], F.col("_b"), STEP, F.when(F.col("op") != "touch", event), "_mark", inclusive=False).where("op = 'touch'")
    both = held.select("doc", "op", *STEP, "commit", "_b", "_mark").unionByName(log.where("op = 'clear'").select("doc", "op", *STEP, "commit", "_b"), allowMissingColumns=True)
    met = carry_forward(both, ["doc"], F.col("_b"), STEP, F.when(F.col("op") == "clear", F.struct(*STEP)), "_clear", inclusive=False)
    standing = (F.col("_mark.op") == "add") & (F.col("_clear").isNull() | (F.struct(*[f"_mark.{c}" for c in STEP]) > F.col("_clear")))
    return met.where((F.col("op") == "touch") & standing).select("doc", "commit", F.col("_mark.page").alias("page"))


# bursts, hand-off, revisions --------------------------------------------------------


def coalesce_bursts(log: DataFrame, tick: str) -> DataFrame:
    """One row per key and tick: the last event, and how many it stands for."""
    return (log.groupBy("doc", F.window("ts", tick).alias("w"))
            .agg(F.count(F.lit(1)).alias("n"), F.max_by("event_id", stamp()).alias("last_id"))
            .select("doc", F.col("w.start").alias("tick"), "n", "last_id"))


def handoff(log: DataFrame, block: Column | None = None) -> DataFrame:
    """A one-slot mailbox: a take gets the value parked since the last take, or nothing.

    Among parks and takes, that is whatever the row just before the take parked.
    """
    ops = log.where(F.col("op").isin("park", "take"))
    before = previous(ops, ["doc"], hour_block() if block is None else block, ORDER, ["op", "value"], "_p")
    return before.where("op = 'take'").select("doc", "event_id", F.when(F.col("_p.op") == "park", F.col("_p.value")).alias("value"))


def dedupe_payload(snapshots: DataFrame) -> DataFrame:
    """One stored payload per document revision, shared by its snapshots."""
    return snapshots.groupBy("doc", "stamp").agg(F.min_by("event_id", stamp()).alias("payload_id"), F.count(F.lit(1)).alias("n_snapshots"))


def restore_cost(snapshots: DataFrame, block: Column | None = None) -> DataFrame:
    """Whether stepping back from each snapshot only repaints (same revision) or reopens."""
    before = previous(snapshots, ["doc"], hour_block() if block is None else block, ORDER, ["stamp"], "_p")
    return before.where("_p IS NOT NULL").select("doc", "event_id", (F.col("_p.stamp") == F.col("stamp")).alias("cheap"))
