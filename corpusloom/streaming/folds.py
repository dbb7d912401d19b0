"""Edit logs as streams.

Rows may arrive in any order inside the watermark. Each key keeps the events
the watermark has not passed yet and applies them in (ts, event_id) order once
it has, so the result is the batch answer for any split into micro-batches and
any restart. Events older than the watermark are not applied: Spark takes them
out ahead of the step and counts them in the query's progress
(``numRowsDroppedByWatermark``). The log still holds them, and the batch operator
over the log is the answer with them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.editlog import annot_steps

DELAY = "1 hour"


def _ordered(initial: dict, step: Callable[[dict, dict], None], emit: Callable[[dict], tuple | list], columns: list[str]):
    """A stateful function folding ``columns`` of each event, in event-time order, per key.

    ``emit`` gives the row of a key's new state, or a list of rows (none is fine).
    """
    tie = columns.index("sub") + 2 if "sub" in columns else 1  # steps of one event keep their order

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"fold": initial, "wait": [], "late": 0, "applied": 0}
        passed = state.getCurrentWatermarkMs()
        for pdf in batches:
            micros = pdf["ts"].astype("datetime64[us]").astype("int64")
            for ts, event_id, *rest in zip(micros, pdf["event_id"], *[pdf[c] for c in columns]):
                event = [int(ts), int(event_id), *[None if v is pd.NaT or v != v else v.item() if hasattr(v, "item") else v for v in rest]]
                if ts // 1000 < passed:
                    held["late"] += 1
                else:
                    held["wait"].append(event)
        held["wait"].sort(key=lambda e: (e[0], e[1], e[tie]))
        ready = [e for e in held["wait"] if e[0] // 1000 < passed]
        held["wait"] = held["wait"][len(ready):]
        for e in ready:
            step(held["fold"], dict(zip(["ts", "event_id", *columns], e)))
        held["applied"] += len(ready)
        if held["wait"]:
            state.setTimeoutTimestamp(max(held["wait"][0][0] // 1000, passed) + 1)
        made = emit(held["fold"]) if ready else []
        state.update((json.dumps(held),))
        if made:
            yield pd.DataFrame([(*key, *row, held["applied"], held["late"]) for row in (made if isinstance(made, list) else [made])])

    return run


def _fold(stream: DataFrame, keys: list[str], key_types: str, out: str, fn) -> DataFrame:
    schema = f"{key_types}, {out}, applied long, late long"
    names = [f.split()[0] for f in schema.split(", ")]

    def named(key, batches, state):
        for pdf in fn(key, batches, state):
            pdf.columns = names
            yield pdf

    return (stream.withWatermark("ts", DELAY).groupBy(*keys)
            .applyInPandasWithState(named, schema, "held string", "update", GroupStateTimeout.EventTimeTimeout))


def replay(edits: DataFrame, limit: int | None = None) -> DataFrame:
    """Undo depth, redo count and undo label per session, updated as the watermark moves; at most ``limit`` steps, if given."""

    def step(s: dict, e: dict) -> None:
        if e["op"] == "push":
            s["past"] = [*s["past"], e["label"]][-limit:] if limit else [*s["past"], e["label"]]
            s["redo"] = 0
        elif e["op"] == "undo" and s["past"]:
            s["past"].pop()
            s["redo"] += 1
        elif e["op"] == "redo" and s["redo"]:
            s["past"].append("")
            s["redo"] -= 1
        elif e["op"] == "clear":
            s["past"], s["redo"] = [], 0

    fn = _ordered({"past": [], "redo": 0}, step, lambda s: (len(s["past"]), s["redo"], s["past"][-1] if s["past"] else ""), ["op", "label"])
    return _fold(edits, ["session"], "session long", "depth long, redo long, label string", fn)


def field_state(log: DataFrame) -> DataFrame:
    """Last write per field; a cleared text field shows as a null value."""

    def step(s: dict, e: dict) -> None:
        if e["seed"]:
            texty = e["kind"] in ("text", "choice")
            if s["value"] is None and e["value"] and (texty or e["value"] != "Off"):
                s.update(kind=e["kind"], value=e["value"], on=bool(e["on"]) if texty else True, seeded=True)
        elif e["kind"] == "text" and not e["value"]:
            s.update(kind=None, value=None, on=None, seeded=False)
        else:
            s.update(kind=e["kind"], value=e["value"], on=bool(e["on"]), seeded=False)

    fn = _ordered({"kind": None, "value": None, "on": None, "seeded": False}, step,
                  lambda s: (s["kind"], s["value"], s["on"], s["seeded"]), ["kind", "value", "on", "seed"])
    return _fold(log, ["doc", "name"], "doc long, name string", "kind string, value string, on boolean, seeded boolean", fn)


def handoff(log: DataFrame) -> DataFrame:
    """The value each document's latest take received."""

    def step(s: dict, e: dict) -> None:
        if e["op"] == "park":
            s["slot"] = e["value"]
        else:
            s["taken"], s["slot"], s["take"] = s["slot"], None, e["event_id"]

    fn = _ordered({"slot": None, "taken": None, "take": None}, step, lambda s: (s["take"], s["taken"]), ["op", "value"])
    return _fold(log, ["doc"], "doc long", "take_id long, value string", fn)


def coalesce_bursts(log: DataFrame, tick: str) -> DataFrame:
    """One row per key and tick once the watermark has closed it; built-in state, no Python."""
    return (log.withWatermark("ts", DELAY).groupBy("doc", F.window("ts", tick).alias("w"))
            .agg(F.count(F.lit(1)).alias("n"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_id"))
            .select("doc", F.col("w.start").alias("tick"), "n", "last_id"))


def _mark_step(commit_ms: int | None) -> Callable[[dict, dict], None]:
    """Fold one annotation event into the standing marks; pages repainted go to ``out`` with their commit."""

    def step(s: dict, e: dict) -> None:
        marks, pages = s["marks"], []
        name = None if e["id"] is None else str(int(e["id"]))  # a column with nulls comes as floats
        if e["op"] == "add":
            marks[name] = [int(e["page"]), e["event_id"]]
            pages = [int(e["page"])]
        elif e["op"] == "clear":
            pages = [p for p, _ in marks.values()]
            marks.clear()
        elif name in marks and e["op"] in ("remove", "touch"):
            pages = [(marks.pop(name) if e["op"] == "remove" else marks[name])[0]]
        if commit_ms is not None:
            s["out"] += [[e["ts"] // 1000 // commit_ms * commit_ms, p] for p in pages]

    return step


def changed_pages(log: DataFrame, commit_seconds: int = 3600) -> DataFrame:
    """(doc, commit, page) of every page an add, touch, remove, clear or load repaints, as the watermark passes it.

    ``commit`` is the start of the event's stretch of ``commit_seconds``. A row
    may come again in a later batch; its distinct rows are the batch answer.
    """

    def emit(s: dict) -> list:
        out, s["out"] = sorted({tuple(x) for x in s["out"]}), []
        return [(pd.Timestamp(ms, unit="ms"), page) for ms, page in out]

    fn = _ordered({"marks": {}, "out": []}, _mark_step(commit_seconds * 1000), emit, ["op", "id", "page", "sub"])
    return _fold(annot_steps(log), ["doc"], "doc long", "commit timestamp, page long", fn)


def live_annots(log: DataFrame) -> DataFrame:
    """Per document its standing marks, as an array of (id, page, event_id) that grows and shrinks with the log."""

    def emit(s: dict) -> tuple:
        return (sorted((int(k), int(p), int(e)) for k, (p, e) in s["marks"].items()),)

    fn = _ordered({"marks": {}, "out": []}, _mark_step(None), emit, ["op", "id", "page", "sub"])
    return _fold(annot_steps(log), ["doc"], "doc long", "marks array<struct<id:bigint,page:bigint,event_id:bigint>>", fn)


def upsert_latest(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that can be replayed: each batch lands in its own folder.

    Read it back with the highest ``applied`` per key; a batch written twice
    after a restart overwrites itself.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def latest(written: DataFrame, keys: list[str]) -> DataFrame:
    """Current value per key from what :func:`upsert_latest` wrote."""
    rest = [c for c in written.columns if c not in (*keys, "batch")]
    return written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "applied").alias("v")).select(*keys, "v.*")
