"""Registered plans: state folded from edit logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import editlog, lookups, undo
from ..sources.fields import scan_fields
from .registry import plan
from .views import Views


def mailbox(v: Views) -> DataFrame:
    """Clicks and views park a file, purchases and errors take it."""
    op = F.when(F.col("event_type").isin("click", "view"), "park").when(F.col("event_type").isin("purchase", "error"), "take")
    return v.logged.select(F.col("user_id").alias("doc"), "block", "ts", "event_id", op.alias("op"), F.concat(F.lit("file"), F.col("event_id").cast("string")).alias("value"))


@plan
def t1_replay(v: Views) -> DataFrame:
    return undo.replay(v.edits, F.col("block"))


@plan
def t1_replay_shallow(v: Views) -> DataFrame:
    """The same log with a history of three steps, so the limit bites everywhere."""
    return undo.replay(v.edits, F.col("block"), limit=3)


@plan
def t2_field_state(v: Views) -> DataFrame:
    return editlog.field_state(v.field_log).select("doc", "name", "kind", "value", F.col("on").alias("is_on"), "event_id", "seeded")


@plan
def t3_live_annots(v: Views) -> DataFrame:
    return editlog.live_annots(v.annot_log)


@plan
def t4_changed_pages(v: Views) -> DataFrame:
    return editlog.changed_pages(v.annot_log, F.date_format("ts", "yyyy-MM-dd HH"), F.col("block"))


@plan
def t5_coalesce_bursts(v: Views) -> DataFrame:
    out = editlog.coalesce_bursts(v.field_log, "6 hours")
    return out.withColumn("tick", F.date_format("tick", "yyyy-MM-dd HH:mm"))


@plan
def t6_handoff(v: Views) -> DataFrame:
    return editlog.handoff(mailbox(v), F.col("block"))


@plan
def t7_dedupe_payload(v: Views) -> DataFrame:
    return editlog.dedupe_payload(v.revisions)


@plan
def t8_restore_cost(v: Views) -> DataFrame:
    return editlog.restore_cost(v.revisions, F.col("block"))


@plan
def a5_completion(v: Views) -> DataFrame:
    return editlog.completion(editlog.field_state(v.field_log))


@plan
def p10_mirror_values(v: Views) -> DataFrame:
    boxes = scan_fields(v.widgets).select("doc", "name", "widget_id", "x", "y")
    return lookups.mirror_values(boxes, editlog.field_state(v.field_log)).withColumnRenamed("on", "is_on")
