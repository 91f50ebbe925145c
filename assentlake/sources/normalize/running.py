"""Formats in which a record sets the model for all messages after it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from assentlake import fixed
from assentlake.functions.binding import once
from assentlake.functions.text import non_empty
from assentlake.functions.variants import child, flatten_content, json_variant, parse_ts, text_at
from assentlake.operators.carry import block_changes, timeline, value_at
from assentlake.session import staged
from assentlake.sources.files import file_stem, parse_lines
from assentlake.sources.normalize.shape import MESSAGE_COLUMNS, filled, line_id

V = "v"

# Values that a control record of these formats has as its type.
CODEX_CONTROL = ("session_meta", "turn_context")
SESSION_CONTROL = ("model_change",)


def _control(raw: DataFrame, words: Sequence[str]) -> DataFrame:
    """All lines, with the record ``v`` of those that may be control records, and no text.

    A line without any of the words is not parsed. A writer may escape letters, so lines with
    such an escape are parsed too.
    """
    value = F.col("value")
    may = reduce(or_, (value.contains(w) for w in (*words, "\\u00")))
    return once(raw, V, F.when(may, json_variant(value))).drop("value")


def _emit(replies: DataFrame, lists: DataFrame, harness: str) -> DataFrame:
    """Messages of replies: the model of the reply, of the last change, of the file, or none.

    The one join of texts; ``lists`` is staged, so that it is broadcast where it is small.
    """
    running = F.coalesce("own_model", value_at(F.col("pos"), F.col("changes")), "before", "initial")
    return (
        replies.join(lists, ["file_path", "block_start"])
        .withColumn("msg_id", line_id())
        .withColumn("harness", F.lit(harness))
        .withColumn("model", F.coalesce(running, F.lit(fixed.FALLBACK_MODEL[harness])))
        .select(*MESSAGE_COLUMNS)
    )


def _with_thread_models(lines: DataFrame, known: DataFrame) -> DataFrame:
    """block_changes of lines (.., changed, meta_id), where a thread's model stands for a missing one.

    Only session_meta lines look a model up. Other control lines get keys of their own that
    match nothing, so that a shuffled join does not pile them up on NULL.
    """
    control = F.when(F.coalesce("changed", "meta_id").isNotNull(), F.struct("pos", "changed", "meta_id"))
    blocks = lines.groupBy("file_path", "block_start").agg(
        F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.collect_list(control).alias("control")
    )
    block = ["file_path", "block_start", "first_pos", "last_pos"]
    single = blocks.select(*block, F.explode_outer("control").alias("c"))
    key = F.when(F.col("c.changed").isNull() & F.col("c.meta_id").isNotNull(), F.col("c.meta_id")).otherwise(
        F.concat_ws("#", F.lit("\0"), "file_path", "block_start", "c.pos")
    )
    joined = single.withColumn("_key", key).join(known, F.col("_key") == F.col("_id"), "left")
    value = F.coalesce("c.changed", "_found")
    change = F.when(value.isNotNull(), F.struct(F.col("c.pos").alias("pos"), value.alias("value")))
    return joined.groupBy(*block).agg(F.sort_array(F.collect_list(change)).alias("changes"))


def normalize_codex(raw: DataFrame, thread_models: DataFrame | None, run_ts: Column) -> DataFrame:
    """Rollout lines to messages. The model starts at the thread's lookup value."""
    path = F.col("file_path")
    kind = text_at(V, "$.type")
    context = text_at(V, "$.payload.model", "$.payload.collaboration_mode.settings.model", "$.payload.info.model")
    session = F.coalesce(non_empty(F.regexp_extract(path, fixed.UUID_PATTERN, 0)), file_stem(path, ".jsonl"))
    lines = _control(raw, CODEX_CONTROL).select(
        "file_path",
        "block_start",
        "pos",
        F.when(kind == "session_meta", text_at(V, "$.payload.model"))
        .when(kind == "turn_context", context)
        .alias("changed"),
        F.when(kind == "session_meta", text_at(V, "$.payload.id", "$.payload.session_id")).alias("meta_id"),
    )
    if thread_models is None:
        lists = timeline(block_changes(lines, F.col("changed"))).withColumn("initial", F.lit(None).cast("string"))
    else:
        known = staged(thread_models.select(F.col("id").alias("_id"), F.col("model").alias("_found")), "threads")
        blocks = timeline(_with_thread_models(lines, known)).withColumn("_session", session)
        lists = (
            blocks.join(known, F.col("_session") == F.col("_id"), "left")
            .withColumnRenamed("_found", "initial")
            .drop("_session", "_id")
        )

    assistant = text_at(V, "$.payload.role", "$.role") == "assistant"
    payload_content = child(V, "$.payload.content")
    is_blank = payload_content.isNull() | F.coalesce(F.try_variant_get(payload_content, "$", "string") == "", F.lit(False))
    content = F.when(is_blank, child(V, "$.content")).otherwise(payload_content)
    replies = filled(parse_lines(raw).where(assistant), flatten_content(content, ["output_text", "text"])).select(
        "file_path",
        "block_start",
        "pos",
        session.alias("session_id"),
        parse_ts(V, ["$.timestamp", "$.payload.timestamp"], run_ts).alias("ts"),
        F.lit(None).cast("string").alias("own_model"),
        "text",
    )
    return _emit(replies, staged(lists, "codex"), "codex")


def _normalize_sessions(raw: DataFrame, harness: str, change: Column, own_model: Column, run_ts: Column) -> DataFrame:
    kind = text_at(V, "$.type")
    lines = _control(raw, SESSION_CONTROL).select(
        "file_path", "block_start", "pos", F.when(kind == "model_change", change).alias("changed")
    )
    lists = timeline(block_changes(lines, F.col("changed"))).withColumn("initial", F.lit(None).cast("string"))
    assistant = (kind == "message") & (text_at(V, "$.message.role") == "assistant")
    text = flatten_content(child(V, "$.message.content"), ["text"])
    replies = filled(parse_lines(raw).where(assistant), text).select(
        "file_path",
        "block_start",
        "pos",
        file_stem(F.col("file_path"), ".jsonl").alias("session_id"),
        parse_ts(V, ["$.message.timestamp", "$.timestamp"], run_ts).alias("ts"),
        own_model.alias("own_model"),
        "text",
    )
    return _emit(replies, staged(lists, harness), harness)


def normalize_omp(raw: DataFrame, run_ts: Column) -> DataFrame:
    return _normalize_sessions(raw, "omp", text_at(V, "$.model"), text_at(V, "$.message.model"), run_ts)


def normalize_pi(raw: DataFrame, run_ts: Column) -> DataFrame:
    return _normalize_sessions(
        raw, "pi", text_at(V, "$.modelId", "$.model"), text_at(V, "$.message.model", "$.message.modelId"), run_ts
    )
