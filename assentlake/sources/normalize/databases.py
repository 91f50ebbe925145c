"""Formats kept in SQLite files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assentlake import fixed
from assentlake.functions.binding import once
from assentlake.functions.text import trim_all
from assentlake.functions.variants import array_at, json_variant, parse_ts, string_at, text_at
from assentlake.sources.files import parent_name, parse_lines
from assentlake.sources.normalize.documents import items
from assentlake.sources.normalize.shape import messages

V, ITEM = "v", "item"

CURSOR_QUERY = "SELECT key, value FROM ItemTable WHERE key LIKE '%chat%' OR key LIKE '%composer%'"
OPENCODE_MESSAGES_QUERY = "SELECT id, session_id, time_created, data FROM message"
OPENCODE_PARTS_QUERY = "SELECT message_id, data FROM part"
THREADS_QUERY = "SELECT id, model FROM threads WHERE model IS NOT NULL"
SESSIONS_QUERY = "SELECT id, model FROM sessions WHERE model IS NOT NULL"


def normalize_cursor(rows: DataFrame, run_ts: Column) -> DataFrame:
    """Rows (file_path, key, value) of the editor's item table."""
    key = F.lower("key")
    parsed = parse_lines(rows.where(key.contains("chat") | key.contains("composer")))
    nothing = F.array().cast("array<variant>")
    holders = F.coalesce(
        array_at(V, "$"),
        F.concat(
            F.coalesce(array_at(V, "$.tabs"), nothing),
            F.coalesce(array_at(V, "$.allComposers"), nothing),
            F.coalesce(array_at(V, "$.conversations"), nothing),
        ),
    )
    talks = items(parsed, holders).withColumnsRenamed({"item": "talk", "item_no": "talk_no"})
    talk = F.col("talk")
    bubbles = items(talks, F.coalesce(array_at(talk, "$.bubbles"), array_at(talk, "$.messages")))
    spoken = (
        F.coalesce(text_at(ITEM, "$.type") == "ai", F.lit(False))
        | F.coalesce(text_at(ITEM, "$.speaker") == "ai", F.lit(False))
        | F.coalesce(text_at(ITEM, "$.role") == "assistant", F.lit(False))
    )
    text = F.coalesce(string_at(ITEM, "$.text"), string_at(ITEM, "$.rawText"), string_at(ITEM, "$.content"), F.lit(""))
    return messages(
        bubbles.where(spoken),
        "cursor",
        F.concat_ws("#", "file_path", "key", "talk_no", "item_no"),
        parent_name(F.col("file_path")),
        parse_ts(ITEM, ["$.timestamp"], run_ts),
        F.coalesce(
            text_at(talk, "$.modelType", "$.selectedModel"), F.lit(fixed.FALLBACK_MODEL["cursor"])
        ),
        trim_all(text),
    )


def join_message_part(message: DataFrame, part: DataFrame) -> DataFrame:
    """Each part next to its message; ids are unique within one database file only."""
    parts = part.select(
        F.col("file_path"), F.col("message_id").alias("id"), F.col("data").alias("part_data")
    )
    return message.withColumnRenamed("data", "message_data").join(parts, ["file_path", "id"])


def normalize_opencode(message: DataFrame, part: DataFrame, run_ts: Column) -> DataFrame:
    """Every part with text of an assistant message is a message row."""
    m, p = F.col("m"), F.col("p")
    # The role is tested before the join, so that only assistant messages are shuffled.
    replies = (
        once(message, "m", json_variant(F.col("data")))
        .where(text_at(m, "$.role") == "assistant")
        .select(
            "file_path", "id", "session_id", "time_created",
            text_at(m, "$.model").alias("data"),
        )
    )
    body = F.coalesce(
        F.when(text_at(p, "$.type") == "text", string_at(p, "$.text")), string_at(p, "$.content")
    )
    parsed = once(part, "p", json_variant(F.col("data")))
    texts = once(parsed, "data", trim_all(body)).where(F.length("data") > 0).drop("p")
    millis = F.nullif(F.expr("try_cast(time_created as bigint)"), F.lit(0).cast("bigint"))
    return messages(
        join_message_part(replies, texts),
        "opencode",
        F.concat_ws("#", "file_path", "id"),
        F.col("session_id").cast("string"),
        F.coalesce(F.timestamp_millis(millis), run_ts),
        F.coalesce(F.col("message_data"), F.lit(fixed.FALLBACK_MODEL["opencode"])),
        F.col("part_data"),
    )
