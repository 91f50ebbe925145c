"""What all log formats share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assentlake.functions.binding import once
from assentlake.operators.carry import block_changes, timeline
from assentlake.session import staged

MESSAGE_COLUMNS = ("msg_id", "harness", "session_id", "ts", "model", "text")
#: Digits of a line number, so that ids sort as lines do.
LINE_DIGITS = 12


def line_blocks(raw: DataFrame) -> DataFrame:
    """Where the blocks of each file begin, counted in lines: one row for each block.

    Staged, so that its real size decides how lines meet it: small ones are broadcast, and the
    texts stay where they were read.
    """
    return staged(timeline(block_changes(raw)).drop("changes", "before"), "blocks")


def line_id() -> Column:
    """Identifies a line by its file and its number there, from 0, however the file was split."""
    line = F.col("first_line") + F.col("pos") - F.col("first_pos")
    return F.concat_ws("#", "file_path", F.lpad(line.cast("string"), LINE_DIGITS, "0"))


def filled(records: DataFrame, text: Column) -> DataFrame:
    """Add ``text``; records without one are dropped."""
    return once(records, "text", text).where(F.length("text") > 0)


def messages(
    records: DataFrame,
    harness: str,
    msg_id: Column,
    session_id: Column,
    ts: Column,
    model: Column,
    text: Column,
    keep_empty: bool = False,
) -> DataFrame:
    """Project records to the messages table; empty texts are dropped unless told otherwise."""
    rows = once(records, "text", text) if keep_empty else filled(records, text)
    return rows.select(
        msg_id.alias("msg_id"),
        F.lit(harness).alias("harness"),
        session_id.alias("session_id"),
        ts.alias("ts"),
        model.alias("model"),
        "text",
    )


def line_messages(
    records: DataFrame,
    harness: str,
    session_id: Column,
    ts: Column,
    model: Column,
    text: Column,
    blocks: DataFrame | None,
) -> DataFrame:
    """Messages of records that are lines.

    With ``blocks`` (see line_blocks) ids do not depend on how files are split. Without, they
    name the block and the place in the scan, and cost nothing.
    """
    place = F.concat_ws("#", "file_path", "block_start", "pos")
    if blocks is None:
        return messages(records, harness, place, session_id, ts, model, text)
    keys = ("file_path", "block_start", "pos")
    rows = filled(records, text).select(
        *keys, session_id.alias("session_id"), ts.alias("ts"), model.alias("model"), "text"
    )
    numbered = rows.join(blocks, ["file_path", "block_start"])
    return numbered.select(line_id().alias("msg_id"), F.lit(harness).alias("harness"), *MESSAGE_COLUMNS[2:])
