"""Formats with one self-contained JSON record per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assentlake import fixed
from assentlake.functions.text import trim_all
from assentlake.functions.variants import child, flatten_content, parse_ts, string_at, text_at
from assentlake.sources.files import file_stem, parse_lines
from assentlake.sources.lookups import with_model
from assentlake.sources.normalize.shape import line_messages

V = "v"


def not_synthetic(model: Column) -> Column:
    """False for placeholder models such as <synthetic>."""
    return ~model.startswith("<") & (model != "synthetic")


def is_claude_reply(v: str = V) -> Column:
    """True for the record of an assistant, in any of the places a writer puts the role."""
    return (text_at(v, "$.type", "$.role") == "assistant") | (text_at(v, "$.message.role") == "assistant")


def normalize_claude(raw: DataFrame, run_ts: Column, blocks: DataFrame | None = None) -> DataFrame:
    model = F.coalesce(
        text_at(V, "$.message.model", "$.model"), F.lit(fixed.FALLBACK_MODEL["claude"])
    )
    records = (
        parse_lines(raw)
        .where(is_claude_reply())
        .withColumn("model", model)
        .where(not_synthetic(F.col("model")))
        .withColumn("content", F.coalesce(child(V, "$.message.content"), child(V, "$.content")))
    )
    return line_messages(
        records,
        "claude",
        file_stem(F.col("file_path"), ".jsonl"),
        parse_ts(V, ["$.timestamp", "$.message.timestamp"], run_ts),
        F.col("model"),
        flatten_content(F.col("content"), ["text"], any_content=True),
        blocks,
    )


def normalize_codebuddy(
    raw: DataFrame, session_models: DataFrame | None, run_ts: Column, blocks: DataFrame | None = None
) -> DataFrame:
    path = F.col("file_path")
    assistant = (text_at(V, "$.role", "$.type", "$.message.role") == "assistant") | (
        text_at(V, "$.message.role") == "assistant"
    )
    records = (
        parse_lines(raw.where(path.contains("/projects/") | path.contains("/sessions/")))
        .where(assistant)
        .withColumn("session_id", file_stem(path, ".jsonl"))
        .withColumn("own_model", text_at(V, "$.model", "$.message.model"))
        .withColumn("content", F.coalesce(child(V, "$.content"), child(V, "$.message.content")))
    )
    out = line_messages(
        records,
        "codebuddy",
        F.col("session_id"),
        parse_ts(V, ["$.timestamp", "$.message.timestamp"], run_ts),
        F.col("own_model"),
        flatten_content(F.col("content"), ["text", "output_text"]),
        blocks,
    )
    return with_model(out, session_models, F.col("session_id"), fixed.FALLBACK_MODEL["codebuddy"])


def normalize_openclaw_lines(raw: DataFrame, run_ts: Column, blocks: DataFrame | None = None) -> DataFrame:
    records = parse_lines(raw).where(text_at(V, "$.role", "$.type") == "assistant")
    return line_messages(
        records,
        "openclaw",
        file_stem(F.col("file_path"), ".jsonl"),
        parse_ts(V, ["$.timestamp"], run_ts),
        F.coalesce(text_at(V, "$.model"), F.lit(fixed.FALLBACK_MODEL["openclaw"])),
        plain_text(V),
        blocks,
    )


def plain_text(v: Column) -> Column:
    """A string ``content``, else a string ``text``, trimmed."""
    return trim_all(F.coalesce(string_at(v, "$.content"), string_at(v, "$.text"), F.lit("")))

