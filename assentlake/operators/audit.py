"""Counts over raw log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assentlake.functions.binding import once
from assentlake.functions.text import non_empty, trim_all
from assentlake.functions.variants import array_at, child, json_variant, string_at, text_at

V = "v"

# What a line of an assistant reply usually holds, and what it then lacks.
REPLY_MARKS = ('"assistant"', '"role":"model"', '"output_text"')
PLAIN_TEXT_MARK = '"text"'
OTHER_MARKS = ('"tool"', '"thinking"')


def _reply_texts() -> Column:
    """Number of non-blank texts of an assistant record, 0 for other records."""
    holder = F.coalesce(child(V, "$.message"), child(V, "$.payload"), V)
    assistant = F.coalesce(text_at(holder, "$.role") == "assistant", F.lit(False)) | F.coalesce(
        text_at(V, "$.role") == "assistant", F.lit(False)
    )
    content = F.coalesce(child(holder, "$.content"), child(V, "$.content"))
    kind = F.schema_of_variant(content)

    def filled(text: Column) -> Column:
        return F.coalesce(trim_all(text) != "", F.lit(False))

    def block(b: Column) -> Column:
        text = F.when(F.schema_of_variant(b) == "STRING", b.cast("string")).when(
            text_at(b, "$.type") == "text", string_at(b, "$.text")
        )
        return filled(text)

    count = (
        F.when(kind == "STRING", filled(content.cast("string")).cast("int"))
        .when(kind.startswith("ARRAY"), F.size(F.filter(array_at(content, "$"), block)))
        .otherwise(F.lit(0))
    )
    return F.when(assistant, count).otherwise(F.lit(0))


def line_audit(raw: DataFrame, *by: str) -> DataFrame:
    """Non-blank lines, lines that parse, and assistant texts, by the given columns."""
    filled = raw.where(non_empty(trim_all(F.col("value"))).isNotNull())
    lines = once(filled, "v", json_variant(F.col("value")))
    return lines.groupBy(*by).agg(
        F.count("*").alias("lines"),
        F.count("v").alias("parsed"),
        F.coalesce(F.sum(_reply_texts()), F.lit(0)).alias("assistant_texts"),
    )


def prefilter_audit(raw: DataFrame, *by: str) -> DataFrame:
    """How many lines a substring test would skip, and how many of those hold plain text."""
    value = F.col("value")
    marked = F.lit(False)
    for mark in REPLY_MARKS:
        marked = marked | value.contains(mark)
    doubtful = value.contains(PLAIN_TEXT_MARK)
    for mark in OTHER_MARKS:
        doubtful = doubtful & ~value.contains(mark)
    return raw.groupBy(*by).agg(
        F.count("*").alias("lines"),
        F.count_if(marked).alias("candidates"),
        F.count_if(~marked).alias("skipped"),
        F.count_if(~marked & doubtful).alias("skipped_with_text"),
    )
