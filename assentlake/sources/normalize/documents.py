"""Formats with one JSON document per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assentlake import fixed
from assentlake.functions.text import trim_all
from assentlake.functions.variants import child, flatten_content, parse_ts, string_at, text_at
from assentlake.sources.files import doc_elements, file_stem, parent_name, parse_docs
from assentlake.sources.normalize.lines import plain_text
from assentlake.sources.normalize.shape import messages

V, ITEM = "v", "item"


def items(docs: DataFrame, elements: Column) -> DataFrame:
    """One row per element of an array of each document, as (item_no, item).

    Elements of a document in several parts are numbered through.
    """
    # The outer form: the inner one would add a test that reads the array once more.
    exploded = docs.select("*", F.posexplode_outer(elements).alias("item_no", "item"))
    if "first_item" in docs.columns:
        exploded = exploded.withColumn("item_no", F.col("first_item") + F.col("item_no"))
    return exploded.where(F.col("item").isNotNull())


def item_id(tag: str) -> Column:
    return F.concat_ws("#", "file_path", F.lit(tag), "item_no")


def normalize_pi_workflow(raw: DataFrame, run_ts: Column) -> DataFrame:
    """Every string result of a workflow journal is a message, blank ones included."""
    entries = items(parse_docs(raw), doc_elements("$.journal")).withColumn(
        "result", string_at(ITEM, "$.result")
    )
    return messages(
        entries.where(F.col("result").isNotNull()),
        "pi",
        item_id("journal"),
        F.coalesce(text_at(V, "$.runId"), file_stem(F.col("file_path"), ".json")),
        run_ts,
        F.lit(fixed.FALLBACK_MODEL["pi_workflow"]),
        F.col("result"),
        keep_empty=True,
    )


def normalize_cline(raw: DataFrame, run_ts: Column) -> DataFrame:
    """Task files. A task kept in both file kinds counts in both."""
    task = parent_name(F.col("file_path"))
    entries = items(parse_docs(raw), doc_elements("$"))
    ts = parse_ts(ITEM, ["$.ts"], run_ts)
    default = F.lit(fixed.FALLBACK_MODEL["cline"])
    api = messages(
        entries.where(text_at(ITEM, "$.role") == "assistant"),
        "cline",
        item_id("api"),
        task,
        ts,
        F.coalesce(text_at(ITEM, "$.model"), default),
        flatten_content(child(ITEM, "$.content"), ["text"]),
    )
    said = (
        (text_at(ITEM, "$.type") == "say")
        & (text_at(ITEM, "$.say") == "text")
        & string_at(ITEM, "$.text").isNotNull()
    )
    ui = messages(
        entries.where(said), "cline", item_id("ui"), task, ts, default, string_at(ITEM, "$.text"), keep_empty=True
    )
    return api.unionByName(ui)


def normalize_hermes(raw: DataFrame, run_ts: Column) -> DataFrame:
    """Session dumps: the messages array, and the choices of a recorded response."""
    docs = parse_docs(raw)
    session = F.coalesce(text_at(V, "$.session_id"), file_stem(F.col("file_path"), ".json"))
    default = F.lit(fixed.FALLBACK_MODEL["hermes"])
    turns = messages(
        items(docs, doc_elements("$.messages")).where(text_at(ITEM, "$.role") == "assistant"),
        "hermes",
        item_id("messages"),
        session,
        parse_ts(V, ["$.last_updated"], run_ts),
        F.coalesce(text_at(V, "$.model"), default),
        flatten_content(child(ITEM, "$.content"), ["text"]),
    )
    answered = (text_at(ITEM, "$.message.role") == "assistant") & string_at(
        ITEM, "$.message.content"
    ).isNotNull()
    choices = messages(
        items(docs, doc_elements("$.response.choices")).where(answered),
        "hermes",
        item_id("choices"),
        session,
        parse_ts(V, ["$.timestamp"], run_ts),
        F.coalesce(text_at(V, "$.response.model", "$.model"), default),
        trim_all(string_at(ITEM, "$.message.content")),
        keep_empty=True,
    )
    return turns.unionByName(choices)


def normalize_openclaw_docs(raw: DataFrame, run_ts: Column) -> DataFrame:
    """A bare array, or an object that holds the array in messages or history."""
    elements = doc_elements("$", "$.messages", "$.history")
    assistant = (text_at(ITEM, "$.role") == "assistant") | (text_at(ITEM, "$.type") == "assistant")
    return messages(
        items(parse_docs(raw), elements).where(assistant),
        "openclaw",
        item_id("doc"),
        file_stem(F.col("file_path"), ".json"),
        parse_ts(ITEM, ["$.timestamp"], run_ts),
        F.coalesce(
            text_at(ITEM, "$.model"), text_at(V, "$.model"), F.lit(fixed.FALLBACK_MODEL["openclaw"])
        ),
        plain_text(ITEM),
    )
