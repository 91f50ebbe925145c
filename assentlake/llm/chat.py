"""Chat transcripts as training text, in relational expressions only.

A block is ``<s>[INST] role [/INST] text</s>`` and a line feed; adjacent turns of one role share
a block, with ``<|turn|>`` between their texts. Where a role or text holds such a mark it is
escaped like an entity, so that the marks of the output are those of the template alone and
every turn can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

OPEN, MIDDLE, BETWEEN, CLOSE = "<s>[INST] ", " [/INST] ", "<|turn|>", "</s>\n"
# The escape sign first; a mark loses its first character.
ESCAPES = (
    ("&", "&amp;"),
    ("<s>", "&lt;s>"),
    ("</s>", "&lt;/s>"),
    ("<|turn|>", "&lt;|turn|>"),
    ("[INST]", "&#91;INST]"),
    ("[/INST]", "&#91;/INST]"),
)
UNESCAPES = (("&lt;", "<"), ("&#91;", "["), ("&amp;", "&"))
LEARNT = "assistant"


def _replaced(text: Column, table) -> Column:
    for old, new in table:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escape(text: Column) -> Column:
    return _replaced(text, ESCAPES)


def unescape(text: Column) -> Column:
    return _replaced(text, UNESCAPES)


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, segments and formatted of each conversation in ``turns``.

    ``turns`` has conv_id, turn, role and text, a row per turn; further columns are not looked
    at. Turns are ordered by (turn, role, text), nulls first, so ties have one order and
    repeated rows stay. A null role or text is empty; rows with a null conv_id form one
    conversation. ``segments`` holds the output in pieces (text, loss); those under the loss
    mask are the texts of the assistant, and all together are ``formatted``. No rows, no result.
    """
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))
    t = F.col("turns")
    starts = F.filter(
        F.sequence(F.lit(1), F.size(t)),
        lambda i: (i == 1) | (F.element_at(t, i)["role"] != F.element_at(t, F.greatest(i - 1, F.lit(1)))["role"]),
    )
    s = F.col("starts")
    # Each start with its successor gives a block; the arrays are gone through once.
    blocks = F.transform(
        s,
        lambda at, i: F.struct(
            F.element_at(t, at)["role"].alias("role"),
            F.transform(
                F.slice(t, at, F.coalesce(F.get(s, i + 1), F.size(t) + 1) - at), lambda x: x["text"]
            ).alias("texts"),
        ),
    )

    def part(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def block(b: Column) -> Column:
        inner = F.flatten(
            F.transform(
                b["texts"],
                lambda x, i: F.array(
                    part(F.when(i == 0, F.lit("")).otherwise(F.lit(BETWEEN)), F.lit(False)),
                    part(escape(x), b["role"] == LEARNT),
                ),
            )
        )
        head = part(F.concat(F.lit(OPEN), escape(b["role"]), F.lit(MIDDLE)), F.lit(False))
        return F.concat(F.array(head), inner, F.array(part(F.lit(CLOSE), F.lit(False))))

    return (
        sorted_turns.withColumn("starts", starts)
        .withColumn("blocks", blocks)
        .select("conv_id", F.flatten(F.transform("blocks", block)).alias("segments"))
        .select("conv_id", "segments", F.array_join(F.transform("segments", lambda x: x["text"]), "").alias("formatted"))
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds, in order."""
    ends = F.split(formatted, r"</s>\n", -1)

    def turns(b: Column) -> Column:
        role = F.substring_index(F.substr(b, F.lit(len(OPEN) + 1)), MIDDLE, 1)
        rest = F.substr(b, F.length(role) + len(OPEN) + len(MIDDLE) + 1)
        return F.transform(
            F.split(rest, r"<\|turn\|>", -1), lambda x: F.struct(unescape(role).alias("role"), unescape(x).alias("text"))
        )

    return F.flatten(F.transform(F.slice(ends, 1, F.size(ends) - 1), turns))


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, from the output."""
    lines = F.transform("read", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    learnt = F.transform(F.filter("segments", lambda x: x["loss"]), lambda x: unescape(x["text"]))
    return (
        chats.withColumn("read", read_turns(F.col("formatted")))
        .withColumn("learnt", F.array_join(learnt, ""))
        .select(
            "conv_id",
            F.size("read").cast("long").alias("n_turns"),
            F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
            F.length("learnt").cast("long").alias("loss_chars"),
            F.sha2("learnt", 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )
