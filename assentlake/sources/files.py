"""Log files as rows: discovery, JSON lines and whole JSON documents."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assentlake import fixed
from assentlake.functions.binding import once
from assentlake.functions.variants import JSON_OPTIONS, json_variant
from assentlake.session import first_sign
from assentlake.sources.pieces import SEPARATOR, split_arrays

#: A folder, a pattern of folders as Spark's readers take it, or several of them.
Roots = str | Sequence[str]
#: Bytes up to which a document is read as one row; parsing it takes several times as much.
WHOLE_BYTES = 8 << 20
# What the signs of such a pattern stand for; a sign in brackets means the same in a regex.
PATTERN_SIGNS = {"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")", ",": "|", "[": "[", "]": "]"}


def decoded(path: Column) -> Column:
    """A file URI with its percent escapes resolved; a plus sign stays a plus sign."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def file_stem(path: Column, suffix: str) -> Column:
    """File name without the suffix."""
    name = F.substring_index(path, "/", -1)
    return F.when(name.endswith(suffix), F.left(name, F.length(name) - len(suffix))).otherwise(name)


def parent_name(path: Column) -> Column:
    """Name of the directory that holds the file."""
    return F.substring_index(F.substring_index(path, "/", -2), "/", 1)


def root_list(roots: Roots) -> list[str]:
    """The roots as a list without repetitions."""
    return list(dict.fromkeys([roots] if isinstance(roots, str) else roots))


def _below_root(path: Column, root: str) -> Column:
    """The rest of a path behind its root; NULL for a path elsewhere."""
    marker = root.rstrip("/").split(":", 1)[-1].lstrip("/") + "/"
    if not any(sign in marker for sign in "*?{["):
        at = F.locate(marker, path)
        return F.when(at > 0, F.substring(path, at + len(marker), 1 << 30))
    special = PATTERN_SIGNS if "{" in marker else {k: v for k, v in PATTERN_SIGNS.items() if k != ","}
    pattern = "".join(special.get(c) or re.escape(c) for c in marker)
    return F.nullif(F.regexp_extract(path, f"(?s)/{pattern}(.*)$", 1), F.lit(""))


def selected(
    path: Column,
    root: Roots,
    suffixes: Sequence[str],
    max_depth: int = 5,
    below: Sequence[tuple[str, int]] = (),
    require_any: Sequence[str] = (),
    exclude: Sequence[str] = (),
) -> Column:
    """Which paths below ``root`` a scan takes; with several roots, below any of them.

    ``max_depth`` counts the directories between root and file; ``below`` narrows a scan to
    subfolders, each with a depth of its own. Paths through a pruned directory or with an
    excluded substring are left out; with ``require_any`` a path must hold one of the given
    substrings.
    """
    inside = F.coalesce(*(_below_root(path, r) for r in root_list(root)))
    steps = F.split(inside, "/")
    dirs = F.slice(steps, F.lit(1), F.size(steps) - 1)

    def any_of(tests: Sequence[Column]) -> Column:
        return reduce(or_, tests, F.lit(False))

    def within(folder: str, depth: int) -> Column:
        own = len([step for step in folder.split("/") if step])
        return inside.startswith(f"{folder}/" if folder else "") & (F.size(dirs) - own <= depth)

    keep = any_of([within(folder, depth) for folder, depth in (below or [("", max_depth)])])
    keep = keep & ~F.arrays_overlap(dirs, F.array(*(F.lit(d) for d in fixed.PRUNED_DIRS)))
    keep = keep & any_of([path.endswith(suffix) for suffix in suffixes])
    for part in exclude:
        keep = keep & ~path.contains(part)
    return keep & any_of([path.contains(part) for part in require_any]) if require_any else keep


def _reader(spark: SparkSession, glob: str):
    # Read errors fail the task, which is tried again; no file is cut short silently.
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)


def discover(spark: SparkSession, root: Roots, suffix: str, max_depth: int = 5, **rules) -> DataFrame:
    """Files below ``root`` as (file_path, length). Only listings are read, no content."""
    listed = _reader(spark, "*" + suffix.rsplit("/", 1)[-1]).format("binaryFile").load(root_list(root))
    path = decoded(F.col("path"))
    return listed.where(selected(path, root, [suffix], max_depth, **rules)).select(
        path.alias("file_path"), "length"
    )


def read_lines(
    spark: SparkSession, root: Roots, suffix: str = ".jsonl", max_depth: int = 5, **rules
) -> DataFrame:
    """Lines as (file_path, block_start, pos, value).

    A big file is read in several blocks. ``block_start`` orders the blocks of a file and
    ``pos`` the lines of a block, whatever the number of tasks.
    """
    lines = _reader(spark, "*" + suffix.rsplit("/", 1)[-1]).text(root_list(root))
    path = decoded(F.col("_metadata.file_path"))
    return lines.where(selected(path, root, [suffix], max_depth, **rules)).select(
        path.alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("pos"),
        "value",
    )


def _unsplit_pieces(spark: SparkSession, paths: list[str], extension: str) -> DataFrame:
    """Files as (file_path, value): what stands between their separators, each file in one task."""
    codec = spark._jvm.org.apache.hadoop.io.compress.PassthroughCodec
    # Text with a codec is not split; this codec leaves the bytes as they are.
    reader = spark.read.option("io.compression.codecs", codec.CLASSNAME).option(codec.OPT_EXTENSION, extension)
    literal = [re.sub(r"([*?\[\]{}\\])", r"\\\1", path) for path in paths]
    pieces = reader.option("lineSep", SEPARATOR).text(literal)
    split = F.raise_error("a file that must be read by one task was split").cast("string")
    value = F.when(F.col("_metadata.file_block_start") == 0, F.col("value")).otherwise(split)
    return pieces.select(F.col("_metadata.file_path").alias("file_path"), value.alias("value"))


def read_docs(
    spark: SparkSession, root: Roots, suffix: str = ".json", max_depth: int = 5, **rules
) -> DataFrame:
    """Documents as (file_path, value, first_item).

    A file is one row. Only an array that is too large for that is several: smaller arrays of
    consecutive elements, with the number of elements before in ``first_item``. If any part of it is
    malformed the whole document is left out, as a malformed one of a single row is by ``parse_docs``.
    """
    name = suffix.rsplit("/", 1)[-1]
    uri = F.col("_metadata.file_path")
    path = decoded(uri)
    docs = _reader(spark, "*" + name).format("binaryFile").load(root_list(root))
    docs = docs.where(selected(path, root, [suffix], max_depth, **rules))
    # Only listings are read here, and the first sign of large files.
    listed = docs.where(F.col("length") > WHOLE_BYTES).select(uri, "path").collect() if "." in name else []
    large = {u: p for u, p in listed if first_sign(spark, p) == "["}
    # A test of the URI alone leaves files out before they are opened.
    rows = docs.where(~uri.isin(list(large))) if large else docs
    whole = rows.select(
        path.alias("file_path"), F.col("content").cast("string").alias("value"), F.lit(0).cast("bigint").alias("first_item")
    )
    if not large:
        return whole
    parts = split_arrays(_unsplit_pieces(spark, list(large.values()), "." + name.rsplit(".", 1)[-1]))
    parts = parts.withColumn("value", F.col("value").cast("string"))
    malformed = parts.where(~F.col("sound") | F.json_array_length("value").isNull()).select("file_path")
    # At most the paths of the large files.
    sound = parts.join(F.broadcast(malformed.distinct()), "file_path", "left_anti")
    return whole.unionByName(sound.select(decoded(F.col("file_path")).alias("file_path"), "value", "first_item"))


# The fields of a log document that a format reads. Each value and each element of an array is
# a VARIANT of its own, so that the size of the whole document does not matter.
DOCUMENT = (
    "runId variant, session_id variant, model variant, last_updated variant, timestamp variant,"
    "journal array<variant>, messages array<variant>, history array<variant>,"
    "response struct<model: variant, choices: array<variant>>"
)
HEAD = ("runId", "session_id", "model", "last_updated", "timestamp")


def _lost(value: Column) -> Column:
    """Whether ``doc`` lacks a field or the elements that a sound document has.

    What cannot be held by a VARIANT is NULL; the same read as text is not. Only documents with
    a NULL under a key that they have are read again.
    """
    keys = F.json_object_keys(value)
    paths = [[n] for n in (*HEAD, "journal", "messages", "history")] + [["response", "model"], ["response", "choices"]]
    text = F.from_json(value, DOCUMENT.replace("variant", "string"), JSON_OPTIONS)

    def at(struct: Column, path: list[str]) -> Column:
        return struct[path[0]] if len(path) == 1 else struct[path[0]][path[1]]

    empty = reduce(or_, (F.array_contains(keys, p[0]) & at(F.col("doc.fields"), p).isNull() for p in paths))
    gone = reduce(or_, (at(F.col("doc.fields"), p).isNull() & at(text, p).isNotNull() for p in paths))
    of_object = F.col("doc.fields").isNotNull() & F.when(empty, gone).otherwise(False)
    of_array = F.col("doc.fields").isNull() & F.col("doc.items").isNull() & F.json_array_length(value).isNotNull()
    return F.coalesce(of_object, F.lit(False)) | F.coalesce(of_array, F.lit(False))


def parse_lines(raw: DataFrame) -> DataFrame:
    """Replace ``value`` by the record ``v``; blank and malformed lines are dropped."""
    return once(raw, "v", json_variant(F.col("value"))).drop("value").where(F.col("v").isNotNull())


def parse_docs(raw: DataFrame) -> DataFrame:
    """Replace ``value`` by ``doc``, the fields or elements, and ``v``, an object of the head fields.

    Malformed documents, and those that are neither object nor array, are dropped. A field or
    element of a sound document that no VARIANT can hold is an error: it must not vanish silently.
    """
    value = F.col("value")
    fields = F.from_json(F.when(F.json_object_keys(value).isNotNull(), value), DOCUMENT, JSON_OPTIONS)
    items = F.from_json(F.when(F.json_array_length(value).isNotNull(), value), "array<variant>", JSON_OPTIONS)
    docs = once(raw, "doc", F.struct(fields.alias("fields"), items.alias("items")))
    too_large = F.raise_error("a field or element of a document is too large for a VARIANT").cast("boolean")
    docs = docs.where(F.when(_lost(value), too_large).otherwise(True)).drop("value")
    head = F.struct(
        *(F.col(f"doc.fields.{n}").alias(n) for n in HEAD),
        F.struct(F.col("doc.fields.response.model").alias("model")).alias("response"),
    )
    return docs.where("doc.fields is not null or doc.items is not null").withColumn("v", F.to_variant_object(head))


def doc_elements(*paths: str) -> Column:
    """The elements of the first path of a parsed document that holds an array."""
    return F.coalesce(*(F.col("doc.items" if p == "$" else "doc.fields" + p[1:]) for p in paths))
