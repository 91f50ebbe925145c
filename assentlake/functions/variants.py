"""Column functions on VARIANT values: the untyped edge of the session logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from assentlake.functions.text import non_empty, trim_all

# The parser's own bound on a string, 20 MB, would turn sound records into NULL; the rest keeps
# it to plain JSON.
JSON_OPTIONS = {
    "maxStringLen": "2147483647",
    "allowSingleQuotes": "false",
    "allowNonNumericNumbers": "false",
}


def json_variant(value: Column) -> Column:
    """The JSON text as a VARIANT, NULL if malformed. The last of repeated keys counts.

    Records of every size are read alike, up to the 128 MB that a VARIANT can hold. A sound
    object beyond that is an error: it must not vanish silently.
    """
    record = F.from_json(value, "variant", JSON_OPTIONS)
    check = F.from_json(value, "bad string", {**JSON_OPTIONS, "columnNameOfCorruptRecord": "bad"})
    sound = F.ltrim(value, F.lit("\t\n\r ")).startswith("{") & check["bad"].isNull()
    return F.coalesce(record, F.when(sound, F.raise_error("a record is too large for a VARIANT").cast("variant")))


def child(v: Column | str, path: str) -> Column:
    """The value at the path; NULL if it is missing or a JSON null."""
    sub = F.try_variant_get(v, path, "variant")
    return F.when(~F.is_variant_null(sub), sub)


def has_kind(v: Column | str, kind: str) -> Column:
    """True if the variant is of the kind: STRING, ARRAY or OBJECT."""
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def string_at(v: Column | str, path: str) -> Column:
    """The value at the path if it really is a JSON string, else NULL."""
    sub = child(v, path)
    return F.when(F.schema_of_variant(sub) == "STRING", F.try_variant_get(v, path, "string"))


def text_at(v: Column | str, *paths: str) -> Column:
    """First non-empty scalar among the paths."""
    return F.coalesce(*(non_empty(F.try_variant_get(v, p, "string")) for p in paths))


def array_at(v: Column | str, path: str) -> Column:
    """The elements at the path; NULL if the value there is no array."""
    return F.try_variant_get(v, path, "array<variant>")


def flatten_content(content: Column, block_types: Sequence[str], any_content: bool = False) -> Column:
    """Message text of a string or of an array of strings and typed blocks, trimmed.

    ``block_types`` names the blocks whose ``text`` counts. With ``any_content`` other
    blocks give their ``content`` if it is a string.
    """
    def block_text(b: Column) -> Column:
        allowed = F.coalesce(F.try_variant_get(b, "$.type", "string").isin(*block_types), F.lit(False))
        named = F.when(allowed, string_at(b, "$.text"))
        if any_content:
            named = F.coalesce(named, string_at(b, "$.content"))
        return F.coalesce(named, F.when(F.schema_of_variant(b) == "STRING", b.cast("string")))

    joined = F.array_join(F.transform(array_at(content, "$"), block_text), " ")
    kind = F.schema_of_variant(content)
    return trim_all(
        F.when(kind == "STRING", content.cast("string"))
        .when(kind.startswith("ARRAY"), joined)
        .otherwise(F.lit(""))
    )


def parse_ts(v: Column | str, paths: Sequence[str], run_ts: Column) -> Column:
    """First usable timestamp among the paths, as epoch milliseconds or ISO text.

    A missing, empty or zero value gives ``run_ts``; text that is no timestamp gives NULL,
    so that the message still counts but belongs to no day.
    """
    raw = F.coalesce(
        *(F.nullif(non_empty(F.try_variant_get(v, p, "string")), F.lit("0")) for p in paths)
    )
    millis = F.coalesce(
        *(F.nullif(F.try_variant_get(v, p, "bigint"), F.lit(0).cast("bigint")) for p in paths)
    )
    is_number = raw.rlike(r"^-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?\z") & millis.isNotNull()
    return (
        F.when(raw.isNull(), run_ts)
        .when(is_number, F.timestamp_millis(millis))
        .otherwise(F.try_to_timestamp(raw))
    )
