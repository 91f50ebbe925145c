"""Column functions on strings. All of them stay in built-in JVM expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from assentlake import fixed

# Whitespace as JSON log writers understand it: Unicode spaces and the byte order mark.
WHITESPACE = (
    "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)
WHITESPACE_CLASS = r"\s\p{Z}\uFEFF"
#: Characters of a piece when a long text is cut to look at many places in it.
CHUNK = 1024


def trim_all(c: Column) -> Column:
    """Trim every kind of Unicode whitespace, not only the space character."""
    return F.btrim(c, F.lit(WHITESPACE))


def non_empty(c: Column) -> Column:
    """NULL for an empty string, so that coalesce() can skip it."""
    return F.nullif(c, F.lit(""))


def strip_fences(c: Column) -> Column:
    """Replace each closed ``` block by one space; an unclosed fence is kept."""
    return F.when(c.contains("```"), F.regexp_replace(c, r"(?s)```.*?```", " ")).otherwise(c)


def at_least_three_characters(c: Column) -> Column:
    """True if three or more characters remain after trimming."""
    solid = f"[^{WHITESPACE_CLASS}]"
    return c.rlike(f"(?s){solid}.+{solid}")


def normalize_model(c: Column, extra_prefixes: Sequence[str] = ()) -> Column:
    """Canonical model name: no vendor path, routing prefix, tag or snapshot date."""
    prefixes = "|".join((*fixed.ROUTING_PREFIXES, *extra_prefixes))
    m = F.lower(trim_all(c))
    m = F.substring_index(m, "/", -1)
    m = F.regexp_replace(m, rf"^(?:{prefixes})-", "")
    m = F.regexp_replace(m, fixed.MODEL_FREE, "")
    m = F.regexp_replace(m, fixed.MODEL_CONTEXT, "$1")
    m = F.regexp_replace(m, fixed.MODEL_DATE, "")
    m = F.regexp_replace(m, fixed.MODEL_SPELLING, "claude-3-$1-")
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(fixed.UNKNOWN_MODEL)).otherwise(trim_all(m))


def chunks(t: Column) -> Column:
    """The text in pieces of CHUNK characters, so that a place in it is found at once."""
    return F.regexp_extract_all(t, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def snippet_in(pieces: Column, size: Column, start: Column, length: Column) -> Column:
    """One-line context of the span at 0-based ``start`` of a text given as its chunks and length."""
    first = F.greatest(start - F.lit(fixed.SNIPPET_BEFORE), F.lit(0))
    last = F.least(start + length + F.lit(fixed.SNIPPET_AFTER), size)
    at = F.floor(first / CHUNK).cast("int")
    near = F.array_join(F.slice(pieces, at + 1, F.floor((last - 1) / CHUNK).cast("int") - at + 1), "")
    body = trim_all(F.regexp_replace(F.substring(near, first % CHUNK + 1, last - first), r"\r?\n+", " "))
    return F.concat(
        F.when(first > 0, "...").otherwise(""), body, F.when(last < size, "...").otherwise("")
    )
