"""The phrase lexicon: text lines to entries, and the matcher built from them."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assentlake import fixed
from assentlake.functions.text import WHITESPACE_CLASS, non_empty, trim_all
from assentlake.operators.ranking import with_rank

SHIPPED = Path(__file__).resolve().parent.parent / "data" / "lexicon.txt"

# A word boundary that knows ASCII words only: a Chinese character right after "right"
# ends the word. The engine's own \b counts Chinese characters as word characters.
ASCII_BOUNDARY = (
    r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
)

# A lexicon is a configuration file: beyond this many entries it is not one.
MAX_ENTRIES = 20_000


def lexicon_lines(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Lines of a lexicon file (the shipped one by default) as (line_no, value)."""
    if path is None:
        rows = list(enumerate(SHIPPED.read_text(encoding="utf-8").split("\n"), start=1))
        return spark.createDataFrame(rows, "line_no bigint, value string")
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\n")).alias("pos", "value")).select(
        (F.col("pos") + 1).cast("bigint").alias("line_no"), "value"
    )


def _java_pattern(phrase: Column, is_regex: Column) -> Column:
    quoted = F.regexp_replace(phrase, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    boundary = F.lit(ASCII_BOUNDARY)
    literal = F.when(phrase.rlike("^[a-zA-Z]"), F.concat(boundary, quoted, boundary)).otherwise(quoted)
    # \s stands for Unicode whitespace, first inside a character class, then outside one.
    spaced = F.regexp_replace(
        phrase, r"(?<!\\)\\s(?=[^\[\]]*\])", WHITESPACE_CLASS.replace("\\", "\\\\")
    )
    spaced = F.regexp_replace(
        spaced, r"(?<!\\)\\s(?![^\[\]]*\])", "[" + WHITESPACE_CLASS.replace("\\", "\\\\") + "]"
    )
    spaced = F.regexp_replace(spaced, r"(?<!\\)\\b", ASCII_BOUNDARY.replace("\\", "\\\\").replace("$", "\\$"))
    return F.concat(F.lit("(?iu)"), F.when(is_regex, spaced).otherwise(literal))


def load_lexicon(lines: DataFrame) -> DataFrame:
    """Entries (rank, phrase, category, is_regex, pattern) of lexicon lines.

    Longer phrases rank first, equal lengths keep the order of the file. Comments, blank
    lines, lines without a category mark and patterns that match nothing at all are dropped.
    """
    text = trim_all(F.col("value"))
    tail = F.substring_index("text", "|", -1)
    head = trim_all(F.left(F.col("text"), F.length("text") - F.length(tail) - 1))
    entries = (
        lines.select("line_no", text.alias("text"))
        .where((F.col("text") != "") & ~F.col("text").startswith("#") & F.col("text").contains("|"))
        .select(
            "line_no",
            head.alias("entry"),
            F.coalesce(non_empty(trim_all(tail)), F.lit(fixed.DEFAULT_CATEGORY)).alias("category"),
        )
        .where(F.col("entry") != "")
        .withColumn("is_regex", F.col("entry").startswith("regex:"))
        .withColumn(
            "phrase", F.when(F.col("is_regex"), F.substr("entry", F.lit(7))).otherwise(F.col("entry"))
        )
        .withColumn("pattern", _java_pattern(F.col("phrase"), F.col("is_regex")))
        .where(~F.expr("'' rlike pattern"))
    )
    ranked = with_rank(entries, F.length("phrase").desc(), F.col("line_no"))
    return ranked.select(F.col("rank").cast("int"), "phrase", "category", "is_regex", "pattern")


def _fold(text: str) -> str:
    return text.lower()


def needle_of(phrase: str, is_regex: bool) -> str:
    """Lower-case text that every match of the entry contains; '' if none is known."""
    if not is_regex:
        return _fold(phrase)
    outside_groups = re.sub(r"\\.|\([^()]*\)", "", phrase)
    if "|" in outside_groups:
        return ""
    plain = re.match(r"[^\\\[\](){}.*+?^$|]*", phrase).group()
    if phrase[len(plain):len(plain) + 1] in ("*", "?", "{"):
        plain = plain[:-1]
    return _fold(plain)


def _prefix_tree(words: Sequence[str]) -> str:
    """A regex for the words, with shared prefixes written once."""
    by_first: dict[str, list[str]] = {}
    for word in words:
        by_first.setdefault(word[:1], []).append(word[1:])
    if "" in by_first:
        return ""
    parts = [re.escape(first) + _prefix_tree(rest) for first, rest in by_first.items()]
    return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"


@dataclass(frozen=True)
class Entry:
    rank: int
    phrase: str
    category: str
    is_regex: bool
    pattern: str


@dataclass(frozen=True)
class Matcher:
    """A lexicon in the form the detection expressions need: literals of the query plan."""

    entries: tuple[Entry, ...]

    @classmethod
    def of(cls, lexicon: DataFrame) -> Matcher:
        rows = lexicon.limit(MAX_ENTRIES + 1).collect()
        if len(rows) > MAX_ENTRIES:
            raise ValueError(f"a lexicon may hold {MAX_ENTRIES} entries at most")
        entries = (Entry(r["rank"], r.phrase, r.category, r.is_regex, r.pattern) for r in rows)
        return cls(tuple(sorted(entries, key=lambda e: e.rank)))

    @classmethod
    def shipped(cls, spark: SparkSession) -> Matcher:
        global _shipped
        if _shipped is None:
            _shipped = cls.of(load_lexicon(lexicon_lines(spark)))
        return _shipped

    @cached_property
    def gate(self) -> str:
        """One regex that finds something in every text in which any entry matches."""
        needles = [needle_of(e.phrase, e.is_regex) for e in self.entries]
        words: list[str] = []
        for word in sorted({n for n in needles if n}, key=lambda n: (len(n), n)):
            if not any(known in word for known in words):
                words.append(word)
        parts = [e.pattern for e, n in zip(self.entries, needles) if not n]
        if words:
            parts.append("(?iu)" + _prefix_tree(words))
        return "|".join(f"(?:{p})" for p in parts) or r"(?!)"

    @cached_property
    def keywords(self) -> tuple[str, ...]:
        """A few short lower-case words, one of which is in every text that can match.

        Plain substring search is many times faster than a regex, so these words stand
        before the gate. Empty if some entry has no required text.
        """
        needles = {needle_of(e.phrase, e.is_regex) for e in self.entries}
        if not needles or "" in needles:
            return ()

        def windows(needle: str) -> set[str]:
            size = min(len(needle), 5 if needle.isascii() else 2)
            return {needle[i:i + size] for i in range(len(needle) - size + 1)}

        covers: dict[str, set[str]] = {}
        for needle in needles:
            for word in windows(needle):
                covers.setdefault(word, set()).add(needle)
        chosen: list[str] = []
        while needles:
            best = max(covers, key=lambda w: (len(covers[w] & needles), w))
            chosen.append(best)
            needles -= covers[best]
        return tuple(chosen)

    @cached_property
    def literal(self) -> Column:
        """The entries as one constant array, in rank order."""
        schema = (
            "array<struct<rank:int,phrase:string,category:string,pattern:string,"
            "needle:string,shows_match:boolean>>"
        )
        rows = [
            {
                "rank": e.rank,
                "phrase": e.phrase,
                "category": e.category,
                "pattern": e.pattern,
                "needle": needle_of(e.phrase, e.is_regex),
                "shows_match": any(mark in e.phrase for mark in "[.?"),
            }
            for e in self.entries
        ]
        return F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)), schema)


_shipped: Matcher | None = None
