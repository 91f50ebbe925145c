"""Phrase detection: messages to hits, without a shuffle.

Every step is a projection of one message. A cheap regex over the required words of all
entries stops almost every message; the few that pass are tried against the entries
whose required word they hold.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from assentlake.functions.arrays import leading, running
from assentlake.functions.binding import bind, once
from assentlake.functions.text import at_least_three_characters, chunks, snippet_in, strip_fences
from assentlake.sources.lexicon import Matcher


def prepare_text(messages: DataFrame) -> DataFrame:
    """Add ``t``, the text that is searched: fenced blocks are cut out."""
    return messages.withColumn("t", strip_fences(F.col("text")))


def _any_of(text: Column, words: Sequence[str]) -> Column:
    return reduce(or_, (text.contains(w) for w in words), F.lit(False))


def may_match(matcher: Matcher) -> Column:
    """True for every message with a hit, and for few others.

    The exists() over a one-element array binds a value once, so that fences are cut and
    case is folded a single time per message although several tests look at the result.
    """
    plain = [w for w in matcher.keywords if w.isascii()]
    wide = [w for w in matcher.keywords if not w.isascii()]

    def has_keyword(t: Column) -> Column:
        if not matcher.keywords:
            return F.lit(True)
        has_wide = (F.octet_length(t) > F.length(t)) & _any_of(t, wide)
        return has_wide | F.exists(F.array(F.lower(t)), lambda low: _any_of(low, plain))

    def test(t: Column) -> Column:
        return has_keyword(t) & t.rlike(matcher.gate) & at_least_three_characters(t)

    return (F.length("text") >= 3) & F.exists(F.array(F.col("t")), test)


def _occurrences(t: Column, entry: Column) -> Column:
    """Each match of one entry, left to right, as spans with 0-based starts."""

    def spans(found: Column, starts: Column) -> Column:
        return F.transform(
            found,
            lambda text, i: F.struct(
                F.get(starts, i).alias("start"),
                F.length(text).alias("length"),
                entry["rank"].alias("rank"),
                F.when(entry["shows_match"], text).otherwise(entry["phrase"]).alias("phrase"),
                entry["category"].alias("category"),
            ),
        )

    def located(found: Column, pieces: Column) -> Column:
        # From one start to the next: the match, and the piece up to the next match.
        steps = F.transform(
            found, lambda _, i: F.length(F.get(pieces, i)) + F.coalesce(F.length(F.get(found, i - 1)), F.lit(0))
        )
        return bind(running(steps, lambda a, b: a + b), lambda starts: spans(found, starts))

    return bind(
        F.regexp_extract_all(t, entry["pattern"], F.lit(0)),
        lambda found: bind(F.split(t, entry["pattern"], -1), lambda pieces: located(found, pieces)),
    )


def candidates(matcher: Matcher) -> Column:
    """All matches of all entries in ``t``, overlaps included."""
    t = F.col("t")
    # Case is folded once per message, not once per entry.
    likely = F.flatten(
        F.transform(
            F.array(F.lower(t)),
            lambda low: F.filter(matcher.literal, lambda e: low.contains(e["needle"])),
        )
    )
    return F.flatten(F.transform(likely, lambda e: _occurrences(t, e)))


def _end(span: Column) -> Column:
    return span["start"] + span["length"]


def _clusters(ordered: Column) -> Column:
    """Spans in the order of their starts, cut where one begins after all before it have ended."""

    def cut(ends: Column) -> Column:
        heads = F.filter(
            F.sequence(F.lit(0), F.size(ordered) - 1),
            lambda i: (i == 0) | (F.get(ordered, i)["start"] >= F.get(ends, i - 1)),
        )
        return bind(
            heads,
            lambda at: F.transform(
                at, lambda h, k: F.slice(ordered, h + 1, F.coalesce(F.get(at, k + 1), F.size(ordered)) - h)
            ),
        )

    return bind(running(F.transform(ordered, _end), F.greatest), cut)


def _by_rank(cluster: Column) -> Column:
    """The rank rule in one cluster: entry by entry, what overlaps nothing kept before is kept.

    Matches of one entry do not overlap each other, so they are judged together. What is kept
    stays in order and free of overlaps: only the last one that begins before a span ends can
    overlap it.
    """

    def clear(kept: Column, s: Column) -> Column:
        before = leading(kept, lambda k: k["start"] < _end(s))
        return (before == 0) | (_end(F.get(kept, before - 1)) <= s["start"])

    def add(kept: Column, rank: Column) -> Column:
        fresh = F.filter(cluster, lambda s: (s["rank"] == rank) & clear(kept, s))
        return F.array_sort(F.concat(kept, fresh))

    ranks = F.array_sort(F.array_distinct(F.transform(cluster, lambda s: s["rank"])))
    return F.aggregate(ranks, F.slice(cluster, 1, 0), add)


def resolve_overlaps(spans: Column) -> Column:
    """Keep a span only if it overlaps none of an earlier rank that is kept; ordered by start.

    Spans can only meet inside a cluster of overlapping ones, and nearly all clusters are single
    spans, so the time grows with the number of spans (and, sorting them, its logarithm).
    """

    def kept(ordered: Column) -> Column:
        return F.flatten(F.transform(_clusters(ordered), lambda c: F.when(F.size(c) == 1, c).otherwise(_by_rank(c))))

    return bind(F.array_sort(spans), lambda ordered: F.when(F.size(ordered) > 1, kept(ordered)).otherwise(ordered))


def _unnest(spanned: DataFrame) -> DataFrame:
    # Without the texts, which would be copied for each hit. The outer form on purpose: for the
    # inner one the optimizer adds a test on the size of the array below this point and so
    # computes every array twice.
    slim = spanned.drop("text", "t")
    return slim.select("*", F.inline_outer("spans")).drop("spans").where(F.col("rank").isNotNull())


def match_candidates(messages: DataFrame, matcher: Matcher) -> DataFrame:
    """One row per occurrence of a lexicon entry, before overlaps are resolved."""
    tried = prepare_text(messages).where(may_match(matcher))
    return _unnest(tried.withColumn("spans", candidates(matcher)))


def with_spans(messages: DataFrame, matcher: Matcher) -> DataFrame:
    """Add ``spans``, the accepted hits of each message; every message stays."""
    spans = F.when(may_match(matcher), resolve_overlaps(candidates(matcher)))
    return once(prepare_text(messages), "spans", spans)


def with_hit_count(messages: DataFrame, matcher: Matcher) -> DataFrame:
    """Add ``n_hits``; text columns are dropped."""
    spanned = with_spans(messages, matcher)
    return spanned.withColumn("n_hits", F.coalesce(F.size("spans"), F.lit(0))).drop("text", "t", "spans")


def with_snippets(t: Column, spans: Column) -> Column:
    """The spans with the text around each; the text is cut into pieces once, and not copied."""
    return bind(
        F.struct(chunks(t).alias("pieces"), F.length(t).alias("size")),
        lambda cut: F.transform(
            spans,
            lambda s: F.struct(
                s["rank"].alias("rank"),
                s["phrase"].alias("phrase"),
                s["category"].alias("category"),
                s["start"].alias("start"),
                s["length"].alias("length"),
                snippet_in(cut["pieces"], cut["size"], s["start"], s["length"]).alias("snippet"),
            ),
        ),
    )


def detect(messages: DataFrame, matcher: Matcher) -> DataFrame:
    """The hits: message columns plus rank, phrase, category, start, length and snippet."""
    tried = prepare_text(messages).where(may_match(matcher))
    spans = bind(resolve_overlaps(candidates(matcher)), lambda kept: with_snippets(F.col("t"), kept))
    return _unnest(tried.withColumn("spans", spans))


def message_hits(messages: DataFrame, matcher: Matcher) -> DataFrame:
    """Hits per message and whether there is any."""
    counted = with_hit_count(messages.select("msg_id", "text"), matcher)
    return counted.withColumn("matched", (F.col("n_hits") > 0).cast("int"))
