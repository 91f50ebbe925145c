"""Rollups of messages and hits.

``counted`` is the messages table with n_hits and norm_model; ``hits`` has one row per hit.
Both come from one projection per message, so a rollup needs one pass and one shuffle of
partial sums.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from assentlake import fixed
from assentlake.functions.scores import classify_level, per_hundred, per_thousand
from assentlake.functions.text import normalize_model
from assentlake.operators.detect import detect, with_hit_count
from assentlake.sources.lexicon import Matcher


def count_hits(messages: DataFrame, matcher: Matcher) -> DataFrame:
    return with_hit_count(messages, matcher).withColumn("norm_model", normalize_model(F.col("model")))


def find_hits(messages: DataFrame, matcher: Matcher) -> DataFrame:
    return detect(messages, matcher).withColumn("norm_model", normalize_model(F.col("model")))


def model_messages(messages: DataFrame) -> DataFrame:
    return messages.groupBy(normalize_model(F.col("model")).alias("model")).agg(
        F.count("*").alias("messages")
    )


def model_hits(hits: DataFrame) -> DataFrame:
    return hits.groupBy(F.col("norm_model").alias("model")).agg(F.count("*").alias("hits"))


def model_harnesses(messages: DataFrame) -> DataFrame:
    """Agents per model, sorted. There are eleven agents, so the sets stay small."""
    return messages.groupBy(normalize_model(F.col("model")).alias("model")).agg(
        F.array_sort(F.collect_set("harness")).alias("harnesses")
    )


def join_matches_left(messages_by_model: DataFrame, hits_by_model: DataFrame) -> DataFrame:
    """Models without any hit keep a row with zero hits."""
    return messages_by_model.join(hits_by_model, "model", "left").withColumn(
        "hits", F.coalesce("hits", F.lit(0))
    )


def model_counts(counted: DataFrame) -> DataFrame:
    """Messages and hits per model in one pass, with rates and level."""
    by_model = counted.groupBy(F.col("norm_model").alias("model")).agg(
        F.count("*").alias("messages"), F.sum("n_hits").alias("hits")
    )
    return with_rates(by_model)


def with_rates(counts: DataFrame) -> DataFrame:
    """Add rate (per cent), mdi (per thousand) and level to rows with hits and messages."""
    hits, messages = F.col("hits"), F.col("messages")
    return (
        counts.withColumn("rate", per_hundred(hits, messages))
        .withColumn("mdi", per_thousand(hits, messages))
        .withColumn("level", classify_level(F.col("mdi")))
    )


def sessions(messages: DataFrame) -> DataFrame:
    """Distinct session ids over all agents together."""
    return messages.agg(F.count_distinct("session_id").alias("sessions"))


def daily(counted: DataFrame) -> DataFrame:
    """Hits per calendar day of the session time zone; messages without a day are left out."""
    return (
        counted.where((F.col("n_hits") > 0) & F.col("ts").isNotNull())
        .groupBy(F.to_date("ts").alias("day"))
        .agg(F.sum("n_hits").alias("hits"))
    )


def phrases(hits: DataFrame) -> DataFrame:
    """Count and category of every phrase; the longest entry names the category."""
    return hits.groupBy("phrase").agg(
        F.count("*").alias("hits"),
        F.min(F.struct("rank", "category")).getField("category").alias("category"),
    )


def harness_dim(spark: SparkSession) -> DataFrame:
    rows = [(h, name) for h, name in fixed.HARNESS_NAMES.items()]
    return spark.createDataFrame(rows, "harness string, name string")


def harness_stats(counted: DataFrame) -> DataFrame:
    """Messages, hits and mdi per agent; agents without messages appear with zeros.

    An agent outside the fixed list counts too and is named by its key.
    """
    by_harness = counted.groupBy("harness").agg(
        F.count("*").alias("messages"), F.sum("n_hits").alias("hits")
    )
    return (
        harness_dim(counted.sparkSession)
        .join(by_harness, "harness", "full")
        .withColumn("name", F.coalesce("name", "harness"))
        .withColumn("messages", F.coalesce("messages", F.lit(0)))
        .withColumn("hits", F.coalesce("hits", F.lit(0)))
        .withColumn("mdi", per_thousand(F.col("hits"), F.col("messages")))
    )


def totals(counted: DataFrame) -> DataFrame:
    return with_rates(
        counted.agg(
            F.count("*").alias("messages"), F.coalesce(F.sum("n_hits"), F.lit(0)).alias("hits")
        )
    )


def active_harnesses(configured: DataFrame) -> DataFrame:
    """Number of configured sources, those without any message included."""
    return configured.agg(F.count_distinct("harness").alias("active"))


def corpus_stats(messages: DataFrame, matcher: Matcher) -> DataFrame:
    sized = messages.select("text", F.length("text").alias("size"))
    return with_hit_count(sized, matcher).agg(
        F.count("*").alias("messages"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("characters"),
        F.coalesce(F.sum("n_hits"), F.lit(0)).alias("hits"),
    )


@dataclass(frozen=True)
class Partial:
    """A saved rollup: sums by key, and for every distinct count a child table (key, element).

    Elements are rows, not arrays in a row, so a key may have any number of them.
    """

    counts: DataFrame
    members: dict[str, DataFrame]


def merge_partials(parts: Sequence[Partial], keys: Sequence[str], sums: Sequence[str]) -> Partial:
    """Combine saved rollups of several runs: sums add up, elements are united."""
    counts = reduce(DataFrame.unionByName, (p.counts for p in parts))
    names = dict.fromkeys(name for p in parts for name in p.members)
    return Partial(
        counts.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums)),
        {n: reduce(DataFrame.unionByName, (p.members[n] for p in parts if n in p.members)).distinct() for n in names},
    )


def with_distinct(partial: Partial, keys: Sequence[str], name: str) -> DataFrame:
    """The sums and, as ``name``, the exact number of distinct elements of that child table."""
    sizes = partial.members[name].groupBy(*keys).agg(F.count("*").alias(name))
    return partial.counts.join(sizes, list(keys), "left").withColumn(name, F.coalesce(name, F.lit(0)))
