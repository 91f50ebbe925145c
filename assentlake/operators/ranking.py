"""Orders, top lists, views and the fair quote sample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from assentlake import fixed
from assentlake.session import staged

# Groups are cut into this many slices before the per-group top rows are taken, so that a
# phrase with a third of all hits is not sorted by one task.
SLICES = 64


def with_rank(rows: DataFrame, *order: Column) -> DataFrame:
    """Add ``rank``, the 1-based position in the given total order.

    A window without a partition would sort everything in one task. Here the rows are
    sorted by ranges, written with their place inside the range, and the sizes of the
    ranges before it are added.
    """
    placed = rows.orderBy(*order).select(
        "*",
        F.spark_partition_id().alias("_range"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"),
    )
    fixed_places = staged(placed, "ranks")
    sizes = fixed_places.groupBy("_range").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    return (
        # One row per range: as many as the sort had partitions.
        fixed_places.join(F.broadcast(offsets), "_range")
        .withColumn("rank", F.col("_before") + F.col("_place") + 1)
        .drop("_range", "_place", "_before")
    )


def model_order() -> Sequence[Column]:
    return (F.col("hits").desc(), F.col("mdi").desc(), F.col("model").asc())


def phrase_order() -> Sequence[Column]:
    return (F.col("hits").desc(), F.col("phrase").asc())


def rank_models(counts: DataFrame) -> DataFrame:
    return with_rank(counts, *model_order())


def top_models(counts: DataFrame, k: int = 5) -> DataFrame:
    return counts.orderBy(*model_order()).limit(k)


def top_phrases(phrase_counts: DataFrame, k: int = 5) -> DataFrame:
    return phrase_counts.orderBy(*phrase_order()).limit(k)


def top_phrases_per_model(hits: DataFrame, k: int = fixed.TOP_PHRASES) -> DataFrame:
    """(model, top) with the k most frequent phrases as an array of structs."""
    counted = hits.groupBy(F.col("norm_model").alias("model"), "phrase").agg(F.count("*").alias("count"))
    best = Window.partitionBy("model").orderBy(F.col("count").desc(), F.col("phrase").asc())
    kept = counted.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
    rows = F.array_sort(F.collect_list(F.struct("place", "phrase", "count")))
    return kept.groupBy("model").agg(
        F.transform(rows, lambda r: F.struct(r["phrase"], r["count"])).alias("top")
    )


def ranking_view(
    ranking: DataFrame,
    tier: str = "all",
    search: str = "",
    sort: str = "rank",
    descending: bool = True,
) -> DataFrame:
    """Filtered and sorted ranking table, as a reader of the report would narrow it."""
    out = ranking
    if tier == "high":
        out = out.where(F.col("mdi") > fixed.HIGH_TIER_MDI)
    elif tier == "low":
        out = out.where(F.col("mdi") <= fixed.HIGH_TIER_MDI)
    wanted = search.strip().lower()
    if wanted:
        out = out.where(F.lower("model").contains(wanted))
    key = {"rank": "rank", "count": "hits", "total": "messages", "rate": "rate", "mdi": "mdi"}[sort]
    first = F.col(key).desc() if descending else F.col(key).asc()
    return out.orderBy(first, F.col("rank").asc())


def relative_share(rows: DataFrame, value: str = "mdi") -> DataFrame:
    """Add ``share``: the value in per cent of the greatest one, which counts as 1 at least."""
    top = rows.agg(F.greatest(F.coalesce(F.max(value), F.lit(1.0)), F.lit(1.0)).alias("_top"))
    percent = F.floor(F.col(value) / F.col("_top") * F.lit(100.0) + F.lit(0.5))
    # A single row.
    return (
        rows.crossJoin(F.broadcast(top))
        .withColumn("share", F.least(F.lit(100), percent).cast("int"))
        .drop("_top")
    )


def quote_order() -> Sequence[Column]:
    return (
        F.col("ts").desc_nulls_last(),
        F.col("harness").asc(),
        F.col("session_id").asc(),
        F.col("model").asc(),
        F.col("snippet").asc(),
    )


def quotes_round_robin(
    hits: DataFrame, lo: int = fixed.QUOTES_MIN, hi: int = fixed.QUOTES_MAX
) -> DataFrame:
    """A fair sample of quotes: the newest hit of every phrase, then the second newest, ...

    Phrases take turns in the order of their frequency. The sample has as many quotes as
    there are phrases, but ``lo`` at least and ``hi`` at most. ``hits`` is read twice.
    """
    counts = hits.groupBy("phrase").agg(F.count("*").alias("hits"))
    # No more than ``hi`` phrases can get a turn: a bounded side for the joins below.
    turns = F.broadcast(counts.orderBy(*phrase_order()).limit(hi).withColumnRenamed("hits", "phrase_hits"))
    size = counts.agg(
        F.least(F.lit(hi), F.greatest(F.lit(lo), F.count("*").cast("int"))).alias("size")
    )

    slice_no = F.pmod(F.xxhash64("session_id", "ts", "snippet"), F.lit(SLICES))
    per_slice = Window.partitionBy("phrase", "slice").orderBy(*quote_order())
    per_phrase = Window.partitionBy("phrase").orderBy(*quote_order())
    newest = (
        hits.join(turns, "phrase")
        .withColumn("slice", slice_no)
        .withColumn("round", F.row_number().over(per_slice))
        .where(F.col("round") <= hi)
        .withColumn("round", F.row_number().over(per_phrase))
        .where(F.col("round") <= hi)
    )
    turn = (F.col("round").asc(), F.col("phrase_hits").desc(), F.col("phrase").asc())
    # At most ``hi`` rows reach this window.
    sample = newest.orderBy(*turn).limit(hi).withColumn("place", F.row_number().over(Window.orderBy(*turn)))
    return (
        sample.crossJoin(F.broadcast(size))
        .where(F.col("place") <= F.col("size"))
        .drop("slice", "size", "phrase_hits")
    )


def quotes_by_phrase(quotes: DataFrame, phrase: str) -> DataFrame:
    return quotes.where(F.lower("phrase").contains(phrase.lower()))
