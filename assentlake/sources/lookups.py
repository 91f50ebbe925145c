"""Model lookups: tables that say which model a session ran on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assentlake.functions.text import non_empty
from assentlake.session import staged


def model_lookup(rows: DataFrame) -> DataFrame:
    """(id, model) rows with neither missing; the greatest model wins for a repeated id."""
    return (
        rows.select(F.col("id").cast("string").alias("id"), F.col("model").cast("string").alias("model"))
        .where((non_empty(F.col("id")).isNotNull()) & (non_empty(F.col("model")).isNotNull()))
        .groupBy("id")
        .agg(F.max("model").alias("model"))
    )


def with_model(rows: DataFrame, lookup: DataFrame | None, key: Column, default: str) -> DataFrame:
    """Fill a NULL ``model`` from the lookup by key, else with the default.

    The lookup is staged, so that its real size decides about the join: a small one is
    broadcast and no row moves. A large one is joined by key; rows that have a model look for
    keys of their own that match nothing, so that they stay spread.
    """
    if lookup is None:
        return rows.withColumn("model", F.coalesce("model", F.lit(default)))
    found = staged(lookup.select(F.col("id").alias("_id"), F.col("model").alias("_found")), "lookup")
    own = F.concat(F.lit("\0"), F.xxhash64(*(c for c in rows.columns if c != "text")).cast("string"))
    wanted = F.when(F.col("model").isNull(), key).otherwise(own)
    joined = rows.withColumn("_key", wanted).join(found, F.col("_key") == F.col("_id"), "left")
    return joined.withColumn("model", F.coalesce("model", "_found", F.lit(default))).drop("_key", "_id", "_found")
