"""Submissions to leaderboard tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from assentlake.operators.payloads import (
    HARNESSES,
    MODELS,
    documents,
    explode_entries,
    listed_entries,
    payload_json,
    sanitize,
)
from assentlake.session import staged

USER_COLUMNS = ("user_id", "login", "display_name", "avatar_url", "profile_url")


@dataclass
class Tables:
    """The four leaderboard tables, plus the submissions that were turned away."""

    entries: DataFrame
    submissions: DataFrame
    models: DataFrame
    harnesses: DataFrame
    rejected: DataFrame | None = None


def latest_entries(accepted: DataFrame) -> DataFrame:
    """Entry rows of a batch: the last received submission of each user.

    Time of receipt decides, never the time a client claims.
    """
    newest = Window.partitionBy("user_id").orderBy(
        F.col("created_at").desc(), F.col("submission_id").desc()
    )
    return (
        accepted.withColumn("_n", F.row_number().over(newest))
        .where(F.col("_n") == 1)
        .select(
            *[c for c in USER_COLUMNS if c in accepted.columns],
            "hits",
            "messages",
            "mdi",
            "sessions_scanned",
            "model_count",
            "version",
            "generated_at",
            F.col("created_at").alias("updated_at"),
        )
    )


def newest_entries(changes: DataFrame, version: str) -> DataFrame:
    """Of each user the entry received last; among equal times the one of the highest ``version``."""
    newest = Window.partitionBy("user_id").orderBy(F.col("updated_at").desc(), F.col(version).desc())
    return changes.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") == 1).drop("_n", version)


def upsert_entries(old: DataFrame, new: DataFrame) -> DataFrame:
    """Replace a user's entry by a newer one; a batch that arrives late changes nothing."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return newest_entries(both, "_new")


def apply_submissions(raw: DataFrame, old: Tables | None = None, stage: bool = False) -> Tables:
    """Parse raw submissions (submission_id, user columns, created_at, payload_json).

    Without ``old`` the tables hold this batch only. With ``stage`` the parsed submissions
    are written once, for the tables that all read them: their clean columns, and the texts of
    those that were turned away. The rows they list are read from these.
    """
    parsed = sanitize(documents(raw).withColumn("accepted", F.col("v").isNotNull()), keep=not stage)
    listed = explode_entries
    if stage:
        rejected = F.when(~F.col("accepted"), F.col("payload_json"))
        parsed = staged(parsed.withColumn("payload_json", rejected), "submissions")
        listed = listed_entries
    accepted = parsed.where("accepted").withColumn("payload_json", payload_json())
    entries = latest_entries(accepted)
    history = accepted.select(
        "submission_id",
        "user_id",
        "hits",
        "messages",
        "mdi",
        "sessions_scanned",
        "model_count",
        "version",
        "generated_at",
        "payload_json",
        "created_at",
    )
    batch = Tables(
        entries=entries,
        submissions=history,
        models=listed(parsed, MODELS),
        harnesses=listed(parsed, HARNESSES),
        rejected=parsed.where(~F.col("accepted")).select(*raw.columns),
    )
    if old is None:
        return batch
    return Tables(
        entries=upsert_entries(old.entries, batch.entries),
        submissions=old.submissions.unionByName(batch.submissions),
        models=old.models.unionByName(batch.models),
        harnesses=old.harnesses.unionByName(batch.harnesses),
        rejected=batch.rejected,
    )
